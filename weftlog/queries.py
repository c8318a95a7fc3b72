"""Queries over the star log, one for each operator, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import Log
from .plans.engine import evaluate
from .sources.tables import star_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PRELUDE = """
WITH ev AS (
  SELECT 'po-' || o_orderkey AS ev_id, 'place order' AS ev_type, CAST(o_orderdate AS TIMESTAMP) AS ev_time FROM orders
  UNION ALL SELECT 'si-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d'), 'ship item', CAST(l_shipdate AS TIMESTAMP) FROM lineitem
  UNION ALL SELECT 'we-' || event_id, event_type, CAST(ts AS TIMESTAMP) FROM events),
ob AS (
  SELECT 'c-' || c_custkey AS ob_id, 'customer' AS ob_type FROM customer
  UNION ALL SELECT 'o-' || o_orderkey, 'order' FROM orders
  UNION ALL SELECT 'p-' || p_partkey, 'part' FROM part
  UNION ALL SELECT 's-' || s_suppkey, 'supplier' FROM supplier
  UNION ALL SELECT 'n-' || n_nationkey, 'nation' FROM nation
  UNION ALL SELECT 'r-' || r_regionkey, 'region' FROM region
  UNION ALL SELECT DISTINCT 'u-' || user_id, 'user' FROM events),
li AS (SELECT *, 'si-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS id FROM lineitem),
e2o AS (
  SELECT 'po-' || o_orderkey AS ev_id, 'place order' AS ev_type, CAST(o_orderdate AS TIMESTAMP) AS ev_time, 'o-' || o_orderkey AS ob_id, 'order' AS ob_type, 'order' AS qualifier FROM orders
  UNION ALL SELECT 'po-' || o_orderkey, 'place order', CAST(o_orderdate AS TIMESTAMP), 'c-' || o_custkey, 'customer', 'buyer' FROM orders
  UNION ALL SELECT id, 'ship item', CAST(l_shipdate AS TIMESTAMP), 'o-' || l_orderkey, 'order', 'order' FROM li
  UNION ALL SELECT id, 'ship item', CAST(l_shipdate AS TIMESTAMP), 'p-' || l_partkey, 'part', 'item' FROM li
  UNION ALL SELECT id, 'ship item', CAST(l_shipdate AS TIMESTAMP), 's-' || l_suppkey, 'supplier', 'source' FROM li
  UNION ALL SELECT 'we-' || event_id, event_type, CAST(ts AS TIMESTAMP), 'u-' || user_id, 'user', 'actor' FROM events
  UNION ALL SELECT 'we-' || event_id, event_type, CAST(ts AS TIMESTAMP), 'c-' || user_id, 'customer', 'account' FROM events),
o2o AS (
  SELECT 'o-' || o_orderkey AS src_id, 'order' AS src_type, 'c-' || o_custkey AS tgt_id, 'customer' AS tgt_type, 'placed_by' AS qualifier FROM orders
  UNION ALL SELECT 'c-' || c_custkey, 'customer', 'n-' || c_nationkey, 'nation', 'lives_in' FROM customer
  UNION ALL SELECT 's-' || s_suppkey, 'supplier', 'n-' || s_nationkey, 'nation', 'based_in' FROM supplier
  UNION ALL SELECT 'n-' || n_nationkey, 'nation', 'r-' || n_regionkey, 'region', 'part_of' FROM nation
  UNION ALL SELECT DISTINCT 'u-' || user_id, 'user', 'c-' || user_id, 'customer', 'is' FROM events)
"""


def query(name: str, sql: str | None = None, prelude: bool = True):
    """Register a query; sql goes after the prelude's tables ev, ob, li, e2o, o2o (start with a comma for more)."""

    def add(f: Callable[[Log], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(star_log(spark, sf_dir))
        if sql is not None:
            SQL[name] = PRELUDE + sql if prelude else sql
        return f

    return add


def box(events: dict | None = None, objects: dict | None = None, filters=(), sizes=(), constraints=(), labels=(), children=(), ev_labels=None, ob_labels=None) -> dict:
    body = {"newEventVars": {str(k): v for k, v in (events or {}).items()}, "newObjectVars": {str(k): v for k, v in (objects or {}).items()}, "filters": list(filters), "sizeFilters": list(sizes), "constraints": list(constraints), "labels": list(labels), "evVarLabels": ev_labels or {}, "obVarLabels": ob_labels or {}}
    return {"Box": [body, list(children)]}


def tree(*nodes: dict, edges: dict | None = None) -> dict:
    return {"nodes": list(nodes), "edgeNames": [[list(k), v] for k, v in (edges or {}).items()]}


def o2e(ob: int, ev: int, qualifier: str | None = None, label: str | None = None) -> dict:
    return {"type": "O2E", "object": ob, "event": ev, "qualifier": qualifier, "filterLabel": label}


def o2o(a: int, b: int, qualifier: str | None = None, label: str | None = None) -> dict:
    return {"type": "O2O", "object": a, "other_object": b, "qualifier": qualifier, "filterLabel": label}


def between(a: int, b: int, low: float | None, high: float | None) -> dict:
    return {"type": "TimeBetweenEvents", "from_event": a, "to_event": b, "min_seconds": low, "max_seconds": high}


def number(kind: str, low=None, high=None) -> dict:
    return {"type": kind, "min": low, "max": high}


def ev_attr(ev: int, name: str, value: dict) -> dict:
    return {"type": "EventAttributeValueFilter", "event": ev, "attribute_name": name, "value_filter": value}


def ob_attr(ob: int, name: str, at: dict, value: dict) -> dict:
    return {"type": "ObjectAttributeValueFilter", "object": ob, "attribute_name": name, "at_time": at, "value_filter": value}


def childs(name: str, low: int | None = None, high: int | None = None) -> dict:
    return {"type": "NumChilds", "child_name": name, "min": low, "max": high}


def sized(f: dict) -> dict:
    return {"type": "SizeFilter", "filter": f}


DAY = 86400.0
ALWAYS, SOMETIME, AT = {"type": "Always"}, {"type": "Sometime"}, lambda e: {"type": "AtEvent", "event": e}


def bindings(log: Log, t: dict, node: int = 0) -> DataFrame:
    df = evaluate(t, log).node(node)
    return df.withColumn("violation", F.col("violation").cast("int"))


def plain(name: str, t: dict, sql: str, node: int = 0) -> None:
    """A query that is a node's bindings without violation."""
    query(name, sql)(lambda log: bindings(log, t, node).drop("violation"))


def tagged_rows(name: str, t: dict, sql: str, node: int = 0) -> None:
    query(name, sql)(lambda log: bindings(log, t, node))


# Summaries.
query("info_e2o_types", """, et AS (SELECT DISTINCT ev_type FROM ev), ot AS (SELECT DISTINCT ob_type FROM ob)
SELECT et.ev_type, ot.ob_type, count(r.ev_id) AS n, coalesce(string_agg(DISTINCT r.qualifier, ',' ORDER BY r.qualifier), '') AS qualifiers
FROM et CROSS JOIN ot LEFT JOIN e2o r ON r.ev_type = et.ev_type AND r.ob_type = ot.ob_type GROUP BY 1, 2""")(lambda log: log.e2o_summary())
query("info_o2o_types", """, st AS (SELECT DISTINCT ob_type AS src_type FROM ob), ot AS (SELECT DISTINCT ob_type AS tgt_type FROM ob)
SELECT st.src_type, ot.tgt_type, count(r.src_id) AS n, coalesce(string_agg(DISTINCT r.qualifier, ',' ORDER BY r.qualifier), '') AS qualifiers
FROM st CROSS JOIN ot LEFT JOIN o2o r ON r.src_type = st.src_type AND r.tgt_type = ot.tgt_type GROUP BY 1, 2""")(lambda log: log.o2o_summary())
query("info_totals", " SELECT 'events' AS what, count(*) AS n FROM ev UNION ALL SELECT 'objects', count(*) FROM ob UNION ALL SELECT 'e2o', count(*) FROM e2o UNION ALL SELECT 'o2o', count(*) FROM o2o")(lambda log: log.totals())
query("qualifiers_per_event_type", """, p AS (SELECT ev_type, qualifier, ev_id, count(DISTINCT ob_id) AS n FROM e2o GROUP BY 1, 2, 3)
SELECT p.ev_type, p.qualifier, t.object_types, max(p.n) > 1 AS multiple FROM p JOIN
 (SELECT ev_type, qualifier, string_agg(DISTINCT ob_type, ',' ORDER BY ob_type) AS object_types FROM e2o GROUP BY 1, 2) t USING (ev_type, qualifier) GROUP BY 1, 2, 3""")(lambda log: log.qualifiers_per_event_type())
query("sample_ids", " (SELECT 'event' AS kind, ev_id AS id FROM ev ORDER BY ev_id LIMIT 25) UNION ALL (SELECT 'object', ob_id FROM ob ORDER BY ob_id LIMIT 25)")(lambda log: log.sample_ids(25))
query("element_object", """ SELECT ob_id, ob_type FROM ob WHERE ob_id = 'c-7'""")(lambda log: log.element("object", "c-7").select("ob_id", "ob_type"))

# Binding steps.
plain("bind_ob", tree(box(objects={0: ["customer", "nation"]})), " SELECT ob_id AS o1 FROM ob WHERE ob_type IN ('customer', 'nation')")
plain("bind_ev", tree(box({0: ["place order", "click"]})), " SELECT ev_id AS e1 FROM ev WHERE ev_type IN ('place order', 'click')")
plain("bind_e2o", tree(box({0: ["place order"]}, {0: ["order"]}, [o2e(0, 0)])), " SELECT DISTINCT ev_id AS e1, ob_id AS o1 FROM e2o WHERE ev_type = 'place order' AND ob_type = 'order'")
plain("bind_e2o_qualifier", tree(box({0: ["ship item", "place order"]}, {0: ["order", "customer"]}, [o2e(0, 0, "buyer")])), " SELECT DISTINCT ev_id AS e1, ob_id AS o1 FROM e2o WHERE qualifier = 'buyer'")
plain("bind_o2o", tree(box(objects={0: ["order"], 1: ["customer"]}, filters=[o2o(0, 1, "placed_by")])), " SELECT DISTINCT src_id AS o1, tgt_id AS o2 FROM o2o WHERE qualifier = 'placed_by'")
plain("bind_o2o_chain", tree(box(objects={0: ["customer"], 1: ["nation"], 2: ["region"]}, filters=[o2o(0, 1), o2o(1, 2)])), " SELECT a.src_id AS o1, a.tgt_id AS o2, b.tgt_id AS o3 FROM o2o a JOIN o2o b ON a.tgt_id = b.src_id WHERE a.src_type = 'customer' AND b.tgt_type = 'region'")
plain("bind_o2o_reversed", tree(box(objects={0: ["nation"], 1: ["customer", "supplier"]}, filters=[o2o(1, 0)])), " SELECT DISTINCT tgt_id AS o1, src_id AS o2 FROM o2o WHERE tgt_type = 'nation'")
plain("bind_multi_type", tree(box({0: ["click", "view", "purchase"]}, {0: ["user", "customer"]}, [o2e(0, 0)])), " SELECT DISTINCT ev_id AS e1, ob_id AS o1 FROM e2o WHERE ev_type IN ('click', 'view', 'purchase')")

_PAIR = {"events": {0: ["place order"], 1: ["ship item"]}, "objects": {0: ["order"]}}
_PAIR_SQL = " SELECT 'po-' || o_orderkey AS e1, id AS e2, 'o-' || o_orderkey AS o1 FROM orders JOIN li ON l_orderkey = o_orderkey WHERE epoch_us(CAST(l_shipdate AS TIMESTAMP)) - epoch_us(CAST(o_orderdate AS TIMESTAMP)) "
plain("filter_tbe_closed", tree(box(**_PAIR, filters=[o2e(0, 0), o2e(0, 1), between(0, 1, 0, 30 * DAY)])), _PAIR_SQL + "BETWEEN 0 AND 2592000000000")
plain("filter_tbe_open", tree(box(**_PAIR, filters=[o2e(0, 0), o2e(0, 1), between(0, 1, 100 * DAY, None)])), _PAIR_SQL + ">= 8640000000000")
plain("filter_tbe_negative", tree(box(**_PAIR, filters=[o2e(0, 0), o2e(0, 1), between(0, 1, None, -1)])), _PAIR_SQL + "<= -1000000")
plain("filter_not_equal", tree(box({0: ["ship item"], 1: ["ship item"]}, {0: ["order"]}, [o2e(0, 0), o2e(0, 1), {"type": "NotEqual", "var_1": {"Event": 0}, "var_2": {"Event": 1}}])), " SELECT a.id AS e1, b.id AS e2, 'o-' || a.l_orderkey AS o1 FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey WHERE a.id <> b.id")
plain("filter_event_id", tree(box({0: ["place order"]}, filters=[ev_attr(0, "ocel:id", {"type": "String", "is_in": ["po-1", "po-2", "po-77"]})])), " SELECT ev_id AS e1 FROM ev WHERE ev_id IN ('po-1', 'po-2', 'po-77')")
plain("filter_event_time", tree(box({0: ["place order", "ship item"]}, filters=[ev_attr(0, "ocel:time", {"type": "Time", "from": "1995-01-01T00:00:00Z", "to": "1995-06-30T00:00:00Z"})])), " SELECT ev_id AS e1 FROM ev WHERE ev_type IN ('place order', 'ship item') AND ev_time BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30'")
plain("filter_event_attr_float", tree(box({0: ["place order"]}, filters=[ev_attr(0, "total", number("Float", 100000.0, 200000.0))])), " SELECT 'po-' || o_orderkey AS e1 FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
plain("filter_event_attr_int", tree(box({0: ["ship item"]}, filters=[ev_attr(0, "line", number("Integer", 3, 4))])), " SELECT id AS e1 FROM li WHERE l_linenumber BETWEEN 3 AND 4")
plain("filter_event_attr_string", tree(box({0: ["place order"]}, filters=[ev_attr(0, "status", {"type": "String", "is_in": ["F", "P"]})])), " SELECT 'po-' || o_orderkey AS e1 FROM orders WHERE o_orderstatus IN ('F', 'P')")
plain("filter_event_attr_bool", tree(box({0: ["place order"]}, filters=[ev_attr(0, "status", {"type": "Boolean", "is_true": True})])), " SELECT ev_id AS e1 FROM ev WHERE false")
plain("filter_object_attr_always", tree(box(objects={0: ["user"]}, filters=[ob_attr(0, "value", ALWAYS, number("Float", None, 450.0))])), " SELECT 'u-' || user_id AS o1 FROM events GROUP BY user_id HAVING coalesce(max(value), 0) <= 450 AND count(value) = count(*)")
plain("filter_object_attr_sometime", tree(box(objects={0: ["user"]}, filters=[ob_attr(0, "value", SOMETIME, number("Float", 400.0, None))])), " SELECT 'u-' || user_id AS o1 FROM events GROUP BY user_id HAVING max(value) >= 400")
plain("filter_object_attr_at_event", tree(box({0: ["purchase"]}, {0: ["user"]}, [o2e(0, 0), ob_attr(0, "value", AT(0), number("Float", 100.0, None))])), """, latest AS (SELECT p.event_id, p.user_id, arg_max(h.value, (h.ts, h.event_id)) AS v FROM events p JOIN events h ON h.user_id = p.user_id AND h.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY 1, 2)
SELECT 'we-' || event_id AS e1, 'u-' || user_id AS o1 FROM latest WHERE v >= 100""")
plain("range_join_events", tree(box({0: ["purchase"], 1: ["error"]}, filters=[between(0, 1, 0, 60)])), " SELECT a.ev_id AS e1, b.ev_id AS e2 FROM ev a, ev b WHERE a.ev_type = 'purchase' AND b.ev_type = 'error' AND epoch_us(b.ev_time) - epoch_us(a.ev_time) BETWEEN 0 AND 60000000")

# Trees.
_SHIP = box({1: ["ship item"]}, filters=[o2e(0, 1), between(0, 1, 0, 30 * DAY)])
_PLACE = {"events": {0: ["place order"]}, "objects": {0: ["order"]}, "filters": [o2e(0, 0)]}
_SHIP_N = """, root AS (SELECT ev_id AS e1, ob_id AS o1, ev_time FROM e2o WHERE ev_type = 'place order' AND ob_type = 'order'),
kids AS (SELECT r.e1, r.o1, s.ev_id AS e2 FROM root r JOIN e2o s ON s.ob_id = r.o1 AND s.ev_type = 'ship item' AND epoch_us(s.ev_time) - epoch_us(r.ev_time) BETWEEN 0 AND 2592000000000),
n AS (SELECT r.e1, r.o1, count(k.e2) AS n FROM root r LEFT JOIN kids k USING (e1, o1) GROUP BY 1, 2)
"""
tagged_rows("child_count", tree(box(**_PLACE, constraints=[sized(childs("A", 1, 2))], children=[1]), _SHIP, edges={(0, 1): "A"}), _SHIP_N + " SELECT e1, o1, CASE WHEN n BETWEEN 1 AND 2 THEN NULL ELSE 0 END AS violation FROM n")
plain("child_count_rows", tree(box(**_PLACE, sizes=[childs("A", 2, None)], children=[1]), _SHIP, edges={(0, 1): "A"}), _SHIP_N + " SELECT k.e1, k.e2, k.o1 FROM kids k JOIN n USING (e1, o1) WHERE n >= 2", node=1)
plain("child_count_proj", tree(box(objects={0: ["order"]}, sizes=[{"type": "NumChildsProj", "child_name": "A", "var_name": {"Object": 1}, "min": 3, "max": None}], children=[1]), box({0: ["ship item"]}, {1: ["supplier"]}, [o2e(0, 0), o2e(1, 0)]), edges={(0, 1): "A"}), " SELECT 'o-' || l_orderkey AS o1 FROM li GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) >= 3")
_A = box({0: ["ship item"]}, filters=[o2e(0, 0), ev_attr(0, "quantity", number("Float", 3.0, None))])
_B = box({0: ["ship item"]}, filters=[o2e(0, 0)])
plain("child_set_equal", tree(box(objects={0: ["order"]}, sizes=[{"type": "BindingSetEqual", "child_names": ["A", "B"]}], children=[1, 2]), _A, _B, edges={(0, 1): "A", (0, 2): "B"}), " SELECT 'o-' || o_orderkey AS o1 FROM orders LEFT JOIN li ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(*) FILTER (l_quantity < 3) = 0")
plain("child_proj_set_equal", tree(box(objects={0: ["order"]}, sizes=[{"type": "BindingSetProjectionEqual", "child_name_with_var_name": [["A", {"Object": 1}], ["B", {"Object": 2}]]}], children=[1, 2]), box({0: ["ship item"]}, {1: ["supplier"]}, [o2e(0, 0), o2e(1, 0)]), box({1: ["ship item"]}, {2: ["supplier"]}, [o2e(0, 1), o2e(2, 1), ev_attr(1, "quantity", number("Float", 10.0, None))]), edges={(0, 1): "A", (0, 2): "B"}), """, g AS (SELECT o_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS a, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) FILTER (l_quantity >= 10) AS b FROM orders LEFT JOIN li ON l_orderkey = o_orderkey GROUP BY 1)
SELECT 'o-' || o_orderkey AS o1 FROM g WHERE a IS NOT DISTINCT FROM b""")

# Constraints over two children: one whose rows are violated if they are not soon, one of large quantity.
_CHILD_A = box({1: ["ship item"]}, filters=[o2e(0, 1)], constraints=[{"type": "Filter", "filter": between(0, 1, 0, 60 * DAY)}])
_CHILD_B = box({2: ["ship item"]}, filters=[o2e(0, 2)], constraints=[{"type": "Filter", "filter": ev_attr(2, "quantity", number("Float", 25.0, None))}])
_GATES_SQL = """, root AS (SELECT ev_id AS e1, ob_id AS o1, ev_time FROM e2o WHERE ev_type = 'place order' AND ob_type = 'order'),
s AS (SELECT r.e1, r.o1, count(l.id) AS n, count(*) FILTER (l.id IS NOT NULL AND NOT (epoch_us(CAST(l.l_shipdate AS TIMESTAMP)) - epoch_us(r.ev_time) BETWEEN 0 AND 5184000000000)) AS va, count(*) FILTER (l.l_quantity < 25) AS vb
  FROM root r LEFT JOIN li l ON 'o-' || l.l_orderkey = r.o1 GROUP BY 1, 2)
SELECT e1, o1, CASE WHEN %s THEN NULL ELSE 0 END AS violation FROM s"""
for _kind, _test in (("SAT", "va = 0 AND vb = 0"), ("ANY", "n - va > 0 AND n - vb > 0"), ("NOT", "NOT (n - va > 0 AND n - vb > 0)"), ("OR", "va = 0 OR vb = 0"), ("AND", "va = 0 AND vb = 0")):
    tagged_rows(f"constraint_{_kind.lower()}", tree(box(**_PLACE, constraints=[{"type": _kind, "child_names": ["A", "B"]}], children=[1, 2]), _CHILD_A, _CHILD_B, edges={(0, 1): "A", (0, 2): "B"}), _GATES_SQL % _test)
for _kind, _test in (("OR", "va = 0 OR vb = 0"), ("AND", "va = 0 AND vb = 0")):
    tagged_rows(f"gate_{_kind.lower()}", tree(box(**_PLACE, constraints=[{"type": "SAT", "child_names": ["G"]}], children=[1]), {_kind: [2, 3]}, _CHILD_A, _CHILD_B, edges={(0, 1): "G"}), _GATES_SQL % _test)
tagged_rows("gate_not", tree(box(**_PLACE, constraints=[{"type": "SAT", "child_names": ["G"]}], children=[1]), {"NOT": 2}, _CHILD_A, edges={(0, 1): "G"}), _GATES_SQL % "NOT (n - va > 0)")
tagged_rows("constraint_filter", tree(box(**_PLACE, constraints=[{"type": "Filter", "filter": ev_attr(0, "total", number("Float", 150000.0, None))}, {"type": "Filter", "filter": ev_attr(0, "status", {"type": "String", "is_in": ["O"]})}])), " SELECT 'po-' || o_orderkey AS e1, 'o-' || o_orderkey AS o1, CASE WHEN o_totalprice < 150000 THEN 0 WHEN o_orderstatus <> 'O' THEN 1 END AS violation FROM orders")
_DEEP = tree(
    box(objects={0: ["customer"]}, sizes=[childs("orders", 2, None)], constraints=[{"type": "SAT", "child_names": ["orders"]}], children=[1]),
    box({0: ["place order"]}, {1: ["order"]}, [o2e(0, 0, "buyer"), o2e(1, 0, "order")], constraints=[sized(childs("items", 1, None))], children=[2]),
    box({1: ["ship item"]}, filters=[o2e(1, 1), between(0, 1, 0, None)]),
    edges={(0, 1): "orders", (1, 2): "items"},
)
_DEEP_SQL = """, lvl AS (SELECT o_custkey, o_orderkey, count(l.id) FILTER (epoch_us(CAST(l.l_shipdate AS TIMESTAMP)) >= epoch_us(CAST(o_orderdate AS TIMESTAMP))) AS n FROM orders LEFT JOIN li l ON l.l_orderkey = o_orderkey GROUP BY 1, 2),
top AS (SELECT o_custkey, count(*) AS orders, count(*) FILTER (n = 0) AS bad FROM lvl GROUP BY 1 HAVING count(*) >= 2)"""
tagged_rows("three_level_tree", _DEEP, _DEEP_SQL + " SELECT 'c-' || o_custkey AS o1, CASE WHEN bad > 0 THEN 0 END AS violation FROM top")
tagged_rows("size_filter_drop_descendants", _DEEP, _DEEP_SQL + " SELECT 'po-' || o_orderkey AS e1, 'c-' || o_custkey AS o1, 'o-' || o_orderkey AS o2, CASE WHEN n = 0 THEN 0 END AS violation FROM lvl JOIN top USING (o_custkey)", node=1)
query("node_summary", _DEEP_SQL + """ SELECT 0 AS node, count(*) AS situations, count(*) FILTER (bad > 0) AS violated FROM top
UNION ALL SELECT 1, count(*), count(*) FILTER (n = 0) FROM lvl JOIN top USING (o_custkey)
UNION ALL SELECT 2, CAST(coalesce(sum(n), 0) AS BIGINT), 0 FROM lvl JOIN top USING (o_custkey)""")(lambda log: evaluate(_DEEP, log).summary())
query("plan_profile", """, n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey) AS o, (SELECT count(*) FROM li JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE epoch_us(CAST(l_shipdate AS TIMESTAMP)) >= epoch_us(CAST(o_orderdate AS TIMESTAMP))) AS l)
SELECT 0 AS node, 0 AS step, 'o1' AS variable, 'scan' AS bound_by, c AS n FROM n UNION ALL SELECT 1, 0, 'e1', 'O2E', o FROM n UNION ALL SELECT 1, 1, 'o2', 'O2E', o FROM n UNION ALL SELECT 2, 0, 'e2', 'O2E', l FROM n""")(lambda log: evaluate(_DEEP, log).profile().drop("factor"))
query("page_violated", _DEEP_SQL + " SELECT o1, 0 AS violation FROM (SELECT 'c-' || o_custkey AS o1 FROM top WHERE bad > 0 ORDER BY o1 LIMIT 10 OFFSET 5) t")(lambda log: evaluate(_DEEP, log).page(0, 5, 10, "violated")[0])

# The expression language.
plain("cel_predicate", tree(box({0: ["place order"]}, {0: ["order"]}, [o2e(0, 0), {"type": "BasicFilterCEL", "cel": 'e1.attr("total") > 100000.0 && e1.attr("priority").startsWith("1") || o1.id() == "o-3"'}])), " SELECT 'po-' || o_orderkey AS e1, 'o-' || o_orderkey AS o1 FROM orders WHERE (o_totalprice > 100000 AND starts_with(o_orderpriority, '1')) OR o_orderkey = 3")
plain("cel_labels", tree(box({0: ["place order"]}, {0: ["order"]}, [o2e(0, 0)], labels=[{"label": "big", "cel": 'e1.attr("total") >= 150000.0'}, {"label": "tag", "cel": 'big ? e1.attr("status") + "!" : e1.type()'.replace('e1.attr("status") + "!"', 'string(e1.attr("status"))')}])), " SELECT 'po-' || o_orderkey AS e1, 'o-' || o_orderkey AS o1, o_totalprice >= 150000 AS big, CASE WHEN o_totalprice >= 150000 THEN o_orderstatus ELSE 'place order' END AS tag FROM orders")
plain("cel_child_aggregate", tree(box(objects={0: ["order"]}, sizes=[{"type": "AdvancedCEL", "cel": 'A.map(x, x.q).sum() >= 100.0 && A.exists(x, x.satisfied)'}], labels=[{"label": "n", "cel": "A.size()"}], children=[1]), box({0: ["ship item"]}, filters=[o2e(0, 0)], labels=[{"label": "q", "cel": 'double(e1.attr("quantity"))'}]), edges={(0, 1): "A"}), " SELECT 'o-' || l_orderkey AS o1, count(*) AS n FROM li GROUP BY l_orderkey HAVING sum(l_quantity) >= 100")


# Log filtering, export, neighbourhoods.
from .operators import anonymity, declare, discover, export, extract, filterlog, graph, paths, translate  # noqa: E402

_KEEP = tree(box({0: ["place order"]}, {0: ["order"], 1: ["customer"]}, [o2e(0, 0, "order", "INCLUDED"), o2e(1, 0, "buyer", "INCLUDED"), o2o(0, 1, "placed_by", "INCLUDED"), ev_attr(0, "total", number("Float", 200000.0, None))], ev_labels={"0": "INCLUDED"}, ob_labels={"0": "INCLUDED", "1": "INCLUDED"}))
query("filter_log_events", " SELECT 'po-' || o_orderkey AS ev_id, 'place order' AS ev_type FROM orders WHERE o_totalprice >= 200000")(lambda log: filterlog.filter_log(log, _KEEP).events.select("ev_id", "ev_type"))
query("filter_log_objects", " SELECT 'o-' || o_orderkey AS ob_id, 'order' AS ob_type FROM orders WHERE o_totalprice >= 200000 UNION SELECT 'c-' || o_custkey, 'customer' FROM orders WHERE o_totalprice >= 200000")(lambda log: filterlog.filter_log(log, _KEEP).objects)
query("filter_log_e2o", " SELECT r.ev_id, r.ob_id, r.qualifier FROM e2o r JOIN orders ON r.ev_id = 'po-' || o_orderkey WHERE o_totalprice >= 200000")(lambda log: filterlog.filter_log(log, _KEEP).e2o.select("ev_id", "ob_id", "qualifier"))
query("filter_log_o2o", " SELECT r.src_id, r.tgt_id, r.qualifier FROM o2o r JOIN orders ON r.src_id = 'o-' || o_orderkey WHERE o_totalprice >= 200000")(lambda log: filterlog.filter_log(log, _KEEP).o2o.select("src_id", "tgt_id", "qualifier"))
_DROP = tree(box({0: ["error"]}, ev_labels={"0": "EXCLUDED"}))
query("filter_log_excluded", " SELECT ev_type, count(*) AS n FROM ev WHERE ev_type <> 'error' GROUP BY 1")(lambda log: filterlog.filter_log(log, _DROP).events.groupBy("ev_type").agg(F.count("*").alias("n")))
_ORDERS = tree(box({0: ["place order"]}, {0: ["customer"]}, [o2e(0, 0), ev_attr(0, "total", number("Float", 250000.0, None))], constraints=[{"type": "Filter", "filter": ev_attr(0, "status", {"type": "String", "is_in": ["O"]})}]))
query("export_wide_table", " SELECT 'c-' || c_custkey AS o1, c_mktsegment AS o1_segment, 'po-' || o_orderkey AS e1, o_orderpriority AS e1_priority, o_orderstatus AS e1_status, o_orderstatus = 'O' AS \"Satisfied\" FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice >= 250000")(lambda log: export.wide_table(log, evaluate(_ORDERS, log)).drop("o1_acctbal", "e1_total"))
query("graph_neighbourhood", """, l AS (SELECT ev_id AS a, ob_id AS b FROM e2o UNION SELECT ob_id, ev_id FROM e2o UNION SELECT src_id, tgt_id FROM o2o UNION SELECT tgt_id, src_id FROM o2o),
d1 AS (SELECT b FROM l WHERE a = 'o-10'), d2 AS (SELECT DISTINCT l.b FROM l JOIN d1 ON l.a = d1.b),
r AS (SELECT 'o-10' AS id, 0 AS distance UNION ALL SELECT b, 1 FROM d1 UNION ALL SELECT b, 2 FROM d2)
SELECT id, min(distance) AS distance FROM r GROUP BY id""")(lambda log: graph.neighbourhood(log, "o-10", 2))
query("graph_spanning_tree")(lambda log: graph.graph_edges(log, graph.neighbourhood(log, "o-10", 2), spanning_tree=True))

# Translation: the engine's bindings; the SQL is what the translator writes, over the log's tables.
_VALUES = """, event_attrs AS (SELECT 'po-' || o_orderkey AS ev_id, 'total' AS name, 0 AS seq, NULL::VARCHAR AS s, NULL::BIGINT AS i, o_totalprice AS d, NULL::BOOLEAN AS b, NULL::TIMESTAMP AS ts FROM orders UNION ALL SELECT 'po-' || o_orderkey, 'status', 0, o_orderstatus, NULL, NULL, NULL, NULL FROM orders)
"""
for _name, _tree in (
    ("translate_relations", tree(box({0: ["place order"]}, {0: ["order"]}, [o2e(0, 0, "order"), ev_attr(0, "total", number("Float", 300000.0, None))], constraints=[{"type": "Filter", "filter": ev_attr(0, "status", {"type": "String", "is_in": ["O"]})}]))),
    ("translate_windows", tree(box({0: ["purchase"], 1: ["error"]}, filters=[between(0, 1, 0, 30)]))),
):
    query(_name, _VALUES + translate.to_sql(_tree, "duckdb", {"events": "ev", "objects": "ob"}))(lambda log, t=_tree: bindings(log, t))

# Declarative constraints.
query("declare_objects_per_event", " SELECT ob_type, n, count(*) AS events FROM (SELECT ob_type, ev_id, count(*) AS n FROM e2o WHERE ev_type = 'ship item' GROUP BY 1, 2) t GROUP BY 1, 2")(lambda log: declare.objects_per_event(log, "ship item"))
query("declare_events_per_object", """, n AS (SELECT ob_id, count(DISTINCT ev_id) AS n FROM e2o WHERE ev_type = 'ship item' GROUP BY 1)
SELECT o.ob_type, coalesce(n.n, 0) AS n, count(*) AS objects FROM ob o LEFT JOIN n USING (ob_id) WHERE o.ob_type IN ('order', 'part', 'supplier') GROUP BY 1, 2""")(lambda log: declare.events_per_object(log, "ship item"))
_ARC = declare.Arc("place order", "ship item", "EF", "each", "order")
query("declare_conformance", """, s AS (SELECT a.ev_id, a.ob_id, count(DISTINCT b.ev_id) AS n FROM e2o a LEFT JOIN e2o b ON a.ob_id = b.ob_id AND b.ev_type = 'ship item' AND b.ev_time > a.ev_time WHERE a.ev_type = 'place order' AND a.ob_type = 'order' GROUP BY 1, 2)
SELECT count(*) AS obligations, count(*) FILTER (n > 0) AS satisfied, count(*) FILTER (n > 0) / count(*) AS fraction FROM s""")(lambda log: declare.conformance(log, _ARC))
query("declare_conformance_directly", """, e AS (SELECT DISTINCT ob_id, ev_id, ev_type, ev_time FROM e2o WHERE ob_type = 'user'),
s AS (SELECT a.ob_id, a.ev_id, (SELECT min(ev_time) FROM e WHERE e.ob_id = a.ob_id AND e.ev_time > a.ev_time) AS nxt FROM e a WHERE a.ev_type = 'view'),
n AS (SELECT s.ob_id, s.ev_id, count(b.ev_id) AS n FROM s LEFT JOIN e b ON b.ob_id = s.ob_id AND b.ev_time = s.nxt AND b.ev_type = 'click' GROUP BY 1, 2)
SELECT count(*) AS obligations, count(*) FILTER (n > 0) AS satisfied, count(*) FILTER (n > 0) / count(*) AS fraction FROM n""")(lambda log: declare.conformance(log, declare.Arc("view", "click", "DF", "each", "user")))
query("declare_edge_durations", " SELECT a.ev_id AS s, CAST(trunc((epoch_us(min(b.ev_time)) - epoch_us(a.ev_time)) / 1000) AS BIGINT) AS ms FROM e2o a JOIN e2o b ON a.ob_id = b.ob_id AND b.ev_type = 'ship item' AND b.ev_time > a.ev_time WHERE a.ev_type = 'place order' AND a.ob_type = 'order' GROUP BY a.ev_id, a.ob_id, a.ev_time")(lambda log: declare.edge_durations(log, _ARC))
query("declare_duration_histogram", """, d AS (SELECT CAST(trunc((epoch_us(min(b.ev_time)) - epoch_us(a.ev_time)) / 1000) AS BIGINT) AS ms FROM e2o a JOIN e2o b ON a.ob_id = b.ob_id AND b.ev_type = 'ship item' AND b.ev_time > a.ev_time WHERE a.ev_type = 'place order' AND a.ob_type = 'order' GROUP BY a.ev_id, a.ob_id, a.ev_time),
r AS (SELECT min(ms) AS lo, (max(ms) - min(ms)) / 25 AS raw FROM d), p AS (SELECT lo, raw, pow(10, floor(log10(raw))) AS p FROM r),
w AS (SELECT lo, p * CASE WHEN raw / p < 1.5 THEN 1 WHEN raw / p < 3 THEN 2 WHEN raw / p < 7 THEN 5 ELSE 10 END AS width FROM p), s AS (SELECT width, floor(lo / width) * width AS start FROM w)
SELECT CAST(floor((ms - start) / width) AS INTEGER) AS bin, floor((ms - start) / width) * width + start AS low, (floor((ms - start) / width) + 1) * width + start AS high, count(*) AS n FROM d, s GROUP BY 1, 2, 3""")(lambda log: declare.histogram(declare.edge_durations(log, _ARC), "ms"))
_LABELS = declare.Arc.of("ship item", "ship item", "EF", each=["part"], all=["supplier"])
_PART_AND_SUPPLIER = """, e AS (SELECT p.ev_id, p.ev_time, p.ob_id AS part, s.ob_id AS supplier FROM e2o p JOIN e2o s USING (ev_id) WHERE p.ev_type = 'ship item' AND p.ob_type = 'part' AND s.ob_type = 'supplier'),
n AS (SELECT a.ev_id, a.part, a.ev_time, count(b.ev_id) AS n, min(b.ev_time) AS u FROM e a LEFT JOIN e b ON a.part = b.part AND a.supplier = b.supplier AND b.ev_time > a.ev_time GROUP BY 1, 2, 3) """
_JUDGED = "SELECT count(*) AS obligations, count(*) FILTER (n > 0) AS satisfied, count(*) FILTER (n > 0) / count(*) AS fraction FROM n"
query("declare_conformance_all", _PART_AND_SUPPLIER + _JUDGED)(lambda log: declare.conformance(log, _LABELS))
query("declare_label_durations", _PART_AND_SUPPLIER + "SELECT ev_id AS s, CAST(trunc((epoch_us(u) - epoch_us(ev_time)) / 1000) AS BIGINT) AS ms FROM n WHERE n > 0")(lambda log: declare.edge_durations(log, _LABELS))
query("declare_conformance_o2o", """, s AS (SELECT DISTINCT a.ev_id, a.ev_time, r.tgt_id FROM e2o a JOIN o2o r ON r.src_id = a.ob_id WHERE a.ev_type = 'click' AND a.ob_type = 'user' AND r.src_type = 'user' AND r.tgt_type = 'customer'),
t AS (SELECT ob_id, ev_time AS u FROM e2o WHERE ev_type = 'place order' AND ob_type = 'customer'),
n AS (SELECT s.ev_id, count(u) AS n FROM s LEFT JOIN t ON t.ob_id = s.tgt_id AND u < s.ev_time GROUP BY 1) """ + _JUDGED)(lambda log: declare.conformance(log, declare.Arc.of("click", "place order", "EP", any=[declare.O2O("user", "customer")])))


def _discovered(arcs: str) -> str:
    """SQL of the arcs over the sources r (ev_id, ev_type, ev_time, ob_id, object_type) that reach 0.8."""
    return arcs + f""", p AS (SELECT ob_id, ev_type, min(ev_time) AS f, max(ev_time) AS l, count(*) AS n FROM (SELECT DISTINCT ev_id, ev_type, ev_time, ob_id FROM e2o) x GROUP BY 1, 2),
o AS (SELECT ev_type AS source, object_type, count(*) AS obligations FROM r GROUP BY 1, 2),
h AS (SELECT r.ev_type AS source, p.ev_type AS target, object_type, 'AS' AS arrow, count(*) FILTER (n > CASE WHEN p.ev_type = r.ev_type THEN 1 ELSE 0 END) AS met FROM r JOIN p USING (ob_id) GROUP BY 1, 2, 3
  UNION ALL SELECT r.ev_type, p.ev_type, object_type, 'EF', count(*) FILTER (l > ev_time) FROM r JOIN p USING (ob_id) GROUP BY 1, 2, 3
  UNION ALL SELECT r.ev_type, p.ev_type, object_type, 'EP', count(*) FILTER (f < ev_time) FROM r JOIN p USING (ob_id) GROUP BY 1, 2, 3)
SELECT source, target, arrow, object_type, met / obligations AS fraction FROM h JOIN o USING (source, object_type) WHERE met / obligations >= 0.8"""


def _arcs(log: Log, found: list) -> DataFrame:
    return log.spark.createDataFrame([(a.source, a.target, a.arrow, str(a.object_type), f) for a, f in found], "source string, target string, arrow string, object_type string, fraction double")


query("declare_discovery", _discovered(", r AS (SELECT DISTINCT ev_id, ev_type, ev_time, ob_id, ob_type AS object_type FROM e2o)"))(lambda log: _arcs(log, declare.discover(log)))

# Path schemas.
query("path_type_graph", " SELECT 'e2o' AS relation, ev_type AS source, ob_type AS target, qualifier, count(*) AS n FROM e2o GROUP BY 2, 3, 4 UNION ALL SELECT 'o2o', src_type, tgt_type, qualifier, count(*) FROM o2o GROUP BY 2, 3, 4")(lambda log: paths.type_graph(log))
query("path_enumerate", """, g AS (SELECT DISTINCT ev_type AS a, ob_type AS b FROM e2o UNION SELECT DISTINCT src_type, tgt_type FROM o2o), u AS (SELECT a, b FROM g UNION SELECT b, a FROM g)
SELECT 1 AS length, 'order > region' AS types FROM u WHERE a = 'order' AND b = 'region'
UNION ALL SELECT 2, 'order > ' || x.b || ' > region' FROM u x JOIN u y ON x.b = y.a WHERE x.a = 'order' AND y.b = 'region' AND x.b NOT IN ('order', 'region')
UNION ALL SELECT 3, 'order > ' || x.b || ' > ' || y.b || ' > region' FROM u x JOIN u y ON x.b = y.a JOIN u z ON y.b = z.a WHERE x.a = 'order' AND z.b = 'region' AND x.b NOT IN ('order', 'region') AND y.b NOT IN ('order', 'region', x.b)""")(lambda log: log.spark.createDataFrame([(len(p), " > ".join([p[0].ends[0]] + [s.ends[1] for s in p])) for p in paths.enumerate_schemas(log, "order", "region", 3)], "length int, types string"))
_TO_REGION = (paths.Step("o2o", "order", "customer", "placed_by"), paths.Step("o2o", "customer", "nation", "lives_in"), paths.Step("o2o", "nation", "region", "part_of"))
_SHIPPED = (paths.Step("e2o", "place order", "order", "order"), paths.Step("e2o", "ship item", "order", "order", True))
query("path_connections", " SELECT a.src_id AS source, c.tgt_id AS target FROM o2o a JOIN o2o b ON a.tgt_id = b.src_id JOIN o2o c ON b.tgt_id = c.src_id WHERE a.src_type = 'order' AND c.tgt_type = 'region'")(lambda log: paths.connections(log, _TO_REGION).drop("seconds"))
query("path_connections_first", " SELECT source, target, seconds FROM (SELECT a.ev_id AS source, b.ev_id AS target, (epoch_us(b.ev_time) - epoch_us(a.ev_time)) / 1000000 AS seconds, row_number() OVER (PARTITION BY a.ev_id ORDER BY b.ev_time, b.ev_id) AS n FROM e2o a JOIN e2o b ON a.ob_id = b.ob_id AND b.ev_time >= a.ev_time WHERE a.ev_type = 'place order' AND b.ev_type = 'ship item' AND a.ob_type = 'order') t WHERE n = 1")(lambda log: paths.connections(log, _SHIPPED, "forward", selection="first"))
query("path_connections_closest", " SELECT source, target, seconds FROM (SELECT a.ev_id AS source, b.ev_id AS target, (epoch_us(b.ev_time) - epoch_us(a.ev_time)) / 1000000 AS seconds, row_number() OVER (PARTITION BY a.ev_id ORDER BY abs(epoch_us(b.ev_time) - epoch_us(a.ev_time)), b.ev_id) AS n FROM e2o a JOIN e2o b ON a.ob_id = b.ob_id WHERE a.ev_type = 'place order' AND b.ev_type = 'ship item' AND a.ob_type = 'order') t WHERE n = 1")(lambda log: paths.connections(log, _SHIPPED, selection="closest"))
query("path_measures", """, p AS (SELECT a.ev_id AS s, b.ev_id AS t, (epoch_us(b.ev_time) - epoch_us(a.ev_time)) / 1000000 AS sec FROM e2o a JOIN e2o b ON a.ob_id = b.ob_id AND b.ev_time >= a.ev_time WHERE a.ev_type = 'place order' AND b.ev_type = 'ship item' AND a.ob_type = 'order'),
n AS (SELECT (SELECT count(*) FROM ev WHERE ev_type = 'place order') AS a, (SELECT count(*) FROM ev WHERE ev_type = 'ship item') AS b)
SELECT count(*) AS support, count(*) AS path_count, count(DISTINCT s) / any_value(n.a) AS coverage, count(DISTINCT t) / any_value(n.b) AS reach, count(DISTINCT s) / count(*) AS selectivity, count(DISTINCT t) / count(*) AS exclusivity, count(*) = 0 AS is_dead, min(sec) AS min_s, max(sec) AS max_s, avg(sec) AS mean_s, median(sec) AS median_s FROM p, n""")(lambda log: paths.measures(log, _SHIPPED, temporal="forward"))
query("path_discover", """, p AS (SELECT 'nation -part_of-> region' AS schema, src_id AS s, tgt_id AS t, 'region' AS kind FROM o2o WHERE qualifier = 'part_of'
  UNION ALL SELECT 'nation <-lives_in- customer', tgt_id, src_id, 'customer' FROM o2o WHERE qualifier = 'lives_in'
  UNION ALL SELECT 'nation <-based_in- supplier', tgt_id, src_id, 'supplier' FROM o2o WHERE qualifier = 'based_in'),
n AS (SELECT ob_type, count(*) AS n FROM ob GROUP BY 1)
SELECT schema, count(*) AS support, count(*) AS path_count, count(DISTINCT s) / (SELECT n FROM n WHERE ob_type = 'nation') AS coverage, count(DISTINCT t) / any_value(n.n) AS reach,
 count(DISTINCT s) / count(*) AS selectivity, count(DISTINCT t) / count(*) AS exclusivity, count(*) = 0 AS is_dead FROM p JOIN n ON n.ob_type = p.kind GROUP BY 1""")(lambda log: paths.discover(log, "nation", None, 1).drop("length", "equivalence", "min_s", "max_s", "mean_s", "median_s"))
query("path_detail_durations", " SELECT count(*) AS n, min(seconds) AS low, max(seconds) AS high FROM (SELECT a.ev_id AS s, b.ev_id AS t, min((epoch_us(b.ev_time) - epoch_us(a.ev_time)) / 1000000) AS seconds FROM e2o a JOIN e2o b ON a.ob_id = b.ob_id AND b.ev_time >= a.ev_time WHERE a.ev_type = 'place order' AND b.ev_type = 'ship item' AND a.ob_type = 'order' GROUP BY 1, 2) p")(
    lambda log: paths.connections(log, _SHIPPED, "forward").agg(F.count("seconds").alias("n"), F.min("seconds").alias("low"), F.max("seconds").alias("high"))
)
query("path_degrees", """, p AS (SELECT src_id AS s, tgt_id AS t FROM o2o WHERE src_type = 'customer' AND tgt_type = 'nation'),
a AS (SELECT ob_id, count(p.t) AS n FROM ob LEFT JOIN p ON p.s = ob_id WHERE ob_type = 'customer' GROUP BY 1), b AS (SELECT ob_id, count(p.s) AS n FROM ob LEFT JOIN p ON p.t = ob_id WHERE ob_type = 'nation' GROUP BY 1)
SELECT 'source' AS side, n, count(*) AS elements FROM a GROUP BY 2 UNION ALL SELECT 'target', n, count(*) FROM b GROUP BY 2""")(lambda log: paths.degrees(log, (paths.Step("o2o", "customer", "nation", "lives_in"),)))

# Discovery.
query("discover_counts")(lambda log: log.spark.createDataFrame([(c.name, c.direction) for k, n in (("object", "order"), ("object", "customer"), ("event", "ship item")) for c in discover.count_constraints(log, k, n)], "name string, direction string"))
query("discover_count_histogram", ", n AS (SELECT 'o-' || o_orderkey AS id, count(l.id) AS n FROM orders LEFT JOIN li l ON l.l_orderkey = o_orderkey GROUP BY 1) SELECT n, count(*) AS instances FROM n WHERE n > 0 GROUP BY 1")(lambda log: discover.symmetric(log, "object").where("direction = 'e2o reversed' and related = 'ship item' and id like 'o-%'").groupBy("id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("instances")))
query("discover_delays", """, e AS (SELECT DISTINCT ob_id, ev_id, ev_type, ev_time FROM e2o WHERE ob_type = 'order')
SELECT a.ev_type AS first, b.ev_type AS "then", a.ob_id, a.ev_id, min(floor((epoch_us(b.ev_time) - epoch_us(a.ev_time)) / 1000) / 1000) AS seconds FROM e a JOIN e b ON a.ob_id = b.ob_id AND a.ev_id <> b.ev_id AND b.ev_time >= a.ev_time GROUP BY 1, 2, 3, 4""")(lambda log: discover.delays(log, "order"))
query("discover_follows", """, e AS (SELECT DISTINCT ob_id, ev_id, ev_type, ev_time FROM e2o WHERE ob_type = 'order'),
d AS (SELECT a.ev_type AS first, b.ev_type AS nxt, a.ob_id, a.ev_id, min(floor((epoch_us(b.ev_time) - epoch_us(a.ev_time)) / 1000) / 1000) AS seconds FROM e a JOIN e b ON a.ob_id = b.ob_id AND a.ev_id <> b.ev_id AND b.ev_time >= a.ev_time GROUP BY 1, 2, 3, 4),
s AS (SELECT first, nxt, stddev_pop(seconds) AS spread, any_value(c.n) AS total FROM d JOIN (SELECT ev_type, count(*) AS n FROM e GROUP BY 1) c ON c.ev_type = first GROUP BY 1, 2 HAVING count(*) >= any_value(c.n) * 0.4),
h AS (SELECT first, nxt, spread, total, ceil(seconds / spread) AS k, count(*) AS n FROM d JOIN s USING (first, nxt) WHERE spread > 0 GROUP BY 1, 2, 3, 4, 5),
c AS (SELECT *, sum(n) OVER (PARTITION BY first, nxt ORDER BY k) AS sofar FROM h)
SELECT '''' || first || ''' → ''' || nxt || ''' for ''order''' AS name, CAST(0 AS DOUBLE) AS low, round(min(k) * any_value(spread), 3) AS high FROM c WHERE sofar >= ceil(total * 0.4) GROUP BY first, nxt""")(lambda log: log.spark.createDataFrame([(c.name, c.low, c.high) for c in discover.follow_constraints(log, "order", 0.4)], "name string, low double, high double").withColumn("high", F.round("high", 3)))
query("discover_or")(lambda log: log.spark.createDataFrame([(n,) for n, _ in discover.or_constraints(log, "object", "supplier", 0.9)], "name string"))


# Extraction from the tables themselves.
def etl(name: str, blueprint: dict, pick: Callable[[Log], DataFrame], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sources = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "orders", "lineitem", "nation", "events", "supplier")}
        return pick(extract.extract(spark, blueprint, sources)[0])

    QUERIES[name], SQL[name] = run, sql


def column(c: str) -> dict:
    return {"type": "column", "column": c}


def constant(v: str) -> dict:
    return {"type": "constant", "value": v}


def template(v: str) -> dict:
    return {"type": "template", "template": v}


def virtual(name: str, **operation) -> dict:
    return {"name": name, "operation": operation}


def _objects(source: str, **more) -> dict:
    return {"source": source, "usages": [{"mode": "object", "object_id": template("C{c_custkey}"), "object_type": constant("customer"), **more}]}


_BUILDING = {"type": "column-equals", "column": "c_mktsegment", "value": "BUILDING"}
etl("etl_filter", {"virtual_tables": [virtual("v", type="filter", source="customer", condition={"type": "AND", "conditions": [_BUILDING, {"type": "column-matches", "column": "c_name", "pattern": "[02468]$"}]})], "tables": [_objects("v")]}, lambda log: log.objects, "SELECT 'C' || c_custkey AS ob_id, 'customer' AS ob_type FROM customer WHERE c_mktsegment = 'BUILDING' AND regexp_matches(c_name, '[02468]$')")
etl("etl_conditions", {"tables": [_objects("customer", filter={"type": "OR", "conditions": [{"type": "column-not-equals", "column": "c_mktsegment", "value": "BUILDING"}, {"type": "column-equals", "column": "c_custkey", "value": "7"}]})]}, lambda log: log.objects, "SELECT 'C' || c_custkey AS ob_id, 'customer' AS ob_type FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_custkey = 7")
etl("etl_join", {"virtual_tables": [virtual("v", type="join", left="customer", right="nation", join_type="inner", on=[["c_nationkey", "n_nationkey"]])], "tables": [{"source": "v", "usages": [{"mode": "object", "object_id": template("{n_name}/{c_custkey}"), "object_type": column("n_name")}]}]}, lambda log: log.objects, "SELECT n_name || '/' || c_custkey AS ob_id, n_name AS ob_type FROM customer JOIN nation ON c_nationkey = n_nationkey")
etl("etl_union", {"virtual_tables": [virtual("a", type="filter", source="customer", condition=_BUILDING), virtual("b", type="filter", source="customer", condition={"type": "column-equals", "column": "c_mktsegment", "value": "MACHINERY"}), virtual("v", type="union", sources=["a", "b"])], "tables": [_objects("v")]}, lambda log: log.objects, "SELECT 'C' || c_custkey AS ob_id, 'customer' AS ob_type FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_EVENTS_OF = {"mode": "event", "event_type": constant("placed"), "id": template("E-{o_orderkey}"), "timestamp": {"type": "column", "column": "o_orderdate"}, "attributes": [{"attribute": "prio", "column": "o_orderpriority"}], "inline_objects": [{"object_id": template("C{o_custkey}"), "object_type": constant("customer"), "qualifier": constant("by")}]}
etl("etl_template", {"tables": [{"source": "orders", "usages": [_EVENTS_OF]}]}, lambda log: log.events.select("ev_id", "ev_type", F.date_format("ev_time", "yyyy-MM-dd").alias("day")), "SELECT 'E-' || o_orderkey AS ev_id, 'placed' AS ev_type, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
etl("etl_inline_refs", {"tables": [{"source": "orders", "usages": [_EVENTS_OF]}]}, lambda log: log.e2o.select("ev_id", "ob_id", "ob_type", "qualifier"), "SELECT 'E-' || o_orderkey AS ev_id, 'C' || o_custkey AS ob_id, 'customer' AS ob_type, 'by' AS qualifier FROM orders")
etl("etl_change_events", {"tables": [{"source": "orders", "usages": [{"mode": "change-table", "timestamp": {"type": "column", "column": "o_orderdate"}, "rules": [{"condition": {"type": "column-equals", "column": "o_orderstatus", "value": "F"}, "event_type": "finish", "id": template("f{o_orderkey}")}, {"condition": {"type": "column-matches", "column": "o_orderpriority", "pattern": "^1"}, "event_type": "urgent", "id": template("u{o_orderkey}")}]}]}]}, lambda log: log.events.select("ev_id", "ev_type"), "SELECT CASE WHEN o_orderstatus = 'F' THEN 'f' ELSE 'u' END || o_orderkey AS ev_id, CASE WHEN o_orderstatus = 'F' THEN 'finish' ELSE 'urgent' END AS ev_type FROM orders WHERE o_orderstatus = 'F' OR starts_with(o_orderpriority, '1')")
etl("etl_object_history", {"tables": [{"source": "events", "usages": [{"mode": "object", "object_id": template("u{user_id}"), "object_type": constant("user"), "timestamp": {"type": "column", "column": "ts"}, "attributes": {"type": "static", "mappings": [{"attribute": "last", "column": "event_type"}]}}]}]}, lambda log: log.object_attrs.groupBy("ob_id", "name", "v.s").agg(F.count("*").alias("n")), "SELECT 'u' || user_id AS ob_id, 'last' AS name, event_type AS s, count(*) AS n FROM events GROUP BY 1, 3")
etl("etl_relations", {"tables": [_objects("customer"), {"source": "nation", "usages": [{"mode": "object", "object_id": column("n_name"), "object_type": constant("nation")}]}, {"source": "v", "usages": [{"mode": "o2o-relation", "source_id": template("C{c_custkey}"), "target_id": column("n_name"), "qualifier": constant("in")}]}], "virtual_tables": [virtual("v", type="join", left="customer", right="nation", on=[["c_nationkey", "n_nationkey"]])]}, lambda log: log.o2o.select("src_id", "tgt_id", "qualifier"), "SELECT 'C' || c_custkey AS src_id, n_name AS tgt_id, 'in' AS qualifier FROM customer JOIN nation ON c_nationkey = n_nationkey")


# Rows that repeat and have no id of their own: each is an event.
_SHIPMENTS = {"mode": "event", "event_type": column("l_linestatus"), "timestamp": {"type": "column", "column": "l_shipdate"}, "attributes": [{"attribute": "flag", "column": "l_returnflag"}]}
_BARE = {"virtual_tables": [virtual("v", type="filter", source="shipments", condition={"type": "column-not-empty", "column": "l_linestatus"})], "tables": [{"source": "v", "usages": [_SHIPMENTS]}]}
_CHANGES = {"tables": [{"source": "shipments", "usages": [{"mode": "change-table", "timestamp": {"type": "column", "column": "l_shipdate"}, "rules": [{"condition": {"type": "column-matches", "column": "l_linestatus", "pattern": "("}, "event_type": "never"}, {"condition": {"type": "column-equals", "column": "l_returnflag", "value": "R"}, "event_type": "back"}, {"condition": {"type": "column-equals", "column": "l_linestatus", "value": "O"}, "event_type": "open"}]}]}]}


def _bare(spark: SparkSession, sf_dir: str, blueprint: dict) -> tuple[Log, extract.Report]:
    shipments = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linestatus", "l_returnflag", F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("l_shipdate"))
    return extract.extract(spark, blueprint, {"shipments": shipments})


def _events_without_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _bare(spark, sf_dir, _BARE)[0]
    rows = log.events.join(log.event_attrs.select("ev_id", F.col("v.s").alias("flag")), "ev_id", "left")
    return rows.groupBy("ev_type", F.date_format("ev_time", "yyyy-MM-dd").alias("month"), "flag").agg(F.count("*").alias("n"), F.count_distinct("ev_id").alias("ids"))


QUERIES["etl_events_without_id"] = _events_without_id
SQL["etl_events_without_id"] = "SELECT l_linestatus AS ev_type, strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS month, l_returnflag AS flag, count(*) AS n, count(*) AS ids FROM lineitem WHERE l_linestatus <> '' GROUP BY 1, 2, 3"
QUERIES["etl_changes_without_id"] = lambda spark, sf_dir: _bare(spark, sf_dir, _CHANGES)[0].events.groupBy("ev_type", F.date_format("ev_time", "yyyy-MM-dd").alias("month")).agg(F.count("*").alias("n"))
SQL["etl_changes_without_id"] = "SELECT CASE WHEN l_returnflag = 'R' THEN 'back' ELSE 'open' END AS ev_type, strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS month, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'O' GROUP BY 1, 2"
QUERIES["etl_report_totals"] = lambda spark, sf_dir: _bare(spark, sf_dir, _BARE)[1].totals()
SQL["etl_report_totals"] = "SELECT 'event' AS kind, l_linestatus AS type_name, count(*) AS n FROM lineitem WHERE l_linestatus <> '' GROUP BY 2"


def _timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.date_format(F.col("o_orderdate").cast("timestamp"), "dd.MM.yyyy HH:mm").alias("t"))
    return orders.select("o_orderkey", F.date_format(extract.parse_time(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("at"), F.date_format(extract.parse_time(F.col("t"), {"type": "format-string", "format": "%d.%m.%Y %H:%M"}), "yyyy-MM-dd HH:mm:ss").alias("by_format"))


QUERIES["etl_timestamps"] = _timestamps
SQL["etl_timestamps"] = "SELECT o_orderkey, strftime(date_trunc('minute', o_orderdate), '%Y-%m-%d %H:%M:%S') AS at, strftime(date_trunc('minute', o_orderdate), '%Y-%m-%d %H:%M:%S') AS by_format FROM orders"


def _multivalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat_ws(" ,", "o_orderpriority", F.lit(""), "o_orderstatus").alias("t"))
    return orders.select("o_orderkey", F.explode(extract.split_values(F.col("t"), {"delimiter": ","})).alias("value"))


QUERIES["etl_multivalue"] = _multivalue
SQL["etl_multivalue"] = "SELECT o_orderkey, trim(o_orderpriority) AS value FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders"

# Anonymity: customers by the market segment, and by the days and priorities of their orders.
from .model import Box, event, obj  # noqa: E402

_ANON_BOX = Box(new_events={0: ["place order"]}, new_objects={0: ["customer"]}, filters=[o2e(0, 0)])
_ANON_PATTERN = Box(new_events={0: ["place order"]}, new_objects={0: ["customer"]}, filters=[o2e(0, 0)])


def _policy(k: int, diversity: int, t: float) -> anonymity.Policy:
    return anonymity.Policy([anonymity.QuasiIdentifier(_ANON_PATTERN, obj(0), event(0), "status")], ["segment"], k, diversity, t)


def _check(log: Log, k: int = 3, diversity: int = 2, t: float = 0.5) -> anonymity.Check:
    return anonymity.Check(_policy(k, diversity, t), _ANON_BOX, log)


_ANON_SQL = """WITH v AS (SELECT o_custkey AS c, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2),
f AS (SELECT c, string_agg(s || n, ',' ORDER BY s) AS fp FROM v GROUP BY 1),
m AS (SELECT f.c, f.fp, c_mktsegment AS seg FROM f JOIN customer ON c_custkey = f.c),
k AS (SELECT fp, count(*) AS size, count(DISTINCT seg) AS distinct_sensitive FROM m GROUP BY 1),
l AS (SELECT fp, seg, count(*) AS n FROM m GROUP BY 1, 2), g AS (SELECT seg, count(*) / (SELECT count(*) FROM m) AS p FROM m GROUP BY 1),
e AS (SELECT l.fp, round(1 - sum(least(l.n / k.size, g.p)), 12) AS emd FROM l JOIN k USING (fp) JOIN g USING (seg) GROUP BY 1)
"""
QUERIES["anon_classes"] = lambda spark, sf_dir: _check(star_log(spark, sf_dir)).classes().select("size", "distinct_sensitive", F.round("emd", 9).alias("emd"))
SQL["anon_classes"] = _ANON_SQL + "SELECT k.size, k.distinct_sensitive, round(e.emd, 9) AS emd FROM k JOIN e USING (fp)"
QUERIES["anon_verdict"] = lambda spark, sf_dir: _check(star_log(spark, sf_dir)).verdict().withColumns({c: F.round(c, 9) for c in ("t_min", "t_max_emd")})
SQL["anon_verdict"] = _ANON_SQL + "SELECT true AS activated, CAST(sum(size) AS BIGINT) AS protected, count(*) AS classes, bool_and(size >= 3) AS k_ok, bool_and(distinct_sensitive >= 2) AS l_ok, bool_and(emd <= 0.5) AS t_ok, min(size) AS k_max, min(distinct_sensitive) AS l_max, round(min(emd), 9) AS t_min, round(max(emd), 9) AS t_max_emd FROM k JOIN e USING (fp)"
QUERIES["anon_risk"] = lambda spark, sf_dir: _check(star_log(spark, sf_dir)).at_risk()
SQL["anon_risk"] = _ANON_SQL + "SELECT 'c-' || m.c AS id FROM m JOIN k USING (fp) WHERE size < 3"
QUERIES["anon_sensitive_risk"] = lambda spark, sf_dir: _check(star_log(spark, sf_dir)).sensitive_at_risk()
SQL["anon_sensitive_risk"] = _ANON_SQL + "SELECT DISTINCT 'segment' AS attribute, m.seg AS value FROM m JOIN k USING (fp) JOIN e USING (fp) WHERE distinct_sensitive < 2 OR emd > 0.5"

# Files: a log written and read back. Customers, what they placed and where they live.
import tempfile  # noqa: E402
import uuid  # noqa: E402

from .operators.filterlog import filter_log  # noqa: E402
from .sources import files  # noqa: E402

_LIVES = tree(box({0: ["place order"]}, {0: ["customer"], 1: ["nation"]}, [o2e(0, 0) | {"filterLabel": "INCLUDED"}, o2o(0, 1) | {"filterLabel": "INCLUDED"}]))
_LIVES["nodes"][0]["Box"][0] |= {"evVarLabels": {"0": "INCLUDED"}, "obVarLabels": {"0": "INCLUDED", "1": "INCLUDED"}}


def _written_and_read(kind: str, pick: Callable[[Log], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="weftlog-")
        path = f"{folder.rstrip('/')}/weftlog-{uuid.uuid4().hex}.{kind}"
        files.write_log(filter_log(star_log(spark, sf_dir), _LIVES), path, kind)
        return pick(files.read_log(spark, path, kind))

    return run


for _kind in ("json", "xml"):
    QUERIES[f"file_{_kind}_relations"] = _written_and_read(_kind, lambda log: log.e2o.select("ev_id", "ev_type", F.date_format("ev_time", "yyyy-MM-dd").alias("day"), "ob_id", "ob_type", "qualifier").union(log.o2o.select("src_id", "src_type", F.lit(""), "tgt_id", "tgt_type", "qualifier")))
    SQL[f"file_{_kind}_relations"] = PRELUDE + " SELECT ev_id, ev_type, strftime(ev_time, '%Y-%m-%d') AS day, ob_id, ob_type, qualifier FROM e2o WHERE ev_type = 'place order' AND ob_type = 'customer' UNION ALL SELECT src_id, src_type, '', tgt_id, tgt_type, qualifier FROM o2o WHERE src_id IN (SELECT ob_id FROM e2o WHERE ev_type = 'place order' AND ob_type = 'customer') AND tgt_type = 'nation'"
    QUERIES[f"file_{_kind}_attributes"] = _written_and_read(_kind, lambda log: log.event_attrs.groupBy("ev_type", "name").agg(F.count("*").alias("n"), F.count_distinct("ev_id").alias("events")))
    SQL[f"file_{_kind}_attributes"] = "SELECT 'place order' AS ev_type, unnest(['total', 'status', 'priority']) AS name, count(*) AS n, count(*) AS events FROM orders"
