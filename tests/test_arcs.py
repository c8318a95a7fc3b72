"""Declarative arcs with labels of several associations, against nested loops."""

import itertools
import random

import pytest

from weftlog.log import Log
from weftlog.operators import declare
from weftlog.operators.declare import O2O, Arc


@pytest.fixture(scope="module")
def parts(spark):
    """A random log over types x, y, z with ties in time, several objects an event, and o2o from x to z; and its rows."""
    rng = random.Random(11)
    events = {f"e{i}": (rng.choice("abc"), rng.randrange(15)) for i in range(45)}
    e2o = sorted({(e, f"{k}{rng.randrange(4)}") for e in events for k in "xyz" for _ in range(rng.randrange(3))})
    o2o = sorted({(f"x{rng.randrange(4)}", f"z{rng.randrange(4)}") for _ in range(5)})
    rows = [(e, events[e][0], f"2024-01-01 00:00:{events[e][1]:02}", o, o[0]) for e, o in e2o]
    links = spark.createDataFrame(rows, "ev_id string, ev_type string, t string, ob_id string, ob_type string").selectExpr("ev_id", "ev_type", "cast(t as timestamp) as ev_time", "ob_id", "ob_type", "'q' as qualifier")
    none = Log.empty(spark)
    pairs = spark.createDataFrame([(a, a[0], b, b[0], "q") for a, b in o2o], none.o2o.schema)
    links = links.union(links.limit(5)).cache()  # a pair may stand twice
    return Log(links.select("ev_id", "ev_type", "ev_time").distinct(), links.select("ob_id", "ob_type").distinct(), none.event_attrs, none.object_attrs, links, pairs, none.types), events, e2o, o2o


def brute(parts, arc):
    """{(event, objects of the each associations): times of its targets}."""
    _, events, e2o, o2o = parts
    own = lambda e, k: {o for f, o in e2o if f == e and o[0] == k}

    def objects(e, of):
        if isinstance(of, str):
            return own(e, of)
        return {b if not of.reversed else a for a, b in o2o for o in own(e, of.first) if o == (b if of.reversed else a) and (a if of.reversed else b)[0] == of.second}

    def answers(o, t, e, x):
        u = events[x][1]
        if (x, o) not in e2o:
            return False
        if arc.arrow in ("DF", "DP"):
            times = [events[f][1] for f, p in e2o if p == o and (events[f][1] > t if arc.arrow == "DF" else events[f][1] < t)]
            return bool(times) and u == (min(times) if arc.arrow == "DF" else max(times))
        return arc.arrow == "AS" or (u > t if arc.arrow == "EF" else u < t)

    out = {}
    for e, (k, t) in events.items():
        found = [(how, objects(e, of)) for how, of in arc.label]
        if k != arc.source or not all(objs for _, objs in found):
            continue
        rest = [(how, objs) for how, objs in found if how != "each"]
        for binding in itertools.product(*[sorted(objs) for how, objs in found if how == "each"]):
            good = lambda x: all(answers(o, t, e, x) for o in binding) and all((all if how == "all" else any)(answers(o, t, e, x) for o in objs) for how, objs in rest)  # noqa: B023, E731
            out[(e, binding)] = [events[x][1] for x in events if x != e and events[x][0] == arc.target and good(x)]
    return out


LABELS = [
    {"all": ["x"]}, {"any": ["x"]}, {"each": ["x"], "any": ["y"]}, {"each": ["x", "y"]}, {"each": ["x"], "all": ["y"], "any": ["z"]},
    {"each": [O2O("x", "z")]}, {"any": [O2O("z", "x", True)]}, {"all": [O2O("x", "z")], "any": ["y"]},
]


@pytest.mark.parametrize("label", LABELS, ids=str)
def test_labels_against_loops(parts, label):
    every = (("AS", "a"), ("EF", "b"), ("EP", "a"), ("DF", "b"), ("DP", "b"))
    k = LABELS.index(label)
    for arrow, target in (every[k % 5], every[(k + 2) % 5]):
        arc = Arc.of("a", target, arrow, **label)
        want = brute(parts, arc)
        rows = declare.obligations(parts[0], arc).collect()
        shown = lambda r: (r["ev_id"], () if r["ob_id"] is None else (r["ob_id"], *(r["others"] if "others" in r else ())))
        assert len(rows) == len(want) and {shown(r): r["targets"] for r in rows} == {k: len(v) for k, v in want.items()}
        if arrow in ("AS", "EF", "EP"):
            times = sorted((e, 1000 * (min(v) - parts[1][e][1])) for (e, _), v in want.items() if v)
            assert sorted((r["s"], r["ms"]) for r in declare.edge_durations(parts[0], arc).collect()) == times


def test_discovery_against_loops(parts):
    log = parts[0]
    kinds = ["x", "y", "z", O2O("x", "z"), O2O("z", "x", True)]
    want, near = {}, {}
    for a, b, of, how, arrow in itertools.product("abc", "abc", kinds, ("each", "any"), ("AS", "EF", "EP")):
        got = brute(parts, Arc(a, b, arrow, how, of))
        met = sum(bool(v) for v in got.values())
        if a == b and arrow == "AS" and isinstance(of, O2O):
            near[(a, b, str(of), of.reversed, how)] = met, len(got)
        else:
            want[(a, b, str(of), how, arrow)] = met, len(got)
    got = {}
    for r in declare.arc_counts(log, ("each", "any"), "Bidirectional").collect():
        of = r["first"] if r["second"] is None else str(O2O(r["first"], r["second"], r["reversed"]))
        for arrow in ("AS", "EF", "EP"):
            got[(r["source"], r["target"], of, r["how"], arrow)] = r[arrow], r["obligations"]
    for key, (met, total) in want.items():
        assert got.get(key, (0, total)) == (met, total), key
    for (a, b, of, _, how), (met, total) in near.items():
        bound = got.get((a, b, of, how, "AS"), (0, total))
        assert bound[0] >= met and bound[1] == total
    arcs = [Arc("a", b, "EF", "all", of) for b in "ab" for of in ("x", "y")]
    share = {arc: sum(map(bool, brute(parts, arc).values())) / len(brute(parts, arc)) for arc in arcs}
    found = dict(declare.discover(log, 1 - max(share.values()), ("all",), ("EF",), activities=["a", "b"], types=["x", "y"]))
    assert found and {k: v for k, v in found.items() if k in share} == pytest.approx({k: v for k, v in share.items() if v >= max(share.values())})
    few = dict(declare.discover(log, 1.0, counts=(1, 2), arrows=("EF",), activities=["a"], types=["x"]))
    exact = {arc: sum(1 <= len(v) <= 2 for v in brute(parts, arc).values()) / len(brute(parts, arc)) for arc in (Arc(a, b, "EF", "each", "x", 1, 2) for a in "a" for b in "a")}
    assert few and few == pytest.approx(exact)
    with pytest.raises(ValueError):
        declare.discover(log, o2o_mode="Sideways")


def test_wire_format_and_text():
    arc = Arc.of("a", "b", "EF", each=["x"], any=[O2O("x", "z", True)], low=0, high=0)
    assert Arc.from_json(arc.to_json()) == arc
    assert declare.template_string([arc]) == "EF(each x & any x<z, a, b, 0, 0)"
    with pytest.raises(ValueError):
        Arc.of("a", "b", "EF")


def test_relations_side_by_side_answer_without_a_join(spark):
    rng = random.Random(5)
    rows = [(f"e{i}", rng.randrange(9), f"x{rng.randrange(3)}", rng.choice(["y0", "y1", None])) for i in range(40)]
    rows = spark.createDataFrame(rows + rows[:7], "ev_id string, at int, x string, y string").selectExpr("ev_id", "timestamp_seconds(at) AS ev_time", "x", "y").cache()  # some stand twice
    e2o = rows.selectExpr("ev_id", "'a' AS ev_type", "ev_time", "stack(2, x, 'x', y, 'y') AS (ob_id, ob_type)", "'q' AS qualifier")
    none = Log.empty(spark)
    bare, beside = (Log(none.events, none.objects, none.event_attrs, none.object_attrs, e2o, none.o2o, none.types, wide=wide) for wide in ({}, {"a": rows}))
    for arrow in ("AS", "EF", "EP"):
        arc = Arc.of("a", "a", arrow, each=["x"], all=["y"])
        got, want = ({(r["ev_id"], r["ob_id"]): r["targets"] for r in declare.obligations(log, arc).collect()} for log in (beside, bare))
        assert got == want and len(got) == 40 and any(got.values()) and declare.obligations(beside, arc).count() == 40
        first = [{r["s"]: r["ms"] for r in declare.edge_durations(log, arc).collect()} for log in (beside, bare)]
        assert first[0] == first[1] and set(first[0]) == {s for (s, _), n in got.items() if n}
        assert "Join" not in declare.obligations(beside, arc)._jdf.queryExecution().optimizedPlan().toString()


def test_a_hub_is_not_expanded_to_pairs(spark):
    n = 3000  # of one x, each with a y of its own
    e2o = spark.range(n).selectExpr("concat('e', id) AS ev_id", "'a' AS ev_type", "timestamp_seconds(id) AS ev_time", "explode(array(struct('x0' AS ob_id, 'x' AS ob_type), struct(concat('y', id % 1500) AS ob_id, 'y' AS ob_type))) AS o", "'q' AS qualifier").select("ev_id", "ev_type", "ev_time", "o.*", "qualifier")
    none = Log.empty(spark)
    df = declare.obligations(Log(none.events, none.objects, none.event_attrs, none.object_attrs, e2o, none.o2o, none.types), Arc.of("a", "a", "EF", each=["x"], all=["y"]))
    rows = df.collect()
    assert len(rows) == n and sum(r["targets"] for r in rows) == 1500
    seen, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if (at := p.metrics().get("numOutputRows")).isDefined():
            seen.append(at.get().value())
        inner = [p.executedPlan()] if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [p.plan()] if p.getClass().getSimpleName().endswith("QueryStageExec") else []
        kids = p.children()
        todo += inner + [kids.apply(i) for i in range(kids.size())]
    assert seen and max(seen) <= 3 * n


def test_conformance_counts_a_null_object_as_unanswered(spark):
    rows = spark.sql("SELECT * FROM VALUES ('e1', 1, 'x', 'y'), ('e2', 2, 'x', 'y'), ('e2', 2, 'x', 'y'), ('e3', 3, 'x', null), ('e4', 4, 'x', null) AS t(ev_id, at, x, y)").selectExpr("ev_id", "timestamp_seconds(at) AS ev_time", "x", "y")
    none = Log.empty(spark)
    log = Log(*(getattr(none, n) for n in ("events", "objects", "event_attrs", "object_attrs", "e2o", "o2o", "types")), wide={"a": rows})
    r = declare.conformance(log, Arc.of("a", "a", "EF", each=["x"], all=["y"])).first()
    assert (r["obligations"], r["satisfied"], r["fraction"]) == (4, 1, 0.25)


def test_conformance_deals_no_ids(spark):
    rows = spark.sql("SELECT * FROM VALUES ('e1', 1, 'x', 'y'), ('e2', 2, 'x', 'y'), ('e3', 2, 'x', 'y'), ('e3', 2, 'x', 'y'), (null, 2, 'x', 'y'), (null, 2, 'x', 'y') AS t(ev_id, at, x, y)").selectExpr("ev_id", "timestamp_seconds(at) AS ev_time", "x", "y")
    none = Log.empty(spark)
    log = Log(*(getattr(none, n) for n in ("events", "objects", "event_attrs", "object_attrs", "e2o", "o2o", "types")), wide={"a": rows})
    df = declare.conformance(log, Arc.of("a", "a", "EF", each=["x"], all=["y"]))
    assert "md5" in df._jdf.queryExecution().analyzed().toString()
    r = df.first()
    assert (r["obligations"], r["satisfied"]) == (4, 1)
    assert sorted(x["ev_id"] or "" for x in declare.obligations(log, Arc.of("a", "a", "EF", each=["x"], all=["y"])).collect()) == ["", "e1", "e2", "e3"]
