"""The engine against nested loops written from the semantics, on seeded random logs and trees."""

import itertools
import json
import random
from datetime import datetime, timedelta

import pytest

from weftlog.log import SCHEMAS, Log
from weftlog.model import Tree, Variable, event, forest, obj
from weftlog.plans.engine import evaluate, vars_of

EVENT_TYPES, OBJECT_TYPES = ["pay", "ship", "call"], ["order", "item"]
START = datetime(2024, 1, 1)


class Data:
    """A log as Python dictionaries."""

    def __init__(self, seed):
        r = random.Random(seed)
        self.events = {f"e{i}": (r.choice(EVENT_TYPES), START + timedelta(hours=r.randrange(12))) for i in range(8)}
        self.objects = {f"x{i}": r.choice(OBJECT_TYPES) for i in range(5)}
        self.e2o = {(e, o, r.choice("qp")) for e in self.events for o in self.objects if r.random() < 0.35}
        self.o2o = {(a, b, r.choice("qp")) for a in self.objects for b in self.objects if r.random() < 0.25}
        value = lambda: r.choice([("integer", r.randrange(5)), ("float", r.random() * 5), ("string", r.choice("ab")), ("boolean", r.random() < 0.5)])
        self.event_attrs = [(e, "v", k, value()) for e in self.events for k in range(1) if r.random() < 0.7]
        self.object_attrs = [(o, "v", START + timedelta(hours=r.randrange(12)), k, value()) for o in self.objects for k in range(r.randrange(4))]

    def log(self, spark):
        fields = {"string": 1, "integer": 2, "float": 3, "boolean": 4}

        def struct(v):
            out = [v[0], None, None, None, None, None]
            out[fields[v[0]]] = v[1]
            return tuple(out)

        rows = {
            "events": [(e, t, at) for e, (t, at) in self.events.items()],
            "objects": list(self.objects.items()),
            "event_attrs": [(e, self.events[e][0], n, k, struct(v)) for e, n, k, v in self.event_attrs],
            "object_attrs": [(o, self.objects[o], n, at, k, struct(v)) for o, n, at, k, v in self.object_attrs],
            "e2o": [(e, *self.events[e], o, self.objects[o], q) for e, o, q in self.e2o],
            "o2o": [(a, self.objects[a], b, self.objects[b], q) for a, b, q in self.o2o],
            "types": [],
        }
        return Log(**{n: spark.createDataFrame(rows[n], s) for n, s in SCHEMAS.items()})


def passes(v, f):
    if v is None:
        return False
    kind, x = v
    if f["type"] in ("Float", "Integer"):
        return kind in ("integer", "float") and (f["min"] is None or x >= f["min"]) and (f["max"] is None or x <= f["max"])
    return (kind == "boolean" and x == f["is_true"]) if f["type"] == "Boolean" else kind == "string" and x in f["is_in"]


def holds(d, b, f):
    kind = f["type"]
    if kind == "NotEqual":
        x, y = Variable.parse(f["var_1"]), Variable.parse(f["var_2"])
        return x in b and y in b and (x.kind != y.kind or b[x] != b[y])
    if not vars_of(f) <= set(b):
        return False
    if kind == "O2E":
        return any((b[event(f["event"])], b[obj(f["object"])], q) in d.e2o for q in ("qp" if f["qualifier"] is None else f["qualifier"]))
    if kind == "O2O":
        return any((b[obj(f["object"])], b[obj(f["other_object"])], q) in d.o2o for q in ("qp" if f["qualifier"] is None else f["qualifier"]))
    if kind == "TimeBetweenEvents":
        s = (d.events[b[event(f["to_event"])]][1] - d.events[b[event(f["from_event"])]][1]).total_seconds()
        return (f["min_seconds"] is None or s >= f["min_seconds"]) and (f["max_seconds"] is None or s <= f["max_seconds"])
    if kind == "EventAttributeValueFilter":
        return passes(next((v for e, n, _, v in d.event_attrs if e == b[event(f["event"])] and n == f["attribute_name"]), None), f["value_filter"])
    own = [(at, k, v) for o, n, at, k, v in d.object_attrs if o == b[obj(f["object"])] and n == f["attribute_name"]]
    at = f["at_time"]
    if at["type"] == "Always":
        return all(passes(v, f["value_filter"]) for *_, v in own)
    if at["type"] == "Sometime":
        return any(passes(v, f["value_filter"]) for *_, v in own)
    known = [x for x in own if x[0] <= d.events[b[event(at["event"])]][1]]
    return bool(known) and passes(max(known, key=lambda x: x[:2])[2], f["value_filter"])


def size_holds(f, children):
    if f["type"] == "BindingSetEqual":
        sets = [{tuple(sorted((v.name, x) for v, x in b.items())) for b, _ in children[n]} for n in f["child_names"]]
        return all(s == sets[0] for s in sets)
    if f["type"] == "BindingSetProjectionEqual":
        sets = [{b.get(Variable.parse(v)) for b, _ in children[n]} for n, v in f["child_name_with_var_name"]]
        return all(s == sets[0] for s in sets)
    rows = children.get(f["child_name"])
    if rows is None:
        return False
    n = len(rows) if f["type"] == "NumChilds" else len({b[v] for b, _ in rows for v in [Variable.parse(f["var_name"])] if v in b})
    return (f["min"] is None or n >= f["min"]) and (f["max"] is None or n <= f["max"])


def constraint_holds(d, b, c, children):
    kind = c["type"]
    if kind == "Filter":
        return holds(d, b, c["filter"])
    if kind == "SizeFilter":
        return size_holds(c["filter"], children)
    sets = [children.get(n) for n in c["child_names"]]
    good = [s is not None and all(v is None for _, v in s) for s in sets]
    some = [s is not None and any(v is None for _, v in s) for s in sets]
    if kind == "SAT":
        return all(good)
    if kind == "ANY":
        return all(some)
    if kind == "NOT":
        return not all(s is None or x for s, x in zip(sets, some, strict=True))
    if kind == "OR":
        return any(s is None or x for s, x in zip(sets, good, strict=True))
    return all(s is None or x for s, x in zip(sets, good, strict=True))


def run(d, tree, i, parent, out):
    """Rows (binding, violation) of node i below a binding; out gathers them by node."""
    box = tree.nodes[i].box
    ranges = [[x for x in (d.events if v.kind == "Event" else d.objects) if (d.events[x][0] if v.kind == "Event" else d.objects[x]) in types] for v, types in box.new_vars.items()]
    rows = []
    for values in itertools.product(*ranges):
        b = {**parent, **dict(zip(box.new_vars, values, strict=True))}
        if not all(holds(d, b, f) for f in box.filters):
            continue
        below: dict = {}
        children = {tree.edge(i, c): run(d, tree, c, b, below) for c in tree.nodes[i].children}
        if not all(size_holds(f, children) for f in box.size_filters):
            continue
        violation = next((k for k, c in enumerate(box.constraints) if not constraint_holds(d, b, c, children)), None)
        rows.append((b, violation))
        for k, r in below.items():
            out.setdefault(k, []).extend(r)
    out.setdefault(i, []).extend(rows)
    return rows


def random_tree(seed):
    r = random.Random(seed)
    q = lambda: r.choice([None, None, "q", "p"])

    def filters(evs, obs):
        out = []
        for e in evs:
            if obs and r.random() < 0.8:
                out.append({"type": "O2E", "object": r.choice(obs), "event": e, "qualifier": q(), "filterLabel": None})
        if len(obs) > 1 and r.random() < 0.7:
            a, b = r.sample(obs, 2)
            out.append({"type": "O2O", "object": a, "other_object": b, "qualifier": q(), "filterLabel": None})
        if len(evs) > 1 and r.random() < 0.7:
            a, b = r.sample(evs, 2)
            out.append({"type": "TimeBetweenEvents", "from_event": a, "to_event": b, "min_seconds": r.choice([None, 0, -7200]), "max_seconds": r.choice([None, 3600 * 4])})
        if len(evs) > 1 and r.random() < 0.3:
            out.append({"type": "NotEqual", "var_1": {"Event": evs[0]}, "var_2": {"Event": evs[1]}})
        test = r.choice([{"type": "Float", "min": 1.0, "max": None}, {"type": "Integer", "min": None, "max": 3}, {"type": "String", "is_in": ["a"]}, {"type": "Boolean", "is_true": True}])
        if evs and r.random() < 0.3:
            out.append({"type": "EventAttributeValueFilter", "event": r.choice(evs), "attribute_name": "v", "value_filter": test})
        if obs and r.random() < 0.4:
            at = r.choice([{"type": "Always"}, {"type": "Sometime"}] + ([{"type": "AtEvent", "event": r.choice(evs)}] if evs else []))
            out.append({"type": "ObjectAttributeValueFilter", "object": r.choice(obs), "attribute_name": "v", "at_time": at, "value_filter": test})
        return out

    types = lambda pool: sorted(r.sample(pool, r.randrange(1, len(pool) + 1)))
    root_e, root_o = r.choice([(0, 1), (1, 1), (1, 2), (2, 1)])
    nodes = []
    kids = r.randrange(0, 3)

    def add(box, children):
        nodes.append({"Box": [box, children]})

    def make(evs, obs, new_e, new_o, names, extra_filters=True):
        size = lambda n: r.choice([{"type": "NumChilds", "child_name": n, "min": r.choice([None, 1]), "max": r.choice([None, 2])}, {"type": "NumChildsProj", "child_name": n, "var_name": r.choice([{"Event": 5}, {"Object": 0}]), "min": r.choice([None, 1]), "max": r.choice([None, 2])}])
        sizes = [size(r.choice(names))] if names and r.random() < 0.3 else []
        constraints = []
        if names:
            constraints.append({"type": r.choice(["SAT", "ANY", "NOT", "OR", "AND"]), "child_names": r.sample(names, r.randrange(1, len(names) + 1)) + (["none"] if r.random() < 0.1 else [])})
            if r.random() < 0.5:
                constraints.append({"type": "SizeFilter", "filter": size(r.choice(names))})
            if len(names) > 1 and r.random() < 0.5:
                constraints.append({"type": "SizeFilter", "filter": r.choice([{"type": "BindingSetEqual", "child_names": names[:2]}, {"type": "BindingSetProjectionEqual", "child_name_with_var_name": [[names[0], {"Event": 5}], [names[1], {"Event": 5}]]}])})
        constraints += [{"type": "Filter", "filter": f} for f in filters(evs, obs)[:1] if r.random() < 0.6]
        return {"newEventVars": {str(e): types(EVENT_TYPES) for e in new_e}, "newObjectVars": {str(o): types(OBJECT_TYPES) for o in new_o}, "filters": filters(evs, obs), "sizeFilters": sizes, "constraints": constraints}

    evs, obs = list(range(root_e)), list(range(root_o))
    add(make(evs, obs, evs, obs, [f"c{k}" for k in range(kids)]), [k + 1 for k in range(kids)])
    edges = []
    for k in range(kids):
        shadow = [0] if r.random() < 0.15 else []
        deep = r.random() < 0.4
        add(make(evs + [5], obs, [5], shadow, ["d"] if deep else []), [])
        edges.append([[0, k + 1], f"c{k}"])
    for k in range(kids):
        if "d" in json.dumps(nodes[k + 1]["Box"][0]["constraints"]) and any("d" in c.get("child_names", []) or c.get("filter", {}).get("child_name") == "d" for c in nodes[k + 1]["Box"][0]["constraints"]):
            nodes[k + 1]["Box"][1].append(len(nodes))
            edges.append([[k + 1, len(nodes)], "d"])
            add(make(evs + [5], obs + [4], [], [4], []), [])
    return {"nodes": nodes, "edgeNames": edges}


@pytest.mark.parametrize("seed", range(24))
def test_random_trees(spark, seed):
    d = Data(seed)
    tree = Tree.parse(random_tree(seed))
    out: dict = {}
    for root in tree.roots:
        run(d, tree, root, {}, out)
    result = evaluate(Tree.parse(json.loads(json.dumps(tree.to_json()))), d.log(spark))
    for i in range(len(tree.nodes)):
        df = result.node(i)
        names = [c for c in df.columns if c != "violation"]
        got = sorted((tuple(r[n] for n in names), -1 if r["violation"] is None else r["violation"]) for r in df.collect())
        want = sorted((tuple(b[Variable.named(n)] for n in names), -1 if v is None else v) for b, v in out.get(i, []))
        assert got == want, (seed, i)


def test_wire_format_and_forest():
    t = Tree.parse({"nodes": [{"Box": [{"newEventVars": {}, "newObjectVars": {"0": ["order"]}, "filters": [], "sizeFilters": [], "constraints": []}, [1]]}, {"OR": [2, 3]}, {"Box": [{}, []]}, {"NOT": 4}, {"Box": [{}, []]}], "edgeNames": [[[0, 1], "G"]]})
    assert t.roots == [0] and t.nodes[1].box.constraints == [{"type": "OR", "child_names": ["UNNAMED - 2", "UNNAMED - 3"]}]
    assert Tree.parse(t.to_json()).to_json() == t.to_json()
    two = forest([t, t])
    assert two.roots == [0, 5] and two.edge(5, 6) == "G" and two.nodes[6].box.constraints[0]["child_names"] == ["UNNAMED - 7", "UNNAMED - 8"]
    with pytest.raises(ValueError):
        Tree.parse({"nodes": [{"OR": [0]}], "edgeNames": []})


def test_pages(spark):
    log = Data(1).log(spark)
    result = evaluate({"nodes": [{"Box": [{"newEventVars": {"0": EVENT_TYPES}, "newObjectVars": {}, "filters": [], "sizeFilters": [], "constraints": [{"type": "Filter", "filter": {"type": "EventAttributeValueFilter", "event": 0, "attribute_name": "v", "value_filter": {"type": "Float", "min": 0.0, "max": None}}}]}, []]}], "edgeNames": []}, log)
    df, total = result.page(0, 1, 3, version=result.version)
    assert total == 8 and [r["e1"] for r in df.collect()] == ["e1", "e2", "e3"]
    assert result.page(0, only="violated")[1] + result.page(0, only="satisfied")[1] == 8 and result.page(0, 10, 1)[0].count() == 0
    with pytest.raises(ValueError):
        result.page(0, version=result.version + 1)
    with pytest.raises(IndexError):
        result.page(3)
