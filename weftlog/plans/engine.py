"""Evaluation of a query tree as DataFrame plans.

Each node becomes one frame over the inherited variables that its subtree uses and the variables it binds: joins in a
greedy order, filters as columns or semi joins, then labels, size filters and constraints over aggregates of its
children's frames. A child is evaluated once for each distinct combination of the inherited values that it uses, not for
each parent row. What a node reports is that frame joined below its parent's, so rows under a dropped parent go too.
Nothing is collected and nothing is nested: a tree is a graph of joins and aggregates that Catalyst plans as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cel
from ..log import Log
from ..model import EVENT, Box, Tree, Variable, event, obj



def time_of(v: Variable) -> str:
    return f"_t_{v.name}"


def type_of(v: Variable) -> str:
    return f"_y_{v.name}"


def columns_of(v: Variable) -> list[str]:
    return [v.name, type_of(v)] + ([time_of(v)] if v.kind == EVENT else [])


def vars_of(f: dict, box: Box | None = None) -> set[Variable]:
    """Variables that a filter or constraint uses."""
    kind = f["type"]
    if kind == "O2E":
        return {obj(f["object"]), event(f["event"])}
    if kind == "O2O":
        return {obj(f["object"]), obj(f["other_object"])}
    if kind == "TimeBetweenEvents":
        return {event(f["from_event"]), event(f["to_event"])}
    if kind == "NotEqual":
        return {Variable.parse(f["var_1"]), Variable.parse(f["var_2"])}
    if kind == "EventAttributeValueFilter":
        return {event(f["event"])}
    if kind == "ObjectAttributeValueFilter":
        at = f["at_time"]
        return {obj(f["object"])} | ({event(at["event"])} if at["type"] == "AtEvent" else set())
    if kind in ("BasicFilterCEL", "AdvancedCEL"):
        return cel_vars(f["cel"])
    if kind == "Filter":
        return vars_of(f["filter"])
    if kind == "SizeFilter":
        return vars_of(f["filter"])
    return set()


def cel_vars(text: str) -> set[Variable]:
    return {Variable.named(n) for n in cel.names_in(text) if n[0] in "eo" and n[1:].isdigit() and int(n[1:]) > 0}


def value_passes(v: Column, f: dict) -> Column:
    """A value filter on a tagged value; other types and null are false."""
    kind, ok = f["type"], F.lit(True)
    if kind in ("Float", "Integer"):
        x = F.coalesce(v["d"], v["i"].cast("double"))
        ok = x.isNotNull()
        if f.get("min") is not None:
            ok = ok & (x >= float(f["min"]))
        if f.get("max") is not None:
            ok = ok & (x <= float(f["max"]))
    elif kind == "Boolean":
        ok = v["b"] == F.lit(bool(f["is_true"]))
    elif kind == "String":
        ok = v["s"].isin(list(f["is_in"])) if f["is_in"] else F.lit(False)
    elif kind == "Time":
        ok = _time_passes(v["ts"], f)
    else:
        raise ValueError(f"unknown value filter {kind}")
    return F.coalesce(ok, F.lit(False))


def _time_passes(t: Column, f: dict) -> Column:
    ok = t.isNotNull()
    for key, test in (("from", lambda b: t >= b), ("to", lambda b: t <= b)):
        if f.get(key) is not None:
            ok = ok & test(F.to_timestamp(F.lit(f[key])))
    return F.coalesce(ok, F.lit(False))


def window_passes(f: dict) -> Column:
    a, b = time_of(event(f["from_event"])), time_of(event(f["to_event"]))
    seconds = (F.unix_micros(F.col(b)) - F.unix_micros(F.col(a))) / F.lit(1e6)
    ok = F.lit(True)
    if f.get("min_seconds") is not None:
        ok = ok & (seconds >= float(f["min_seconds"]))
    if f.get("max_seconds") is not None:
        ok = ok & (seconds <= float(f["max_seconds"]))
    return F.coalesce(ok, F.lit(False))


@dataclass
class Frame:
    """Rows of bindings; types: the types a bound variable may have (None: any); extra counts helper columns."""

    df: DataFrame | None
    types: dict[Variable, list[str] | None]
    log: Log
    extra: int = 0
    values: dict[tuple, str] = field(default_factory=dict)

    def fresh(self) -> str:
        self.extra += 1
        return f"_x{self.extra}"

    # Binding steps.

    def scan(self, v: Variable) -> DataFrame:
        df = self.log.events if v.kind == EVENT else self.log.objects
        ident, kind = ("ev_id", "ev_type") if v.kind == EVENT else ("ob_id", "ob_type")
        if self.types[v] is not None:
            df = df.where(F.col(kind).isin(self.types[v]))
        more = [F.col("ev_time").alias(time_of(v))] if v.kind == EVENT else []
        return df.select(F.col(ident).alias(v.name), F.col(kind).alias(type_of(v)), *more)

    def bind(self, v: Variable, windows: list[dict]) -> None:
        """Enumerate a variable; a closed time window to a bound event is an equi-join on time buckets."""
        own = self.scan(v)
        if self.df is None:
            self.df = own
            return
        for f in windows:
            a, b = event(f["from_event"]), event(f["to_event"])
            low, high = f.get("min_seconds"), f.get("max_seconds")
            if low is not None and high is not None and high >= low:
                other, (lo, hi) = (a, (low, high)) if v == b else (b, (-high, -low))
                self._bucketed(v, own, other, float(lo), float(hi))
                return
        self.df = self.df.crossJoin(own)

    def _bucketed(self, v: Variable, own: DataFrame, other: Variable, low: float, high: float) -> None:
        """Events with time in [other + low, other + high]: each bound row asks the buckets that its window touches."""
        width = max(high - low, 1.0)
        seconds = F.unix_micros(F.col(time_of(other))) / F.lit(1e6)
        first, last = (F.floor((seconds + x) / width) for x in (low - 1e-6, high + 1e-6))
        asked = self.df.withColumn("_bucket", F.explode(F.sequence(first, last)))
        own = own.withColumn("_bucket", F.floor(F.unix_micros(F.col(time_of(v))) / F.lit(1e6) / width))
        self.df = asked.join(own, "_bucket").drop("_bucket")

    def bind_related(self, v: Variable, f: dict) -> None:
        """Bind a variable from one that is bound, by an equi-join on the distinct pairs of the relation."""
        relation, keys, (left, right) = self._relation(f)
        new_left = v == left
        bound = right if new_left else left
        own, other = keys if new_left else keys[::-1]
        more = ["ev_type", "ev_time"] if relation == "e2o" and new_left else [{"ob_id": "ob_type", "src_id": "src_type", "tgt_id": "tgt_type"}[own]]
        pairs = self.log.pairs(relation, keys, f.get("qualifier"), self.types[left], self.types[right], *more)
        new = [F.col(own).alias(v.name), F.col(more[0]).alias(type_of(v))] + ([F.col("ev_time").alias(time_of(v))] if v.kind == EVENT else [])
        pairs = pairs.select(F.col(other).alias(bound.name), *new)
        self.df = self.df.join(pairs, bound.name)

    def _relation(self, f: dict) -> tuple[str, tuple[str, str], tuple[Variable, Variable]]:
        if f["type"] == "O2E":
            return "e2o", ("ev_id", "ob_id"), (event(f["event"]), obj(f["object"]))
        return "o2o", ("src_id", "tgt_id"), (obj(f["object"]), obj(f["other_object"]))

    # Predicates: a column that is never null. Helper columns may be joined on.

    def holds(self, f: dict) -> Column:
        kind = f["type"]
        missing = [v for v in vars_of(f) if v not in self.types]
        if missing and kind != "NotEqual":
            return F.lit(False)
        if kind in ("O2E", "O2O"):
            relation, keys, (left, right) = self._relation(f)
            flag = self.fresh()
            pairs = self.log.pairs(relation, keys, f.get("qualifier"), self.types[left], self.types[right])
            if left == right:
                pairs = pairs.where(F.col(keys[0]) == F.col(keys[1])).select(F.col(keys[0]).alias(left.name), F.lit(True).alias(flag))
                self.df = self.df.join(pairs, left.name, "left")
            else:
                pairs = pairs.select(F.col(keys[0]).alias(left.name), F.col(keys[1]).alias(right.name), F.lit(True).alias(flag))
                self.df = self.df.join(pairs, [left.name, right.name], "left")
            return F.coalesce(F.col(flag), F.lit(False))
        if kind == "TimeBetweenEvents":
            return window_passes(f)
        if kind == "NotEqual":
            a, b = Variable.parse(f["var_1"]), Variable.parse(f["var_2"])
            if a not in self.types or b not in self.types:
                return F.lit(False)
            return F.lit(True) if a.kind != b.kind else F.coalesce(F.col(a.name) != F.col(b.name), F.lit(False))
        if kind == "EventAttributeValueFilter":
            return self._event_attribute(event(f["event"]), f["attribute_name"], f["value_filter"])
        if kind == "ObjectAttributeValueFilter":
            return self._object_attribute(f)
        if kind == "BasicFilterCEL":
            return cel.predicate(f["cel"], self.scope(f["cel"]))
        raise ValueError(f"unknown filter {kind}")

    def _event_attribute(self, v: Variable, name: str, f: dict) -> Column:
        if name == "ocel:id":
            return F.col(v.name).isin(list(f["is_in"])) if f["type"] == "String" and f["is_in"] else F.lit(False)
        if name == "ocel:time":
            return _time_passes(F.col(time_of(v)), f) if f["type"] == "Time" else F.lit(False)
        return value_passes(F.col(self.value(v, name)), f)

    def value(self, v: Variable, name: str, which: str = "listed") -> str:
        """A column with an attribute's value: an event's first, an object's first listed."""
        key = (v, name, which)
        if key not in self.values:
            column = self.values[key] = self.fresh()
            ident = "ev_id" if v.kind == EVENT else "ob_id"
            found = self.log.event_values(name) if v.kind == EVENT else self.log.object_values(name, which)
            self.df = self.df.join(found.select(F.col(ident).alias(v.name), F.col("v").alias(column)), v.name, "left")
        return self.values[key]

    def _history(self, name: str) -> DataFrame:
        return self.log.object_attrs.where(F.col("name") == name)

    def _object_attribute(self, f: dict) -> Column:
        v, name, at, test = obj(f["object"]), f["attribute_name"], f["at_time"], f["value_filter"]
        if name == "ocel:id":
            return F.col(v.name).isin(list(test["is_in"])) if test["type"] == "String" and test["is_in"] else F.lit(False)
        if at["type"] == "AtEvent":
            return value_passes(F.col(self.value_at(v, name, F.col(time_of(event(at["event"]))), (event(at["event"]),))), test)
        flag = self.fresh()
        passes = value_passes(F.col("v"), test)
        seek = ~passes if at["type"] == "Always" else passes
        found = self._history(name).where(seek).select(F.col("ob_id").alias(v.name)).distinct().withColumn(flag, F.lit(True))
        self.df = self.df.join(found, v.name, "left")
        there = F.coalesce(F.col(flag), F.lit(False))
        return ~there if at["type"] == "Always" else there

    def value_at(self, v: Variable, name: str, at: Column, by: tuple[Variable, ...]) -> str:
        """An object's latest value up to a time: an as-of join over the distinct objects and times that are asked for."""
        column, stamp = self.fresh(), self.fresh()
        self.df = self.df.withColumn(stamp, at)
        asked = self.df.select(v.name, stamp).distinct()
        known = self._history(name).select(F.col("ob_id").alias(v.name), "time", "seq", "v")
        found = asked.join(known, v.name).where(F.col("time") <= F.col(stamp)).groupBy(v.name, stamp).agg(F.max_by("v", F.struct("time", "seq")).alias(column))
        self.df = self.df.join(found, [v.name, stamp], "left")
        return column

    def scope(self, text: str, sets: dict[str, cel.Typed] | None = None, labels: dict[str, cel.Typed] | None = None) -> cel.Scope:
        """What an expression can name; the attributes that it reads are joined on first."""
        names = {v.name: cel.Typed(F.col(v.name), "event" if v.kind == EVENT else "object") for v in self.types}
        for fn, var, attribute in cel.attributes_in(text):
            if fn == "attr" and var in names:
                self.value(Variable.named(var), attribute)

        def attr(name: str, attribute: str) -> Column:
            key = (Variable.named(name), attribute, "listed")
            if key not in self.values:
                raise cel.CelError("attr() needs a variable and a literal name")
            return F.col(self.values[key])

        def attr_at(name: str, attribute: str, at: Column) -> Column:
            v = Variable.named(name)
            return F.col(self.value(v, attribute)) if v.kind == EVENT else F.col(self.value_at(v, attribute, at, ()))

        def attrs(name: str) -> Column:
            v, column = Variable.named(name), self.fresh()
            ident = "ev_id" if v.kind == EVENT else "ob_id"
            source = self.log.event_attrs.withColumn("time", F.lit(None).cast("timestamp")) if v.kind == EVENT else self.log.object_attrs
            own = source.groupBy(F.col(ident).alias(v.name)).agg(F.array_sort(F.collect_list(F.struct("seq", "name", "time", "v"))).alias(column))
            self.df = self.df.join(own, v.name, "left")
            return F.transform(F.col(column), lambda x: F.struct(x["name"].alias("name"), x["v"].alias("value"), x["time"].alias("time")))

        def listed(what: str) -> Column:
            if (what,) not in self.values:
                column = self.values[(what,)] = self.fresh()
                self.df = self.df.crossJoin(F.broadcast(self.log.listed(what).select(F.col("elements").alias(column))))  # one row
            return F.col(self.values[(what,)])

        def fact(name: str, what: str) -> Column:
            return F.col(f"_{'y' if what == 'type' else 't'}_{name}")

        return cel.Scope({**names, **(labels or {}), **(sets or {})}, attr, attr_at, attrs, fact, lambda what: getattr(self.log, what).count(), listed)


def binding_order(box: Box, inherited: set[Variable]) -> list[tuple[Variable, dict | None]]:
    """New variables with the relation filter that binds each (None: enumerated). Related to bound ones first; a start is
    the variable with most relations, an object rather than an event."""
    left = dict(box.new_vars)
    relations = [f for f in box.filters if f["type"] in ("O2E", "O2O") and len(vars_of(f)) == 2]
    degree = {v: sum(v in vars_of(f) for f in relations) for v in left}
    bound, out = set(inherited), []
    while left:
        best = None
        for f in relations:
            own = vars_of(f)
            new = [v for v in own if v in left]
            if len(new) == 1 and (own - {new[0]}) <= bound:
                rank = (f.get("qualifier") is None, -degree[new[0]], new[0])
                if best is None or rank < best[0]:
                    best = (rank, new[0], f)
        if best:
            _, v, f = best
        else:
            v, f = min(left, key=lambda v: (-degree[v], v.kind == EVENT, v)), None
        out.append((v, f))
        bound.add(v)
        del left[v]
    return out


@dataclass
class NodeResult:
    """own: the node's frame by the inherited values it uses; full: its bindings below surviving parents, as variable
    and label columns and violation (index of the first violated constraint, null if satisfied)."""

    own: DataFrame
    refs: list[Variable]
    types: dict[Variable, list[str] | None]
    label_kinds: dict[str, str]
    full: DataFrame | None = None
    visible: list[Variable] = field(default_factory=list)


class Evaluation:
    def __init__(self, tree: Tree, log: Log, seeds: DataFrame | None = None, seed_types: dict[Variable, list[str] | None] | None = None):
        self.tree, self.log, self.seeds, self.seed_types = tree, log, seeds, seed_types or {}
        self.results: dict[int, NodeResult] = {}
        #: node, step, variable, how it is bound, and the frame after that step and the filters that it completes.
        self.steps: list[tuple[int, int, str, str, DataFrame]] = []
        parents = tree.parents()
        for root in tree.roots:
            self._evaluate(root, dict(self.seed_types), seeds)
        for i in self._top_down():
            r, p = self.results[i], parents.get(i)
            if p is None:
                r.full, r.visible = r.own, [*r.refs, *[v for v in tree.nodes[i].box.new_vars if v not in r.refs]]
                continue
            up = self.results[p]
            new = tree.nodes[i].box.new_vars
            kept = [v for v in up.visible if v not in new]
            above = up.full.select(*[c for v in kept for c in columns_of(v)])
            names = [v.name for v in r.refs]
            own = r.own.drop(*[c for v in r.refs for c in columns_of(v) if c != v.name])
            r.full = above.join(own, names) if names else above.crossJoin(own)
            r.visible = kept + list(new)

    def _top_down(self) -> list[int]:
        order, todo = [], list(self.tree.roots)
        while todo:
            i = todo.pop(0)
            order.append(i)
            todo += self.tree.nodes[i].children
        return order

    def _uses(self, i: int) -> set[Variable]:
        """Inherited variables that a node's subtree uses."""
        node = self.tree.nodes[i]
        box = node.box
        own: set[Variable] = set()
        for f in [*box.filters, *box.size_filters, *box.constraints]:
            own |= vars_of(f)
        for x in box.labels:
            own |= cel_vars(x["cel"])
        named = {x for f in [*box.size_filters, *[c.get("filter", {}) for c in box.constraints]] for x in projected(f)}
        for c in node.children:
            own |= self._uses(c)
            name = self.tree.edge(i, c)
            own |= {v for n, v in named if n == name}
            if any(n == name and v is None for n, v in named):  # whole bindings are compared
                own |= set(self.tree.nodes[c].box.new_vars)
        return own - set(box.new_vars)

    def _evaluate(self, i: int, inherited: dict[Variable, list[str] | None], start: DataFrame | None) -> NodeResult:
        node, box = self.tree.nodes[i], self.tree.nodes[i].box
        # A node without a parent keeps all that it is given; a child only what it uses.
        refs = sorted(v for v in inherited if i in self.tree.roots or v in self._uses(i))
        types = {v: inherited[v] for v in refs}
        df = start.select(*[c for v in refs for c in columns_of(v)]).distinct() if start is not None and refs else None
        frame = Frame(df, types, self.log)
        done: list[dict] = []
        for step, (v, f) in enumerate(binding_order(box, set(refs))):
            frame.types[v] = box.new_vars[v]
            if f is not None:
                frame.bind_related(v, f)
                done.append(f)
            else:
                windows = [w for w in box.filters if w["type"] == "TimeBetweenEvents" and v in vars_of(w) and len(vars_of(w)) == 2 and vars_of(w) - {v} <= set(frame.types)]
                frame.bind(v, windows)
            self._filters(frame, box, done)
            self.steps.append((i, step, v.name, f["type"] if f else "scan", frame.df))
        if frame.df is None:  # nothing is bound and nothing is used from above: one empty binding
            frame.df = self.log.spark.range(1).select()
        self._filters(frame, box, done)
        return self._finish(i, frame, refs)

    def _filters(self, frame: Frame, box: Box, done: list[dict]) -> None:
        """Every filter as soon as its variables are bound."""
        for f in box.filters:
            if not any(f is x for x in done) and frame.df is not None and vars_of(f) <= set(frame.types):
                done.append(f)
                ok = frame.holds(f)  # may join on to the frame
                frame.df = frame.df.where(ok)

    def _finish(self, i: int, frame: Frame, refs: list[Variable]) -> NodeResult:
        """Children, then labels, size filters and constraints."""
        node, box = self.tree.nodes[i], self.tree.nodes[i].box
        leftover = [f for f in box.filters if not vars_of(f) <= set(frame.types) and f["type"] != "BasicFilterCEL"]
        if leftover:
            frame.df = frame.df.where(F.lit(False))
        # Without sets to compare, a frame is what its variables say; children start from it.
        children = {self.tree.edge(i, c): self._evaluate(c, dict(frame.types), frame.df) for c in node.children}
        sets = Children(frame, children, {self.tree.edge(i, c): self.tree.nodes[c].box for c in node.children})
        labels: dict[str, cel.Typed] = {}
        kinds: dict[str, str] = {}
        for x in box.labels:
            names = sets.typed(cel.names_in(x["cel"]))
            col = cel.label(x["cel"], frame.scope(x["cel"], names, labels))  # may join on to the frame
            frame.df = frame.df.withColumn(x["label"], col)
            kind = {"bigint": "int", "double": "double", "boolean": "bool"}.get(frame.df.schema[x["label"]].dataType.simpleString(), "string")
            labels[x["label"]], kinds[x["label"]] = cel.Typed(F.col(x["label"]), kind), kind
        for f in box.size_filters:
            ok = sets.holds(f, labels)
            frame.df = frame.df.where(ok)
        violated = []
        for k, c in enumerate(box.constraints):
            ok = frame.holds(c["filter"]) if c["type"] == "Filter" else sets.holds(c["filter"], labels) if c["type"] == "SizeFilter" else sets.satisfied(c)
            violated.append(F.when(~ok, F.lit(k)))
        violation = F.coalesce(*violated) if violated else F.lit(None).cast("int")
        own = [c for v in frame.types for c in columns_of(v)]
        df = frame.df.select(*own, *labels, violation.cast("int").alias("violation"))
        r = self.results[i] = NodeResult(df, refs, dict(frame.types), kinds)
        return r


def projected(f: dict) -> list[tuple[str, Variable | None]]:
    """(child name, variable) that a size filter reads of child sets; None: whole bindings."""
    kind = f.get("type")
    if kind == "SizeFilter":
        return projected(f["filter"])
    if kind == "NumChildsProj":
        return [(f["child_name"], Variable.parse(f["var_name"]))]
    if kind == "BindingSetEqual":
        return [(n, None) for n in f["child_names"]]
    if kind == "BindingSetProjectionEqual":
        return [(n, Variable.parse(v)) for n, v in f["child_name_with_var_name"]]
    if kind == "AdvancedCEL":
        return [(n, None) for n in cel.names_in(f["cel"])]
    return []


class Children:
    """Aggregates of a node's child sets, joined to its frame as they are asked for."""

    def __init__(self, frame: Frame, results: dict[str, NodeResult], boxes: dict[str, Box]):
        self.frame, self.results, self.boxes = frame, results, boxes
        self.known: dict[tuple, str] = {}

    def _joined(self, name: str, key: tuple, column: Column) -> str:
        """A column of the frame with an aggregate over the child rows of each row; null where there are none."""
        if (name, *key) not in self.known:
            out = self.known[(name, *key)] = self.frame.fresh()
            r = self.results[name]
            refs = [v.name for v in r.refs]
            if refs:
                self.frame.df = self.frame.df.join(r.own.groupBy(*refs).agg(column.alias(out)), refs, "left")
            else:
                self.frame.df = self.frame.df.crossJoin(F.broadcast(r.own.agg(column.alias(out))))  # one row
        return self.known[(name, *key)]

    def _count(self, name: str, key: tuple, column: Column) -> Column:
        return F.coalesce(F.col(self._joined(name, key, column)), F.lit(0))

    def count(self, name: str) -> Column:
        return self._count(name, ("n",), F.count("*"))

    def violated(self, name: str) -> Column:
        return self._count(name, ("violated",), F.count("violation"))

    def satisfied_count(self, name: str) -> Column:
        return self._count(name, ("satisfied",), F.count(F.when(F.col("violation").isNull(), 1)))

    def _element(self, name: str, v: Variable) -> Column | None:
        """A variable of a child's binding, as a column of the child's frame; None: it is the parent's own."""
        return F.col(v.name) if v in self.results[name].types else None

    def _set(self, name: str, vs: list[Variable], labels: list[str]) -> Column:
        """The sorted set of a child's bindings over some variables and labels."""
        r = self.results[name]
        parts = [(F.col(v.name) if v in r.types else F.lit(None).cast("string")).alias(v.name) for v in vs]
        parts += [(F.col(x).cast("string") if x in r.label_kinds else F.lit(None).cast("string")).alias(x) for x in labels]
        made = F.col(self._joined(name, ("set", tuple(vs), tuple(labels)), F.array_sort(F.collect_set(F.struct(*parts)))))
        return F.coalesce(F.transform(made, lambda x: F.to_json(x)), F.array().cast("array<string>"))

    def holds(self, f: dict, labels: dict[str, cel.Typed]) -> Column:
        kind = f["type"]
        if kind in ("NumChilds", "NumChildsProj"):
            name = f["child_name"]
            if name not in self.results:
                return F.lit(False)
            n = self.count(name) if kind == "NumChilds" else self._distinct(name, Variable.parse(f["var_name"]))
            return F.lit(True) & (n >= f["min"] if f.get("min") is not None else F.lit(True)) & (n <= f["max"] if f.get("max") is not None else F.lit(True))
        if kind == "BindingSetEqual":
            names = f["child_names"]
            if any(n not in self.results for n in names):
                return F.lit(False)
            vs = sorted({v for n in names for v in self.boxes[n].new_vars})
            said = sorted({x for n in names for x in self.results[n].label_kinds})
            return self._equal([self._set(n, vs, said) for n in names])
        if kind == "BindingSetProjectionEqual":
            pairs = [(n, Variable.parse(v)) for n, v in f["child_name_with_var_name"]]
            if any(n not in self.results for n, _ in pairs):
                return F.lit(False)
            return self._equal([self._projection(n, v) for n, v in pairs])
        if kind == "AdvancedCEL":
            return cel.predicate(f["cel"], self.frame.scope(f["cel"], self.typed(cel.names_in(f["cel"])), labels))
        raise ValueError(f"unknown size filter {kind}")

    def _distinct(self, name: str, v: Variable) -> Column:
        if v in self.results[name].types:
            return self._count(name, ("distinct", v), F.count_distinct(F.col(v.name)))
        there = v in self.frame.types  # the parent's own value, once if the set has rows
        return F.when(self.count(name) > 0, F.lit(1 if there else 0)).otherwise(F.lit(0))

    def _projection(self, name: str, v: Variable) -> Column:
        if v in self.results[name].types:
            one = F.coalesce(F.col(v.name), F.lit("\u0000"))
            found = F.col(self._joined(name, ("values", v), F.array_sort(F.collect_set(one))))
            return F.coalesce(found, F.array().cast("array<string>"))
        own = F.col(v.name) if v in self.frame.types else F.lit("\u0000")
        return F.when(self.count(name) > 0, F.array(own)).otherwise(F.array().cast("array<string>"))

    def _equal(self, sets: list[Column]) -> Column:
        return reduce(lambda a, b: a & b, [sets[0] == s for s in sets[1:]], F.lit(True))

    def satisfied(self, c: dict) -> Column:
        """SAT, ANY, NOT, OR, AND over named children."""
        kind, names = c["type"], c["child_names"]
        known = [n for n in names if n in self.results]
        unknown = len(known) < len(names)
        every = lambda tests: reduce(lambda a, b: a & b, tests, F.lit(True))
        if kind == "SAT":
            return F.lit(not unknown) & every([self.violated(n) == 0 for n in known])
        if kind == "ANY":
            return F.lit(not unknown) & every([self.satisfied_count(n) > 0 for n in known])
        if kind == "NOT":
            return ~every([self.satisfied_count(n) > 0 for n in known])
        if kind == "OR":
            return reduce(lambda a, b: a | b, [self.violated(n) == 0 for n in known], F.lit(unknown))
        if kind == "AND":
            return every([self.violated(n) == 0 for n in known])
        raise ValueError(f"unknown constraint {kind}")

    def typed(self, wanted: set[str]) -> dict[str, cel.Typed]:
        """The child sets among some names as lists of maps."""
        out = {}
        for name in wanted & set(self.results):
            r = self.results[name]
            fields = {v.name: "event" if v.kind == EVENT else "object" for v in r.types} | r.label_kinds | {"satisfied": "bool"}
            parts = [F.col(c).alias(c) for c in fields if c != "satisfied"] + [F.col("violation").isNull().alias("satisfied")]
            col = F.col(self._joined(name, ("list",), F.collect_list(F.struct(*parts))))
            empty = F.array().cast(f"array<struct<{','.join(f'{c}:{dict(int='bigint', double='double', bool='boolean').get(k, 'string')}' for c, k in fields.items())}>>")
            out[name] = cel.Typed(F.coalesce(col, empty), ("list", ("map", fields)))
        return out


@dataclass
class EvalResult:
    tree: Tree
    evaluation: Evaluation
    version: int = 0

    def node(self, i: int) -> DataFrame:
        """Bindings of a node: a column for each variable and label, and violation."""
        r = self.evaluation.results[i]
        return r.full.select(*[v.name for v in sorted(r.visible)], *r.label_kinds, "violation")

    def capped(self, i: int, most: int) -> tuple[DataFrame, bool]:
        """At most so many of a node's bindings, and whether there are more. Nothing is capped unless asked."""
        df = self.node(i)
        return df.limit(most), df.limit(most + 1).count() > most

    def summary(self) -> DataFrame:
        """Situations and violated situations of each node."""
        parts = [self.node(i).agg(F.count("*").alias("situations"), F.count("violation").alias("violated")).select(F.lit(i).alias("node"), "situations", "violated") for i in sorted(self.evaluation.results)]
        return reduce(DataFrame.union, parts)

    def profile(self) -> DataFrame:
        """node, step, variable, bound_by, n (rows after the step) and factor (n by that of the step before in the node)."""
        counts = [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("node"), F.lit(k).alias("step"), F.lit(v).alias("variable"), F.lit(how).alias("bound_by"), "n") for i, k, v, how, df in self.evaluation.steps]
        if not counts:
            return self.evaluation.log.spark.createDataFrame([], "node int, step int, variable string, bound_by string, n long, factor double")
        before = F.lag("n").over(Window.partitionBy("node").orderBy("step"))  # a row a step
        return reduce(DataFrame.union, counts).withColumn("factor", F.try_divide(F.col("n").cast("double"), before))

    def page(self, node: int, offset: int = 0, limit: int = 100, only: str | None = None, version: int | None = None, most: int = 1000) -> tuple[DataFrame, int]:
        """A page of a node's bindings in the order of its columns, and the total: all, only "violated" or "satisfied"."""
        if version is not None and version != self.version:
            raise ValueError("the result is no longer current")
        if node not in self.evaluation.results:
            raise IndexError(f"no node {node}")
        df = self.node(node)
        if only:
            df = df.where(F.col("violation").isNotNull() if only == "violated" else F.col("violation").isNull())
        return df.orderBy(*[c for c in df.columns if c != "violation"]).offset(offset).limit(min(limit, most)), df.count()


_VERSION = [0]


def evaluate(tree: Tree | dict | str, log: Log, seeds: DataFrame | None = None, seed_types: dict | None = None) -> EvalResult:
    """Lazy plans for all nodes of a tree. seeds: rows of variables that the root inherits, with their columns_of()."""
    tree = tree if isinstance(tree, Tree) else Tree.parse(tree)
    _VERSION[0] += 1
    return EvalResult(tree, Evaluation(tree, log, seeds, seed_types), _VERSION[0])
