"""Discovery of constraints from a log: counts of related elements, eventually-follows delays, and either-or pairs.

Aggregates are DataFrames; what comes to the driver is histograms of small numbers by type, of which ranges are chosen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..log import Log
from ..plans.engine import columns_of, evaluate

#: Instances from which a sample is taken, its share, and its seed.
SAMPLE_FROM, SAMPLE_SHARE, SAMPLE_SEED = 3000, 0.1, 13375050
#: Mean counts beyond which a relation says little; steps of a range search.
MOST_MEAN, MOST_STEPS = 30, 1000


@dataclass(frozen=True)
class CountConstraint:
    """Elements of a type that an instance of another type relates to: low to high (None: open)."""

    instance: tuple[str, str]
    direction: str
    related: str
    low: int
    high: int | None

    @property
    def name(self) -> str:
        if self.low == self.high:
            n = f"={self.low}"
        elif self.high is None:
            n = f"≥{self.low}" if self.low else "any number of"
        else:
            n = f"{self.low}-{self.high}" if self.low else f"≤{self.high}"
        return f"{n} '{self.related}' per '{self.instance[1]}'"

    def to_tree(self) -> dict:
        """A root that binds the instance, a child that binds what it relates to, and a count on the child."""
        kind, own = self.instance
        if kind == "event":
            root, child = {"newEventVars": {"0": [own]}, "newObjectVars": {}}, {"newEventVars": {}, "newObjectVars": {"1": [self.related]}, "filters": [{"type": "O2E", "object": 1, "event": 0, "qualifier": None}]}
        elif self.direction == "e2o reversed":
            root, child = {"newEventVars": {}, "newObjectVars": {"0": [own]}}, {"newEventVars": {"1": [self.related]}, "newObjectVars": {}, "filters": [{"type": "O2E", "object": 0, "event": 1, "qualifier": None}]}
        else:
            a, b = (0, 1) if self.direction == "o2o" else (1, 0)
            root, child = {"newEventVars": {}, "newObjectVars": {"0": [own]}}, {"newEventVars": {}, "newObjectVars": {"1": [self.related]}, "filters": [{"type": "O2O", "object": a, "other_object": b, "qualifier": None}]}
        count = {"type": "SizeFilter", "filter": {"type": "NumChilds", "child_name": "A", "min": self.low, "max": self.high}}
        return {"nodes": [{"Box": [{**root, "filters": [], "sizeFilters": [], "constraints": [count]}, [1]]}, {"Box": [{**child, "sizeFilters": [], "constraints": []}, []]}], "edgeNames": [[[0, 1], "A"]]}


@dataclass(frozen=True)
class FollowConstraint:
    """An event of a type is followed by one of another on the same object within low to high seconds."""

    object_type: str
    first: str
    then: str
    low: float
    high: float

    @property
    def name(self) -> str:
        return f"'{self.first}' → '{self.then}' for '{self.object_type}'"

    def to_tree(self) -> dict:
        child = {"newEventVars": {"1": [self.then]}, "newObjectVars": {}, "filters": [{"type": "O2E", "object": 0, "event": 1, "qualifier": None}, {"type": "TimeBetweenEvents", "from_event": 0, "to_event": 1, "min_seconds": self.low, "max_seconds": self.high}], "sizeFilters": [], "constraints": []}
        root = {"newEventVars": {"0": [self.first]}, "newObjectVars": {"0": [self.object_type]}, "filters": [{"type": "O2E", "object": 0, "event": 0, "qualifier": None}], "sizeFilters": [], "constraints": [{"type": "SizeFilter", "filter": {"type": "NumChilds", "child_name": "A", "min": 1, "max": None}}]}
        return {"nodes": [{"Box": [root, [1]]}, {"Box": [child, []]}], "edgeNames": [[[0, 1], "A"]]}


def instances(log: Log, kind: str, name: str) -> DataFrame:
    """id of the instances of a type: all, or of many a share by hash."""
    df = log.events.where(F.col("ev_type") == name).select(F.col("ev_id").alias("id")) if kind == "event" else log.objects.where(F.col("ob_type") == name).select(F.col("ob_id").alias("id"))
    n = df.count()
    if n < SAMPLE_FROM:
        return df
    return df.orderBy(F.xxhash64("id", F.lit(SAMPLE_SEED)), "id").limit(math.ceil(n * SAMPLE_SHARE))


def symmetric(log: Log, kind: str) -> DataFrame:
    """id, direction, related (type), other (id): an event's objects; an object's objects both ways and its events."""
    e2o = log.e2o.select("ev_id", "ev_type", "ob_id", "ob_type").distinct()
    if kind == "event":
        return e2o.select(F.col("ev_id").alias("id"), F.lit("e2o").alias("direction"), F.col("ob_type").alias("related"), F.col("ob_id").alias("other"))
    o2o = log.o2o.select("src_id", "src_type", "tgt_id", "tgt_type").distinct()
    return (
        o2o.select(F.col("src_id").alias("id"), F.lit("o2o").alias("direction"), F.col("tgt_type").alias("related"), F.col("tgt_id").alias("other"))
        .union(e2o.select("ob_id", F.lit("e2o reversed"), "ev_type", "ev_id"))
        .union(o2o.select("tgt_id", F.lit("o2o reversed"), "src_type", "src_id"))
    )


def count_histograms(log: Log, kind: str, name: str, only: DataFrame | None = None) -> tuple[int, dict[tuple[str, str], dict[int, int]]]:
    """The number of instances, and for each direction and type how many have each count. Instances without any count as
    zero, but for an object's events, of which only objects that have some count."""
    own = only if only is not None else instances(log, kind, name)
    total = own.count()
    n = symmetric(log, kind).join(own, "id", "left_semi").groupBy("direction", "related", "id").agg(F.count("*").alias("n"))
    out: dict[tuple[str, str], dict[int, int]] = {}
    for r in n.groupBy("direction", "related", "n").agg(F.count("*").alias("instances")).toLocalIterator():
        out.setdefault((r["direction"], r["related"]), {})[r["n"]] = r["instances"]
    for (direction, _), h in out.items():
        if direction != "e2o reversed" and (missing := total - sum(h.values())) > 0:
            h[0] = h.get(0, 0) + missing
    return total, out


def covering_ranges(h: dict[int, int], coverage: float) -> list[tuple[int, int]]:
    """Ranges of counts that cover a share of the instances, grown from the mean to both sides, from zero up, and from far
    above down; those that contain another are dropped."""
    values, weights = np.array(list(h), np.int64), np.array(list(h.values()), np.int64)
    n = int(weights.sum())
    mean = np.float32((values * weights).sum()) / np.float32(n)
    spread = np.sqrt(np.float32((weights * (values - mean) ** 2).sum()) / np.float32(n))
    step, target = max(1, round(float(np.float32(0.01) * spread))), math.ceil(float(np.float32(n) * np.float32(coverage)))
    inside = lambda a, b: int(weights[(values >= a) & (values <= b)].sum())
    found = []
    for start, down, up in ((int(mean), step, step), (0, 0, step), (10 + 10 * int(mean), step, 0)):
        low = high = start
        for _ in range(MOST_STEPS):
            if inside(low, high) >= target:
                found.append((low, high))
                break
            low, high = max(0, low - down), high + up
    return [r for r in dict.fromkeys(found) if not any(o != r and r[0] <= o[0] and o[1] <= r[1] for o in found)]


def count_constraints(log: Log, kind: str, name: str, coverage: float = 0.9, only: DataFrame | None = None) -> list[CountConstraint]:
    total, found = count_histograms(log, kind, name, only)
    out = []
    for (direction, related), h in sorted(found.items()):
        mean = sum(k * v for k, v in h.items()) / max(1, sum(h.values()))
        if not total or not 0 < mean <= MOST_MEAN:
            continue
        for low, high in covering_ranges(h, coverage):
            out.append(CountConstraint((kind, name), direction, related, 0 if low < min(h) else low, None if high > max(h) else high))
    return list(dict.fromkeys(out))


def _events_of(log: Log, object_type: str, only: DataFrame | None) -> DataFrame:
    own = log.e2o.where(F.col("ob_type") == object_type).select("ob_id", "ev_id", "ev_type", "ev_time")
    own = own if log.single_pairs else own.distinct()
    return own if only is None else own.join(only.select(F.col("id").alias("ob_id")), "ob_id", "left_semi")


def delays(log: Log, object_type: str, only: DataFrame | None = None) -> DataFrame:
    """first, then, ev_id, ob_id, seconds: for each event of an object (only: of those with such an id) the least delay to
    each type of its other events. An object's events are gone through once, from the last to the first, with the nearest
    time of each type so far: no event meets all others of its object."""
    own = _events_of(log, object_type, only).withColumn("at", F.unix_micros("ev_time"))
    types = sorted(r["ev_type"] for r in log.e2o.where(F.col("ob_type") == object_type).select("ev_type").distinct().toLocalIterator())
    back = Window.partitionBy("ob_id").orderBy(-F.col("at"))
    from_now, later = back.rangeBetween(Window.unboundedPreceding, 0), back.rangeBetween(Window.unboundedPreceding, -1)
    twins = F.count("*").over(Window.partitionBy("ob_id", "at", "ev_type"))
    when = [F.when(F.col("ev_type") == x, F.col("at")) for x in types]
    nearest = own.withColumn("twins", twins).withColumns({f"from{k}": F.min(c).over(from_now) for k, c in enumerate(when)} | {f"later{k}": F.min(c).over(later) for k, c in enumerate(when)})
    own_type = [(F.col("ev_type") == x) & (F.col("twins") == 1) for x in types]
    rows = F.array(*[F.struct(F.lit(x).alias("then"), F.when(own_type[k], F.col(f"later{k}")).otherwise(F.col(f"from{k}")).alias("next")) for k, x in enumerate(types)])
    if not types:
        return own.select(F.col("ev_type").alias("first"), F.lit("").alias("then"), "ob_id", "ev_id", F.lit(0.0).alias("seconds")).limit(0)
    found = nearest.select(F.col("ev_type").alias("first"), "ob_id", "ev_id", "at", F.explode(rows).alias("n")).where("n.next is not null")
    return found.select("first", "n.then", "ob_id", "ev_id", (F.floor((F.col("n.next") - F.col("at")) / 1000) / 1000).alias("seconds"))


def follow_constraints(log: Log, object_type: str, coverage: float = 0.9, only: DataFrame | None = None) -> list[FollowConstraint]:
    """Pairs of types whose delays cover a share of the first type's events, of all objects or those with an id of only.
    The upper bound is the first multiple of the delays' deviation that covers enough."""
    own = _events_of(log, object_type, only).select("ob_id", "ev_id", "ev_type").distinct().groupBy(F.col("ev_type").alias("first")).agg(F.count("*").alias("all"))
    d = delays(log, object_type, only)
    stats = d.groupBy("first", "then").agg(F.count("*").alias("n"), F.stddev_pop("seconds").alias("spread")).join(F.broadcast(own), "first")
    stats = stats.where(F.col("n") >= F.col("all") * coverage)
    steps = d.join(stats.where("spread > 0"), ["first", "then"]).withColumn("step", F.ceil(F.col("seconds") / F.col("spread")))
    h = steps.groupBy("first", "then", "all", "spread", "step").agg(F.count("*").alias("n"))
    found: dict[tuple, dict[int, int]] = {}
    for r in h.toLocalIterator():
        found.setdefault((r["first"], r["then"], r["all"], r["spread"]), {})[r["step"]] = r["n"]
    out = []
    for (first, then, total, spread), steps_of in sorted(found.items()):
        target, sofar = math.ceil(total * coverage), 0
        for k in sorted(steps_of):
            sofar += steps_of[k]
            if sofar >= target and k <= MOST_STEPS:
                out.append(FollowConstraint(object_type, first, then, 0.0, k * spread))
                break
    return out


def labelled(log: Log, tree: dict, ids: DataFrame) -> DataFrame:
    """id, ok: whether each instance (the root's variable of its kind) satisfies a tree."""
    result = evaluate(tree, log)
    root = result.evaluation.results[0]
    v = sorted(root.visible)[-1] if root.visible else None
    own = root.full.groupBy(F.col(columns_of(v)[0]).alias("id")).agg(F.bool_and(F.col("violation").isNull()).alias("ok"))
    return ids.join(own, "id", "left").select("id", F.coalesce("ok", F.lit(True)).alias("ok"))


def merged_or(a: dict, b: dict, kind: str) -> dict:
    """A root that binds the instance, whose constraint is that one of two subtrees holds. Of what a tree's own root binds
    only the instance moves up: a follow constraint's first event stays in its subtree."""
    own, other = ("newEventVars", "newObjectVars") if kind == "event" else ("newObjectVars", "newEventVars")
    root = dict(a["nodes"][0]["Box"][0], filters=[], constraints=[{"type": "OR", "child_names": ["A", "B"]}]) | {other: {}}
    nodes: list = [{"Box": [root, []]}]
    names = []
    for label, t in (("A", a), ("B", b)):
        at = len(nodes)
        nodes[0]["Box"][1].append(at)
        names.append([[0, at], label])
        for i, n in enumerate(t["nodes"]):
            box = dict(n["Box"][0])
            if i == 0:
                box |= {own: {}}
            nodes.append({"Box": [box, [c + at for c in n["Box"][1]]]})
        names += [[[x + at, y + at], name] for (x, y), name in t["edgeNames"]]
    return {"nodes": nodes, "edgeNames": names}


def or_constraints(log: Log, kind: str, name: str, coverage: float = 0.9, gain: float = 1.1) -> list[tuple[str, dict]]:
    """Pairs of constraints of which one holds often enough where neither does alone: the second is found on the instances
    that violate the first. The first is a count constraint and the second a count or, of objects, a follow constraint; or
    both are follow constraints, where the first does not hold too often already."""
    ids = instances(log, kind, name).cache()
    n, out, seen = ids.count(), [], set()
    firsts: list = list(dict.fromkeys(x for share in (0.11, 0.7, 1.0) for x in count_constraints(log, kind, name, share * coverage, ids)))
    if kind == "object":
        firsts += follow_constraints(log, name, 0.8 * coverage, ids)
    for c in firsts:
        counts = isinstance(c, CountConstraint)
        one = labelled(log, c.to_tree(), ids).cache()
        bad = one.where("not ok").select("id").cache()
        violating = bad.count()
        seconds: list = []
        if violating and counts:
            seconds = [d for d in count_constraints(log, kind, name, coverage, bad) if d.related != c.related]
            if kind == "object":
                seconds += follow_constraints(log, name, 0.9 * coverage, bad)
        elif violating and n - violating < math.ceil(1.1 * coverage * n):
            seconds = follow_constraints(log, name, coverage, bad)
        for d in seconds:
            if (c, d) in seen:
                continue
            seen |= {(c, d), (d, c)}
            two = labelled(log, d.to_tree(), ids).withColumnRenamed("ok", "ok2")
            r = one.join(two, "id").agg(F.count_if(F.col("ok")).alias("a"), F.count_if(F.col("ok2")).alias("b"), F.count_if(F.col("ok") | F.col("ok2")).alias("either")).first()
            a, b, either = r["a"] / n, r["b"] / n, r["either"] / n
            expected = 1 - (1 - a) * (1 - b)
            if either >= coverage and expected > 0 and either / expected >= gain:
                out.append((f"{c.name} OR {d.name}", merged_or(c.to_tree(), d.to_tree(), kind)))
        bad.unpersist()
        one.unpersist()
    ids.unpersist()
    return out


def discover_all(log: Log, event_types: list[str], object_types: list[str], coverage: float = 0.9, ors: bool = True) -> list[tuple[str, dict]]:
    """Every kind of constraint for the types asked for, as (name, tree)."""
    out = [(c.name, c.to_tree()) for t in object_types for c in follow_constraints(log, t, coverage)]
    for kind, names in (("object", object_types), ("event", event_types)):
        for n in names:
            out += [(c.name, c.to_tree()) for c in count_constraints(log, kind, n, coverage)]
            if ors:
                out += or_constraints(log, kind, n, coverage)
    return out
