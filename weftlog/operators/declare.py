"""Object-centric declarative constraints: activity and edge statistics, conformance, discovery."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..log import Log

#: AS: any time; EF, EP: after, before; DF, DP: directly after, before among the involved objects' events.
ARROWS = ("AS", "EF", "EP", "DF", "DP")


@dataclass(frozen=True)
class O2O:
    """Objects of type second that an event's objects of type first point to (reversed: that point to those)."""

    first: str
    second: str
    reversed: bool = False

    def __str__(self) -> str:
        return f"{self.first}{'<' if self.reversed else '>'}{self.second}"


#: What an arc is over: a type of the event's own objects, or objects that those are related to.
Association = str | O2O


@dataclass(frozen=True)
class Arc:
    """From one activity to another over objects of a type: how ("each", "any", "all") the source event's objects are
    involved, and how many targets there have to be. counts (0, 0) is a negated arc. more are further associations of
    its label, each with how its objects are involved; a target has to meet all of them."""

    source: str
    target: str
    arrow: str
    how: str
    object_type: Association
    low: int | None = 1
    high: int | None = None
    more: tuple[tuple[str, Association], ...] = ()

    @property
    def label(self) -> tuple[tuple[str, Association], ...]:
        return ((self.how, self.object_type), *self.more)

    @staticmethod
    def of(source: str, target: str, arrow: str, each=(), any=(), all=(), low: int | None = 1, high: int | None = None) -> Arc:
        """An arc with a label of lists of associations. The first one finds the candidates that the others judge."""
        label = [(how, x) for how, own in (("each", each), ("all", all), ("any", any)) for x in own]
        if not label:
            raise ValueError("an arc's label needs an association")
        if arrow not in ARROWS:
            raise ValueError(f"no arrow {arrow!r}")
        return Arc(source, target, arrow, *label[0], low, high, tuple(label[1:]))

    @staticmethod
    def from_json(said: dict) -> Arc:
        """An arc of the wire format: from, to, arc_type, label of each, any and all, counts."""
        one = lambda x: x["object_type"] if x["type"] == "Simple" else O2O(x["first"], x["second"], x["reversed"])
        lists = {how: [one(x) for x in said["label"].get(how, [])] for how in ("each", "any", "all")}
        return Arc.of(said["from"], said["to"], said["arc_type"], **lists, low=said["counts"][0], high=said["counts"][1])

    def to_json(self) -> dict:
        one = lambda x: {"type": "Simple", "object_type": x} if isinstance(x, str) else {"type": "O2O", "first": x.first, "second": x.second, "reversed": x.reversed}
        label = {how: [one(x) for own, x in self.label if own == how] for how in ("each", "any", "all")}
        return {"from": self.source, "to": self.target, "arc_type": self.arrow, "label": label, "counts": [self.low, self.high]}


def synthetic_events(log: Log, object_type: str) -> DataFrame:
    """ev_id, ev_type, ev_time, ob_id: an <init> and an <exit> event for each object with events, at its first and last."""
    own = log.e2o.where(F.col("ob_type") == object_type).groupBy("ob_id").agg(F.min("ev_time").alias("first"), F.max("ev_time").alias("last"))
    start = own.select(F.concat(F.lit("<init>-"), "ob_id").alias("ev_id"), F.lit(f"<init> {object_type}").alias("ev_type"), F.col("first").alias("ev_time"), "ob_id")
    return start.union(own.select(F.concat(F.lit("<exit>-"), "ob_id"), F.lit(f"<exit> {object_type}"), "last", "ob_id"))


def related(log: Log, activity: str, object_type: str) -> DataFrame:
    """ev_id, ev_time, ob_id of an activity's events, synthetic ones included."""
    if activity in (f"<init> {object_type}", f"<exit> {object_type}"):
        return synthetic_events(log, object_type).where(F.col("ev_type") == activity).select("ev_id", "ev_time", "ob_id")
    return log.e2o.where((F.col("ev_type") == activity) & (F.col("ob_type") == object_type)).select("ev_id", "ev_time", "ob_id").distinct()


def involved(log: Log, activity: str, of: Association) -> DataFrame:
    """ev_id, ev_time, ob_id: the objects that an association gives for each event of an activity."""
    if isinstance(of, str):
        return related(log, activity, of)
    near, far = ("tgt", "src") if of.reversed else ("src", "tgt")
    links = log.o2o.where((F.col(f"{near}_type") == of.first) & (F.col(f"{far}_type") == of.second)).select(F.col(f"{near}_id").alias("ob_id"), F.col(f"{far}_id").alias("far"))
    return related(log, activity, of.first).join(links, "ob_id").select("ev_id", "ev_time", F.col("far").alias("ob_id")).distinct()


def objects_per_event(log: Log, activity: str) -> DataFrame:
    """ob_type, n, events: relation rows of an event by object type; events without any of a type are left out."""
    n = log.e2o.where(F.col("ev_type") == activity).groupBy("ob_type", "ev_id").agg(F.count("*").alias("n"))
    return n.groupBy("ob_type", "n").agg(F.count("*").alias("events"))


def events_per_object(log: Log, activity: str) -> DataFrame:
    """ob_type, n, objects: events of the activity by object, zero included, for the types that it has objects of."""
    own = log.e2o.where(F.col("ev_type") == activity)
    n = own.groupBy("ob_id").agg(F.count_distinct("ev_id").alias("n"))
    objects = log.objects.join(own.select("ob_type").distinct(), "ob_type", "left_semi").join(n, "ob_id", "left")
    return objects.groupBy("ob_type", F.coalesce("n", F.lit(0)).alias("n")).agg(F.count("*").alias("objects"))


def _after(arc: Arc, a: str, b: str):
    if arc.arrow in ("EF", "DF"):
        return F.col(b) > F.col(a)
    return F.col(b) < F.col(a) if arc.arrow in ("EP", "DP") else F.lit(True)


def _answered(rows: DataFrame, keys: list[str], arc: Arc, repeats: bool = False) -> DataFrame:
    """Of rows (keys, s, at, side: 0 a source, 1 a target, 2 both) the sources, with how many targets of equal keys answer
    each and when the earliest does. Rows of equal keys pass once, in the order of time: no source meets all targets.
    repeats: rows may be equal, which count once."""
    itself = arc.arrow == "AS" and arc.source == arc.target  # an event does not answer itself
    ordered, order = rows, F.col("at").asc_nulls_first() if arc.arrow in ("EP", "DP") else F.col("at").desc_nulls_first()
    by = Window.partitionBy(*keys)
    if repeats:
        before = by.orderBy(order, "s")
        ordered = ordered.withColumn("again", F.lag("s").over(before).eqNullSafe(F.col("s")) & F.lag("at").over(before).eqNullSafe(F.col("at"))).where("not again").drop("again")
    ahead = by.orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    whole = by if arc.arrow == "AS" else ahead
    hit = F.when((F.col("side") != 0) & reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]), F.col("at"))
    found = ordered.withColumn("targets", F.count(hit).over(whole)).withColumn("earliest", F.min(hit).over(whole))
    if itself:
        own, twins = Window.partitionBy(*keys, "s"), Window.partitionBy(*keys, "at")
        found = found.withColumn("own", F.count(hit).over(own)).withColumn("others", F.count(hit).over(twins) - F.count(hit).over(Window.partitionBy(*keys, "at", "s"))).withColumn("after", F.min(hit).over(ahead))
        found = found.withColumn("targets", F.col("targets") - F.col("own")).withColumn("earliest", F.when((F.col("earliest") == F.col("at")) & (F.col("others") == 0), F.col("after")).otherwise(F.col("earliest")))
    return found.where("side != 1").select("s", *keys, "at", "targets", "earliest")


def _each(log: Log, arc: Arc) -> DataFrame:
    """s, ob_id, at, targets, earliest: for each source event and object of it, how many targets of that object answer it
    and when the earliest does."""
    keyed = lambda activity, side: related(log, activity, arc.object_type).select("ob_id", F.col("ev_id").alias("s"), F.unix_micros("ev_time").alias("at"), F.lit(side).alias("side"))
    return _answered(keyed(arc.source, 0).union(keyed(arc.target, 1)), ["ob_id"], arc)


def _judged(log: Log, arc: Arc, named: bool = True) -> tuple[DataFrame, list[str]]:
    """s, own, targets, ms and the names of own: for each source event, and each choice of an object for every "each" of the
    label, how many targets answer it, and the time to the earliest. Where a source has one object for each "any" and
    "all", a target answers it if it has the objects chosen and these: equal keys, which pass in the order of time (an
    event meets every choice of its own objects). Only sources with more objects there meet their targets pair by pair.
    Not named: s may be a 128-bit digest of the source's id, which is shorter; nulls stay null."""
    keys = [f"o{k}" for k in range(len(arc.label))]
    own = [f"o{k}" for k, (how, _) in enumerate(arc.label) if how == "each"]
    late = ((F.col("earliest") - F.col("at")) / 1000).cast("bigint").alias("ms")
    beside = [log.wide.get(activity) for activity in (arc.source, arc.target)]
    if all(x is not None and {of for _, of in arc.label} <= {*x.columns} for x in beside):
        sides = (2,) if arc.source == arc.target else (0, 1)
        name = F.col("ev_id") if named else F.unhex(F.md5("ev_id"))
        rows = reduce(DataFrame.union, [x.select(name.alias("s"), F.unix_micros("ev_time").alias("at"), *[F.col(of).alias(k) for k, (_, of) in zip(keys, arc.label, strict=True)], F.lit(side).alias("side")) for x, side in zip(beside, sides, strict=False)])
        return _answered(rows, keys, arc, True).select("s", *own, "targets", late), own
    source = target = None
    for k, (how, of) in zip(keys, arc.label, strict=True):
        every = involved(log, arc.source, of).select(F.col("ev_id").alias("s"), F.unix_micros("ev_time").alias("at"), F.col("ob_id").alias(k))
        if how != "each":
            every = every.groupBy("s", "at").agg(F.min(k).alias(k), (F.count("*") > 1).alias(f"many_{k}"))
        of_target = related(log, arc.target, of if isinstance(of, str) else of.second).select(F.col("ev_id").alias("s"), F.unix_micros("ev_time").alias("at"), F.col("ob_id").alias(k))
        source = every if source is None else source.join(every, ["s", "at"])
        target = of_target if target is None else target.join(of_target, ["s", "at"])
    several = reduce(Column.__or__, [F.col(f"many_{k}") for k in keys if k not in own], F.lit(False))
    shaped = lambda df, side: df.select("s", "at", *keys, F.lit(side).alias("side"))
    out = _answered(shaped(source.where(~several), 0).union(shaped(target, 1)), keys, arc).select("s", *own, "targets", late)
    if len(own) == len(keys):
        return out, own
    bound, hits, names = _label_hits(log, arc, False, source.where(several).select("s").distinct())
    met = hits.groupBy(*names).agg(F.count("*").alias("targets"), F.min("u").alias("u"))
    paired = bound.join(met, names, "left").select("s", *own, F.coalesce("targets", F.lit(0)).alias("targets"), ((F.unix_micros("u") - F.unix_micros("t")) / 1000).cast("bigint").alias("ms"))
    return out.union(paired), own


def _sources(log: Log, arc: Arc, of: Association, directly: bool) -> DataFrame:
    """s, t, ob_id and, if directly, near: when the nearest event of the object, of any activity, is (rows without go)."""
    source = involved(log, arc.source, of).select(F.col("ev_id").alias("s"), F.col("ev_time").alias("t"), "ob_id")
    if not directly:
        return source
    kind = of if isinstance(of, str) else of.second
    times = log.e2o.where(F.col("ob_type") == kind).select(F.lit(None).cast("string").alias("s"), F.col("ev_time").alias("t"), "ob_id").distinct()
    both = times.union(source).withColumn("at", F.unix_micros("t"))
    order, nearest = (-F.col("at"), F.min) if arc.arrow == "DF" else (F.col("at"), F.max)
    ahead = Window.partitionBy("ob_id").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("near", nearest(F.when(F.col("s").isNull(), F.col("at"))).over(ahead))
    return found.where("s is not null and near is not null").select("s", "t", "ob_id", "near")


def _label_hits(log: Log, arc: Arc, directly: bool, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Bindings of the label (s, t, an object for each "each"), hits (these and x, u of each target that answers one) and
    the columns that tell bindings apart. The first association's objects bring sources and targets together; the others
    only look at these pairs. A source event without objects for one of the associations is bound to nothing. only: the
    source events (s) to look at."""
    bound = hits = None
    keys = ["s"]
    for k, (how, of) in enumerate(arc.label):
        source = _sources(log, arc, of, directly)
        every = involved(log, arc.source, of).select(F.col("ev_id").alias("s"), F.col("ev_time").alias("t"), "ob_id")
        if only is not None:
            source, every = (df.join(only, "s", "left_semi") for df in (source, every))
        target = related(log, arc.target, of if isinstance(of, str) else of.second).select(F.col("ev_id").alias("x"), F.col("ev_time").alias("u"), "ob_id")
        at = F.unix_micros("u") == F.col("near") if directly else _after(arc, "t", "u")
        if hits is None:
            pairs = source.join(target, "ob_id").where(at & (F.col("s") != F.col("x")))
        else:
            pairs = hits.select("s", "x").distinct().join(source, "s").join(target, ["x", "ob_id"]).where(at)
        one = [f"o{k}"] if how == "each" else []
        mine = every.withColumn(f"o{k}", F.col("ob_id")).select("s", "t", *one).distinct()
        if how == "all":  # a target has to have every object
            wanted = every.groupBy("s").agg(F.count("*").alias("wanted"))
            pairs = pairs.groupBy("s", "x", "u").agg(F.count_distinct("ob_id").alias("met")).join(wanted, "s").where("met = wanted")
        met = pairs.withColumn(f"o{k}", F.col("ob_id") if one else F.lit(None)).select("s", "x", "u", *one).distinct()
        bound = mine if bound is None else bound.join(mine.drop("t"), "s")
        hits = met if hits is None else hits.join(met.drop("u"), ["s", "x"])
        keys += one
    return bound, hits, keys


def _passes(arc: Arc) -> bool:
    """Whether one pass over each object's events judges the arc."""
    return arc.how == "each" and not arc.more and isinstance(arc.object_type, str)


def obligations(log: Log, arc: Arc, named: bool = True) -> DataFrame:
    """ev_id, ob_id, targets: for each source event, or each object of it, how many targets answer it. ob_id is the object
    of the label's first "each" (null without one); others has those of further ones, if the label has several. Not named: see _judged()."""
    directly = arc.arrow in ("DF", "DP")
    if _passes(arc) and not directly:
        return _each(log, arc).select(F.col("s").alias("ev_id"), "ob_id", "targets")
    if directly:
        bound, hits, keys = _label_hits(log, arc, True)
        n = hits.groupBy(*keys).agg(F.count("*").alias("targets"))
        judged, own = bound.select(*keys).join(n, keys, "left").withColumn("targets", F.coalesce("targets", F.lit(0))), keys[1:]
    else:
        judged, own = _judged(log, arc, named)
    first = F.col(own[0]) if own else F.lit(None).cast("string")
    others = [F.array(*own[1:]).alias("others")] if len(own) > 1 else []
    return judged.select(F.col("s").alias("ev_id"), first.alias("ob_id"), "targets", *others)


def conformance(log: Log, arc: Arc) -> DataFrame:
    """obligations, satisfied, fraction of an arc; no obligations: fraction 1."""
    ok = F.lit(True)
    if arc.low is not None:
        ok = ok & (F.col("targets") >= arc.low)
    if arc.high is not None:
        ok = ok & (F.col("targets") <= arc.high)
    out = obligations(log, arc, False).agg(F.count("*").alias("obligations"), F.count(F.when(ok, 1)).alias("satisfied"))
    return out.withColumn("fraction", F.when(F.col("obligations") > 0, F.try_divide("satisfied", "obligations")).otherwise(F.lit(1.0)))


def edge_durations(log: Log, arc: Arc) -> DataFrame:
    """s, ms: for each source event (and objects of its "each") the time to the earliest target that answers it."""
    if _passes(arc):
        return _each(log, arc).where("earliest is not null").select("s", ((F.col("earliest") - F.col("at")) / 1000).cast("bigint").alias("ms"))
    return _judged(log, arc)[0].where("ms is not null").select("s", "ms")


def nice_width(low: float, high: float, bins: int = 25) -> float:
    """A bin width of 1, 2, 5 or 10 times a power of ten."""
    raw = (high - low) / bins
    if raw <= 0:
        return 1.0
    power = 10.0 ** math.floor(math.log10(raw))
    part = raw / power
    return power * (1 if part < 1.5 else 2 if part < 3 else 5 if part < 7 else 10)


def histogram(values: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """bin, low, high, n of the bins that have values."""
    ends = values.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    width = nice_width(float(ends["low"] or 0), float(ends["high"] or 0), bins)
    start = math.floor(float(ends["low"] or 0) / width) * width
    k = F.floor((F.col(column) - F.lit(start)) / F.lit(width)).cast("int")
    out = values.where(F.col(column).isNotNull()).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    return out.select("bin", (F.col("bin") * width + start).alias("low"), ((F.col("bin") + 1) * width + start).alias("high"), "n")


def arc_counts(log: Log, how: tuple[str, ...] = ("each",), o2o_mode: str = "None", activities: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """source, target, first, second, reversed (second null: a simple type), how, obligations and, by AS, EF and EP, the
    obligations that some target may answer: exactly so many, but for "all", and AS over O2O to the same activity, which
    they bound from above. One plan for all arcs: an event meets its objects' activities, not their events."""
    if o2o_mode not in O2O_MODES:
        raise ValueError(f"no mode {o2o_mode!r}")
    own = log.e2o.select("ev_id", "ev_type", "ev_time", "ob_id", "ob_type").distinct()
    if activities is not None:
        own = own.where(F.col("ev_type").isin(activities))
    none = F.lit(None).cast("string")
    source = own.select("ev_id", "ev_type", "ev_time", "ob_id", F.col("ob_type").alias("first"), none.alias("second"), F.lit(False).alias("reversed"))
    for back, (near, far) in ((False, ("src", "tgt")), (True, ("tgt", "src"))):
        if o2o_mode in ("Bidirectional", "Reversed" if back else "Direct"):
            links = log.o2o.select(F.col(f"{near}_id").alias("near"), F.col(f"{far}_id").alias("far"), F.col(f"{far}_type").alias("second"))
            far_own = own.join(links, F.col("ob_id") == F.col("near")).select("ev_id", "ev_type", "ev_time", F.col("far").alias("ob_id"), F.col("ob_type").alias("first"), "second", F.lit(back).alias("reversed"))
            source = source.union(far_own.distinct())
    if types is not None:
        source = source.where(F.col("first").isin(types) & F.coalesce("second", "first").isin(types))
    spans = own.groupBy("ob_id", F.col("ev_type").alias("target")).agg(F.min("ev_time").alias("begins"), F.max("ev_time").alias("ends"), F.count("*").alias("n"))
    itself = F.when((F.col("ev_type") == F.col("target")) & F.col("second").isNull(), 1).otherwise(0)
    met = source.join(spans, "ob_id").select("*", (F.col("n") > itself).alias("AS"), (F.col("ends") > F.col("ev_time")).alias("EF"), (F.col("begins") < F.col("ev_time")).alias("EP"))
    over = ["ev_type", "first", "second", "reversed"]
    timed = ("AS", "EF", "EP")
    wanted = source.groupBy("ev_id", *over).agg(F.count("*").alias("wanted")) if set(how) - {"each"} else None
    out = None
    for h in how:
        if h == "each":
            total = source.groupBy(*over).agg(F.count("*").alias("obligations"))
            hits = met.groupBy(*over, "target").agg(*[F.count_if(a).alias(a) for a in timed])
        else:
            total = wanted.groupBy(*over).agg(F.count("*").alias("obligations"))
            by_event = met.groupBy("ev_id", *over, "target").agg(*[F.count_if(a).alias(a) for a in timed])
            if h == "all":
                by_event = _same(by_event, wanted, ["ev_id", *over]).select("ev_id", *over, "target", *[F.when(F.col(a) == F.col("wanted"), 1).otherwise(0).alias(a) for a in timed])
            hits = by_event.groupBy(*over, "target").agg(*[F.count_if(F.col(a) > 0).alias(a) for a in timed])
        rows = _same(hits, total, over).select(F.col("ev_type").alias("source"), "target", "first", "second", "reversed", F.lit(h).alias("how"), "obligations", *timed)
        out = rows if out is None else out.union(rows)
    return out


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """A join on keys that may be null, with a's columns and b's others."""
    b = b.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in b.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return a.join(b, on).drop(*[f"_{c}" for c in keys])


#: Which O2O associations discovery looks at: from an event's objects to what they point to, to what points to them.
O2O_MODES = ("None", "Direct", "Reversed", "Bidirectional")


def discover(log: Log, noise: float = 0.2, how: tuple[str, ...] = ("each",), arrows: tuple[str, ...] = ("AS", "EF", "EP"), activities: list[str] | None = None, counts: tuple[int, int | None] = (1, None), o2o_mode: str = "None", types: list[str] | None = None) -> list[tuple[Arc, float]]:
    """Arcs of one association whose fraction of satisfied obligations is at least 1 - noise, over all pairs of activities
    (one with itself included) that share objects; counts are the targets that an obligation needs. One plan counts all
    arcs; only where its count is a bound (see arc_counts; DF, DP; counts beyond one) is an arc that reaches the
    threshold by it judged by a plan of its own. What is held here grows with the log's types alone."""
    low, high = counts
    if low < 1:
        raise ValueError("discovered arcs need a target")
    out = []
    for r in arc_counts(log, how, o2o_mode, activities, types).collect():
        of = r["first"] if r["second"] is None else O2O(r["first"], r["second"], r["reversed"])
        for arrow in arrows:
            arc = Arc(r["source"], r["target"], arrow, r["how"], of, low, high)
            fraction = r[{"DF": "EF", "DP": "EP"}.get(arrow, arrow)] / r["obligations"]
            bound = arrow in ("DF", "DP") or r["how"] == "all" or (low, high) != (1, None) or (arrow == "AS" and r["second"] is not None and r["source"] == r["target"])
            if bound and fraction >= 1 - noise:
                fraction = conformance(log, arc).first()["fraction"]
            if fraction >= 1 - noise:
                out.append((arc, fraction))
    return sorted(out, key=lambda x: (x[0].source, x[0].target, str(x[0].object_type), x[0].how, x[0].arrow))


def template_string(arcs: list[Arc]) -> str:
    """Arcs as text, a line each: ARROW(how type, source, target, low, high); further associations after a &."""
    shown = lambda x: "*" if x is None else str(x)
    label = lambda a: " & ".join(f"{how} {of}" for how, of in a.label)
    return "\n".join(f"{a.arrow}({label(a)}, {a.source}, {a.target}, {shown(a.low)}, {shown(a.high)})" for a in arcs)
