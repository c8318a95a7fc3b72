"""Path schemas: paths over the graph of types, the element pairs that they connect, and measures of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..log import Log


@dataclass(frozen=True)
class Step:
    """One edge of a schema: a relation by its types and qualifier, walked forwards or backwards."""

    relation: str
    source: str
    target: str
    qualifier: str
    backwards: bool = False

    @property
    def ends(self) -> tuple[str, str]:
        return (self.target, self.source) if self.backwards else (self.source, self.target)


def type_graph(log: Log) -> DataFrame:
    """relation, source, target, qualifier, n: the edges between types."""
    a = log.e2o.groupBy(F.col("ev_type").alias("source"), F.col("ob_type").alias("target"), "qualifier").agg(F.count("*").alias("n"))
    b = log.o2o.groupBy(F.col("src_type").alias("source"), F.col("tgt_type").alias("target"), "qualifier").agg(F.count("*").alias("n"))
    return a.select(F.lit("e2o").alias("relation"), "*").union(b.select(F.lit("o2o"), "*"))


def enumerate_schemas(log: Log, source: str, target: str | None = None, max_length: int = 3, through: set[str] | None = None) -> list[tuple[Step, ...]]:
    """Paths without a type twice from one type to another (None: any), over the schema's graph, which is small."""
    edges = [Step(r["relation"], r["source"], r["target"], r["qualifier"]) for r in type_graph(log).orderBy("relation", "source", "target", "qualifier").toLocalIterator()]
    steps = edges + [Step(e.relation, e.source, e.target, e.qualifier, True) for e in edges]
    out: list[tuple[Step, ...]] = []

    def walk(at: str, path: tuple[Step, ...], seen: frozenset) -> None:
        if path and (target is None or at == target):
            out.append(path)
        if len(path) == max_length or (path and at == target):
            return
        for s in steps:
            a, b = s.ends
            if a == at and b not in seen and (through is None or b == target or b in through):
                walk(b, (*path, s), seen | {b})

    walk(source, (), frozenset({source}))
    return sorted(out, key=lambda p: (len(p), str(p)))


def _edge(log: Log, s: Step) -> DataFrame:
    if s.relation == "e2o":
        df = log.e2o.where((F.col("ev_type") == s.source) & (F.col("ob_type") == s.target) & (F.col("qualifier") == s.qualifier)).select(F.col("ev_id").alias("a"), F.col("ob_id").alias("b"), F.col("ev_time").alias("t"))
    else:
        df = log.o2o.where((F.col("src_type") == s.source) & (F.col("tgt_type") == s.target) & (F.col("qualifier") == s.qualifier)).select(F.col("src_id").alias("a"), F.col("tgt_id").alias("b"), F.lit(None).cast("timestamp").alias("t"))
    return df.select(F.col("b").alias("a"), F.col("a").alias("b"), "t") if s.backwards else df


def connections(log: Log, schema: tuple[Step, ...], temporal: str = "none", bound_seconds: float | None = None, selection: str = "all", distinct: bool = True) -> DataFrame:
    """source, target, seconds (last event's time less the first's; null without two) of the pairs that a path connects.
    temporal: none, forward or bounded, between consecutive events; selection: all, first, last or closest by source."""
    df = None
    for s in schema:
        edge = _edge(log, s)
        if df is None:
            df = edge.select(F.col("a").alias("source"), F.col("b").alias("at"), F.col("t").alias("first"), F.col("t").alias("last"))
            continue
        edge = edge.select(F.col("a").alias("at"), F.col("b").alias("next"), "t")
        df = df.join(edge, "at")
        gap = (F.unix_micros("t") - F.unix_micros("last")) / 1e6
        if temporal == "forward":
            df = df.where(gap.isNull() | (gap >= 0))
        elif temporal == "bounded":
            df = df.where(gap.isNull() | (F.abs(gap) <= max(0.0, bound_seconds or 0.0)))
        df = df.select("source", F.col("next").alias("at"), F.coalesce("first", "t").alias("first"), F.coalesce("t", "last").alias("last"))
    df = df.select("source", F.col("at").alias("target"), ((F.unix_micros("last") - F.unix_micros("first")) / 1e6).alias("seconds"))
    if distinct:
        df = df.groupBy("source", "target").agg(F.min("seconds").alias("seconds"))
    if selection == "all":
        return df
    order = {"first": F.col("seconds").asc_nulls_last(), "last": F.col("seconds").desc_nulls_last(), "closest": F.abs("seconds").asc_nulls_last()}[selection]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(order, "target"))).where("_n = 1").drop("_n")


def measures(log: Log, schema: tuple[Step, ...], **how) -> DataFrame:
    """support (connected pairs), path_count, coverage (of sources), reach (of targets), selectivity (connected sources by
    support), exclusivity (connected targets by support), is_dead, and seconds: min, max, mean, median."""
    paths = connections(log, schema, distinct=False, **{k: v for k, v in how.items() if k != "selection"})
    pairs = connections(log, schema, **how)
    got = pairs.agg(F.count("*").alias("support"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"), F.avg("seconds").alias("mean_s"), F.median("seconds").alias("median_s"))
    all_paths = paths.agg(F.count("*").alias("path_count"))
    first, last = schema[0].ends[0], schema[-1].ends[1]
    total = lambda kind, name: elements(log, kind).agg(F.count("*").alias(name))
    one = got.crossJoin(all_paths).crossJoin(total(first, "n_sources")).crossJoin(total(last, "n_targets"))  # a row each
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return one.select("support", "path_count", share("sources", "n_sources").alias("coverage"), share("targets", "n_targets").alias("reach"), share("sources", "support").alias("selectivity"), share("targets", "support").alias("exclusivity"), (F.col("support") == 0).alias("is_dead"), "min_s", "max_s", "mean_s", "median_s")


def elements(log: Log, kind: str) -> DataFrame:
    """id of the objects or events of a type."""
    return log.objects.where(F.col("ob_type") == kind).select(F.col("ob_id").alias("id")).union(log.events.where(F.col("ev_type") == kind).select("ev_id"))


def degrees(log: Log, schema: tuple[Step, ...], **how) -> DataFrame:
    """side, n, elements: targets by source and sources by target, zeros for unconnected elements included."""
    pairs = connections(log, schema, **how)

    def side(name: str, kind: str) -> DataFrame:
        n = pairs.groupBy(F.col(name).alias("id")).agg(F.count("*").alias("n"))
        return elements(log, kind).join(n, "id", "left").groupBy(F.coalesce("n", F.lit(0)).alias("n")).agg(F.count("*").alias("elements")).select(F.lit(name).alias("side"), "n", "elements")

    return side("source", schema[0].ends[0]).union(side("target", schema[-1].ends[1]))


def rank(found: list[tuple[tuple[Step, ...], dict]], top: int | None = None) -> list[tuple[tuple[Step, ...], dict]]:
    """Schemas that connect something first, then by selectivity and support, greatest first."""
    return sorted(found, key=lambda x: (x[1]["is_dead"], -x[1]["selectivity"], -x[1]["support"]))[:top]


def describe(schema: tuple[Step, ...]) -> str:
    """The types along a path, each step with its qualifier and direction."""
    return schema[0].ends[0] + "".join(f" <-{s.qualifier}- {s.ends[1]}" if s.backwards else f" -{s.qualifier}-> {s.ends[1]}" for s in schema)


def discover(log: Log, source: str, target: str | None = None, max_length: int = 3, through: set[str] | None = None, least_selectivity: float = 0.0, top: int | None = None, **how) -> DataFrame:
    """schema, length, the measures of each, and equivalence (schemas that connect the same pairs have the same number),
    for every path between the types: alive ones first, then by selectivity and support. Schemas below least_selectivity
    are left out. There are as many rows as paths over the graph of types, each from its own aggregates."""
    rows = None
    for schema in enumerate_schemas(log, source, target, max_length, through):
        pairs = connections(log, schema, **how).select("source", "target").distinct()
        same = pairs.agg(F.count("*").alias("_n"), F.coalesce(F.bit_xor(F.xxhash64("source", "target")), F.lit(0)).alias("_x"))
        one = measures(log, schema, **how).crossJoin(same).select(F.lit(describe(schema)).alias("schema"), F.lit(len(schema)).alias("length"), "*")
        rows = one if rows is None else rows.union(one)
    if rows is None:
        none = measures(log, (Step("o2o", source, target or source, ""),), **how)
        return none.select(F.lit("").alias("schema"), F.lit(0).alias("length"), "*", F.lit(0).alias("equivalence")).limit(0)
    number = F.dense_rank().over(Window.orderBy("_n", "_x"))  # a row for each schema
    rows = rows.withColumn("equivalence", number).drop("_n", "_x").where(F.col("selectivity") >= least_selectivity)
    rows = rows.orderBy("is_dead", F.desc("selectivity"), F.desc("support"), "schema")
    return rows if top is None else rows.limit(top)


@dataclass
class Detail:
    """pairs: source, target, seconds; samples: seconds; degrees: as degrees() gives them."""

    pairs: DataFrame
    samples: DataFrame
    degrees: DataFrame


def detail(log: Log, schema: tuple[Step, ...], most_pairs: int = 2000, most_samples: int = 50_000, **how) -> Detail:
    """What a page about one schema shows: the first pairs, an even sample of durations (those of the pairs with the least
    hashes, so all are as likely and reruns agree), and the degrees of all elements. Both lists end where they are asked to."""
    pairs = connections(log, schema, **how)
    even = pairs.where("seconds is not null").orderBy(F.xxhash64("source", "target"), "source", "target").limit(most_samples).select("seconds")
    return Detail(pairs.orderBy("source", "target").limit(most_pairs), even, degrees(log, schema, **how))


def to_tree(schema: tuple[Step, ...], bound_seconds: float | None = None) -> dict:
    """One box that binds the path's elements; consecutive events are at most bound_seconds apart, the earlier first."""
    names: dict[str, tuple[str, int]] = {}
    events: dict[str, list[str]] = {}
    objects: dict[str, list[str]] = {}
    order: list[str] = []
    kinds = {t: "event" if s.relation == "e2o" and t == s.source else "object" for s in schema for t in (s.source, s.target)}
    for t in [schema[0].ends[0]] + [s.ends[1] for s in schema]:
        own = events if kinds[t] == "event" else objects
        names[t] = (kinds[t], len(own))
        own[str(len(own))] = [t]
        order.append(t)
    filters: list[dict] = []
    for s in schema:
        (_, a), (_, b) = names[s.source], names[s.target]
        if s.relation == "e2o":
            filters.append({"type": "O2E", "object": b, "event": a, "qualifier": s.qualifier})
        else:
            filters.append({"type": "O2O", "object": a, "other_object": b, "qualifier": s.qualifier})
    path_events = [names[t][1] for t in order if kinds[t] == "event"]
    for a, b in zip(path_events, path_events[1:], strict=False):
        filters.append({"type": "TimeBetweenEvents", "from_event": a, "to_event": b, "min_seconds": 0, "max_seconds": bound_seconds})
    return {"nodes": [{"Box": [{"newEventVars": events, "newObjectVars": objects, "filters": filters, "sizeFilters": [], "constraints": []}, []]}], "edgeNames": []}


def expand_types(log: Log, types: set[str], hub_limit: int = 10, most: int = 50) -> set[str]:
    """Types one edge away from the given ones; a type with more than hub_limit neighbours is not expanded."""
    near: dict[str, set[str]] = {}
    for r in type_graph(log).select("source", "target").distinct().toLocalIterator():
        near.setdefault(r["source"], set()).add(r["target"])
        near.setdefault(r["target"], set()).add(r["source"])
    found = sorted(x for t in types if len(near.get(t, ())) <= hub_limit for x in near.get(t, ()))
    return set(types) | set(list(dict.fromkeys(x for x in found if x not in types))[: max(0, most - len(types))])


def connected_types(log: Log, start: str, top: int = 10) -> list[str]:
    """The types most strongly connected with one: by relations between them, then by name."""
    graph = type_graph(log)
    both = graph.select(F.col("source").alias("a"), F.col("target").alias("b"), "n").union(graph.select("target", "source", "n"))
    found = both.where((F.col("a") == start) & (F.col("b") != start)).groupBy("b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "b").limit(top)
    return [r["b"] for r in found.toLocalIterator()]


def integer_bins(values: DataFrame, column: str) -> DataFrame:
    """low, high, n: a bin for each whole number in a range of up to 40, else as many as Sturges' rule gives."""
    r = values.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("n")).first()
    if not r["n"]:
        return values.select(F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).cast("bigint").alias("n")).limit(0)
    width = 1 if r["high"] - r["low"] <= 40 else max(1, -(-(r["high"] - r["low"] + 1) // (int(r["n"]).bit_length() + 1)))
    low = F.floor((F.col(column) - int(r["low"])) / width) * int(width) + int(r["low"])
    return values.where(F.col(column).isNotNull()).groupBy(low.alias("low")).agg(F.count("*").alias("n")).select("low", (F.col("low") + int(width) - 1).alias("high"), "n")
