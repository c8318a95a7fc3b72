"""Extraction: tables to a log by a declarative blueprint, as lazy DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import Log, tagged

# Patterns that automatic time parsing tries, in order. Day-first comes before month-first.
ZONED = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XX", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XX", "d MMM yyyy HH:mm:ss XX")
NAIVE = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "dd-MM-yyyy HH:mm:ss")
DATES = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy")
# What strftime letters are called in Spark.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "f": "SSSSSS", "z": "XX", "j": "DDD", "p": "a", "I": "hh", "e": "d", "T": "HH:mm:ss", "F": "yyyy-MM-dd"}


def text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def value(said: dict | None) -> Column:
    """column, constant or template expression; a template with a missing part is null."""
    if said is None:
        return F.lit(None).cast("string")
    kind = said["type"]
    if kind == "column":
        return text(said["column"])
    if kind == "constant":
        return F.lit(said["value"])
    if kind == "template":
        parts = re.split(r"\{([^{}]+)\}", said["template"])
        return F.concat(*[text(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)])
    raise ValueError(f"unknown value expression {kind}")


def _first(c: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in patterns])


def parse_time(c: Column, form: dict | None = None) -> Column:
    """A text as a time in UTC: format auto, format-string (strftime), unix-seconds or unix-millis; null if it is none."""
    kind = (form or {"type": "auto"})["type"]
    # A pattern that an older parser would have let pass is just one that does not fit.
    SparkSession.active().conf.set("spark.sql.legacy.timeParserPolicy", "CORRECTED")
    c = F.regexp_replace(F.trim(c), "^[A-Za-z]{3}, ", "")
    if kind == "unix-seconds":
        return F.timestamp_seconds(c.try_cast("double"))
    if kind == "unix-millis":
        return F.timestamp_millis(c.try_cast("bigint"))
    if kind == "format-string":
        pattern = re.sub(r"%(.)|([A-Za-z]+)", lambda m: STRFTIME[m[1]] if m[1] else f"'{m[2]}'", form["format"])
        return F.try_to_timestamp(c, F.lit(pattern))
    return F.coalesce(_first(c, ZONED), _first(c, NAIVE), _first(c, DATES))


def time_of(said: dict, df: DataFrame) -> Column:
    """A timestamp source: column, components (date and time), or constant. Columns that are times stay as they are."""
    kinds = dict(df.dtypes)
    kind = said["type"]
    if kind == "constant":
        return parse_time(F.lit(said["value"]), said.get("format"))
    if kind == "column":
        name = said["column"]
        if kinds[name] in ("timestamp", "timestamp_ntz", "date"):
            return F.col(f"`{name}`").cast("timestamp")
        return parse_time(text(name), said.get("format"))
    d, t = text(said["date_column"]), text(said["time_column"])
    day = F.split_part(F.replace(d, F.lit("T"), F.lit(" ")), F.lit(" "), F.lit(1))
    clock = F.element_at(F.split(F.replace(t, F.lit("T"), F.lit(" ")), " "), -1)
    return F.coalesce(parse_time(F.concat_ws(" ", d, t)), parse_time(F.concat_ws(" ", day, clock)), parse_time(d), parse_time(t))


def condition(said: dict | None) -> Column:
    """OR, AND, column-equals, column-not-equals (missing is true), column-matches, column-not-empty; never null."""
    if said is None:
        return F.lit(True)
    kind = said["type"]
    if kind in ("OR", "AND"):
        own = [condition(x) for x in said["conditions"]]
        return reduce((lambda a, b: a | b) if kind == "OR" else (lambda a, b: a & b), own, F.lit(kind == "AND"))
    c = text(said["column"])
    if kind == "column-equals":
        return F.coalesce(c == said["value"], F.lit(False))
    if kind == "column-not-equals":
        return F.coalesce(c != said["value"], F.lit(True))
    if kind == "column-matches":
        re.compile(said["pattern"])
        return F.coalesce(c.rlike(said["pattern"]), F.lit(False))
    if kind == "column-not-empty":
        return F.coalesce(c != "", F.lit(False))
    raise ValueError(f"unknown condition {kind}")


def split_values(c: Column, said: dict | None) -> Column:
    """A text's values: as it is, split by a delimiter, or a pattern's matches (its groups if it has any); trimmed, and
    empty ones dropped."""
    raw = F.coalesce(c, F.lit(""))
    if said is None or not said.get("enabled", True):
        return F.filter(F.array(raw), lambda x: x != "")
    if said.get("pattern"):
        try:
            groups = re.compile(said["pattern"]).groups
        except re.error:
            return F.array().cast("array<string>")
        found = [F.regexp_extract_all(raw, F.lit(said["pattern"]), F.lit(g)) for g in (range(1, groups + 1) if groups else [0])]
        parts = F.flatten(F.transform(F.arrays_zip(*[f.alias(f"g{i}") for i, f in enumerate(found)]), lambda z: F.array(*[z[f"g{i}"] for i in range(len(found))])))
    else:
        parts = F.split(raw, re.escape(said.get("delimiter", ",")), -1)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def transform(said: dict, tables: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """A virtual table: filter, join (keys compared as text; a clashing name on the right gets right_), union by name
    (the first source's columns)."""
    kind = said["type"]
    if kind == "filter":
        return tables[said["source"]].where(condition(said["condition"]))
    if kind == "join":
        how = said.get("join_type", "inner")
        if strict and how != "inner":
            raise ValueError(f"{how} joins are not supported")
        left, right = tables[said["left"]], tables[said["right"]]
        keys = [tuple(k) for k in said["on"]]
        drop = {b for a, b in keys if a == b and how in ("inner", "left")}
        renamed = right.select(*[F.col(f"`{c}`").alias(f"right_{c}" if c in left.columns else c) for c in right.columns])
        name = lambda b: f"right_{b}" if b in left.columns else b
        on = reduce(lambda x, y: x & y, [left[a].cast("string").eqNullSafe(renamed[name(b)].cast("string")) for a, b in keys])
        return left.join(renamed, on, how).drop(*[name(b) for b in drop])
    if kind == "union":
        parts = [tables[s] for s in said["sources"]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.select(*[c for c in p.columns if c in parts[0].columns]) for p in parts]).select(*parts[0].columns)
    raise ValueError(f"unknown transform {kind}")


def virtual_tables(said: list[dict], tables: dict[str, DataFrame], strict: bool = False) -> dict[str, DataFrame]:
    """All tables, virtual ones in order of what they need; a cycle is an error."""
    needs = {v["name"]: {x for key in ("source", "left", "right") if (x := v["operation"].get(key))} | set(v["operation"].get("sources", ())) for v in said}
    try:
        order = list(TopologicalSorter(needs).static_order())
    except CycleError as e:
        raise ValueError(f"virtual tables need each other: {e.args[1]}") from e
    own, out = {v["name"]: v["operation"] for v in said}, dict(tables)
    for name in order:
        if name in own:
            out[name] = transform(own[name], out, strict)
    return out


@dataclass
class Report:
    success: bool = True
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    log: Log | None = None

    def totals(self) -> DataFrame:
        """kind (event or object), type_name and n of what was extracted."""
        return self.log.events.select(F.lit("event").alias("kind"), F.col("ev_type").alias("type_name")).union(self.log.objects.select(F.lit("object"), "ob_type")).groupBy("kind", "type_name").agg(F.count("*").alias("n"))

    def summary(self) -> dict:
        """The report with total_events, total_objects, event_types and object_types: one job over the log."""
        rows = self.totals().collect()  # a row for each type
        own = {k: {r["type_name"]: r["n"] for r in rows if r["kind"] == k} for k in ("event", "object")}
        return {"success": self.success, "total_events": sum(own["event"].values()), "total_objects": sum(own["object"].values()), "event_types": sorted(own["event"]), "object_types": sorted(own["object"]), "errors": self.errors, "warnings": self.warnings}


#: Of more equal rows, each so many are made by a task of their own.
EQUAL_ROWS = 10_000


def numbered(df: DataFrame, prefix: Column) -> DataFrame:
    """df with _id: the prefix, a digest of the row and, of equal rows after the first, a number. Equal rows are counted,
    with partial aggregation, and given out again, so no order of rows is needed and none of them is lost. Spark takes
    what is given out for as large as the counts: see unsized()."""
    names = [F.col(f"`{c}`") for c in df.columns]
    counted = df.groupBy(*names).agg(F.count("*").alias("_n"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(EQUAL_ROWS).cast("long")))
    many = counted.where(F.col("_n") > EQUAL_ROWS).withColumn("_from", first).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names, "_from")
    parts = counted.where(F.col("_n") <= EQUAL_ROWS).withColumn("_from", F.lit(0).cast("long")).unionByName(many)
    digest = F.concat(F.hex(F.xxhash64(*names)), F.hex(F.xxhash64(F.lit(1), *reversed(names))))
    each = parts.withColumn("_id", F.concat(prefix, digest)).withColumn("_nth", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + EQUAL_ROWS, F.col("_n")) - 1)))
    nth = F.when(F.col("_nth") > 0, F.concat(F.lit("-"), F.col("_nth").cast("string"))).otherwise(F.lit(""))
    return each.withColumn("_id", F.concat("_id", nth)).drop("_n", "_from", "_nth")


def unsized(df: DataFrame) -> DataFrame:
    """df, which joins do not broadcast: what numbered() gives out is larger than Spark takes it for, by any factor."""
    return df.hint("merge")


def identified(df: DataFrame, given: Column | None, prefix: Column) -> DataFrame:
    """df with _id: what is given or, where that is null, an id of the row's own."""
    if given is None:
        return numbered(df, prefix)
    return df.where(given.isNotNull()).withColumn("_id", given).unionByName(numbered(df.where(given.isNull()), prefix))


_OBJECTS, _EVENTS = "ob_id string, ob_type string", "ev_id string, ev_type string, ev_time timestamp"


def _qualified(kind: Column, ident: Column, prefix: bool) -> Column:
    return F.concat(kind, F.lit("-"), ident) if prefix else ident


class Extraction:
    """Rows of every usage, collected as plans and put together by log()."""

    def __init__(self, spark: SparkSession, blueprint: dict, sources: dict[str, DataFrame], strict: bool = False):
        self.spark, self.report = spark, Report()
        self.objects: list[DataFrame] = []
        self.events: list[DataFrame] = []
        self.object_attrs: list[DataFrame] = []
        self.event_attrs: list[DataFrame] = []
        self.links: list[tuple[str, DataFrame, str | None]] = []
        self.tables = virtual_tables(blueprint.get("virtual_tables", []), sources, strict)
        usages = [(t["source"], u) for t in blueprint.get("tables", []) for u in t["usages"]]
        #: Whether rows without an id are numbered, so Spark does not know how many there are.
        self.numbers = any(u["mode"] in ("event", "change-table") and not any(x.get("id") for x in (u, *u.get("rules", ()))) for _, u in usages)
        #: Types whose ids carry the type as a prefix, so relations to them do too.
        self.prefixed = {u["object_type"]["value"] for _, u in usages if u.get("prefix_id_with_type") and u["object_type"]["type"] == "constant"}
        rank = {"object": 0, "change-table": 1, "event": 1, "e2o-relation": 2, "o2o-relation": 2}
        for source, u in sorted(usages, key=lambda x: (rank[x[1]["mode"]], not x[1].get("attributes"))):
            try:
                df = self.tables[source].where(condition(u.get("filter")))
                getattr(self, "_" + u["mode"].replace("-", "_"))(df, u, source)
            except (KeyError, ValueError, re.error) as e:
                self.report.errors.append(f"{source}: {e}")
        self.report.success = not self.report.errors

    def _object(self, df: DataFrame, u: dict, source: str) -> None:
        kind = value(u["object_type"])
        ident = _qualified(kind, value(u["object_id"]), bool(u.get("prefix_id_with_type")))
        self._add_objects(df.select(ident.alias("ob_id"), kind.alias("ob_type")))
        attrs = u.get("attributes")
        if not attrs:
            return
        at = time_of(u["timestamp"], df) if u.get("timestamp") else F.lit("1970-01-01 00:00:00").cast("timestamp")
        if attrs["type"] == "dynamic":
            rows = F.array(F.struct(text(attrs["name_column"]).alias("name"), text(attrs["value_column"]).alias("v")))
        else:
            rows = F.array(*[F.struct(F.lit(m["attribute"]).alias("name"), text(m["column"]).alias("v")) for m in attrs["mappings"]])
        own = df.select(ident.alias("ob_id"), kind.alias("ob_type"), at.alias("time"), F.explode(rows).alias("a"))
        self.object_attrs.append(own.select("ob_id", "ob_type", "a.name", "time", F.lit(0).alias("seq"), tagged("string", F.col("a.v")).alias("v")).where("name is not null and v.s is not null and time is not null and ob_id is not null"))

    def _add_objects(self, df: DataFrame) -> None:
        """ob_id and ob_type, with their place among all that name objects."""
        self.objects.append(df.withColumn("place", F.lit(len(self.objects))))

    def _add_event(self, df: DataFrame, kind: Column, at: Column, attributes: list[dict], refs: list[dict]) -> None:
        own = df.select("*", kind.alias("_kind"), at.alias("_at")).where("_id is not null and _kind is not null and _at is not null")
        self.events.append(own.select(F.col("_id").alias("ev_id"), F.col("_kind").alias("ev_type"), F.col("_at").alias("ev_time")))
        if attributes:
            rows = F.array(*[F.struct(F.lit(m["attribute"]).alias("name"), text(m["column"]).alias("v")) for m in attributes])
            exploded = own.select(F.col("_id").alias("ev_id"), F.col("_kind").alias("ev_type"), F.posexplode(rows).alias("seq", "a"))
            self.event_attrs.append(exploded.select("ev_id", "ev_type", "a.name", "seq", tagged("string", F.col("a.v")).alias("v")).where("v.s is not null"))
        for r in refs:
            kind_col = value(r.get("object_type")) if r.get("object_type") else None
            prefix = bool(r.get("object_type")) and r["object_type"]["type"] == "constant" and r["object_type"]["value"] in self.prefixed
            ids = own.select("_id", (kind_col if kind_col is not None else F.lit(None).cast("string")).alias("ob_type"), F.explode(split_values(value(r["object_id"]), r.get("multi_value"))).alias("ob_id"), F.coalesce(value(r.get("qualifier")), F.lit("")).alias("qualifier"))
            ids = ids.withColumn("ob_id", _qualified(F.col("ob_type"), F.col("ob_id"), prefix))
            if kind_col is not None:
                self._add_objects(ids.select("ob_id", "ob_type").where("ob_type is not null"))
            self.links.append(("e2o", ids.select(F.col("_id").alias("a"), F.col("ob_id").alias("b"), "qualifier"), None))

    def _event(self, df: DataFrame, u: dict, source: str) -> None:
        own = identified(df, value(u["id"]) if u.get("id") else None, F.lit(f"{source}-"))
        self._add_event(own, value(u["event_type"]), time_of(u["timestamp"], own), u.get("attributes") or [], u.get("inline_objects") or [])

    def _change_table(self, df: DataFrame, u: dict, source: str) -> None:
        """The first rule that fits gives a row's event; a rule with a bad pattern is reported, and the others stay."""
        rules = []
        for rule in u["rules"]:
            try:
                rules.append((condition(rule["condition"]), rule))
            except re.error as e:
                self.report.errors.append(f"{source}: rule '{rule['event_type']}': {e}")
        nothing = F.lit(None).cast("string")
        kind, ident = nothing, nothing
        for fits, rule in reversed(rules):
            kind, ident = F.when(fits, F.lit(rule["event_type"])).otherwise(kind), F.when(fits, value(rule.get("id"))).otherwise(ident)
        own = identified(df.where(kind.isNotNull()), ident if any(rule.get("id") for _, rule in rules) else None, F.concat(F.lit(f"{source}_"), kind, F.lit("_")))
        self._add_event(own, kind, time_of(u["timestamp"], own), u.get("attributes") or [], u.get("inline_objects") or [])

    def _relation(self, df: DataFrame, u: dict, relation: str, left: str, right: str) -> None:
        own = df.select(F.explode(split_values(value(u[left]), u.get(f"{left}_multi_value"))).alias("a"), "*").select("a", F.explode(split_values(value(u[right]), u.get(f"{right}_multi_value"))).alias("b"), F.coalesce(value(u.get("qualifier")), F.lit("")).alias("qualifier"))
        self.links.append((relation, own, None))

    def _e2o_relation(self, df: DataFrame, u: dict, source: str) -> None:
        self._relation(df, u, "e2o", "event_id", "object_id")

    def _o2o_relation(self, df: DataFrame, u: dict, source: str) -> None:
        self._relation(df, u, "o2o", "source_id", "target_id")

    def log(self) -> Log:
        """The tables. Of objects with one id the first type stays, in the order of usages, then by name; of events with
        one id the earliest, then the first type by name. Relations need both ends."""
        sized = unsized if self.numbers else lambda df: df
        empty = Log.empty(self.spark)
        union = lambda parts, none: reduce(DataFrame.unionByName, parts) if parts else none
        objects = union(self.objects, empty.objects.withColumn("place", F.lit(0))).where("ob_id is not null and ob_type is not null")
        objects = objects.groupBy("ob_id").agg(F.min(F.struct("place", "ob_type")).alias("o")).select("ob_id", "o.ob_type")
        events = union(self.events, empty.events).groupBy("ev_id").agg(F.min(F.struct("ev_time", "ev_type")).alias("e")).select("ev_id", "e.ev_type", "e.ev_time")
        objects, events = sized(objects), sized(events)
        pairs = {n: union([d for k, d, _ in self.links if k == n], self.spark.createDataFrame([], "a string, b string, qualifier string")).distinct() for n in ("e2o", "o2o")}
        e2o = pairs["e2o"].join(events, F.col("a") == F.col("ev_id")).join(objects, F.col("b") == F.col("ob_id")).select("ev_id", "ev_type", "ev_time", "ob_id", "ob_type", "qualifier")
        src, tgt = (objects.select(F.col("ob_id").alias(f"{s}_id"), F.col("ob_type").alias(f"{s}_type")) for s in ("src", "tgt"))
        o2o = pairs["o2o"].join(src, F.col("a") == F.col("src_id")).join(tgt, F.col("b") == F.col("tgt_id")).select("src_id", "src_type", "tgt_id", "tgt_type", "qualifier")
        e2o, event_attrs, object_attrs = sized(e2o), sized(union(self.event_attrs, empty.event_attrs)), union(self.object_attrs, empty.object_attrs)
        kinds = event_attrs.select(F.lit("event").alias("kind"), F.col("ev_type").alias("type_name"), F.col("name").alias("attr_name")).union(object_attrs.select(F.lit("object"), "ob_type", "name")).distinct()
        return Log(events, objects, event_attrs, object_attrs, e2o, o2o, kinds.withColumn("attr_type", F.lit("string")))


def extract(spark: SparkSession, blueprint: dict, sources: dict[str, DataFrame], strict: bool = False) -> tuple[Log, Report]:
    e = Extraction(spark, blueprint, sources, strict)
    e.report.log = e.log()
    return e.report.log, e.report
