"""An object-centric event log as seven DataFrames, and summaries of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALUE = "struct<t:string,s:string,i:bigint,d:double,b:boolean,ts:timestamp>"
SCHEMAS = {
    "events": "ev_id string, ev_type string, ev_time timestamp",
    "objects": "ob_id string, ob_type string",
    "event_attrs": f"ev_id string, ev_type string, name string, seq int, v {VALUE}",
    "object_attrs": f"ob_id string, ob_type string, name string, time timestamp, seq int, v {VALUE}",
    "e2o": "ev_id string, ev_type string, ev_time timestamp, ob_id string, ob_type string, qualifier string",
    "o2o": "src_id string, src_type string, tgt_id string, tgt_type string, qualifier string",
    "types": "kind string, type_name string, attr_name string, attr_type string",
}
_FIELDS = {"string": "s", "integer": "i", "float": "d", "boolean": "b", "time": "ts"}


def tagged(kind: str, value: Column) -> Column:
    """A value of a kind (string, integer, float, boolean, time) as the tagged struct; null has the kind null."""
    sql = {"s": "string", "i": "bigint", "d": "double", "b": "boolean", "ts": "timestamp"}
    parts = [(value if f == _FIELDS[kind] else F.lit(None)).cast(t).alias(f) for f, t in sql.items()]
    return F.struct(F.when(value.isNull(), F.lit("null")).otherwise(F.lit(kind)).alias("t"), *parts)


def rendered(v: Column) -> Column:
    """A tagged value as text; times in UTC."""
    return F.coalesce(v["s"], v["i"].cast("string"), v["d"].cast("string"), v["b"].cast("string"), F.date_format(v["ts"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))


#: Events or objects that an expression may ask for as one list.
MOST_LISTED = 100_000


@dataclass
class Log:
    events: DataFrame
    objects: DataFrame
    event_attrs: DataFrame
    object_attrs: DataFrame
    e2o: DataFrame
    o2o: DataFrame
    types: DataFrame
    #: What the source guarantees, which saves a shuffle each: an (event, object) or (object, object) pair has one
    #: qualifier; an event has an attribute once.
    single_pairs: bool = False
    single_event_attrs: bool = False
    #: By event type, where the source has an event's relations side by side: ev_id, ev_time and a column for each of some
    #: object types. Each event has exactly one object of each of these types; equal rows are one event.
    wide: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.events.sparkSession

    @staticmethod
    def empty(spark: SparkSession) -> Log:
        return Log(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})

    def pairs(self, relation: str, keys: tuple[str, str], qualifier: str | None, left: list[str] | None, right: list[str] | None, *more: str) -> DataFrame:
        """Distinct endpoint pairs of e2o or o2o, of the types and qualifier asked for (None: any)."""
        df = getattr(self, relation)
        types = {"e2o": ("ev_type", "ob_type"), "o2o": ("src_type", "tgt_type")}[relation]
        for column, allowed in zip(types, (left, right), strict=True):
            if allowed is not None:
                df = df.where(F.col(column).isin(allowed))
        if qualifier is not None:
            df = df.where(F.col("qualifier") == qualifier)
        df = df.select(*keys, *more)
        return df if self.single_pairs else df.dropDuplicates(list(keys))

    def event_values(self, name: str) -> DataFrame:
        """ev_id, v: the first value of an attribute."""
        df = self.event_attrs.where(F.col("name") == name)
        if self.single_event_attrs:
            return df.select("ev_id", "v")
        return df.groupBy("ev_id").agg(F.min_by("v", "seq").alias("v"))

    def object_values(self, name: str, which: str = "listed") -> DataFrame:
        """ob_id, v: an attribute's first listed or its earliest value."""
        order = F.col("seq") if which == "listed" else F.struct("time", "seq")
        return self.object_attrs.where(F.col("name") == name).groupBy("ob_id").agg(F.min_by("v", order).alias("v"))

    # Summaries.

    def e2o_summary(self) -> DataFrame:
        """For every event type and object type: relations and qualifiers, zero and empty where there are none."""
        return self._cross("e2o", ("ev_type", "ob_type"), self.events.select("ev_type").distinct())

    def o2o_summary(self) -> DataFrame:
        return self._cross("o2o", ("src_type", "tgt_type"), self.objects.select(F.col("ob_type").alias("src_type")).distinct())

    def _cross(self, relation: str, keys: tuple[str, str], left: DataFrame) -> DataFrame:
        # Both sides are type names: as many as the log's schema has.
        right = self.objects.select(F.col("ob_type").alias(keys[1])).distinct()
        found = getattr(self, relation).groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("qualifier")), ",").alias("qualifiers"))
        return left.crossJoin(right).join(found, list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("qualifiers", F.lit("")).alias("qualifiers"))

    def totals(self) -> DataFrame:
        count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        return count(self.events, "events").union(count(self.objects, "objects")).union(count(self.e2o, "e2o")).union(count(self.o2o, "o2o"))

    def qualifiers_per_event_type(self) -> DataFrame:
        """For each event type and qualifier: the object types, and whether some event has several objects so qualified."""
        per_event = self.e2o.groupBy("ev_type", "qualifier", "ev_id").agg(F.count_distinct("ob_id").alias("n"), F.collect_set("ob_type").alias("own"))
        out = per_event.groupBy("ev_type", "qualifier").agg(F.max("n").alias("most"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("own")))).alias("types"))
        return out.select("ev_type", "qualifier", F.array_join("types", ",").alias("object_types"), (F.col("most") > 1).alias("multiple"))

    def sample_ids(self, n: int = 10) -> DataFrame:
        """The first n event and object ids, at most 1000 of each."""
        n = min(n, 1000)
        return self.events.select(F.lit("event").alias("kind"), F.col("ev_id").alias("id")).orderBy("id").limit(n).union(self.objects.select(F.lit("object").alias("kind"), F.col("ob_id").alias("id")).orderBy("id").limit(n))

    def element(self, kind: str, ident: str) -> DataFrame:
        """An event or object by id: its type, time, attributes and relations as JSON."""
        own = "ev_id" if kind == "event" else "ob_id"
        base = (self.events if kind == "event" else self.objects).where(F.col(own) == ident)
        attrs = (self.event_attrs if kind == "event" else self.object_attrs).where(F.col(own) == ident)
        attrs = attrs.groupBy(own).agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", *(["time"] if kind != "event" else []), "seq", rendered(F.col("v")).alias("value"))))).alias("attributes"))
        if kind == "event":
            rels = self.e2o.where(F.col("ev_id") == ident).select(own, F.struct("ob_id", "qualifier").alias("r"))
        else:
            rels = self.o2o.where(F.col("src_id") == ident).select(F.col("src_id").alias(own), F.struct(F.col("tgt_id").alias("ob_id"), "qualifier").alias("r"))
        rels = rels.groupBy(own).agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("relationships"))
        return base.join(attrs, own, "left").join(rels, own, "left")

    def listed(self, what: str, most: int = MOST_LISTED) -> DataFrame:
        """One row with elements: an array of id, type, time (null of objects) and attrs (each attribute's first listed
        value) of all events or objects. An expression that asks for it has it beside every row, so more than most
        elements are refused."""
        events = what == "events"
        base, key, kind = (self.events, "ev_id", "ev_type") if events else (self.objects, "ob_id", "ob_type")
        if base.limit(most + 1).count() > most:
            raise ValueError(f"{what}() lists at most {most} elements; count them with numEvents() or numObjects()")
        values = self.event_attrs if events else self.object_attrs
        first = values.groupBy(key, "name").agg(F.min_by("v", "seq").alias("v")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("attrs"))
        at = F.col("ev_time") if events else F.lit(None).cast("timestamp")
        own = base.join(first, key, "left").select(F.struct(F.col(key).alias("id"), F.col(kind).alias("type"), at.alias("time"), "attrs").alias("x"))
        return own.agg(F.collect_list("x").alias("elements"))

    def persist(self) -> Log:
        for name in SCHEMAS:
            getattr(self, name).persist()
        return self

    def unpersist(self) -> None:
        for name in SCHEMAS:
            getattr(self, name).unpersist()
