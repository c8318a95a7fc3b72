"""Object-centric logs in files: JSON, XML, SQLite; case-centric logs (XES). Read with Spark's readers where it has them."""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..log import SCHEMAS, Log, rendered, tagged

_ATTR = "array<struct<name:string,type:string>>"
_TYPES = f"array<struct<name:string,attributes:{_ATTR}>>"
_REL = "array<struct<objectId:string,qualifier:string>>"
JSON_SCHEMA = (
    f"objectTypes {_TYPES}, eventTypes {_TYPES}, objects array<struct<id:string,type:string,attributes:array<struct<name:string,value:string,time:string>>,relationships:{_REL}>>, "
    f"events array<struct<id:string,type:string,time:string,attributes:array<struct<name:string,value:string>>,relationships:{_REL}>>"
)
# The endings of files that hold logs.
ENDINGS = {".json": "json", ".json.gz": "json", ".jsonocel": "json", ".xml": "xml", ".xml.gz": "xml", ".xmlocel": "xml", ".sqlite": "sqlite", ".sqlite3": "sqlite", ".db": "sqlite", ".xes": "xes", ".xes.gz": "xes"}


def format_of(path: str) -> str:
    for ending, kind in sorted(ENDINGS.items(), key=lambda x: -len(x[0])):
        if path.lower().endswith(ending):
            return kind
    raise ValueError(f"not a log by its name: {path}")


def read_log(spark: SparkSession, path: str, kind: str | None = None) -> Log:
    return {"json": read_json, "xml": read_xml, "sqlite": read_sqlite, "xes": read_xes}[kind or format_of(path)](spark, path)


def available(spark: SparkSession, folder: str) -> list[str]:
    """Names of the log files in a folder of any file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return sorted(n for n in (f.getPath().getName() for f in found) if any(n.lower().endswith(e) for e in ENDINGS))


def _typed(raw: Column, kind: Column) -> Column:
    """A text as a tagged value of its declared type; what is not of it stays text."""
    number = F.when(kind == "integer", tagged("integer", raw.try_cast("bigint"))).when(kind == "float", tagged("float", raw.try_cast("double"))).when(kind == "boolean", tagged("boolean", raw.try_cast("boolean"))).when(kind == "time", tagged("time", raw.try_cast("timestamp")))
    return F.when(number.isNotNull() & (number["t"] != "null"), number).otherwise(tagged("string", raw))


def _assemble(spark: SparkSession, events: DataFrame, objects: DataFrame, event_attrs: DataFrame, object_attrs: DataFrame, e2o: DataFrame, o2o: DataFrame, types: DataFrame) -> Log:
    """events(id, type, time), objects(id, type), attributes(id, name, seq, value[, time]), relations(a, b, qualifier),
    types(kind, type_name, attr_name, attr_type) as a log; attributes by their declared types, relations with both ends."""
    ev = events.select(F.col("id").alias("ev_id"), F.col("type").alias("ev_type"), F.col("time").cast("timestamp").alias("ev_time"))
    ob = objects.select(F.col("id").alias("ob_id"), F.col("type").alias("ob_type"))
    declared = lambda kind, t: types.where((F.col("kind") == kind) & F.col("attr_name").isNotNull()).select(F.col("type_name").alias(t), F.col("attr_name").alias("name"), "attr_type")
    # What stands inside its event or object has its type (and time) already. The declared types are as many as names.
    own = lambda df, base, key, kind: df.where("id is not null").withColumnsRenamed({"id": key, "type": kind}) if "type" in df.columns else df.withColumnRenamed("id", key).join(base, key)
    ea = own(event_attrs, ev.select("ev_id", "ev_type"), "ev_id", "ev_type").join(F.broadcast(declared("event", "ev_type")), ["ev_type", "name"], "left")
    oa = own(object_attrs, ob, "ob_id", "ob_type").join(F.broadcast(declared("object", "ob_type")), ["ob_type", "name"], "left")
    ea = ea.select("ev_id", "ev_type", "name", F.col("seq").cast("int").alias("seq"), _typed(F.col("value"), F.coalesce("attr_type", F.lit("string"))).alias("v"))
    oa = oa.select("ob_id", "ob_type", "name", F.col("time").cast("timestamp").alias("time"), F.col("seq").cast("int").alias("seq"), _typed(F.col("value"), F.coalesce("attr_type", F.lit("string"))).alias("v"))
    of_event = e2o.where("a is not null").select(F.col("a").alias("ev_id"), F.col("type").alias("ev_type"), F.col("time").cast("timestamp").alias("ev_time"), "b", "qualifier") if "type" in e2o.columns else e2o.join(ev, F.col("a") == F.col("ev_id"))
    links = of_event.join(ob, F.col("b") == F.col("ob_id")).select("ev_id", "ev_type", "ev_time", "ob_id", "ob_type", "qualifier")
    src, tgt = (ob.select(F.col("ob_id").alias(f"{s}_id"), F.col("ob_type").alias(f"{s}_type")) for s in ("src", "tgt"))
    of_object = o2o.where("a is not null").select(F.col("a").alias("src_id"), F.col("type").alias("src_type"), "b", "qualifier") if "type" in o2o.columns else o2o.join(src, F.col("a") == F.col("src_id"))
    return Log(ev, ob, ea, oa, links, of_object.join(tgt, F.col("b") == F.col("tgt_id")).select("src_id", "src_type", "tgt_id", "tgt_type", "qualifier"), types)


#: The file beside the parts of a document that says that _written() wrote them: an element a line.
LINES = "_lines"
#: Whether shuffle files go when a query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of events, as Spark estimates them, from which a document is written in parts.
LARGE = 16 << 20


def _large(log: Log) -> bool:
    return int(str(log.events._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= LARGE


@contextmanager
def _once(spark: SparkSession, path: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Puts what a document asks for several times into a table beside the path meanwhile, as its plan may be long. What
    was shuffled for a table or a document goes from the disks as soon as that is written."""
    folder = f"{path.rstrip('/')}-tables"
    set_before = spark.conf.get(CLEANUP, None)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}", compression="zstd")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    spark.conf.set(CLEANUP, "true")
    try:
        yield kept
    finally:
        spark.conf.unset(CLEANUP) if set_before is None else spark.conf.set(CLEANUP, set_before)
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _named(log: Log, elements: dict[str, DataFrame], of: Column) -> DataFrame:
    """kind, type_name, attributes (of each declared one, in order) of the types that elements have."""
    present = elements["events"].select(F.lit("event").alias("kind"), F.col("type").alias("type_name")).union(elements["objects"].select(F.lit("object"), "type")).distinct()
    return present.join(log.types.where("attr_name is not null"), ["kind", "type_name"], "left").groupBy("kind", "type_name").agg(F.array_sort(F.collect_list(F.when(F.col("attr_name").isNotNull(), of))).alias("attributes"))


def _written(spark: SparkSession, members: list[tuple[str, str, DataFrame]], path: str, large: bool) -> None:
    """Text in the folder path: each member's opening, its lines (key, value) and its closing. A small document is one
    sorted part. Many tasks write a large one: its parts, in the order of their names, are the document; they are
    compressed by gzip, whose files may be put together as they are."""
    lines = None
    for i, (opening, closing, own) in enumerate(members):
        for place, part in ((2 * i - 0.5, opening), (2 * i, own), (2 * i + 0.5, closing)):
            rows = spark.createDataFrame([(place, "", part)], "place double, key string, value string").coalesce(1) if isinstance(part, str) else part.select(F.lit(float(place)).alias("place"), "key", "value")
            lines = rows if lines is None else lines.union(rows)  # a union's partitions are in order
    if not large:
        lines = lines.repartition(1).sortWithinPartitions("place", F.asc_nulls_last("key"))
    lines.select("value").write.mode("overwrite").text(path, compression="gzip" if large else "none")
    where = spark._jvm.org.apache.hadoop.fs.Path(path, LINES)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where).close()


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    """The lines (value) of a document that _written() has written, which many tasks can read; else None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path, LINES)
    return spark.read.text(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


#: The members of a document, in order. An element's line begins with a space more than its member's place (after a comma).
MEMBERS = ("objectTypes", "eventTypes", "objects", "events")


def read_json(spark: SparkSession, path: str) -> Log:
    """A document is read by one task, but those of write_json() line by line, by many."""
    if (lines := _lines(spark, path)) is None:
        raw = spark.read.schema(JSON_SCHEMA).json(path, multiLine=True)
        member = lambda name: raw.select(F.inline(name))
    else:
        schema = {f.name: f.dataType.elementType for f in StructType.fromDDL(JSON_SCHEMA)}
        element = F.when(F.col("value").startswith(","), F.substr("value", F.lit(2))).otherwise(F.col("value"))
        member = lambda name: lines.select(element.alias("value")).where(F.col("value").startswith(" " * (MEMBERS.index(name) + 1) + "{")).select(F.from_json("value", schema[name]).alias("x")).select("x.*")
    events, objects = member("events"), member("objects")
    kinds = lambda column, kind: member(column).select(F.lit(kind).alias("kind"), F.col("name").alias("type_name"), F.inline_outer("attributes")).toDF("kind", "type_name", "attr_name", "attr_type")
    ea = events.select("id", "type", F.posexplode("attributes").alias("seq", "a")).select("id", "type", "seq", "a.name", "a.value")
    oa = objects.select("id", "type", F.posexplode("attributes").alias("seq", "a")).select("id", "type", "seq", "a.name", "a.value", "a.time")
    rel = lambda df, *own: df.select(F.col("id").alias("a"), *own, F.inline("relationships")).withColumnsRenamed({"objectId": "b"})
    return _assemble(spark, events, objects, ea, oa, rel(events, "type", "time"), rel(objects, "type"), kinds("eventTypes", "event").union(kinds("objectTypes", "object")))


def write_json(log: Log, path: str) -> None:
    """One JSON document, a line for each type and element: see _written()."""
    with _once(log.spark, path) as kept:
        _written(log.spark, _json_members(log, kept), path, _large(log))


def _json_members(log: Log, kept: Callable[[DataFrame, str], DataFrame]) -> list[tuple[str, str, DataFrame]]:
    rel = lambda df, key, other: df.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("objectId"), "qualifier"))).alias("relationships"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    ea = log.event_attrs.groupBy(F.col("ev_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "name", rendered(F.col("v")).alias("value")))).alias("attributes"))
    oa = log.object_attrs.groupBy(F.col("ob_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "name", rendered(F.col("v")).alias("value"), stamp("time").alias("time")))).alias("attributes"))
    fill = lambda name, of: F.coalesce(F.transform(name, lambda x: F.struct(*[x[n].alias(n) for n in of])), F.array()).alias(name)
    events = log.events.select(F.col("ev_id").alias("id"), F.col("ev_type").alias("type"), stamp("ev_time").alias("time")).join(ea, "id", "left").join(kept(rel(log.e2o, "ev_id", "ob_id"), "relations"), "id", "left")
    objects = log.objects.select(F.col("ob_id").alias("id"), F.col("ob_type").alias("type")).join(oa, "id", "left").join(rel(log.o2o, "src_id", "tgt_id"), "id", "left")
    shown = lambda df, *own: df.select(F.col("id").alias("key"), "type", F.to_json(F.struct("id", "type", *own)).alias("value"))
    elements = {
        "objects": kept(shown(objects, fill("attributes", ("name", "value", "time")), fill("relationships", ("objectId", "qualifier"))), "objects"),
        "events": kept(shown(events, "time", fill("attributes", ("name", "value")), fill("relationships", ("objectId", "qualifier"))), "events"),
    }
    named = kept(_named(log, elements, F.struct(F.col("attr_name").alias("name"), F.col("attr_type").alias("type"))), "types")
    kinds = lambda k: named.where(F.col("kind") == k).select(F.col("type_name").alias("key"), F.to_json(F.struct(F.col("type_name").alias("name"), "attributes")).alias("value"))
    parts = [("objectTypes", kinds("object")), ("eventTypes", kinds("event")), ("objects", elements["objects"]), ("events", elements["events"])]
    members = []
    for i, (name, df) in enumerate(parts):
        # The first element has no comma before it; elements of its key stand before the others.
        first = F.lit(df.agg(F.min("key")).first()[0]).cast("string")
        line = F.concat(F.lit(" " * (i + 1)), "value")
        head = df.where(F.col("key").eqNullSafe(first)).agg(F.array_join(F.collect_list(line), "\n,").alias("value")).where("value <> ''").select(first.alias("key"), "value")
        rest = df.where(~F.col("key").eqNullSafe(first)).select("key", F.concat(F.lit(","), line).alias("value"))
        members.append((("{" if i == 0 else ",") + f'"{name}":[', "]" + ("}" if i == len(parts) - 1 else ""), head.union(rest)))
    return members


def read_xml(spark: SparkSession, path: str) -> Log:
    """The XML form: object-types, event-types, objects with timed attributes, events."""
    attr = "attributes struct<attribute:array<struct<_name:string,_type:string,_time:string,_VALUE:string>>>"
    rel = "objects struct<relationship:array<struct<`_object-id`:string,_qualifier:string>>>"
    lines = _lines(spark, path)

    def read(tag: str, schema: str) -> DataFrame:
        if lines is None:
            return spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(schema).load(path)
        return lines.where(F.col("value").startswith(f"<{tag} ")).select(F.from_xml("value", schema, {"rowTag": tag, "attributePrefix": "_"}).alias("x")).select("x.*")

    # Each asks for what it needs: what a schema does not name is passed over.
    objects = lambda *parts: read("object", ", ".join(("_id string, _type string", *parts))).where("_id is not null")
    events = lambda *parts: read("event", ", ".join(("_id string, _type string", *parts))).where("_id is not null")
    kinds = lambda tag, kind: read(tag, f"_name string, {attr}").select(F.lit(kind).alias("kind"), F.col("_name").alias("type_name"), F.explode_outer("attributes.attribute").alias("a")).select("kind", "type_name", F.col("a._name").alias("attr_name"), F.col("a._type").alias("attr_type"))
    own = lambda df: df.select(F.col("_id").alias("id"), F.col("_type").alias("type"), F.posexplode("attributes.attribute").alias("seq", "a")).select("id", "type", "seq", F.col("a._name").alias("name"), F.col("a._VALUE").alias("value"), F.col("a._time").alias("time"))
    links = lambda df, *more: df.select(F.col("_id").alias("a"), F.col("_type").alias("type"), *more, F.explode("objects.relationship").alias("r")).select("*", F.col("r.`_object-id`").alias("b"), F.col("r._qualifier").alias("qualifier")).drop("r")
    ev = events("_time string").select(F.col("_id").alias("id"), F.col("_type").alias("type"), F.col("_time").alias("time"))
    ob = objects().select(F.col("_id").alias("id"), F.col("_type").alias("type"))
    return _assemble(spark, ev, ob, own(events(attr)).drop("time"), own(objects(attr)), links(events("_time string", rel), F.col("_time").alias("time")), links(objects(rel)), kinds("event-type", "event").union(kinds("object-type", "object")))


def _escaped(c: Column) -> Column:
    """Text inside an XML attribute or element; line ends are kept by reference."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _tag(name: str, attributes: dict[str, Column], *inside: Column) -> Column:
    parts: list[Column] = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        parts.append(F.coalesce(F.concat(F.lit(f' {k}="'), _escaped(v), F.lit('"')), F.lit("")))
    return F.concat(*parts, F.lit(">"), *inside, F.lit(f"</{name}>")) if inside else F.concat(*parts, F.lit("/>"))


def write_xml(log: Log, path: str) -> None:
    """The XML form, a line for each type and element: see _written()."""
    with _once(log.spark, path) as kept:
        _written(log.spark, _xml_members(log, kept), path, _large(log))


def _xml_members(log: Log, kept: Callable[[DataFrame, str], DataFrame]) -> list[tuple[str, str, DataFrame]]:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    inside = lambda name, c: F.concat(F.lit(f"<{name}>"), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ""), F.lit(f"</{name}>"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seq", c.alias("x")))), lambda x: x["x"])
    ea = log.event_attrs.groupBy(F.col("ev_id").alias("id")).agg(in_order(_tag("attribute", {"name": F.col("name")}, _escaped(F.coalesce(rendered(F.col("v")), F.lit(""))))).alias("attrs"))
    oa = log.object_attrs.groupBy(F.col("ob_id").alias("id")).agg(in_order(_tag("attribute", {"name": F.col("name"), "time": stamp(F.col("time"))}, _escaped(F.coalesce(rendered(F.col("v")), F.lit(""))))).alias("attrs"))
    link = lambda df, key, other: df.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(_tag("relationship", {"object-id": F.col(other), "qualifier": F.col("qualifier")}))).alias("links"))
    body = lambda: (inside("attributes", F.col("attrs")), inside("objects", F.col("links")))
    events = log.events.select(F.col("ev_id").alias("id"), F.col("ev_type").alias("type"), stamp(F.col("ev_time")).alias("time")).join(ea, "id", "left").join(kept(link(log.e2o, "ev_id", "ob_id"), "relations"), "id", "left")
    objects = log.objects.select(F.col("ob_id").alias("id"), F.col("ob_type").alias("type")).join(oa, "id", "left").join(link(log.o2o, "src_id", "tgt_id"), "id", "left")
    shown = lambda df, tag, *own: df.select("type", _tag(tag, {c: F.col(c) for c in ("id", "type", *own)}, *body()).alias("value"))
    elements = {"objects": kept(shown(objects, "object"), "objects"), "events": kept(shown(events, "event", "time"), "events")}
    named = kept(_named(log, elements, _tag("attribute", {"name": F.col("attr_name"), "type": F.col("attr_type")})), "types")
    parts = [(f"{k}-types", named.where(F.col("kind") == k).select(_tag(f"{k}-type", {"name": F.col("type_name")}, inside("attributes", F.col("attributes"))).alias("value"))) for k in ("object", "event")]
    parts += [("objects", elements["objects"]), ("events", elements["events"])]
    rows = [(name, df.select(F.col("value").alias("key"), "value")) for name, df in parts]
    return [(("<log>" if i == 0 else "") + f"<{name}>", f"</{name}>" + ("</log>" if i == len(rows) - 1 else ""), own) for i, (name, own) in enumerate(rows)]


def write_log(log: Log, path: str, kind: str | None = None) -> None:
    {"json": write_json, "xml": write_xml, "sqlite": write_sqlite}[kind or format_of(path)](log, path)


def read_bytes(spark: SparkSession, data: bytes, kind: str, folder: str) -> Log:
    """A log from the bytes of a file, by its format token or ending (json, xml.gz, .db). The bytes are put in the given
    folder first: one that all executors see, and that this process sees as well for a SQLite file."""
    ending = "." + kind.lstrip(".")
    path = f"{folder.rstrip('/')}/upload-{uuid.uuid4().hex}{ending}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(data, 0, len(data))
    finally:
        out.close()
    return read_log(spark, path, format_of(ending))


def read_sqlite(spark: SparkSession, path: str) -> Log:
    """A SQLite file, which one process can read: tables event, object, event_object, object_object, and one a type."""
    db = sqlite3.connect(f"file:{Path(path.removeprefix('file://'))}?mode=ro", uri=True)
    try:
        rows = lambda sql: [tuple(None if x is None else str(x) for x in r) for r in db.execute(sql)]
        maps = {k: rows(f"SELECT ocel_type, ocel_type_map FROM {k}_map_type") for k in ("event", "object")}
        events, objects, ea, oa, types = [], [], [], [], []
        for kind, out in (("event", ea), ("object", oa)):
            for name, table in maps[kind]:
                columns = [(c[1], c[2]) for c in db.execute(f'PRAGMA table_info("{kind}_{table}")')]
                known = [c for c, _ in columns if not c.startswith("ocel_")]
                sql_types = {"INTEGER": "integer", "REAL": "float", "BOOLEAN": "boolean", "TIMESTAMP": "time"}
                types += [(kind, name, c, sql_types.get(t.upper(), "string")) for c, t in columns if c in known] or [(kind, name, None, None)]
                extra = ["ocel_time", "ocel_changed_field"] if kind == "object" else ["ocel_time"]
                shown = ", ".join(f'"{c}"' for c in ["ocel_id", *extra, *known])
                for seq, r in enumerate(rows(f'SELECT {shown} FROM "{kind}_{table}"')):
                    if kind == "event":
                        events.append((r[0], name, r[1]))
                    values = zip(known, r[1 + len(extra) :], strict=True)
                    out += [(r[0], c, seq, v, r[1]) for c, v in values if v is not None and (kind == "event" or not r[2] or r[2] == c)]
        objects = rows("SELECT ocel_id, ocel_type FROM object")
        e2o, o2o = rows("SELECT ocel_event_id, ocel_object_id, ocel_qualifier FROM event_object"), rows("SELECT ocel_source_id, ocel_target_id, ocel_qualifier FROM object_object")
    finally:
        db.close()
    frame = lambda r, s: spark.createDataFrame(r, s)
    attr, link = "id string, name string, seq int, value string, time string", "a string, b string, qualifier string"
    return _assemble(spark, frame(events, "id string, type string, time string"), frame(objects, "id string, type string"), frame(ea, attr).drop("time"), frame(oa, attr), frame(e2o, link), frame(o2o, link), frame(types, SCHEMAS["types"]))


def write_sqlite(log: Log, path: str) -> None:
    """A SQLite file, written by one process as the format asks, row by row."""
    Path(path).unlink(missing_ok=True)
    db = sqlite3.connect(path)
    name = lambda s: '"' + s.replace('"', '""') + '"'
    try:
        db.execute("CREATE TABLE event (ocel_id TEXT PRIMARY KEY, ocel_type TEXT)")
        db.execute("CREATE TABLE object (ocel_id TEXT PRIMARY KEY, ocel_type TEXT)")
        db.execute("CREATE TABLE event_object (ocel_event_id TEXT, ocel_object_id TEXT, ocel_qualifier TEXT)")
        db.execute("CREATE TABLE object_object (ocel_source_id TEXT, ocel_target_id TEXT, ocel_qualifier TEXT)")
        fill = lambda sql, df: db.executemany(sql, (tuple(r) for r in df.toLocalIterator()))
        fill("INSERT INTO event VALUES (?, ?)", log.events.select("ev_id", "ev_type"))
        fill("INSERT INTO object VALUES (?, ?)", log.objects.select("ob_id", "ob_type"))
        fill("INSERT INTO event_object VALUES (?, ?, ?)", log.e2o.select("ev_id", "ob_id", "qualifier"))
        fill("INSERT INTO object_object VALUES (?, ?, ?)", log.o2o.select("src_id", "tgt_id", "qualifier"))
        sql_types = {"integer": "INTEGER", "float": "REAL", "boolean": "BOOLEAN", "time": "TIMESTAMP"}
        declared: dict[tuple[str, str], list[tuple[str, str]]] = {}
        for r in log.types.distinct().toLocalIterator():
            own = declared.setdefault((r["kind"], r["type_name"]), [])
            if r["attr_name"]:
                own.append((r["attr_name"], sql_types.get(r["attr_type"], "TEXT")))
        for kind, df, key, t in (("event", log.events, "ev_id", "ev_type"), ("object", log.objects, "ob_id", "ob_type")):
            db.execute(f"CREATE TABLE {kind}_map_type (ocel_type TEXT, ocel_type_map TEXT)")
            for (type_name,) in sorted(tuple(r) for r in df.select(t).distinct().toLocalIterator()):
                table, columns = "".join(c if c.isalnum() else "_" for c in type_name), sorted(declared.get((kind, type_name), []))
                db.execute(f"INSERT INTO {kind}_map_type VALUES (?, ?)", (type_name, table))
                more = "".join(f", {name(c)} {s}" for c, s in columns)
                db.execute(f"CREATE TABLE {name(f'{kind}_{table}')} (ocel_id TEXT, ocel_time TIMESTAMP{', ocel_changed_field TEXT' if kind == 'object' else ''}{more})")
                own = df.where(F.col(t) == type_name)
                stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
                if kind == "event":
                    values = log.event_attrs.where(F.col("ev_type") == type_name).groupBy("ev_id").pivot("name", [c for c, _ in columns]).agg(F.min_by(rendered(F.col("v")), "seq")) if columns else None
                    rows = own.join(values, "ev_id", "left") if columns else own
                    fill(f"INSERT INTO {name(f'event_{table}')} VALUES ({', '.join('?' * (2 + len(columns)))})", rows.select("ev_id", stamp("ev_time"), *[F.col(f"`{c}`") for c, _ in columns]))
                else:
                    fill(f"INSERT INTO {name(f'object_{table}')} (ocel_id, ocel_time) VALUES (?, '1970-01-01T00:00:00.000000Z')", own.select("ob_id"))
                    for c, _ in columns:
                        changes = log.object_attrs.where((F.col("ob_type") == type_name) & (F.col("name") == c)).orderBy("ob_id", "time", "seq")
                        fill(f"INSERT INTO {name(f'object_{table}')} (ocel_id, ocel_time, ocel_changed_field, {name(c)}) VALUES (?, ?, ?, ?)", changes.select("ob_id", stamp("time"), F.lit(c), rendered(F.col("v"))))
        db.commit()
    finally:
        db.close()


def read_xes(spark: SparkSession, path: str) -> Log:
    """A case-centric log: a Case object for each trace (its concept:name, else ob_n), an event ev_n for each event with
    its concept:name as type (else UNKNOWN), related by case. Traces are numbered by their place in the file."""
    kinds = ("string", "int", "float", "boolean", "date", "id")
    one = ", ".join(f"`{k}` array<struct<_key:string,_value:string>>" for k in kinds)
    event = "struct<" + ",".join(f"`{k}`:array<struct<_key:string,_value:string>>" for k in kinds) + ">"
    raw = spark.read.format("xml").option("rowTag", "trace").option("attributePrefix", "_").schema(f"{one}, `event` array<{event}>").load(path)
    # Traces are numbered by split, then by their place in it; the driver gets two counts for each split.
    raw = raw.withColumn("_at", F.monotonically_increasing_id()).withColumn("_split", F.shiftright("_at", 33)).withColumn("_events", F.greatest(F.size("event"), F.lit(0)))
    offsets, traces_before, events_before = [], 0, 0
    for r in raw.groupBy("_split").agg(F.max("_at").alias("last"), F.sum("_events").alias("events")).orderBy("_split").toLocalIterator():
        offsets.append((r["_split"], traces_before, events_before))
        traces_before, events_before = traces_before + (r["last"] & ((1 << 33) - 1)) + 1, events_before + r["events"]
    before = F.coalesce(F.sum("_events").over(Window.partitionBy("_split").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = raw.withColumn("_before", before).join(F.broadcast(spark.createDataFrame(offsets, "_split long, _traces long, _first long")), "_split")
    raw = placed.withColumn("trace", F.col("_traces") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).withColumn("number", F.col("_first") + F.col("_before"))
    named = {"string": "string", "int": "integer", "float": "float", "boolean": "boolean", "date": "time", "id": "string"}

    def shaped(k: str):
        return lambda a: F.struct(a["_key"].alias("name"), a["_value"].alias("value"), F.lit(named[k]).alias("kind"))

    def attrs(of) -> Column:
        none = F.array().cast("array<struct<name:string,value:string,kind:string>>")
        return F.concat(*[F.coalesce(F.transform(of(k), shaped(k)), none) for k in kinds])

    def of_trace(k: str) -> Column:
        return F.col(f"`{k}`")

    def get(column: str, key: str) -> Column:
        return F.try_element_at(F.filter(column, lambda a: a["name"] == key), F.lit(1))["value"]

    traces = raw.withColumn("attrs", attrs(of_trace)).withColumn("ob_id", F.coalesce(get("attrs", "concept:name"), F.concat(F.lit("ob_"), F.col("trace").cast("string"))))
    events = traces.select("ob_id", "number", F.posexplode("event").alias("place", "e")).withColumn("attrs", attrs(lambda k: F.col(f"e.`{k}`")))
    events = events.withColumn("id", F.concat(F.lit("ev_"), (F.col("number") + F.col("place")).cast("string"))).withColumn("type", F.coalesce(get("attrs", "concept:name"), F.lit("UNKNOWN"))).withColumn("time", F.coalesce(get("attrs", "time:timestamp").try_cast("timestamp"), F.lit("1970-01-01").cast("timestamp")))
    skip = ["concept:name", "time:timestamp"]
    ea = events.select("id", "type", F.posexplode("attrs").alias("seq", "a")).where(~F.col("a.name").isin(skip)).select("id", "type", "seq", "a.name", "a.value", "a.kind")
    oa = traces.select(F.col("ob_id").alias("id"), F.posexplode("attrs").alias("seq", "a")).where(F.col("a.name") != "concept:name").select("id", "seq", "a.name", "a.value", "a.kind", F.lit("1970-01-01").alias("time"))
    types = ea.select(F.lit("event").alias("kind"), F.col("type").alias("type_name"), F.col("name").alias("attr_name"), F.col("kind").alias("attr_type")).union(oa.select(F.lit("object"), F.lit("Case"), "name", "kind")).groupBy("kind", "type_name", "attr_name").agg(F.min("attr_type").alias("attr_type"))
    links = events.select(F.col("id").alias("a"), F.col("ob_id").alias("b"), F.lit("case").alias("qualifier"))
    objects = traces.select(F.col("ob_id").alias("id"), F.lit("Case").alias("type")).distinct()
    none = spark.createDataFrame([], "a string, b string, qualifier string")
    return _assemble(spark, events.select("id", "type", "time"), objects, ea.select("id", "seq", "name", "value"), oa.select("id", "seq", "name", "value", "time"), links, none, types)

