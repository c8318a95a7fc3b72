"""A log over a star schema of orders and web events: every table is a projection, nothing is copied."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import Log, tagged

_EPOCH = "1970-01-01 00:00:00"


def _id(prefix: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def star_log(spark: SparkSession, sf_dir: str) -> Log:
    """Objects: customer, order, part, supplier, nation, region, user; events: place order, ship item and the web events."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
    t["orders"] = t["orders"].withColumn("at", F.col("o_orderdate").cast("timestamp"))
    ship = F.concat_ws("-", F.lit("si"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyyMMdd"))
    t["lineitem"] = t["lineitem"].withColumn("id", ship).withColumn("at", F.col("l_shipdate").cast("timestamp"))
    t["events"] = t["events"].withColumn("at", F.col("ts").cast("timestamp"))
    users = t["events"].select("user_id").distinct()

    events = _union(
        [
            t["orders"].select(_id("po", "o_orderkey").alias("ev_id"), F.lit("place order").alias("ev_type"), F.col("at").alias("ev_time")),
            t["lineitem"].select(F.col("id").alias("ev_id"), F.lit("ship item").alias("ev_type"), F.col("at").alias("ev_time")),
            t["events"].select(_id("we", "event_id").alias("ev_id"), F.col("event_type").alias("ev_type"), F.col("at").alias("ev_time")),
        ]
    )
    own = (("customer", "c", "c_custkey"), ("orders", "o", "o_orderkey"), ("part", "p", "p_partkey"), ("supplier", "s", "s_suppkey"), ("nation", "n", "n_nationkey"), ("region", "r", "r_regionkey"))
    objects = _union([t[table].select(_id(p, key).alias("ob_id"), F.lit(table.removesuffix("s") if table == "orders" else table).alias("ob_type")) for table, p, key in own] + [users.select(_id("u", "user_id").alias("ob_id"), F.lit("user").alias("ob_type"))])

    def related(table: str, ev_id: Column, ev_type: Column, ob: Column, kind: str, qualifier: str) -> DataFrame:
        return t[table].select(ev_id.alias("ev_id"), ev_type.alias("ev_type"), F.col("at").alias("ev_time"), ob.alias("ob_id"), F.lit(kind).alias("ob_type"), F.lit(qualifier).alias("qualifier"))

    place, ship_type, web = F.lit("place order"), F.lit("ship item"), F.col("event_type")
    e2o = _union(
        [
            related("orders", _id("po", "o_orderkey"), place, _id("o", "o_orderkey"), "order", "order"),
            related("orders", _id("po", "o_orderkey"), place, _id("c", "o_custkey"), "customer", "buyer"),
            related("lineitem", F.col("id"), ship_type, _id("o", "l_orderkey"), "order", "order"),
            related("lineitem", F.col("id"), ship_type, _id("p", "l_partkey"), "part", "item"),
            related("lineitem", F.col("id"), ship_type, _id("s", "l_suppkey"), "supplier", "source"),
            related("events", _id("we", "event_id"), web, _id("u", "user_id"), "user", "actor"),
            related("events", _id("we", "event_id"), web, _id("c", "user_id"), "customer", "account"),
        ]
    )

    # The id of a shipped item names its order, part and supplier.
    shipped = t["lineitem"].select(F.col("id").alias("ev_id"), F.col("at").alias("ev_time"), _id("o", "l_orderkey").alias("order"), _id("p", "l_partkey").alias("part"), _id("s", "l_suppkey").alias("supplier"))

    def linked(df: DataFrame, a: tuple[str, str, str], b: tuple[str, str, str], qualifier: str) -> DataFrame:
        (p, key, kind), (q, to, other) = a, b
        return df.select(_id(p, key).alias("src_id"), F.lit(kind).alias("src_type"), _id(q, to).alias("tgt_id"), F.lit(other).alias("tgt_type"), F.lit(qualifier).alias("qualifier"))

    o2o = _union(
        [
            linked(t["orders"], ("o", "o_orderkey", "order"), ("c", "o_custkey", "customer"), "placed_by"),
            linked(t["customer"], ("c", "c_custkey", "customer"), ("n", "c_nationkey", "nation"), "lives_in"),
            linked(t["supplier"], ("s", "s_suppkey", "supplier"), ("n", "s_nationkey", "nation"), "based_in"),
            linked(t["nation"], ("n", "n_nationkey", "nation"), ("r", "n_regionkey", "region"), "part_of"),
            linked(users, ("u", "user_id", "user"), ("c", "user_id", "customer"), "is"),
        ]
    )

    def values(table: str, ids: dict[str, Column], name: str, kind: str, column: str, at: Column | None = None) -> DataFrame:
        more = {} if "ev_id" in ids else {"time": at if at is not None else F.lit(_EPOCH).cast("timestamp")}
        return t[table].select(*[c.alias(n) for n, c in ids.items()], F.lit(name).alias("name"), *[c.alias(n) for n, c in more.items()], F.lit(0).alias("seq"), tagged(kind, F.col(column)).alias("v"))

    po = {"ev_id": _id("po", "o_orderkey"), "ev_type": place}
    si = {"ev_id": F.col("id"), "ev_type": ship_type}
    we = {"ev_id": _id("we", "event_id"), "ev_type": web}
    event_attrs = (
        [values("orders", po, n, k, c) for n, k, c in (("total", "float", "o_totalprice"), ("priority", "string", "o_orderpriority"), ("status", "string", "o_orderstatus"))]
        + [values("lineitem", si, n, k, c) for n, k, c in (("quantity", "float", "l_quantity"), ("price", "float", "l_extendedprice"), ("discount", "float", "l_discount"), ("returnflag", "string", "l_returnflag"), ("line", "integer", "l_linenumber"))]
        + [values("events", we, n, k, c) for n, k, c in (("value", "float", "value"), ("props", "string", "props"))]
    )
    customer = {"ob_id": _id("c", "c_custkey"), "ob_type": F.lit("customer")}
    part = {"ob_id": _id("p", "p_partkey"), "ob_type": F.lit("part")}
    nation = {"ob_id": _id("n", "n_nationkey"), "ob_type": F.lit("nation")}
    user = {"ob_id": _id("u", "user_id"), "ob_type": F.lit("user")}
    history = t["events"].select(*[c.alias(n) for n, c in user.items()], F.lit("value").alias("name"), F.col("at").alias("time"), F.col("event_id").cast("int").alias("seq"), tagged("float", F.col("value")).alias("v"))
    object_attrs = [
        values("customer", customer, "acctbal", "float", "c_acctbal"),
        values("customer", customer, "segment", "string", "c_mktsegment"),
        values("part", part, "size", "integer", "p_size"),
        values("part", part, "brand", "string", "p_brand"),
        values("nation", nation, "name", "string", "n_name"),
        history,
    ]
    e_types = [(k, n, a) for k, n, a in (("place order", "total", "float"), ("place order", "priority", "string"), ("place order", "status", "string"), ("ship item", "quantity", "float"), ("ship item", "price", "float"), ("ship item", "discount", "float"), ("ship item", "returnflag", "string"), ("ship item", "line", "integer"))]
    o_types = (("customer", "acctbal", "float"), ("customer", "segment", "string"), ("part", "size", "integer"), ("part", "brand", "string"), ("nation", "name", "string"), ("user", "value", "float"))
    types = spark.createDataFrame([("event", *x) for x in e_types] + [("object", *x) for x in o_types], "kind string, type_name string, attr_name string, attr_type string")
    return Log(events, objects, _union(event_attrs), _union(object_attrs), e2o, o2o, types, single_pairs=True, single_event_attrs=True, wide={"ship item": shipped})
