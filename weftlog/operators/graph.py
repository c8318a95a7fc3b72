"""The neighbourhood of an element, breadth first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..log import Log


def links(log: Log) -> DataFrame:
    """a, b: every relation in both directions."""
    one = log.e2o.select(F.col("ev_id").alias("a"), F.col("ob_id").alias("b")).union(log.o2o.select("src_id", "tgt_id"))
    return one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def neighbourhood(log: Log, root: str, max_distance: int = 2, expand_below: int | None = None) -> DataFrame:
    """id, distance of the elements within a distance of the root. An element with expand_below relations or more is
    reached but not expanded, save the root. No rows if the root is unknown."""
    both = links(log)
    if expand_below is not None:
        small = both.groupBy("a").agg(F.count("*").alias("n")).where((F.col("n") < expand_below) | (F.col("a") == root)).select("a")
        both = both.join(small, "a", "left_semi")
    known = log.events.select(F.col("ev_id").alias("id")).union(log.objects.select("ob_id"))
    seen = known.where(F.col("id") == root).distinct().select("id", F.lit(0).alias("distance"))
    for d in range(1, max_distance + 1):
        edge = seen.where(F.col("distance") == d - 1).select(F.col("id").alias("a"))
        found = both.join(edge, "a").select(F.col("b").alias("id"), F.lit(d).alias("distance"))
        seen = seen.union(found).groupBy("id").agg(F.min("distance").alias("distance"))
    return seen


def graph_edges(log: Log, nodes: DataFrame, spanning_tree: bool = False) -> DataFrame:
    """src, tgt, qualifier among the nodes; of a spanning tree one edge for each node but the root, to the least
    neighbour that is one step nearer."""
    edges = log.e2o.select(F.col("ev_id").alias("src"), F.col("ob_id").alias("tgt"), "qualifier").union(log.o2o.select("src_id", "tgt_id", "qualifier"))
    a, b = (nodes.select(F.col("id").alias(k), F.col("distance").alias(f"d_{k}")) for k in ("src", "tgt"))
    edges = edges.join(a, "src").join(b, "tgt")
    if spanning_tree:
        far = F.greatest("d_src", "d_tgt")
        edges = edges.where(F.abs(F.col("d_src") - F.col("d_tgt")) == 1).withColumn("child", F.when(F.col("d_src") == far, F.col("src")).otherwise(F.col("tgt")))
        edges = edges.groupBy("child").agg(F.min(F.struct("src", "tgt", "qualifier")).alias("e")).select("e.*")
    return edges.select("src", "tgt", "qualifier")
