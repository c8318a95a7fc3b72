"""Append-only ingestion of events and relations into a log's tables, and counts over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(events: DataFrame, relations: DataFrame, folder: str, checkpoint: str, late: str = "1 day") -> list[StreamingQuery]:
    """Write streams of events (ev_id, ev_type, ev_time) and relations (ev_id, ev_type, ev_time, ob_id, ob_type,
    qualifier) as Parquet by type. Repeats within the late time are dropped by a watermark, so state stays bounded."""
    one = events.withWatermark("ev_time", late).dropDuplicatesWithinWatermark(["ev_id"])
    two = relations.withWatermark("ev_time", late).dropDuplicatesWithinWatermark(["ev_id", "ob_id", "qualifier"])
    return [
        df.writeStream.format("parquet").partitionBy("ev_type").option("path", f"{folder}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
        for name, df in (("events", one), ("e2o", two))
    ]


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """ev_type, start, n: events by type in windows of event time; late events count until the watermark passes."""
    own = events.withWatermark("ev_time", late).groupBy(F.window("ev_time", width).alias("w"), "ev_type").agg(F.count("*").alias("n"))
    return own.select("ev_type", F.col("w.start").alias("start"), "n")
