"""Incremental ingestion with Structured Streaming: new documents once each, and
event counts in tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseforge.functions import text as T


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by tumbling window and type, for streams and tables alike; on a
    stream, rows later than ``late`` are passed over."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def new_documents(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """Documents whose content has not been seen within ``late`` (column ts)."""
    marked = docs.withColumn("content_hash", T.pure_hash(F.col("text")))
    if docs.isStreaming:
        return marked.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])
    return marked.dropDuplicates(["content_hash"])
