"""Streaming forms over the log of changes (additions: the monitored system has no streams)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(changes: DataFrame, at: str = "detected_at", window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Changes of each type in event-time windows; rows later than the watermark are dropped by Spark."""
    timed = changes.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, window).alias("w"), "change_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "change_type", "n")


def incremental(captures: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a batch operator on each micro-batch of captures, exactly once for each batch number."""
    return captures.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(counts: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drains what is available into an in-memory table, for tests and small reports."""
    return counts.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
