"""Event-time windows; the same plan for a batch and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if late and events.isStreaming else rows


def tumbling(events: DataFrame, size: str, late: str | None = "10 minutes") -> DataFrame:
    """(window, event_type, n, total); rows later than ``late`` are left out of a stream."""
    return _timed(events, late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str, step: str, late: str | None = "10 minutes") -> DataFrame:
    return _timed(events, late).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str | None = "10 minutes") -> DataFrame:
    """(window, user_id, n): runs of a user's events with less than ``gap`` between them."""
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count("*").alias("n"))
