"""Streaming extension: sessions and windowed counts over an event stream, late events bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start_ts, end_ts, n): end_ts is the last event plus the gap. For append or update mode."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    found = timed.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(user, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def stream_counts(events: DataFrame, at: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: str = "event_type") -> DataFrame:
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return timed.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start_ts"), by, "n", "total")
