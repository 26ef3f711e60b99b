"""Event streams: windowed counts with a watermark, and sessions of users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time with a zone


def activity_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of tumbling windows, or sliding ones with slide, over ts; events later than late are left out of a stream."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = _timed(events).withWatermark("ts", late).groupBy(window.alias("w"), "event_type")
    return counts.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events less than gap apart."""
    sessions = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return sessions.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
