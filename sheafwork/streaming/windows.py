"""Event-time windows, the same for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str, watermark: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with gaps of at most ``gap``."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def tumbling(events: DataFrame, size: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """(event_type, start, end, n, total) of tumbling or sliding windows; late rows beyond the watermark go."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", "w.start", "w.end", "n", "total")
