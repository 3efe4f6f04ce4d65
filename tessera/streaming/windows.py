"""Event-time windows; each function takes a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late(df: DataFrame, at: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A watermark on streams; batches stay as they are."""
    return df.withWatermark(at, delay) if df.isStreaming else df


def tumbling(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """start_at, event_type, n, total by tumbling windows, or sliding ones where ``slide`` is given."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = late(events).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start_at"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, start_at, n of sessions that end after a gap."""
    g = late(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start_at"), "n")


def running_max(usage: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The greatest value of each field so far, by key: streamed blocks repeat usage."""
    return usage.groupBy(key).agg(*[F.max(f).alias(f) for f in fields])
