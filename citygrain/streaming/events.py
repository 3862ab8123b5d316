"""Event streams: windowed counts with late data, and months that close as they arrive. An extension; batch queries do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(key, starts, n, total) per window; on a stream, events later than ``late`` are dropped and closed windows are emitted."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(key, F.col("w.start").alias("starts"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, starts, ends, n) of runs of events that are at most ``gap`` apart."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n")
