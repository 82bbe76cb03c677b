"""Windowed counts, late data and duplicates on a stream of requests (event_id, user_id, event_type, ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str, slide: str | None, late: str, *by: str) -> DataFrame:
    """Counts and sums by tumbling (no `slide`) or sliding windows; a window is given out once it can't change."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str, key: str) -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")


def without_duplicates(events: DataFrame, late: str, *keys: str) -> DataFrame:
    """The first of each key among what is not too late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))
