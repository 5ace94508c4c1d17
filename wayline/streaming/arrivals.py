"""Stop events as a stream: an extension, as the batch operators have no stream of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """events: ts, key, value, batch or stream. Counts and sums by key and window of ts; in a stream, events more than
    `late` behind the newest are left out and windows are given out once they are closed."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    found = events.withWatermark("ts", late).groupBy(span.alias("w"), "key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n", "total")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "15 minutes") -> DataFrame:
    """Sessions of a key: events no further apart than `gap`."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n")
