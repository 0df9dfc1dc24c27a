"""Counts of events in windows of time, with late data up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, events, value): each window's counts, final once no event of it can come any more. Events later than ``late``
    behind the newest one are left out, as their window is closed."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    w = e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return w.select(F.col("w.start").alias("start"), "event_type", "events", "value")
