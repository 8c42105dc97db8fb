"""Streaming form of the daily counts that feed a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, key: str, ts: str = "ts", lateness: str = "2 days") -> DataFrame:
    """``(date, <key>, y)`` per day; rows later than ``lateness`` are left out of a stream."""
    days = F.window(ts, "1 day")
    counted = events.withWatermark(ts, lateness).groupBy(days, key).agg(F.count("*").alias("y"))
    return counted.select(F.to_date("window.start").alias("date"), key, "y")
