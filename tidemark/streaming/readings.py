"""Structured Streaming over readings. Extensions: the reference computes on snapshots only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(readings: DataFrame, window: str = "1 hour", late: str = "2 hours", key: str = "site_id") -> DataFrame:
    """Mean, extremes and count by event-time window; readings later than the watermark are dropped."""
    timed = readings.withWatermark("at", late)
    return timed.groupBy(F.window("at", window), key).agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), "mean", "low", "high", "n")


def latest_readings(readings: DataFrame, key: str = "site_id") -> DataFrame:
    """The newest reading of each station so far (update or complete mode)."""
    return readings.groupBy(key).agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))


def sessions(readings: DataFrame, gap: str = "30 minutes", late: str = "2 hours", key: str = "site_id") -> DataFrame:
    """Unbroken runs of readings."""
    timed = readings.withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
