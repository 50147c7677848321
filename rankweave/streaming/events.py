"""Event streams: latest wins per key, and windows as extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts; works on batch and streaming frames."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))


def latest_state(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last record of each key, for update or complete mode."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))
