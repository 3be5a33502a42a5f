"""Structured Streaming form of the composites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_composite(stream: DataFrame, keys: list[str], value: str, time: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean, smallest and largest value per key and time window; state is dropped after the watermark."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, window), *keys)
    return g.agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
