"""Filters over streams: row-local ones pass through, window means wait for the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.operators.filters import min_max


def hourly_means(stream: DataFrame, station: str, time: str, value: str, low: float, high: float, late: str = "1 hour") -> DataFrame:
    """Mean and count of the values in [low, high] of each station and hour; later rows than ``late`` are left out."""
    good = stream.withColumn(value, min_max(F.col(value), low, high))
    return good.withWatermark(time, late).groupBy(F.window(time, "1 hour"), station).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
