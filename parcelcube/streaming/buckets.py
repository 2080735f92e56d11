"""Streaming form of resampling with zonal statistics: an extension, batch semantics where all data has arrived."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_stats(pixels: DataFrame, keys: Iterable[str], layers: Iterable[str], width: str = "30 days", late: str = "7 days", time: str = "time") -> DataFrame:
    """Mean and count per key and event-time window; windows close once the watermark has passed them."""
    layers = list(layers)
    out = pixels.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    return out.agg(*[F.avg(c).alias(c) for c in layers], F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *layers, "n")


def stream_months(pixels: DataFrame, keys: Iterable[str], layers: Iterable[str], late: str = "7 days", time: str = "time") -> DataFrame:
    """Mean per key and calendar month, for update or complete mode: a month is no event-time window."""
    layers = list(layers)
    return pixels.withWatermark(time, late).groupBy(F.date_trunc("month", F.col(time)).alias("month"), *keys).agg(*[F.avg(c).alias(c) for c in layers], F.count("*").alias("n"))
