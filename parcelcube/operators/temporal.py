"""Time buckets and rolling windows over series."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelcube.functions.bands import array_median

AGGREGATES = {
    "mean": F.avg, "median": F.median, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop, "count": F.count,
}
FREQUENCIES = ("ME", "MS", "2W", "4W")


def aggregate(name: str, c: str | Column) -> Column:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}; known are {sorted(AGGREGATES)}")
    column = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(column), F.lit(0.0)) if name == "sum" else AGGREGATES[name](column)


def bucket(time: Column, freq: str, origin: Column | None = None) -> Column:
    """Label of the calendar bucket: month end, month start, or the Sunday that closes 2 or 4 weeks from the origin."""
    day = F.to_date(time)
    if freq == "ME":
        return F.last_day(day)
    if freq == "MS":
        return F.trunc(day, "MM")
    if freq in ("2W", "4W"):
        if origin is None:
            raise ValueError("week buckets need the first date of the series as their origin")
        days = 7 * int(freq[0])
        sunday = F.date_add(F.to_date(origin), F.pmod(8 - F.dayofweek(F.to_date(origin)), F.lit(7)).cast("int"))
        return F.date_add(sunday, (days * F.ceil(F.datediff(day, sunday) / days)).cast("int"))
    raise ValueError(f"unknown frequency {freq!r}; known are {FREQUENCIES}")


def resample(df: DataFrame, keys: Iterable[str], bands: Iterable[str], freq: str = "ME", agg: str = "median", time: str = "time", densify: bool = False) -> DataFrame:
    """One row per series and bucket. densify: empty buckets between the first and the last one appear as null rows."""
    keys, bands = list(keys), list(bands)
    if freq in ("2W", "4W"):
        first = df.groupBy(*keys).agg(F.min(time).alias("__first"))
        df = df.join(first, keys)
        label = bucket(F.col(time), freq, F.col("__first"))
    else:
        label = bucket(F.col(time), freq)
    out = df.groupBy(*keys, label.alias("bucket")).agg(*[aggregate(agg, b).alias(b) for b in bands])
    if densify:
        step = {"ME": "interval 1 month", "MS": "interval 1 month", "2W": "interval 14 days", "4W": "interval 28 days"}[freq]
        low, high = F.min("bucket"), F.max("bucket")
        if freq == "ME":
            low, high = F.trunc(low, "MM"), F.trunc(high, "MM")
        every = F.explode(F.sequence("lo", "hi", F.expr(step))).alias("bucket")
        grid = out.groupBy(*keys).agg(low.alias("lo"), high.alias("hi")).select(*keys, every)
        if freq == "ME":
            grid = grid.withColumn("bucket", F.last_day("bucket"))
        out = grid.join(out, [*keys, "bucket"], "left")
    return out


def _rolling(agg: str, band: str, window) -> Column:  # noqa: ANN001
    if agg == "median":  # ordered frames refuse percentiles; the frame's values are few
        return array_median(F.collect_list(band).over(window))
    return aggregate(agg, band).over(window) if agg != "sum" else F.sum(band).over(window)


def rolling_centered(df: DataFrame, keys: Iterable[str], bands: Iterable[str], window: int, agg: str = "mean", order: str = "bucket") -> DataFrame:
    """Centred windows of rows within a calendar year, at least one value; an even window leans back."""
    if window < 1:
        raise ValueError("window must be at least 1")
    frame = Window.partitionBy(*keys, F.year(order)).orderBy(order).rowsBetween(-(window // 2), window - 1 - window // 2)
    return df.withColumns({b: _rolling(agg, b, frame) for b in bands})


def rolling_trailing(df: DataFrame, keys: Iterable[str], bands: Iterable[str], window: int, agg: str = "mean", order: str = "bucket") -> DataFrame:
    """Trailing windows of rows across years, at least one value."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    return df.withColumns({b: _rolling(agg, b, frame) for b in bands})


def composite(df: DataFrame, keys: Iterable[str], bands: Iterable[str], freq: str | None, agg: str = "median", window: int | None = None, rolling_agg: str | None = None) -> DataFrame:
    """Resample, then smooth; either may be left out. Rolling takes the resample aggregate unless it has its own."""
    if freq:
        df = resample(df, keys, bands, freq, agg)
    if window:
        df = rolling_centered(df, keys, bands, window, rolling_agg or agg, "bucket" if freq else "time")
    return df


def first_per_time(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """Keeps the first row per key in the given order: overlapping parts of a split cube."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")
