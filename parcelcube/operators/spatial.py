"""Zonal statistics and sensor fusion."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATS = {
    "mean": F.avg, "std": F.stddev_pop, "median": lambda c: F.percentile(c, 0.5), "p25": lambda c: F.percentile(c, 0.25), "p75": lambda c: F.percentile(c, 0.75),
    "p90": lambda c: F.percentile(c, 0.9), "min": F.min, "max": F.max,
}


def stat_columns(layers: Iterable[str], stats: Iterable[str]) -> list[tuple[str, str, str]]:
    """(output name, layer, stat): the bare layer when exactly one stat is asked for."""
    stats = list(stats)
    unknown = [s for s in stats if s not in STATS]
    if unknown or not stats:
        raise ValueError(f"unknown stats {unknown}; known are {sorted(STATS)}")
    return [(layer if len(stats) == 1 else f"{layer}_{s}", layer, s) for layer in layers for s in stats]


def spatial_stats(df: DataFrame, keys: Iterable[str], layers: Iterable[str], stats: Iterable[str] = ("mean",), output: Iterable[str] | None = None) -> DataFrame:
    """Statistics over the pixels of each key: nulls are left out, percentiles interpolate, no pixel gives null. output keeps only these layers."""
    layers = [x for x in layers if output is None or x in set(output)]
    return df.groupBy(*keys).agg(*[STATS[s](F.col(layer)).alias(name) for name, layer, s in stat_columns(layers, stats)])


def fuse(df: DataFrame, keys: Iterable[str], columns: Iterable[str], order: Iterable[Column | str], totals: Iterable[str] = ()) -> DataFrame:
    """Rows of several sensors into one per key: the first value by order that is not null; columns in totals are summed."""
    rank, totals = F.struct(*order), set(totals)
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) if c in totals else F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns])


def nearest_time(df: DataFrame, keys: Iterable[str], time: str, at: Column, columns: Iterable[str]) -> DataFrame:
    """The row of each key whose time is nearest to `at`: of two as near the earlier one, then the least columns. Rows without a time are left out."""
    columns = list(columns)
    gap = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(at.cast("timestamp")))
    best = df.where(F.col(time).isNotNull()).groupBy(*keys).agg(F.min(F.struct(gap.alias("gap"), F.col(time).alias(time), *columns)).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in [time, *columns]])


def unpack(df: DataFrame, keys: Iterable[str], variables: Iterable[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Long (variable, value) pixels to one column per band."""
    return df.groupBy(*keys).pivot(variable, list(variables)).agg(F.first(value, ignorenulls=True))


def merge_cubes(a: DataFrame, b: DataFrame, keys: Iterable[str], parcel: str = "parcel_id") -> DataFrame:
    """Full outer join on pixels of two cubes with disjoint bands; parcels that only b has are left out."""
    known = a.select(parcel).distinct()
    return a.join(b.join(known, parcel, "left_semi"), list(keys), "full")


def merge_status(a: DataFrame, b: DataFrame, parcel: str = "parcel_id") -> DataFrame:
    """merged, copied (only a) or skipped (only b) per parcel."""
    left, right = a.select(parcel).distinct().withColumn("a", F.lit(1)), b.select(parcel).distinct().withColumn("b", F.lit(1))
    status = F.when(F.col("a").isNull(), "skipped").when(F.col("b").isNull(), "copied").otherwise("merged")
    return left.join(right, parcel, "full").select(parcel, status.alias("status"))


def nearest_pixel(df: DataFrame, cube: Iterable[str], cx: Column, cy: Column) -> DataFrame:
    """The pixel column and row nearest to a point, each on its own axis; ties to the smaller index."""
    return df.groupBy(*cube).agg(F.min_by("x", F.struct(F.abs(F.col("x_coord") - cx), F.col("x"))).alias("x"), F.min_by("y", F.struct(F.abs(F.col("y_coord") - cy), F.col("y"))).alias("y"))


def interpolate(df: DataFrame, keys: Iterable[str], columns: Iterable[str], order: str = "month") -> DataFrame:
    """Linear in the row position, both directions: inner gaps on the line, outer ones at the nearest value."""
    base = Window.partitionBy(*keys).orderBy(order)
    back, ahead = base.rowsBetween(Window.unboundedPreceding, 0), base.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("__i", F.row_number().over(base))

    def filled(c: str) -> Column:
        held = F.when(F.col(c).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(c).alias("v")))
        p, n = F.last(held, ignorenulls=True).over(back), F.first(held, ignorenulls=True).over(ahead)
        line = p["v"] + (n["v"] - p["v"]) * F.try_divide(F.col("__i") - p["i"], n["i"] - p["i"])
        return F.when(F.col(c).isNotNull(), F.col(c)).when(p.isNull(), n["v"]).when(n.isNull(), p["v"]).otherwise(line)

    return df.withColumns({c: filled(c) for c in columns}).drop("__i")
