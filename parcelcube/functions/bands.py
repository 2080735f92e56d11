"""Calibration of bands. Missing is null everywhere; NaN and infinities become null at ingest."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds on a value; null stays null."""
    out = c if low is None else F.when(c < low, F.lit(low)).otherwise(c)
    return out if high is None else F.when(out > high, F.lit(high)).otherwise(out)


def scale_reflectance(df: DataFrame, bands: Iterable[str], cube: Iterable[str] = ("parcel_id", "sensor"), scale: float = 10_000.0) -> DataFrame:
    """Digital numbers to reflectance, band by band: a cube whose median is at most 1 is scaled already.

    Whether it is follows from how many values are at most 1, and if these are just half from the two values around 1: no values are gathered.
    """
    keys, bands = list(cube), list(bands)

    def small(b: str) -> Column:
        v = F.col(b)
        low, n = F.count_if(v <= 1.0), F.count(v)
        return F.when(2 * low == n, (F.max(F.when(v <= 1.0, v)) + F.min(F.when(v > 1.0, v))) / 2 <= 1.0).otherwise(2 * low > n)

    scaled = df.groupBy(*keys).agg(*[small(b).alias(f"__m_{b}") for b in bands])
    out = df.join(scaled.withColumnsRenamed({k: f"__k_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], "left")
    out = out.withColumns({b: F.when(F.col(f"__m_{b}"), F.col(b)).otherwise(clip(F.col(b) / scale, 0.0, 1.0)) for b in bands})
    return out.select(df.columns)


def deaccumulate(tp: Column) -> Column:
    return tp / 12.5


def sigma_nought(dn: Column) -> Column:
    return F.pow(dn, 2) / 1e9


def decibel(c: Column, floor: float = 1e-10) -> Column:
    return 10 * F.log10(F.when(c < floor, F.lit(floor)).otherwise(c))


def array_median(a: Column) -> Column:
    """Median of the non-null elements."""
    s = F.array_sort(F.filter(a, lambda x: x.isNotNull()))
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def speckle_median(df: DataFrame, bands: Iterable[str], image: Iterable[str] = ("parcel_id", "sensor", "time")) -> DataFrame:
    """3 x 3 median per image. In place of a neighbour without a row stands the pixel of its column in the middle row, then that of its row in
    the middle column, then the pixel itself, so that edges are repeated. A neighbour with a row and no value counts as no value.

    Two windows, no join: the first one finds the three pixels of each place in its row, of places without a pixel beside one too.
    """
    keys, bands = list(image), list(bands)
    across, down = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    own, x = F.struct(F.col("x").alias("at"), *bands), F.col("x")
    rows = df.withColumns({"__own": own, "__left": F.lag(own).over(across), "__right": F.lead(own).over(across)})
    left, right = F.col("__left"), F.col("__right")

    def place(at: Column, seen: Column, *three: Column) -> Column:
        absent = F.when(F.lit(False), F.col("__own"))
        return F.struct(at.alias("x"), seen.alias("__seen"), *[(absent if c is None else c).alias(f"__{i}") for i, c in enumerate(three)])

    places = F.array(
        place(x, F.lit(True), F.when(left["at"] == x - 1, left), F.col("__own"), F.when(right["at"] == x + 1, right)),
        F.when(left.isNull() | (left["at"] < x - 2), place(x - 1, F.lit(False), None, None, F.col("__own"))),
        F.when(right.isNull() | (right["at"] > x + 1), place(x + 1, F.lit(False), F.col("__own"), None, F.when(right["at"] == x + 2, right))),
    )
    rest = [F.col(c) for c in df.columns if c != "x"]
    spread = rows.withColumn("__places", F.filter(places, lambda p: p.isNotNull())).select(*rest, F.inline("__places"))
    three = F.struct(F.col("y").alias("at"), "__0", "__1", "__2")
    spread = spread.withColumns({"__up": F.lag(three).over(down), "__down": F.lead(three).over(down)}).where("__seen")
    above = F.when(F.col("__up")["at"] == F.col("y") - 1, F.col("__up"))
    below = F.when(F.col("__down")["at"] == F.col("y") + 1, F.col("__down"))
    middle = F.col("__1")
    nine = [F.coalesce(F.col(f"__{i}"), middle) for i in range(3)]
    nine += [F.coalesce(line[f"__{i}"], F.col(f"__{i}"), line["__1"], middle) for line in (above, below) for i in range(3)]
    near = spread.withColumn("__nine", F.array(*nine))
    return near.withColumns({b: array_median(F.col("__nine").getField(b)) for b in bands}).select(df.columns)


def calibrate_radar(df: DataFrame, image: Iterable[str] = ("parcel_id", "sensor", "time")) -> DataFrame:
    """The full radar chain: digital numbers, speckle filter, indices on linear values, decibels."""
    from parcelcube.functions.indices import DEFAULTS, compute_indices

    df = df.withColumns({b: sigma_nought(F.col(b)) for b in ("VV", "VH")})
    df = compute_indices(speckle_median(df, ("VV", "VH"), image), DEFAULTS["sentinel1"], list(image)[:2])
    return df.withColumns({b: decibel(F.col(b)) for b in ("VV", "VH")})
