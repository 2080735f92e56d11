"""Numeric side of raster composites: RGBA values per pixel. Drawing is left to others."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelcube.functions.bands import clip

# Fixed values of the true-colour curve.
MAX_R, MID_R, SAT, GAMMA, G_OFF = 3.0, 0.13, 1.2, 1.8, 0.01
LINEAR_BELOW, LINEAR, ENCODE, POWER, SHIFT = 0.0031308, 12.92, 1.055, 0.41666666666, 0.055


def _unit(c: Column) -> Column:
    """Bounds of 0 and 1 on a value that is not null, without repeating it."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def byte(c: Column) -> Column:
    return F.when(c.isNotNull(), F.floor(_unit(c) * 255).cast("int"))


def _contrast(a: Column) -> Column:
    knee, low = MID_R / MAX_R, G_OFF**GAMMA
    curve = F.coalesce(F.try_divide(a * (a * knee - 1.0), a * (2.0 * knee - 1.0) - knee), F.lit(0.0))
    return (F.pow(curve + G_OFF, F.lit(GAMMA)) - low) / ((1.0 + G_OFF) ** GAMMA - low)


def _encode(c: Column) -> Column:
    return F.when(c <= LINEAR_BELOW, LINEAR * c).otherwise(ENCODE * F.pow(c, F.lit(POWER)) - SHIFT)


def true_colour(df: DataFrame, red: Column, green: Column, blue: Column) -> DataFrame:
    """Adds r, g, b and a: contrast, saturation and sRGB encoding, a step of columns each; a missing band makes the pixel transparent."""
    bands = {"r": red, "g": green, "b": blue}
    whole = red.isNotNull() & green.isNotNull() & blue.isNotNull()
    out = df.withColumns({"a": F.when(whole, 255).otherwise(0), **{c: _unit(F.coalesce(v, F.lit(0.0)) / MAX_R) for c, v in bands.items()}})
    out = out.withColumns({c: _contrast(F.col(c)) for c in bands})
    out = out.withColumn("__grey", (F.col("r") + F.col("g") + F.col("b")) / 3.0 * (1.0 - SAT))
    out = out.withColumns({c: _unit(F.col("__grey") + F.col(c) * SAT) for c in bands}).drop("__grey")
    return out.withColumns({c: _encode(F.col(c)) for c in bands}).withColumns({c: byte(F.col(c)) for c in bands})


def stretch(df: DataFrame, columns: Iterable[str], image: Iterable[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Each column to 0..1 between two quantiles of its image, clipped; 0 where they are equal."""
    columns, keys = list(columns), list(image)
    q = df.groupBy(*keys).agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"__q_{c}") for c in columns])
    near = df.join(q, keys)
    return near.withColumns({c: F.when(F.col(c).isNotNull(), clip(F.coalesce(F.try_divide(F.col(c) - F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1] - F.col(f"__q_{c}")[0]), F.lit(0.0)), 0.0, 1.0)) for c in columns}).drop(*[f"__q_{c}" for c in columns])


def stretch_together(df: DataFrame, columns: Iterable[str], image: Iterable[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One stretch for all columns of an image; a missing value in any blanks the pixel."""
    columns, keys = list(columns), list(image)
    q = df.select(*keys, F.explode(F.array(*columns)).alias("v")).groupBy(*keys).agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("__q"))
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    near = df.join(q, keys).withColumn("__ok", whole)
    return near.withColumns({c: F.when(F.col("__ok"), clip(F.coalesce(F.try_divide(F.col(c) - F.col("__q")[0], F.col("__q")[1] - F.col("__q")[0]), F.lit(0.0)), 0.0, 1.0)) for c in columns}).drop("__q", "__ok")


def radar_false_colour(df: DataFrame, image: Iterable[str], vv: str = "VV", vh: str = "VH") -> DataFrame:
    """R = VV, G = VH, B = VV - VH in decibels, each stretched; adds r, g, b, a."""
    keys = list(image)
    rows = df.withColumns({"r": F.col(vv), "g": F.col(vh), "b": F.col(vv) - F.col(vh)})
    whole = F.when(F.col(vv).isNotNull() & F.col(vh).isNotNull(), 255).otherwise(0)
    return stretch(rows, ("r", "g", "b"), keys).withColumns({c: byte(F.coalesce(F.col(c), F.lit(0.0))) for c in ("r", "g", "b")}).withColumn("a", whole)


def month_composite(df: DataFrame, value: str, pixel: Iterable[str], start: str, end: str, bias: float, low: float, high: float, time: str = "time", order: Iterable[str] = ()) -> DataFrame:
    """The last three months of the year seen in [start, end) as R, G, B: (bias + sum) / times, stretched.

    A sum close to the edge of two bytes falls on one side or the other by the order of its terms. With order, columns that tell the rows of a pixel
    apart, they are added in it, however the rows are dealt.
    """
    pixel, order = list(pixel), list(order)
    rows = df.where((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz"))).withColumn("__m", F.month(time))
    months = [r["__m"] for r in rows.select("__m").distinct().orderBy("__m").collect()]  # twelve at most
    if len(months) < 3:
        raise ValueError(f"three months are needed, found {months}")
    bands = dict(zip(("r", "g", "b"), months[-3:], strict=True))
    sums = {f"__s{c}": F.sum(F.when(F.col("__m") == m, F.col(value))) for c, m in bands.items()} | {f"__n{c}": F.count_if(F.col("__m") == m) for c, m in bands.items()}
    if order:
        # running sums take row after row; the last row of a pixel has them all
        w = Window.partitionBy(*pixel).orderBy(*order)
        seen = rows.select(*pixel, *order, "__m", value).withColumns({c: s.over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c, s in sums.items()} | {"__more": F.lead(F.lit(True)).over(w)})
        found = seen.where("__more IS NULL")
    else:
        found = rows.groupBy(*pixel).agg(*[s.alias(c) for c, s in sums.items()])
    shade = lambda c: byte(((bias + F.coalesce(F.col(f"__s{c}"), F.lit(0.0))) / F.greatest(F.col(f"__n{c}"), F.lit(1)) - low) / (high - low))
    return found.select(*pixel, *[shade(c).alias(c) for c in bands], F.lit(255).alias("a"))


def tracking_rvi(df: DataFrame, pixel: Iterable[str], start: str, end: str, value: str = "RVI", order: Iterable[str] = ()) -> DataFrame:
    return month_composite(df, value, pixel, start, end, 0.2, 0.25, 0.75, order=order)


def growth_stage(df: DataFrame, pixel: Iterable[str], start: str, end: str, value: str = "NDVI", order: Iterable[str] = ()) -> DataFrame:
    return month_composite(df, value, pixel, start, end, 0.0, 0.1, 0.7, order=order)


def overlay(df: DataFrame, value: str, image: Iterable[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """A layer for a map: the value stretched to 0..255 between two quantiles of its image; a is 0 where it has none."""
    out = df.withColumn("a", F.when(F.col(value).isNotNull(), 255).otherwise(0))
    return stretch(out, [value], image, low, high).withColumn(value, byte(F.col(value)))
