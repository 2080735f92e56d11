"""Exact quantiles of a whole column by rank selection.

Each round counts the values below, at and between some bounds, and keeps the one range that holds a rank; only rows of such
ranges are counted again. A task holds counts per range and never a column's values. Bounds are values drawn at random: they decide
how soon a range is small, never the result.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a round, rows drawn for them, and the rows of a range that are listed at last.
BOUNDS, DRAWN, LISTED = 255, 4096, 4096

Range = tuple[float | None, float | None]


def _between(value: Column, span: Range) -> Column:
    low, high = span
    return (F.lit(True) if low is None else value > low) & (F.lit(True) if high is None else value < high)


def _any(value: Column, spans: Iterable[Range]) -> Column:
    out = F.lit(False)
    for span in sorted(set(spans), key=lambda s: (s[0] is not None, s[0] or 0.0)):
        out = out | _between(value, span)
    return out


def _below(value: Column, bounds: list[float]) -> Column:
    """How many of ascending bounds are less than the value, by halving."""
    steps = len(bounds).bit_length()
    padded = F.lit(bounds + [math.inf] * ((1 << steps) - len(bounds)))  # no value is more than infinity
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    return F.aggregate(halves, F.lit(0), lambda n, half: F.when(F.get(padded, n + half - 1) < value, n + half).otherwise(n))


def select_ranks(df: DataFrame, column: str, ranks: Iterable[int], n: int) -> dict[int, float]:
    """The values at some ranks, from 0, of the column's n values in ascending order; nulls and NaN are no values."""
    rows = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    value = F.col("v")
    found: dict[int, float] = {}
    # the range around each rank, its rank inside, and the rows of the range
    left: dict[int, tuple[Range, int, int]] = {r: ((None, None), r, n) for r in ranks}
    while left:
        small = {r: at for r, at in left.items() if at[2] <= LISTED}
        if small:
            counts = sorted((c["v"], c["count"]) for c in rows.where(_any(value, [span for span, _, _ in small.values()])).groupBy("v").count().collect())
            for r, (span, nth, _) in small.items():
                low, high = span
                for v, times in counts:
                    if (low is None or v > low) and (high is None or v < high):
                        if nth < times:
                            found[r] = v
                            break
                        nth -= times
                del left[r]
            continue
        near = rows.where(_any(value, [span for span, _, _ in left.values()]))
        drawn = sorted({d["v"] for d in near.orderBy(F.rand()).limit(DRAWN).collect()})
        ends = {e for span, _, _ in left.values() for e in span if e is not None}
        bounds = sorted(ends | {drawn[i * len(drawn) // BOUNDS] for i in range(BOUNDS)})
        at = F.transform(F.array(_below(value, bounds)), lambda k: F.struct(k.alias("k"), F.coalesce(F.get(F.lit(bounds), k) == value, F.lit(False)).alias("same")))[0]
        counts = {(c["k"], c["same"]): c["n"] for c in near.groupBy(at.alias("at")).agg(F.count("*").alias("n")).select("at.*", "n").collect()}
        for r, (span, nth, _) in left.items():
            first = 0 if span[0] is None else bisect_left(bounds, math.nextafter(span[0], math.inf))
            k, before = first, 0
            while True:
                between, same = counts.get((k, False), 0), counts.get((k, True), 0)
                if nth < before + between:
                    edges = (bounds[k - 1] if k > first else span[0], bounds[k] if k < len(bounds) and (span[1] is None or bounds[k] < span[1]) else span[1])
                    left[r] = (edges, nth - before, between)
                    break
                if nth < before + between + same:
                    found[r] = bounds[k]
                    break
                before += between + same
                k += 1
        left = {r: at for r, at in left.items() if r not in found}
    return found


def quantiles(df: DataFrame, column: str, fractions: Iterable[float]) -> list[float | None]:
    """Interpolated quantiles of all values that are not null; nulls of a column without values. NaN comes after all other values.

    Runs some jobs over the column at once: about one pass for each factor of some hundred in the rows.
    """
    fractions = list(fractions)
    value = F.col(column).cast("double")
    total, real = df.agg(F.count(value), F.count_if(~F.isnan(value))).first()
    if not total:
        return [None] * len(fractions)
    places = [(total - 1) * f for f in fractions]
    ranks = {int(k) for p in places for k in (math.floor(p), math.ceil(p))}
    at = select_ranks(df, column, [r for r in ranks if r < real], real) | {r: math.nan for r in ranks if r >= real}
    out = []
    for p in places:
        low, high = math.floor(p), math.ceil(p)
        out.append(at[low] if low == high or at[low] == at[high] else (high - p) * at[low] + (p - low) * at[high])
    return out
