"""Exact quantiles per group without gathering a group: equal values are counted, then placed in one order of the whole table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcube.operators.relational import number_rows


def quantiles_by(df: DataFrame, keys: Iterable[str], column: str, fractions: Mapping[str, float]) -> DataFrame:
    """Interpolated quantiles of each group's values, a column for each name of fractions. Nulls are left out; groups without values have no row.

    NaN comes after all other values; a null key is a group of its own. A group may hold any share of the rows: a task sees a range of
    the (key, value) pairs in order, and of a group only one row for each of its places asked for. The value at a place is the one
    whose positions, from the first to as many as it occurs, hold it.
    """
    keys = list(keys)
    counted = df.select(*keys, F.col(column).cast("double").alias("__v")).where("__v IS NOT NULL").groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    placed = number_rows(counted, [*keys, "__v"], times="__n").drop("__rows")
    groups = placed.groupBy(*keys).agg(F.min("__r").alias("__first"), F.sum("__n").alias("__size")).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    near = placed.join(groups, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    nth = F.col("__r") - F.col("__first")

    def at(place):  # noqa: ANN001, ANN202
        return F.max(F.when((nth <= place) & (place < nth + F.col("__n")), F.col("__v")))

    places = {name: (F.col("__size") - 1) * F.lit(float(f)) for name, f in fractions.items()}
    out = near.groupBy(*keys).agg(
        F.first("__size").alias("__size"), *[at(F.floor(p)).alias(f"__lo_{n}") for n, p in places.items()], *[at(F.ceil(p)).alias(f"__hi_{n}") for n, p in places.items()]
    )

    def between(name):  # noqa: ANN001, ANN202
        low, high, part = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), places[name] - F.floor(places[name])
        return F.when((low == high) | (part == 0), low).otherwise((1 - part) * low + part * high).alias(name)

    return out.select(*keys, *[between(n) for n in fractions])
