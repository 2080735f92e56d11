"""Joins, filters, deduplication, slicing and sampling of tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelcube.operators.quantiles import quantiles


def normalise_name(name: str) -> str:
    """Lower-case ASCII letters and digits with single underscores between."""
    plain = unicodedata.normalize("NFKD", name.strip().lower()).encode("ascii", "ignore").decode()
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]", "_", plain)).strip("_")


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalise_name(c) for c in df.columns])


def normalise_ids(c: Column, separator: str = ",") -> Column:
    """Trimmed, sorted members of a separated list."""
    return F.array_join(F.array_sort(F.transform(F.split(c, separator), lambda x: F.trim(x))), separator)


def literal_list(c: Column, kind: str = "int") -> Column:
    """Sorted elements of a list written as text."""
    return F.array_sort(F.from_json(c, f"array<{kind}>"))


def round_even(df: DataFrame, digits: int = 4) -> DataFrame:
    """All floating columns rounded half to even."""
    return df.withColumns({c: F.bround(c, digits) for c, kind in df.dtypes if kind in ("double", "float")})


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drops columns without any value. One action."""
    held = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if not held[c]])


def feature_columns(df: DataFrame, targets: Iterable[str] = ()) -> list[str]:
    """Numeric and boolean columns except keys, split and targets."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean"}
    out = {"parcel_id", "year", "split", *targets}
    return [c for c, kind in df.dtypes if (kind in numeric or kind.startswith("decimal")) and c not in out]


def metric_columns(df: DataFrame, keys: Iterable[str] = ("parcel_id", "year")) -> list[str]:
    """Numeric columns, means first."""
    names = [c for c in feature_columns(df) if c not in set(keys)]
    return sorted(names, key=lambda c: (not c.endswith("_mean"), names.index(c)))


def join_by_list(df: DataFrame, places: DataFrame, list_col: str, id_col: str, row_key: str, sums: Iterable[str], lists: Iterable[str]) -> DataFrame:
    """Rows meet the places whose id is a member of their separated list; sums and lists of the places' columns."""
    parts = df.select(F.col(row_key), F.posexplode(F.split(list_col, ",")).alias("__i", "__id")).withColumn("__id", F.trim("__id"))
    near = parts.join(places.withColumn("__id", F.col(id_col).cast("string")), "__id")
    ordered = [F.transform(F.array_sort(F.collect_list(F.struct("__i", F.col(c).alias("v")))), lambda x: x["v"]).alias(c) for c in lists]
    return df.join(near.groupBy(row_key).agg(*[F.sum(c).alias(c) for c in sums], *ordered), row_key, "left")


def lookup_lists(df: DataFrame, lookup: DataFrame, lists: dict[str, str], row_key: str, value: str) -> DataFrame:
    """Parallel lists are zipped and looked up by all their columns; the values found, in order, or null."""
    names = list(lists)
    rows = df.select(row_key, F.posexplode(F.arrays_zip(*names)).alias("__i", "__t")).select(row_key, "__i", *[F.col(f"__t.{n}").alias(lists[n]) for n in names])
    found = rows.join(lookup, list(lists.values())).groupBy(row_key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", F.col(value).alias("v")))), lambda x: x["v"]).alias(value))
    return df.join(found, row_key, "left")


def quantile_band(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows between two interpolated quantiles, both included. The quantiles are found at once, so that the scan can prune by them."""
    return df.where(F.col(column).between(*[F.lit(q).cast("double") for q in quantiles(df, column, (low, high))]))


def tolerance(df: DataFrame, a: str, b: str, percent: float = 20) -> DataFrame:
    """Rows whose a differs from b by at most so many percent of b."""
    return df.where(F.abs(F.try_divide(F.col(a) - F.col(b), F.col(b)) * 100) <= percent)


def iqr_outliers(df: DataFrame, column: str, by: Iterable[str] = (), factor: float = 1.5) -> DataFrame:
    """Rows beyond the quartiles by more than factor times their distance."""
    by = list(by)
    if by:
        q = df.groupBy(*by).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
        near = df.join(q, by)
    else:
        near = df.withColumn("__q", F.array(*[F.lit(q).cast("double") for q in quantiles(df, column, (0.25, 0.75))]))
    spread = F.col("__q")[1] - F.col("__q")[0]
    return near.where((F.col(column) < F.col("__q")[0] - factor * spread) | (F.col(column) > F.col("__q")[1] + factor * spread)).drop("__q")


def iqr_normalise(df: DataFrame, column: str, to: str) -> DataFrame:
    """(value - median) / interquartile range."""
    low, middle, high = [F.lit(q).cast("double") for q in quantiles(df, column, (0.25, 0.5, 0.75))]
    return df.withColumn(to, F.try_divide(F.col(column) - middle, high - low))


def duplicate_periods(df: DataFrame) -> DataFrame:
    """One row per normalised id and year: summed production, mean degree, date of the largest delivery."""
    best = F.max(F.struct(F.col("production_kg").alias("kg"), F.col("harvest_date").alias("d")))
    return (
        df.groupBy(normalise_ids(F.col("place_id")).alias("place_id"), F.year("harvest_date").alias("year"))
        .agg(F.sum("production_kg").alias("production_kg"), F.avg("alcohol_degree").alias("alcohol_degree"), best["d"].alias("harvest_date"))
    )


#: Ranges of a table that is numbered as a whole (a power of two), and the rows drawn to set each bound.
RANGES, DRAWN = 256, 16


def number_rows(df: DataFrame, order: Iterable[str], to: str = "__r", times: str | None = None) -> DataFrame:
    """Adds the position of every row in the whole table's order, from 0, and the number of all rows as `__rows`.

    A row that stands for as many rows as its column `times` says gets the first of their positions.

    Rows fall into RANGES ranges by bounds from rows drawn by a hash; positions within a range follow the rows counted in
    the ranges before it. The bounds set only how even the tasks are. They hold a second hash of the whole row behind its place in the
    order, so rows with a frequent value are spread over ranges; only rows that are equal in every column stay together. A row
    finds its range by halving. Nulls come first; rows of equal order are numbered by their hash.
    """
    order = list(order)
    held = df.withColumn("__h", F.xxhash64(*df.columns))
    key = F.struct(*order, "__h")
    drawn = held.select(key.alias("k"), F.xxhash64(F.lit(1), "__h").alias("draw")).orderBy("draw").limit(RANGES * DRAWN)
    marks = drawn.agg(F.sort_array(F.collect_list("k")).alias("k"))
    bounds = marks.select(F.transform(F.sequence(F.lit(1), F.lit(RANGES - 1)), lambda i: F.get("k", F.floor(i * F.size("k") / RANGES).cast("int"))).alias("__bounds"))
    halves = F.array(*[F.lit(RANGES >> i) for i in range(1, RANGES.bit_length())])
    below = F.transform(F.array(key), lambda k: F.aggregate(halves, F.lit(0), lambda n, half: F.when(F.get("__bounds", n + half - 1) < k, n + half).otherwise(n)))[0]
    rows = held.join(F.broadcast(bounds), F.lit(True)).withColumn("__range", below).drop("__bounds")
    span = Window.orderBy("__range")  # over RANGES rows
    before = F.coalesce(F.sum("n").over(span.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(span.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = rows.groupBy("__range").agg((F.sum(times) if times else F.count("*")).alias("n")).select("__range", before.alias("__before"), total.alias("__rows"))
    inside = Window.partitionBy("__range").orderBy(*order, "__h")
    nth = F.coalesce(F.sum(times).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if times else F.row_number().over(inside) - 1
    return rows.join(F.broadcast(starts), "__range").withColumn(to, F.col("__before") + nth).drop("__range", "__before", "__h")


def batch(df: DataFrame, order: Iterable[str], batches: int, number: int | None = None) -> DataFrame:
    """Numbers batches of near equal size from 1, the remainder on the first ones; or only one of them."""
    r, n = F.col("__r"), F.col("__rows")
    size, longer = F.floor(n / batches), n % batches
    head = longer * (size + 1)
    nth = F.when(r < head, F.floor(r / (size + 1))).otherwise(longer + F.floor((r - head) / F.greatest(size, F.lit(1)))) + 1
    out = number_rows(df, order).withColumn("batch", nth.cast("int")).drop("__r", "__rows")
    return out if number is None else out.where(F.col("batch") == number)


def evenly_spaced(df: DataFrame, order: Iterable[str], k: int, by: Iterable[str] = ()) -> DataFrame:
    """k rows at equal steps from the first to the last row of each group, without repeats."""
    by = list(by)
    w = Window.partitionBy(*by)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(max(k - 1, 0))), lambda i: F.floor(i * (F.col("__n") - 1) / F.lit(max(k - 1, 1))))
    return ranked.where(F.array_contains(picks, F.col("__r").cast("bigint"))).drop("__r", "__n")


def split_by_year(year: Column, validation: int, test: int) -> Column:
    return F.when(year < validation, "train").when(year == validation, "val").when(year == test, "test")


def seeded(seed: int, key: Iterable[str]) -> Column:
    """A fixed pseudo-random text per key, which any engine with MD5 can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))


def split_by_hash(df: DataFrame, key: Iterable[str], test: float = 0.2, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Exact sizes: test takes the ceiling of its share, then val of the rest, in the order of a seeded hash.

    Ranks come from buckets of the hash, counted first, so no task sees more than about 1/65536 of the rows.
    """
    n = df.count()
    n_test = -int(-n * test // 1)
    n_val = -int(-(n - n_test) * val // 1)
    key = list(key)
    rows = df.withColumn("__h", seeded(seed, key)).withColumn("__b", F.substring("__h", 1, 4))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("__b").agg(F.count("*").alias("n")).select("__b", before.alias("__before"))  # 65536 rows at most
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy("__h", *key))
    ranked = rows.join(F.broadcast(starts), "__b").withColumn("__r", rank)
    return ranked.withColumn("split", F.when(F.col("__r") <= n_test, "test").when(F.col("__r") <= n_test + n_val, "val").otherwise("train")).drop("__r", "__h", "__b", "__before")


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """All rows of n distinct keys, chosen by a seeded hash."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(seeded(seed, [key]), key).limit(n)
    return df.join(keys, key, "left_semi")


def sample_rows(df: DataFrame, key: Iterable[str], n: int, seed: int = 42) -> DataFrame:
    """n rows (all, if fewer) in the order of a seeded hash of their key."""
    key = list(key)
    return df.orderBy(seeded(seed, key), *key).limit(n)


def first_rows(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def array_tasks(df: DataFrame, order: Iterable[str], sensors: list[str]) -> DataFrame:
    """(task_id, parcel, sensor) by position: the sensor runs fastest."""
    ranked = number_rows(df, order).drop("__rows")
    return ranked.select("*", F.posexplode(F.array(*[F.lit(s) for s in sensors])).alias("__s", "sensor")).withColumn("task_id", F.col("__r") * len(sensors) + F.col("__s")).drop("__r", "__s")


def code_names(code: Column, names: dict) -> Column:
    """The name of each code; null for a code without one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), code) if names else F.lit(None).cast("string")


def difference_percent(a: Column, b: Column) -> Column:
    """How much a differs from b, in percent of b; null where b is 0."""
    return F.try_divide(a - b, b) * 100


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def with_book(df: DataFrame, book: DataFrame, key: str) -> DataFrame:
    """Left join with a book of places; of a place that it lists twice every entry counts.

    Few keys with many rows and entries each are common, so the rows of a key are dealt over salts by their hash, and each salt meets the whole book.
    The number of tasks is given, or else Spark would put small tables together whose join is not small.
    """
    salts = 8 * df.sparkSession.sparkContext.defaultParallelism
    rows = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts))).repartition(salts, key, "__salt")
    entries = book.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))).repartition(salts, key, "__salt")
    return rows.join(entries.hint("merge"), [key, "__salt"], "left").drop("__salt")


def incomplete(df: DataFrame, keys: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """Keys of the rows that lack a value in any of columns, and the names of those columns as an array in their order."""
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return df.select(*keys, gaps.alias("missing")).where(F.size("missing") > 0)


def beyond(df: DataFrame, column: str, limit: float, order: Iterable[str], n: int | None = None) -> DataFrame:
    """Rows whose value lies further from 0 than a limit, in order; the first n of them if a number is given."""
    out = df.where(F.abs(column) > limit).orderBy(*order)
    return out if n is None else out.limit(n)
