"""Summaries and profiles of tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcube.operators.quantiles import quantiles

from parcelcube.operators.relational import number_rows


def year_summary(df: DataFrame, key: str, value: str, year: str = "year") -> DataFrame:
    """Per year and in all (label TOTAL): rows, distinct keys, sum, mean, median, sample deviation."""
    label = F.when(F.grouping_id() == 1, "TOTAL").otherwise(F.col(year).cast("string"))
    return df.rollup(year).agg(
        label.alias("period"), F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std")
    ).drop(year)


def group_summary(df: DataFrame, by: Iterable[str], key: str, value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def densify_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of every pair of seen values, absent ones 0. The grid is as large as the two value sets."""
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    blocks = 64  # every value of a meets each block of the values of b
    kinds = df.select(b).where(F.col(b).isNotNull()).distinct().withColumn("__k", F.pmod(F.xxhash64(b), F.lit(blocks)))
    grid = df.select(a).distinct().withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(kinds, "__k").drop("__k")
    return grid.join(counts, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def variation(df: DataFrame, key: str, value: str, year: str = "year", years: int = 3) -> DataFrame:
    """Coefficient of variation in percent of keys with enough years."""
    out = df.groupBy(key).agg((F.try_divide(F.stddev_samp(value), F.avg(value)) * 100).alias("cv"), F.count_distinct(year).alias("__n"))
    return out.where((F.col("__n") >= years) & F.col("cv").isNotNull()).drop("__n")


def correlations(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over rows that have both."""
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, and their share in percent."""
    wide = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"), (F.try_divide(F.col(c), F.col("__n")) * 100).alias("percent")) for c in df.columns])).alias("x")).select("x.*")


def column_profile(df: DataFrame) -> DataFrame:
    """Range of numeric and boolean columns, distinct values of the others; one pass."""
    parts = []
    for c, kind in df.dtypes:
        numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or kind.startswith("decimal")
        number = F.col(c).cast("double")
        parts.append(F.struct(F.lit(c).alias("column"), (F.min(number) if numeric else F.lit(None).cast("double")).alias("min"), (F.max(number) if numeric else F.lit(None).cast("double")).alias("max"), (F.lit(None).cast("long") if numeric else F.count_distinct(c)).alias("n_unique"), F.count("*").alias("rows")))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from the least to the largest value, which falls into the last bin."""
    ends = df.agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"))
    near = df.where(F.col(column).isNotNull()).join(F.broadcast(ends), F.lit(True))
    nth = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col(column) - F.col("__lo")) * bins, F.col("__hi") - F.col("__lo")), F.lit(0.0)))).cast("int")
    return near.groupBy(nth.alias("bin")).agg(F.count("*").alias("n"))


def density(df: DataFrame, by: Iterable[str], column: str, points: int = 200, cut: float = 3.0, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density of each group on a grid of its own, from its least to its greatest value and cut bandwidths beyond: x and density.

    Values are binned linearly (each shared by its two grid points), and the bins of a group, as many as there are points, are convolved with the
    kernel. The bandwidth is the sample deviation by the fifth root of the count if none is given. Nulls and values that are not finite are
    left out; groups of one value only have no density and no rows.
    """
    keys, last = list(by), points - 1
    if points < 2 or (bandwidth is not None and bandwidth <= 0):
        raise ValueError("two points at least and a bandwidth above 0 are needed")
    held = df.select(*keys, F.col(column).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v) AND abs(__v) < double('infinity')")
    h = F.lit(float(bandwidth)) if bandwidth else F.stddev_samp("__v") * F.pow(F.count("__v"), F.lit(-0.2))
    ends = held.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count("__v").alias("__n"), h.alias("__h")).where("__low < __high")
    grid = ends.withColumn("__start", F.col("__low") - cut * F.col("__h")).withColumn("__step", (F.col("__high") + cut * F.col("__h") - F.col("__start")) / last)
    grid = grid.withColumnsRenamed({k: f"__k_{k}" for k in keys}).drop("__low", "__high")
    near = held.join(grid, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]) if keys else held.join(F.broadcast(grid), F.lit(True))
    near = near.withColumn("__at", (F.col("__v") - F.col("__start")) / F.col("__step")).withColumn("__i", F.least(F.floor("__at"), F.lit(last - 1)).cast("int"))
    share = F.col("__at") - F.col("__i")
    names = [*keys, "__start", "__step", "__h", "__n"]
    bins = near.groupBy(*names, "__i").agg(F.sum(1 - share).alias("__w0"), F.sum(share).alias("__w1"))
    bins = bins.select(*names, F.inline(F.array(F.struct(F.col("__i"), F.col("__w0").alias("__w")), F.struct((F.col("__i") + 1).alias("__i"), F.col("__w1").alias("__w")))))
    bins = bins.groupBy(*names, "__i").agg(F.sum("__w").alias("__w")).groupBy(*names).agg(F.collect_list(F.struct("__i", "__w")).alias("__bins"))
    unit = F.sqrt(F.lit(2.0) * F.pi()) * F.col("__h") * F.col("__n")
    kernel = bins.withColumn("__kernel", F.transform(F.sequence(F.lit(0), F.lit(last)), lambda d: F.exp(-0.5 * F.pow(d * F.col("__step") / F.col("__h"), F.lit(2.0))) / unit))
    at = kernel.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("point"))
    total = F.aggregate("__bins", F.lit(0.0), lambda a, b: a + b["__w"] * F.get("__kernel", F.abs(b["__i"] - F.col("point"))))
    return at.select(*keys, "point", (F.col("__start") + F.col("point") * F.col("__step")).alias("x"), total.alias("density"))


def ecdf(df: DataFrame, column: str, tie: Iterable[str] = ()) -> DataFrame:
    """Share i/n of every row in sorted order; equal values keep different shares."""
    held = df.where(F.col(column).isNotNull())
    return number_rows(held, [column, *tie]).withColumn("share", (F.col("__r") + 1) / F.col("__rows")).drop("__r", "__rows")


def box(df: DataFrame, by: Iterable[str], column: str) -> DataFrame:
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*by).agg(F.min(column).alias("lo"), q.alias("q"), F.max(column).alias("hi")).select(*by, "lo", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "hi")


def describe(df: DataFrame, column: str, percentiles: Iterable[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    percentiles = list(percentiles)
    found = [F.lit(q).cast("double").alias(f"p{round(p * 100)}") for p, q in zip(percentiles, quantiles(df, column, percentiles), strict=True)]
    ends = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    return ends.select("n", "mean", "std", "min", *found, "max")


def error_by(df: DataFrame, by: str, error: str = "error", percent: str | None = "pct_error") -> DataFrame:
    """Rows, mean absolute error, mean error, root mean square and mean percentage error per group."""
    out = [F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("me"), F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse")]
    return df.groupBy(by).agg(*out, *([F.avg(percent).alias("mape")] if percent else []))


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> list[Column]:
    """mae, rmse, r2 and mape as aggregate columns."""
    e, y = F.col(truth) - F.col(predicted), F.col(truth)
    return [
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16))).alias("mape"),
    ]


def within(truth: str, predicted: str, share: float = 0.10) -> Column:
    y = F.col(truth)
    return F.avg((F.abs(F.col(predicted) - y) / F.when(y == 0, 1).otherwise(y) <= share).cast("int"))


def status_rollup(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """completed, partial or failed by the exit codes of a task's windows."""
    good, total = F.count_if(F.col("exit_code") == 0), F.count("*")
    return df.groupBy(*keys).agg(good.alias("succeeded"), (total - good).alias("failed"), total.alias("total"), F.when(good == total, "completed").when(good > 0, "partial").otherwise("failed").alias("status"))


def log_progress(lines: DataFrame, text: str = "value", file: str = "file") -> DataFrame:
    """Per log file: done, failed, or running, by the words in its lines."""
    done, fail = F.count_if(F.lower(text).contains("done")), F.count_if(F.lower(text).contains("fail"))
    return lines.groupBy(file).agg(F.when(fail > 0, "failed").when(done > 0, "done").otherwise("running").alias("status"))


def yearly_values(df: DataFrame, time: str, value: str, samples: str) -> DataFrame:
    """Per year: mean, least, greatest and number of the values, and the sum of the samples behind them."""
    v = F.col(value)
    return df.groupBy(F.year(time).alias("year")).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"), F.sum(samples).alias("n_samples"))


def timestep_values(df: DataFrame, time: str, value: str) -> DataFrame:
    """Per time step with a value: least, greatest, mean and population deviation."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(F.col(time).alias("time")).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def with_targets(summary: DataFrame, targets: DataFrame, year: str = "year") -> DataFrame:
    """A yearly summary with the targets of its years; years without any stay."""
    return summary.join(targets, year, "left")


def monthly_totals(df: DataFrame, keys: Iterable[str], time: str, value: str) -> DataFrame:
    """Mean over the pixels of each time, summed by month."""
    keys = list(keys)
    at = df.groupBy(*keys, time).agg(F.avg(value).alias("__m"))
    return at.groupBy(*keys, F.month(time).alias("month")).agg(F.sum("__m").alias("total"))
