"""Time series of one row per (parcel, year, month) to one wide row per (parcel, year).

Every extractor is a list of aggregate columns, so any set of them is one groupBy over K with one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelcube.operators.relational import number_rows

K = ("parcel_id", "year")
# Months of the growth phases; month 8 is in two of them.
PHASES: dict[str, tuple[int, ...]] = {"dormancy": (12, 1, 2), "budbreak": (3, 4), "flowering": (5, 6), "veraison": (7, 8), "harvest": (8, 9), "postharvest": (10, 11)}
PHASE_AGGREGATES = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "median": F.median, "std": F.stddev_samp}


def in_phase(c: str | Column, months: Iterable[int], month: str = "month") -> Column:
    return F.when(F.col(month).isin(*months), F.col(c) if isinstance(c, str) else c)


def phase_aggregates(columns: Iterable[str], aggs: Iterable[str] = ("mean",), phases: Mapping[str, Iterable[int]] | None = None, strict: bool = False) -> list[Column]:
    """{col}_{phase}_{agg}; strict: {col}_{phase} of the last aggregate, and nothing without phases."""
    aggs = list(aggs)
    phases = ({} if strict else PHASES) if phases is None else phases
    if strict:
        return [PHASE_AGGREGATES[aggs[-1]](in_phase(c, m)).alias(f"{c}_{p}") for c in columns for p, m in phases.items()]
    return [PHASE_AGGREGATES[a](in_phase(c, m)).alias(f"{c}_{p}_{a}") for c in columns for p, m in phases.items() for a in aggs]


def phase_deltas(columns: Iterable[str], agg: str = "mean", phases: Mapping[str, Iterable[int]] = PHASES) -> list[Column]:
    """Difference of consecutive phases in their given order; null if either is missing."""
    names = list(phases)
    value = {(c, p): PHASE_AGGREGATES[agg](in_phase(c, phases[p])) for c in columns for p in names}
    return [(value[c, b] - value[c, a]).alias(f"{c}_{a}_to_{b}_delta") for c in columns for a, b in zip(names, names[1:], strict=False)]


def points(c: str, months: Iterable[int] | None = None, month: str = "month") -> Column:
    """Sorted (m, v) of the values that are not null."""
    held = F.struct(F.col(month).alias("m"), F.col(c).alias("v"))
    keep = F.col(c).isNotNull() if months is None else F.col(c).isNotNull() & F.col(month).isin(*months)
    return F.array_sort(F.collect_list(F.when(keep, held)))


def _trapezoid(s: Column) -> Column:
    n = F.size(s)
    parts = F.zip_with(F.slice(s, 1, F.greatest(n - 1, F.lit(0))), F.slice(s, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (b["m"] - a["m"]) * (a["v"] + b["v"]) / 2)
    return F.when(n >= 2, F.aggregate(parts, F.lit(0.0), lambda t, x: t + x))


def phase_integrals(columns: Iterable[str], names: Iterable[str] = ("flowering", "veraison"), phases: Mapping[str, Iterable[int]] = PHASES) -> list[Column]:
    """Trapezoids over the months of a phase; null below two points."""
    return [_trapezoid(points(c, phases[p])).alias(f"{c}_{p}_integral") for c in columns for p in names]


def monthly_pivot(columns: Iterable[str], months: Iterable[int] = range(3, 10), order: str | None = None) -> list[Column]:
    """{col}_m{month}; of several rows of a month the last by `order` wins."""
    held = F.struct(F.col(order or "month"))
    return [F.max_by(F.when(F.col("month") == m, F.col(c)), F.when(F.col("month") == m, held)).alias(f"{c}_m{m}") for c in columns for m in months]


def peak(columns: Iterable[str]) -> list[Column]:
    """Largest value and its month; ties go to the earliest month."""
    out = []
    for c in columns:
        best = F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), (-F.col("month")).alias("m"))))
        out += [best["v"].alias(f"{c}_peak"), (-best["m"]).alias(f"{c}_peak_month")]
    return out


def season_points(columns: Iterable[str]) -> list[Column]:
    return [points(c).alias(f"__s_{c}") for c in columns]


def season_metrics(df: DataFrame, columns: Iterable[str], keys: Iterable[str] = K, base_percentile: float = 10, threshold: float = 0.2) -> DataFrame:
    """POS, AOS, SOS, EOS, LOS, ROG, ROS and the season integral per column; all null below three points."""
    columns = list(columns)
    return season_columns(df.groupBy(*keys).agg(*season_points(columns)), columns, base_percentile, threshold)


def season_columns(df: DataFrame, columns: Iterable[str], base_percentile: float = 10, threshold: float = 0.2) -> DataFrame:
    for c in columns:
        s, p = F.col(f"__s_{c}"), f"__p_{c}"
        values = F.transform(s, lambda x: x["v"])
        low = F.array_sort(values)
        at = (F.size(s) - 1) * (base_percentile / 100)
        a, b = F.get(low, F.floor(at).cast("int")), F.get(low, F.ceil(at).cast("int"))
        df = df.withColumn(p, F.when(F.size(s) >= 3, F.struct(
            F.size(s).alias("n"), values.alias("v"), F.array_max(values).alias("top"), (a + (b - a) * (at - F.floor(at))).alias("base"), F.array_position(values, F.array_max(values)).cast("int").alias("pos"))))
        n, v, top, base, pos = (F.col(f"{p}.{x}") for x in ("n", "v", "top", "base", "pos"))
        least = base + threshold * (top - base)
        rise = F.zip_with(F.slice(v, F.lit(2), F.greatest(pos - 1, F.lit(0))), F.slice(v, F.lit(1), F.greatest(pos - 1, F.lit(0))), lambda x, y: x - y)
        fall = F.zip_with(F.slice(v, pos + 1, n - pos), F.slice(v, pos, n - pos), lambda x, y: x - y)
        df = df.withColumns({
            f"{c}_POS": F.get(s, pos - 1)["m"],
            f"{c}_AOS": top - base,
            f"{c}_SOS": F.get(F.filter(F.slice(s, F.lit(1), pos - 1), lambda x: x["v"] >= least), F.lit(0))["m"],
            f"{c}_EOS": F.get(F.filter(F.slice(s, pos, n), lambda x: x["v"] < least), F.lit(0))["m"],
            f"{c}_ROG": F.array_max(rise),
            f"{c}_ROS": F.array_min(fall),
        })
        sos, eos = F.col(f"{c}_SOS"), F.col(f"{c}_EOS")
        inside = F.filter(s, lambda x: x["m"].between(sos, eos))
        df = df.withColumns({f"{c}_LOS": eos - sos, f"{c}_integral": F.when(sos.isNotNull() & eos.isNotNull(), F.aggregate(inside, F.lit(0.0), lambda t, x: t + x["v"]))}).drop(p)
    return df.drop(*[f"__s_{c}" for c in columns])


def boolean_flags(columns: Iterable[str], phases: Mapping[str, Iterable[int]] = PHASES) -> list[Column]:
    """early_peak, peak_in_veraison, stress_flowering, harvest_drop, veraison_dominant as 0/1; all null without values."""
    out = []
    for c in columns:
        some = F.count(c) > 0
        month = -F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), (-F.col("month")).alias("m"))))["m"]
        mean = {p: F.avg(in_phase(c, m)) for p, m in phases.items()}

        def flag(cond: Column, some: Column = some) -> Column:
            return F.when(some, cond.cast("int"))

        def below(a: str, b: str, mean: dict = mean) -> Column:
            return mean[a] < mean[b] if {a, b} <= set(mean) else F.lit(None).cast("boolean")

        ranked = [F.struct(v.alias("v"), F.lit(-i).alias("i")) for i, v in enumerate(mean.values())]
        best = F.array_max(F.filter(F.array(*ranked), lambda x: x["v"].isNotNull()))
        at = list(mean).index("veraison") if "veraison" in mean else None
        out += [
            flag(month <= 8).alias(f"{c}_early_peak"),
            flag(month.isin(*phases.get("veraison", (7, 8)))).alias(f"{c}_peak_in_veraison"),
            flag(below("flowering", "budbreak")).alias(f"{c}_stress_flowering"),
            flag(below("harvest", "veraison")).alias(f"{c}_harvest_drop"),
            flag(F.lit(False) if at is None else F.coalesce(best["i"] == -at, F.lit(False))).alias(f"{c}_veraison_dominant"),
        ]
    return out


def temporal_deltas(df: DataFrame, columns: Iterable[str], keys: Iterable[str] = K) -> DataFrame:
    """{col}_delta: value minus that of the previous row of the group by month."""
    w = Window.partitionBy(*keys).orderBy("month")
    return df.withColumns({f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in columns})


def harvest_features(df: DataFrame, columns: Iterable[str], keys: Iterable[str] = K, date: str = "harvest_date", time: str = "time", windows: Iterable[int] = (30, 60)) -> DataFrame:
    """Values around the harvest of each group: nearest observation, means before it, distance from the peak."""
    day = F.first(F.col(date), ignorenulls=True)
    gap = F.abs(F.datediff(F.col(time), F.col(date)))
    out = [F.dayofyear(day).alias("harvest_doy"), F.month(day).alias("harvest_month")]
    for c in columns:
        known = F.col(c).isNotNull()
        near = F.min_by(c, F.struct(gap, F.col(time)))
        best = F.max(F.when(known, F.struct(F.col(c).alias("v"), (-F.unix_micros(F.col(time).cast("timestamp"))).alias("t"))))
        month = F.month(F.timestamp_micros(-best["t"]))
        out += [near.alias(f"{c}_at_harvest")]
        out += [F.avg(F.when(F.to_date(time).between(F.date_sub(F.col(date), w), F.col(date)), F.col(c))).alias(f"{c}_pre_harvest_{w}d_mean") for w in windows]
        out += [(best["v"] - near).alias(f"{c}_peak_to_harvest_delta"), (F.month(day) - month).alias(f"{c}_peak_to_harvest_months")]
    return df.where(F.col(date).isNotNull()).groupBy(*keys).agg(*out)


def label_codes(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """{col}_enc: position of the value among the sorted distinct ones, however many they are; null stays null."""
    for c in columns:
        kinds = df.where(F.col(c).isNotNull()).select(F.col(c).alias("__c")).distinct()
        codes = number_rows(kinds, ["__c"]).select("__c", F.col("__r").cast("double").alias(f"{c}_enc"))
        df = df.join(codes, F.col(c) == F.col("__c"), "left").drop("__c")
    return df


def static_features(df: DataFrame, categorical: Iterable[str] = ("certification", "variety"), boolean: Iterable[str] = ("rainfed",), planting: str = "planting_date") -> DataFrame:
    """Age from the planting year, codes of categories (which stay), booleans as 0/1."""
    if planting in df.columns:
        df = df.withColumn("vine_age", F.col("year") - F.col(planting)).drop(planting)
    df = label_codes(df, [c for c in categorical if c in df.columns])
    return df.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in boolean if c in df.columns})


def drop_sparse_columns(df: DataFrame, threshold: float, protected: Iterable[str] = ()) -> DataFrame:
    """Drops columns whose share of nulls, in percent, is above the threshold. One action over all columns."""
    free = [c for c in df.columns if c not in {*protected, "split"}]
    if threshold >= 100 or not free:
        return df
    share = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in free]).first()
    return df.drop(*[c for c in free if share[c] is not None and 100 * share[c] > threshold])


def merge_targets(features: DataFrame, targets: DataFrame, columns: Iterable[str], keys: Iterable[str] = K) -> DataFrame:
    """Inner join with the target columns that exist (and split); target columns win over equal names."""
    keys = list(keys)
    keep = [c for c in [*columns, "split"] if c in targets.columns and c not in keys]
    return features.drop(*[c for c in keep if c in features.columns]).join(targets.select(*keys, *dict.fromkeys(keep)), keys)
