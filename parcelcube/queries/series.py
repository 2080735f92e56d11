"""Indices, calibration, statistics, time buckets, windows and features."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelcube.catalog import register
from parcelcube.functions import bands as B
from parcelcube.functions.indices import REGISTRY, compute_indices, index
from parcelcube.operators import features as X
from parcelcube.operators import spatial as S
from parcelcube.operators import temporal as T
from parcelcube.plans.config import FeaturesConfig
from parcelcube.plans.pipelines import extract_features
from parcelcube.queries.base import PX, G, M, grid, monthly, pixels, read, rounded
from parcelcube.sources import zarr
from parcelcube.sources.sinks import shared_folder

INDEX_SQL = {
    "NDVI": "(B08 - B04) / nullif(B08 + B04, 0)", "EVI": "(2.5 * (B08 - B04)) / nullif(B08 + 6 * B04 - 7.5 * B02 + 1, 0)", "SAVI": "(1.5 * (B08 - B04)) / nullif(B08 + B04 + 0.5, 0)",
    "NDWI": "(B03 - B08) / nullif(B03 + B08, 0)", "EVI2": "(2.5 * (B08 - B04)) / nullif(B08 + 2.4 * B04 + 1, 0)", "GVMI": "((B08 + 0.1) - (B11 + 0.02)) / nullif((B08 + 0.1) + (B11 + 0.02), 0)",
    "GNDVI": "(B08 - B03) / nullif(B08 + B03, 0)", "NDRE": "(B8A - B05) / nullif(B8A + B05, 0)", "IRECI": "(B07 - B04) / nullif(B05 / nullif(B06, 0), 0)",
    "S2REP": "705 + 35 * (((B04 + B08) / 2 - B05) / nullif(B06 - B05, 0))", "RVI": "(4 * VH) / nullif(VV + VH, 0)", "VH_VV": "VH / nullif(VV, 0)",
    "DpRVI": "(1 - VV / nullif(VV + VH, 0)) * ((4 * VH) / nullif(VV + VH, 0))", "LST_C": "LST - 273.15", "TP_MM": "tp * 1000", "ET_RATIO": "ET_500m / nullif(PET_500m, 0)",
}

#: Values of the red-edge index are large.
DIGITS = {"IRECI": 3}


def _index_query(name: str):  # noqa: ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pixels(spark, sf_dir, REGISTRY[name].bands).select("o", "ln", "parcel_id", F.round(index(name), DIGITS.get(name, 6)).alias("value"))

    return query


for _name, _sql in INDEX_SQL.items():
    register(f"idx_{_name.lower()}", f"WITH {PX} SELECT o, ln, parcel_id, round({_sql}, {DIGITS.get(_name, 6)}) AS value FROM px")(_index_query(_name))

_PHASES = {p: ", ".join(map(str, m)) for p, m in X.PHASES.items()}


@register("parcel_phase_ndvi", f"""WITH {PX}, s AS (SELECT parcel_id, year, month, avg(n) AS mean, stddev_pop(n) AS std, quantile_cont(n, 0.9) AS p90 FROM (SELECT *, (B08 - B04) / nullif(B08 + B04, 0) AS n FROM px) GROUP BY 1, 2, 3),
r AS (SELECT *, avg(mean) OVER (PARTITION BY parcel_id, year ORDER BY month ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS smooth FROM s)
SELECT parcel_id, year, {", ".join(f"round_even(avg(smooth) FILTER (month IN ({m})), 4) AS ndvi_{p}_mean" for p, m in _PHASES.items())}, round_even(max(p90), 4) AS p90_max, round_even(max(std), 4) AS std_max FROM r GROUP BY 1, 2""")
def parcel_phase_ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir, ("B08", "B04")).withColumn("n", index("NDVI"))
    stats = S.spatial_stats(px, ["parcel_id", "year", "month"], ["n"], ["mean", "std", "p90"])
    stats = stats.withColumn("bucket", F.make_date("year", "month", F.lit(1))).withColumn("ndvi", F.col("n_mean"))
    smooth = T.rolling_centered(stats, ["parcel_id"], ["ndvi"], 2, "mean")
    out = smooth.groupBy("parcel_id", "year").agg(*X.phase_aggregates(["ndvi"]), F.max("n_p90").alias("p90_max"), F.max("n_std").alias("std_max"))
    return out.withColumns({c: F.bround(c, 4) for c, kind in out.dtypes if kind == "double"})


@register("s2_scale_guard", f"""WITH {G}, d AS (SELECT vec_id, label, y, x, CASE WHEN label % 2 = 0 THEN v ELSE v * 20000 + 3000 END AS v FROM g), q AS (SELECT label, median(v) AS md FROM d GROUP BY 1)
SELECT vec_id, y, x, round(CASE WHEN md <= 1.0 THEN v ELSE least(greatest(v / 10000, 0), 1) END, 9) AS v FROM d JOIN q USING (label)""")
def s2_scale_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).withColumn("v", F.when(F.col("label") % 2 == 0, F.col("v")).otherwise(F.col("v") * 20000 + 3000))
    return B.scale_reflectance(g, ["v"], ["label"]).select("vec_id", "y", "x", F.round("v", 9).alias("v"))


@register("s1_to_db", f"WITH {PX} SELECT o, ln, round(10 * log10(greatest(VV, 1e-10)), 9) AS vv_db, round(10 * log10(greatest(VH, 1e-10)), 9) AS vh_db FROM px")
def s1_to_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir, ("VV", "VH")).select("o", "ln", F.round(B.decibel(F.col("VV")), 9).alias("vv_db"), F.round(B.decibel(F.col("VH")), 9).alias("vh_db"))


@register("s1_sigma_nought", f"WITH {PX} SELECT o, ln, round(pow(B08, 2) / 1e9, 9) AS sigma FROM px")
def s1_sigma_nought(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir, ("B08",)).select("o", "ln", F.round(B.sigma_nought(F.col("B08")), 9).alias("sigma"))


@register("era5_correct", f"WITH {PX} SELECT o, ln, round(tp / 12.5, 9) AS tp FROM px")
def era5_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir, ("tp",)).select("o", "ln", F.round(B.deaccumulate(F.col("tp")), 9).alias("tp"))


@register("speckle_3x3", f"""WITH {G}, g2 AS (SELECT *, 1 AS one FROM g), n AS (SELECT a.vec_id, a.y, a.x, b.v FROM g2 a, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx), g2 b
  WHERE b.vec_id = a.vec_id AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7))
SELECT vec_id, y, x, round(median(v), 9) AS v FROM n GROUP BY 1, 2, 3""")
def speckle_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.speckle_median(grid(spark, sf_dir), ["v"], ["vec_id"]).select("vec_id", "y", "x", F.round("v", 9).alias("v"))


@register("speckle_sparse", f"""WITH {G}, s AS (SELECT * FROM g WHERE (vec_id + 3 * y + 5 * x) % 4 <> 0), o AS (SELECT s.*, dy, dx FROM s, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)),
n AS (SELECT o.vec_id, o.y, o.x, coalesce(b.v, c.v, d.v, o.v) AS v FROM o LEFT JOIN s b ON b.vec_id = o.vec_id AND b.y = o.y + dy AND b.x = o.x + dx
  LEFT JOIN s c ON c.vec_id = o.vec_id AND c.y = o.y AND c.x = o.x + dx LEFT JOIN s d ON d.vec_id = o.vec_id AND d.y = o.y + dy AND d.x = o.x)
SELECT vec_id, y, x, round(median(v), 9) AS v FROM n GROUP BY 1, 2, 3""")
def speckle_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with holes: a quarter of the places has no pixel."""
    g = grid(spark, sf_dir).where("(vec_id + 3 * y + 5 * x) % 4 <> 0")
    return B.speckle_median(g, ["v"], ["vec_id"]).select("vec_id", "y", "x", F.round("v", 9).alias("v"))


@register("sar_chain", f"""WITH {G}, s AS (SELECT vec_id, y, x, pow(v * 1000, 2) / 1e9 AS vv, pow(v * 500 + 1, 2) / 1e9 AS vh FROM g),
n AS (SELECT a.vec_id, a.y, a.x, median(b.vv) AS vv, median(b.vh) AS vh FROM s a, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx), s b
  WHERE b.vec_id = a.vec_id AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7) GROUP BY 1, 2, 3)
SELECT vec_id, y, x, round((4 * vh) / nullif(vv + vh, 0), 9) AS RVI, round(vh / nullif(vv, 0), 5) AS VH_VV, round(10 * log10(greatest(vv, 1e-10)), 9) AS VV FROM n""")
def sar_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).select("vec_id", "y", "x", (F.col("v") * 1000).alias("VV"), (F.col("v") * 500 + 1).alias("VH"))
    return B.calibrate_radar(g, ["vec_id"]).select("vec_id", "y", "x", F.round("RVI", 9).alias("RVI"), F.round("VH_VV", 5).alias("VH_VV"), F.round("VV", 9).alias("VV"))


@register("compute_indices", f"""WITH {PX}, h AS (SELECT *, count(CASE WHEN parcel_id % 2 = 0 THEN B02 END) OVER (PARTITION BY parcel_id) AS n FROM px)
SELECT o, ln, round(CASE WHEN n > 0 THEN CASE WHEN parcel_id % 2 = 0 THEN B02 END ELSE (B08 - B04) / nullif(B08 + B04, 0) END, 9) AS NDVI, round((1.5 * (B08 - B04)) / nullif(B08 + B04 + 0.5, 0), 9) AS SAVI FROM h""")
def compute_some_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir, ("B08", "B04", "B02")).withColumn("NDVI", F.when(F.col("parcel_id") % 2 == 0, F.col("B02"))).drop("B02")
    return compute_indices(px, ["NDVI", "NDRE", "SAVI"], ["parcel_id"]).select("o", "ln", F.round("NDVI", 9).alias("NDVI"), F.round("SAVI", 9).alias("SAVI"))


_ALL = "round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std, round(median({c}), 6) AS {c}_median, round(quantile_cont({c}, 0.25), 6) AS {c}_p25, round(quantile_cont({c}, 0.75), 6) AS {c}_p75, round(quantile_cont({c}, 0.9), 6) AS {c}_p90, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max"


@register("spatial_stats", f"WITH {PX} SELECT parcel_id, year, month, {_ALL.format(c='B11')}, {_ALL.format(c='VH')} FROM px GROUP BY 1, 2, 3")
def spatial_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.spatial_stats(pixels(spark, sf_dir, ("B11", "VH")), ["parcel_id", "year", "month"], ["B11", "VH"], list(S.STATS)), 6)


@register("spatial_stats_single", f"WITH {PX} SELECT parcel_id, year, round(avg(B03), 9) AS B03 FROM px GROUP BY 1, 2")
def spatial_stats_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.spatial_stats(pixels(spark, sf_dir, ("B03", "B04")), ["parcel_id", "year"], ["B03", "B04"], ["mean"], output=["B03"]))


@register("spatial_stats_empty", f"WITH {PX} SELECT parcel_id, ln, round(avg(B11), 9) AS B11_mean, round(quantile_cont(B11, 0.9), 9) AS B11_p90, round(stddev_pop(B11), 6) AS B11_std FROM px GROUP BY 1, 2")
def spatial_stats_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.spatial_stats(pixels(spark, sf_dir, ("B11",)), ["parcel_id", "ln"], ["B11"], ["mean", "p90", "std"])
    return rounded(out.withColumn("B11_std", F.round("B11_std", 6)))


_RESAMPLED = {"median": "median({c})", "mean": "avg({c})", "sum": "coalesce(sum({c}), 0)", "max": "max({c})", "min": "min({c})", "std": "stddev_pop({c})"}


def _resample_query(agg: str):  # noqa: ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(T.resample(pixels(spark, sf_dir, ("B11", "VV")), ["parcel_id"], ["B11", "VV"], "ME", agg), 6)

    return query


for _agg, _sql in _RESAMPLED.items():
    register(f"resample_{_agg}", f"WITH {PX} SELECT parcel_id, CAST(last_day(time) AS DATE) AS bucket, round({_sql.format(c='B11')}, 6) AS B11, round({_sql.format(c='VV')}, 6) AS VV FROM px GROUP BY 1, 2")(_resample_query(_agg))


@register("resample_densify", """WITH e AS (SELECT o_custkey AS parcel_id, o_orderdate AS time, o_totalprice AS v FROM orders), b AS (SELECT parcel_id, CAST(date_trunc('month', time) AS DATE) AS bucket, round(median(v), 6) AS v FROM e GROUP BY 1, 2),
r AS (SELECT parcel_id, CAST(unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 MONTH)) AS DATE) AS bucket FROM b GROUP BY 1) SELECT r.parcel_id, r.bucket, b.v FROM r LEFT JOIN b USING (parcel_id, bucket)""")
def resample_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "orders").selectExpr("o_custkey AS parcel_id", "o_orderdate AS time", "o_totalprice AS v")
    return rounded(T.resample(e, ["parcel_id"], ["v"], "MS", "median", densify=True), 6)


@register("resample_weeks", """WITH e AS (SELECT o_custkey AS parcel_id, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v FROM orders), f AS (SELECT parcel_id, min(d) AS f FROM e GROUP BY 1),
s AS (SELECT parcel_id, f + CAST((7 - dayofweek(f)) % 7 AS INTEGER) AS s0 FROM f), b AS (SELECT parcel_id, s0 + CAST(14 * ceil(date_diff('day', s0, d) / 14.0) AS INTEGER) AS bucket, v FROM e JOIN s USING (parcel_id))
SELECT parcel_id, CAST(bucket AS DATE) AS bucket, round(avg(v), 6) AS v FROM b GROUP BY 1, 2""")
def resample_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "orders").selectExpr("o_custkey AS parcel_id", "o_orderdate AS time", "o_totalprice AS v")
    return rounded(T.resample(e, ["parcel_id"], ["v"], "2W", "mean"), 6)


_W = "OVER (PARTITION BY parcel_id, year ORDER BY month ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"


def _rolling_query(agg: str, window: int):  # noqa: ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = monthly(spark, sf_dir).withColumn("bucket", F.make_date("year", "month", F.lit(1)))
        return rounded(T.rolling_centered(m, ["parcel_id"], ["v"], window, agg).select("parcel_id", "year", "month", "v"))

    return query


for _label, _agg, _w in (("mean", "mean", 2), ("median", "median", 2), ("w3", "mean", 3), ("w4", "median", 4), ("sum", "sum", 3), ("std", "std", 3)):
    _f = {"mean": "avg", "median": "median", "sum": "sum", "std": "stddev_pop"}[_agg]
    register(f"rolling_centered_{_label}", f"WITH {M} SELECT parcel_id, year, month, round({_f}(v) {_W.format(a=_w // 2, b=_w - 1 - _w // 2)}, 9) AS v FROM m")(_rolling_query(_agg, _w))


@register("rolling_trailing", f"WITH {M} SELECT parcel_id, year, month, round(avg(v) OVER (PARTITION BY parcel_id ORDER BY year, month ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 9) AS v FROM m")
def rolling_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir).withColumn("bucket", F.make_date("year", "month", F.lit(1)))
    return rounded(T.rolling_trailing(m, ["parcel_id"], ["v"], 4).select("parcel_id", "year", "month", "v"))


@register("fuse_sensors", """WITH e AS (SELECT user_id AS parcel_id, CAST(date_trunc('day', ts) AS DATE) AS day, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS rank, ts, event_id, CASE WHEN event_type = 'click' THEN value END AS a, CASE WHEN event_id % 3 <> 0 THEN value END AS b FROM events)
SELECT parcel_id, day, first(a ORDER BY rank, ts, event_id) FILTER (a IS NOT NULL) AS a, first(b ORDER BY rank, ts, event_id) FILTER (b IS NOT NULL) AS b FROM e GROUP BY 1, 2""")
def fuse_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").selectExpr("user_id AS parcel_id", "to_date(ts) AS day", "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS rank", "ts", "event_id", "CASE WHEN event_type = 'click' THEN value END AS a", "CASE WHEN event_id % 3 <> 0 THEN value END AS b")
    return S.fuse(e, ["parcel_id", "day"], ["a", "b"], ["rank", "ts", "event_id"])


@register("fuse_samples", """WITH e AS (SELECT user_id AS parcel_id, CAST(date_trunc('day', ts) AS DATE) AS day, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS rank, ts, event_id, value AS a, CAST(event_id % 7 AS BIGINT) AS n_samples FROM events)
SELECT parcel_id, day, first(a ORDER BY rank, ts, event_id) FILTER (a IS NOT NULL) AS a, CAST(sum(n_samples) AS BIGINT) AS n_samples FROM e GROUP BY 1, 2""")
def fuse_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").selectExpr("user_id AS parcel_id", "to_date(ts) AS day", "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS rank", "ts", "event_id", "value AS a", "event_id % 7 AS n_samples")
    return S.fuse(e, ["parcel_id", "day"], ["a", "n_samples"], ["rank", "ts", "event_id"], totals=["n_samples"])


@register("cube_unpack", """SELECT user_id AS parcel_id, ts AS time, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM events GROUP BY 1, 2""")
def cube_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy("user_id", "ts", "event_type").agg(F.max("value").alias("value"))
    return S.unpack(e.selectExpr("user_id AS parcel_id", "ts AS time", "event_type AS variable", "value"), ["parcel_id", "time"], ["click", "view"])


@register("cube_outer_merge", """WITH a AS (SELECT o_custkey AS parcel_id, o_orderkey AS o, o_totalprice AS va FROM orders WHERE o_orderstatus <> 'O'), b AS (SELECT o_custkey AS parcel_id, o_orderkey AS o, o_orderpriority AS vb FROM orders WHERE o_orderstatus <> 'F')
SELECT parcel_id, o, va, vb FROM a FULL JOIN (SELECT * FROM b WHERE parcel_id IN (SELECT parcel_id FROM a)) USING (parcel_id, o)""")
def cube_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    a = rows.where("o_orderstatus <> 'O'").selectExpr("o_custkey AS parcel_id", "o_orderkey AS o", "o_totalprice AS va")
    b = rows.where("o_orderstatus <> 'F'").selectExpr("o_custkey AS parcel_id", "o_orderkey AS o", "o_orderpriority AS vb")
    return S.merge_cubes(a, b, ["parcel_id", "o"])


@register("cube_merge_status", """SELECT o_custkey AS parcel_id, CASE WHEN count(*) FILTER (o_orderstatus <> 'O') = 0 THEN 'skipped' WHEN count(*) FILTER (o_orderstatus <> 'F') = 0 THEN 'copied' ELSE 'merged' END AS status FROM orders GROUP BY 1""")
def cube_merge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "parcel_id")
    return S.merge_status(rows.where("o_orderstatus <> 'O'"), rows.where("o_orderstatus <> 'F'"))


@register("dup_time_first", "SELECT l_suppkey AS parcel_id, l_shipdate AS time, l_orderkey AS o, l_linenumber AS ln, l_quantity AS v FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber) = 1")
def dup_time_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS parcel_id", "l_shipdate AS time", "l_orderkey AS o", "l_linenumber AS ln", "l_quantity AS v")
    return T.first_per_time(rows, ["parcel_id", "time"], ["o", "ln"])


@register("monthly_pivot", f"WITH {M} SELECT parcel_id, year, {', '.join(f'max(v) FILTER (month = {k}) AS v_m{k}' for k in range(3, 10))} FROM m GROUP BY 1, 2")
def monthly_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).groupBy("parcel_id", "year").agg(*X.monthly_pivot(["v"]))


_AGGS = {"mean": "avg", "max": "max", "min": "min", "sum": "sum", "median": "median", "std": "stddev_samp"}


@register("phase_agg", f"WITH {M} SELECT parcel_id, year, {', '.join(f'round({f}(v) FILTER (month IN ({m})), 9) AS v_{p}_{a}' for p, m in _PHASES.items() for a, f in _AGGS.items())} FROM m GROUP BY 1, 2")
def phase_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monthly(spark, sf_dir).groupBy("parcel_id", "year").agg(*X.phase_aggregates(["v"], list(_AGGS))))


_PAIRS = list(zip(_PHASES, list(_PHASES)[1:], strict=False))


@register("phase_delta", f"WITH {M} SELECT parcel_id, year, {', '.join(f'round(avg(v) FILTER (month IN ({_PHASES[b]})) - avg(v) FILTER (month IN ({_PHASES[a]})), 9) AS v_{a}_to_{b}_delta' for a, b in _PAIRS)} FROM m GROUP BY 1, 2")
def phase_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monthly(spark, sf_dir).groupBy("parcel_id", "year").agg(*X.phase_deltas(["v"])))


_TRAPEZOID = "(SELECT parcel_id, year, CASE WHEN count(*) >= 2 THEN round(coalesce(sum((n - month) * (v + nv) / 2), 0), 9) END AS i FROM (SELECT *, lead(month) OVER w AS n, lead(v) OVER w AS nv FROM m WHERE v IS NOT NULL AND month IN ({m}) WINDOW w AS (PARTITION BY parcel_id, year ORDER BY month)) GROUP BY 1, 2)"


@register("phase_integral", f"WITH {M} SELECT k.parcel_id, k.year, a.i AS v_flowering_integral, b.i AS v_veraison_integral FROM (SELECT DISTINCT parcel_id, year FROM m) k LEFT JOIN {_TRAPEZOID.format(m='5, 6')} a USING (parcel_id, year) LEFT JOIN {_TRAPEZOID.format(m='7, 8')} b USING (parcel_id, year)")
def phase_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monthly(spark, sf_dir).groupBy("parcel_id", "year").agg(*X.phase_integrals(["v"])))


@register("peak_metrics", f"WITH {M} SELECT parcel_id, year, max(v) AS v_peak, first(month ORDER BY v DESC, month) FILTER (v IS NOT NULL) AS v_peak_month, max(w) AS w_peak, first(month ORDER BY w DESC, month) FILTER (w IS NOT NULL) AS w_peak_month FROM m GROUP BY 1, 2")
def peak_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).groupBy("parcel_id", "year").agg(*X.peak(["v", "w"]))


@register("season_metrics", f"""WITH {M}, s AS (SELECT *, row_number() OVER (PARTITION BY parcel_id, year ORDER BY month) AS i, v - lag(v) OVER (PARTITION BY parcel_id, year ORDER BY month) AS d FROM m WHERE v IS NOT NULL),
k AS (SELECT parcel_id, year, count(*) AS n, max(v) AS top, quantile_cont(v, 0.1) AS base, min(i) FILTER (is_top) AS pos, min(month) FILTER (is_top) AS pm FROM (SELECT *, v = max(v) OVER (PARTITION BY parcel_id, year) AS is_top FROM s) GROUP BY 1, 2 HAVING count(*) >= 3),
c AS (SELECT parcel_id, year, pm AS POS, top - base AS AOS, min(month) FILTER (i < pos AND v >= base + 0.2 * (top - base)) AS SOS, min(month) FILTER (i >= pos AND v < base + 0.2 * (top - base)) AS EOS, max(d) FILTER (i > 1 AND i <= pos) AS ROG, min(d) FILTER (i > pos) AS ROS FROM s JOIN k USING (parcel_id, year) GROUP BY 1, 2, 3, 4),
t AS (SELECT c.parcel_id, c.year, sum(s.v) AS integral FROM c JOIN s ON s.parcel_id = c.parcel_id AND s.year = c.year AND s.month BETWEEN c.SOS AND c.EOS GROUP BY 1, 2)
SELECT q.parcel_id, q.year, POS AS v_POS, round(AOS, 9) AS v_AOS, SOS AS v_SOS, EOS AS v_EOS, round(ROG, 9) AS v_ROG, round(ROS, 9) AS v_ROS, EOS - SOS AS v_LOS, round(integral, 9) AS v_integral
FROM (SELECT DISTINCT parcel_id, year FROM m) q LEFT JOIN c USING (parcel_id, year) LEFT JOIN t USING (parcel_id, year)""")
def season_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.season_metrics(monthly(spark, sf_dir), ["v"]))


@register("boolean_flags", f"""WITH {M}, a AS (SELECT parcel_id, year, count(v) AS n, first(month ORDER BY v DESC, month) FILTER (v IS NOT NULL) AS pm, {', '.join(f'avg(v) FILTER (month IN ({m})) AS {p}' for p, m in _PHASES.items())} FROM m GROUP BY 1, 2),
f AS (SELECT *, list_max(list_filter([{', '.join(_PHASES)}], lambda x: x IS NOT NULL)) AS best FROM a)
SELECT parcel_id, year, CASE WHEN n > 0 THEN CAST(pm <= 8 AS INTEGER) END AS v_early_peak, CASE WHEN n > 0 THEN CAST(pm IN (7, 8) AS INTEGER) END AS v_peak_in_veraison, CASE WHEN n > 0 THEN CAST(flowering < budbreak AS INTEGER) END AS v_stress_flowering,
  CASE WHEN n > 0 THEN CAST(harvest < veraison AS INTEGER) END AS v_harvest_drop, CASE WHEN n > 0 THEN CAST(coalesce(veraison = best AND NOT coalesce(dormancy = best, false) AND NOT coalesce(budbreak = best, false) AND NOT coalesce(flowering = best, false), false) AS INTEGER) END AS v_veraison_dominant FROM f""")
def boolean_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).groupBy("parcel_id", "year").agg(*X.boolean_flags(["v"]))


_HARVEST = "h AS (SELECT s_suppkey AS parcel_id, y AS year, make_date(y, 8 + CAST(s_suppkey % 2 AS INTEGER), 1 + CAST(s_suppkey % 27 AS INTEGER)) AS harvest_date FROM supplier, (SELECT CAST(unnest(range(1996, 2001)) AS INTEGER) AS y) WHERE s_acctbal >= 0)"


def _harvests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in debt have years without a date, which the operator leaves out."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("parcel_id"), "s_acctbal", F.explode(F.sequence(F.lit(1996), F.lit(2000))).alias("year"))
    return s.withColumn("harvest_date", F.expr("CASE WHEN s_acctbal >= 0 THEN make_date(year, 8 + CAST(parcel_id % 2 AS INT), 1 + CAST(parcel_id % 27 AS INT)) END")).drop("s_acctbal")


@register("harvest_features", f"""WITH {M}, {_HARVEST}, j AS (SELECT m.parcel_id, m.year, m.month, m.v, last_day(make_date(m.year, m.month, 1)) AS t, h.harvest_date AS hd FROM m JOIN h USING (parcel_id, year)),
a AS (SELECT parcel_id, year, first(v ORDER BY abs(date_diff('day', hd, t)), t) AS atv, max(v) AS pk, first(t ORDER BY v DESC, t) FILTER (v IS NOT NULL) AS pt, avg(v) FILTER (t BETWEEN hd - 30 AND hd) AS p30, avg(v) FILTER (t BETWEEN hd - 60 AND hd) AS p60, min(hd) AS hd FROM j GROUP BY 1, 2)
SELECT parcel_id, year, CAST(dayofyear(hd) AS INTEGER) AS harvest_doy, CAST(month(hd) AS INTEGER) AS harvest_month, round(atv, 9) AS v_at_harvest, round(p30, 9) AS v_pre_harvest_30d_mean, round(p60, 9) AS v_pre_harvest_60d_mean, round(pk - atv, 9) AS v_peak_to_harvest_delta, CAST(month(hd) - month(pt) AS INTEGER) AS v_peak_to_harvest_months FROM a""")
def harvest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir).withColumn("time", F.last_day(F.make_date("year", "month", F.lit(1))))
    return rounded(X.harvest_features(m.join(_harvests(spark, sf_dir), ["parcel_id", "year"], "left"), ["v"]))


@register("temporal_delta", f"WITH {M} SELECT parcel_id, year, month, round(v - lag(v) OVER (PARTITION BY parcel_id, year ORDER BY month), 9) AS v_delta FROM m")
def temporal_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.temporal_deltas(monthly(spark, sf_dir), ["v"]).select("parcel_id", "year", "month", "v_delta"))


@register("interpolate_linear", f"""WITH {M}, i AS (SELECT *, row_number() OVER w AS i FROM m WINDOW w AS (PARTITION BY parcel_id, year ORDER BY month)),
b AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY parcel_id, year ORDER BY month ROWS UNBOUNDED PRECEDING) AS p, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY parcel_id, year ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM i)
SELECT b.parcel_id, b.year, b.month, round(CASE WHEN b.v IS NOT NULL THEN b.v WHEN b.p IS NULL THEN y.v WHEN b.n IS NULL THEN x.v ELSE x.v + (y.v - x.v) * (b.i - b.p) / (b.n - b.p) END, 9) AS v
FROM b LEFT JOIN b x ON x.parcel_id = b.parcel_id AND x.year = b.year AND x.i = b.p LEFT JOIN b y ON y.parcel_id = b.parcel_id AND y.year = b.year AND y.i = b.n""")
def interpolate_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.interpolate(monthly(spark, sf_dir), ["parcel_id", "year"], ["v"]).select("parcel_id", "year", "month", "v"))


@register("features_wide", f"WITH {M} SELECT parcel_id, year, {', '.join(f'round(avg(v) FILTER (month IN ({m})), 9) AS v_{p}_mean' for p, m in _PHASES.items())}, max(v) AS v_peak, first(month ORDER BY v DESC, month) FILTER (v IS NOT NULL) AS v_peak_month, {', '.join(f'max(v) FILTER (month = {k}) AS v_m{k}' for k in range(3, 10))} FROM m GROUP BY 1, 2")
def features_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(extract_features(monthly(spark, sf_dir), FeaturesConfig(columns=("v",), monthly=True, phase_aggs=("mean",), peak=True)))


@register("merge_targets", f"""WITH {M}, f AS (SELECT parcel_id, year, round(avg(w), 9) AS w FROM m GROUP BY 1, 2), t AS (SELECT s_suppkey AS parcel_id, y AS year, s_acctbal AS yield, CASE WHEN y < 1998 THEN 'train' WHEN y = 1998 THEN 'val' ELSE 'test' END AS split FROM supplier, (SELECT CAST(unnest(range(1996, 2000)) AS INTEGER) AS y))
SELECT f.parcel_id, f.year, w, yield, split FROM f JOIN t USING (parcel_id, year)""")
def merge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = rounded(monthly(spark, sf_dir).groupBy("parcel_id", "year").agg(F.avg("w").alias("w")))
    t = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("parcel_id"), F.explode(F.sequence(F.lit(1996), F.lit(1999))).alias("year"), F.col("s_acctbal").alias("yield"))
    t = t.withColumn("split", F.when(F.col("year") < 1998, "train").when(F.col("year") == 1998, "val").otherwise("test"))
    return X.merge_targets(f, t, ["yield", "absent"])


@register("static_encode", """WITH t AS (SELECT p_partkey AS parcel_id, CAST(2020 AS INTEGER) AS year, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS variety, p_type AS certification, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END AS rainfed, 1950 + p_size AS planting_date FROM part),
v AS (SELECT variety, row_number() OVER (ORDER BY variety) - 1 AS k FROM (SELECT DISTINCT variety FROM t WHERE variety IS NOT NULL)), c AS (SELECT certification, row_number() OVER (ORDER BY certification) - 1 AS k FROM (SELECT DISTINCT certification FROM t))
SELECT parcel_id, year, t.variety, t.certification, CAST(coalesce(rainfed, false) AS INTEGER) AS rainfed, year - planting_date AS vine_age, CAST(v.k AS DOUBLE) AS variety_enc, CAST(c.k AS DOUBLE) AS certification_enc FROM t LEFT JOIN v USING (variety) LEFT JOIN c USING (certification)""")
def static_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "part").selectExpr("p_partkey AS parcel_id", "2020 AS year", "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS variety", "p_type AS certification", "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END AS rainfed", "1950 + p_size AS planting_date")
    return X.static_features(t)


@register("drop_high_null", f"WITH {M} SELECT parcel_id, year, month, v FROM (SELECT parcel_id, year, month, v, CASE WHEN month = 1 THEN w END AS sparse FROM m)")
def drop_high_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir).withColumn("sparse", F.when(F.col("month") == 1, F.col("w"))).drop("w")
    return X.drop_sparse_columns(m, 30, ("parcel_id", "year"))


@register("cube_store_scan", f"""WITH {G} SELECT 'P' || label AS parcel_id, variable, y, x, CAST(count(*) AS BIGINT) AS n, round(sum(CAST(v AS FLOAT)::DOUBLE), 6) AS total FROM (SELECT label, vec_id, 'B' || (y % 2) AS variable, CAST(y // 2 AS INTEGER) AS y, x, v FROM g) GROUP BY ALL""")
def cube_store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as images of two bands, one cube per label and a time step per vector, written as cube stores and read from them."""
    g = grid(spark, sf_dir)
    time = F.expr("cast(timestamp_ntz'2000-01-01' + make_interval(0, 0, 0, 0, cast(vec_id as int)) as timestamp_ntz)")
    pixels = g.select(F.lit("S2").alias("sensor"), F.concat(F.lit("P"), F.col("label").cast("string")).alias("parcel_id"), time.alias("time"), F.concat(F.lit("B"), (F.col("y") % 2).cast("string")).alias("variable"), F.floor(F.col("y") / 2).cast("double").alias("y_coord"), F.col("x").cast("double").alias("x_coord"), F.col("v").alias("value"))
    path = f"{shared_folder(spark)}/cubes-{uuid.uuid4().hex}"
    zarr.write_cubes(pixels, path)
    read_back = zarr.CubeStores(spark, path).load("S2")
    return read_back.where("value IS NOT NULL").groupBy("parcel_id", "variable", "y", "x").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
