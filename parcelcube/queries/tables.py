"""Joins, filters, deduplication, sampling, summaries and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelcube.catalog import register
from parcelcube.operators import ml
from parcelcube.operators import profile as P
from parcelcube.operators import relational as R
from parcelcube.operators import spatial as S
from parcelcube.operators.group_quantiles import quantiles_by
from parcelcube.plans import pipelines
from parcelcube.queries.base import M, monthly, read, rounded
from parcelcube.sources import readers
from parcelcube.sources.sinks import unit_column, variety_errors


def rounded6(df: DataFrame, digits: int = 6) -> DataFrame:
    return rounded(df, digits)


@register("dup_period_agg", """SELECT array_to_string(list_sort(list_transform(string_split(pid, ','), lambda x: trim(x))), ',') AS place_id, CAST(year(d) AS INTEGER) AS year, round(sum(kg), 2) AS production_kg, round(avg(deg), 6) AS alcohol_degree, first(d ORDER BY kg DESC, d DESC) AS harvest_date
FROM (SELECT ' L' || (l_suppkey % 7) || ', L' || (l_partkey % 5) || ' ' AS pid, CAST(l_shipdate AS DATE) AS d, l_quantity AS kg, l_discount AS deg FROM lineitem) GROUP BY 1, 2""")
def dup_period_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").selectExpr("concat(' L', l_suppkey % 7, ', L', l_partkey % 5, ' ') AS place_id", "to_date(l_shipdate) AS harvest_date", "l_quantity AS production_kg", "l_discount AS alcohol_degree")
    out = R.duplicate_periods(rows)
    return out.withColumns({"production_kg": F.round("production_kg", 2), "alcohol_degree": F.round("alcohol_degree", 6)})


_LISTS = "r AS (SELECT c_custkey, c_custkey % 100 || ', ' || (c_custkey * 7) % 100 || ',' || (c_custkey * 13) % 130 AS ids FROM customer)"


@register("place_list_join", f"""WITH {_LISTS}, e AS (SELECT c_custkey, i, CAST(trim(string_split(ids, ',')[i]) AS BIGINT) AS k FROM r, (SELECT unnest([1, 2, 3]) AS i)),
j AS (SELECT c_custkey, sum(s_acctbal) AS area, array_to_string(list(s_name ORDER BY i), ';') AS names FROM e JOIN supplier ON s_suppkey = k GROUP BY 1) SELECT r.c_custkey, ids, round(area, 4) AS area, names FROM r LEFT JOIN j USING (c_custkey)""")
def place_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", "concat(c_custkey % 100, ', ', (c_custkey * 7) % 100, ',', (c_custkey * 13) % 130) AS ids")
    places = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_acctbal AS area", "s_name AS names")
    return R.join_by_list(rows, places, "ids", "s_suppkey", "c_custkey", ["area"], ["names"]).select("c_custkey", "ids", F.round("area", 4).alias("area"), F.array_join("names", ";").alias("names"))


@register("parallel_list_lookup", """WITH e AS (SELECT c_custkey, i, CAST(CASE i WHEN 0 THEN c_nationkey ELSE (c_nationkey + 3) % 40 END AS INTEGER) AS nk, CAST(CASE i WHEN 0 THEN c_nationkey % 5 ELSE (c_nationkey + 3) % 5 END AS INTEGER) AS rk FROM customer, (SELECT unnest([0, 1]) AS i)),
f AS (SELECT c_custkey, array_to_string(list(n_name ORDER BY i), ';') AS names FROM e JOIN nation ON n_nationkey = nk AND n_regionkey = rk GROUP BY 1) SELECT c.c_custkey, names FROM customer c LEFT JOIN f USING (c_custkey)""")
def parallel_list_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").selectExpr("c_custkey", "array(c_nationkey, (c_nationkey + 3) % 40) AS a", "array(c_nationkey % 5, (c_nationkey + 3) % 5) AS b")
    out = R.lookup_lists(c, read(spark, sf_dir, "nation"), {"a": "n_nationkey", "b": "n_regionkey"}, "c_custkey", "n_name")
    return out.select("c_custkey", F.array_join("n_name", ";").alias("names"))


@register("quantile_filter", "SELECT o_orderkey, o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.01) AS a, quantile_cont(o_totalprice, 0.99) AS b FROM orders) WHERE o_totalprice BETWEEN a AND b")
def quantile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quantile_band(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@register("tolerance_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs((l_tax - l_discount) / nullif(l_discount, 0) * 100) <= 20")
def tolerance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tolerance(read(spark, sf_dir, "lineitem"), "l_tax", "l_discount").select("l_orderkey", "l_linenumber")


@register("p95_cut", "SELECT o_orderkey FROM orders WHERE o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.95) FROM orders)")
def p95_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quantile_band(read(spark, sf_dir, "orders"), "o_totalprice", 0.0, 0.95).select("o_orderkey")


@register("iqr_outliers", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) SELECT event_id, e.event_type, value FROM events e JOIN q USING (event_type) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.iqr_outliers(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", ["event_type"])


@register("iqr_normalise", "SELECT o_orderkey, round((o_totalprice - m) / nullif(b - a, 0), 6) AS z FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) AS b FROM orders)")
def iqr_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.iqr_normalise(read(spark, sf_dir, "orders"), "o_totalprice", "z").select("o_orderkey", F.round("z", 6).alias("z"))


@register("semi_join_keys", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey AS o_custkey")
    return read(spark, sf_dir, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey")


@register("yearly_rollup", """SELECT CASE WHEN grouping(y) = 1 THEN 'TOTAL' ELSE CAST(y AS VARCHAR) END AS period, count(*) AS n, count(DISTINCT l_suppkey) AS n_keys, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(stddev_samp(l_quantity), 6) AS std
FROM (SELECT year(l_shipdate) AS y, l_suppkey, l_quantity FROM lineitem) GROUP BY ROLLUP (y)""")
def yearly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), "l_suppkey", "l_quantity")
    return rounded6(P.year_summary(rows, "l_suppkey", "l_quantity"))


@register("yearly_summary", "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS n_keys, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median FROM lineitem GROUP BY 1, 2")
def yearly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    return rounded6(P.group_summary(rows, ["year", "l_returnflag"], "l_suppkey", "l_quantity"))


@register("crosstab", "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.crosstab(read(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate")), "year", "l_returnflag", ["A", "N", "R"])


@register("pivot_month_mean", f"WITH {M} SELECT parcel_id, year, {', '.join(f'round(avg(w) FILTER (month = {k}), 6) AS w{k}' for k in (3, 6, 9))} FROM m GROUP BY 1, 2")
def pivot_month_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monthly(spark, sf_dir).groupBy("parcel_id", "year").pivot("month", [3, 6, 9]).agg(F.round(F.avg("w"), 6))
    return out.withColumnsRenamed({str(k): f"w{k}" for k in (3, 6, 9)})


@register("unstack_median", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(median(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS F, round(median(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS O, round(median(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS P FROM orders GROUP BY 1")
def unstack_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.median("o_totalprice"), 4))


@register("value_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@register("densify_counts", "WITH g AS (SELECT * FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type FROM events)) SELECT g.user_id, g.event_type, count(e.event_id) AS n FROM g LEFT JOIN events e USING (user_id, event_type) GROUP BY 1, 2")
def densify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.densify_counts(read(spark, sf_dir, "events"), "user_id", "event_type")


@register("cv_by_key", "SELECT l_suppkey, round(stddev_samp(l_quantity) / nullif(avg(l_quantity), 0) * 100, 6) AS cv FROM lineitem GROUP BY 1 HAVING count(DISTINCT year(l_shipdate)) >= 3 AND stddev_samp(l_quantity) IS NOT NULL")
def cv_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded6(P.variation(read(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate")), "l_suppkey", "l_quantity"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i:]))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded6(P.correlations(read(spark, sf_dir, "lineitem"), _COLS))


@register("null_profile", f"WITH {M} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, round(count(*) FILTER ({c} IS NULL) / count(*) * 100, 6) AS percent FROM m" for c in ("parcel_id", "year", "month", "v", "w")))
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded6(P.null_profile(monthly(spark, sf_dir)))


@register("column_profile", "SELECT 's_suppkey' AS \"column\", CAST(min(s_suppkey) AS DOUBLE) AS min, CAST(max(s_suppkey) AS DOUBLE) AS max, CAST(NULL AS BIGINT) AS n_unique, count(*) AS rows FROM supplier UNION ALL SELECT 's_name', NULL, NULL, count(DISTINCT s_name), count(*) FROM supplier UNION ALL SELECT 's_acctbal', min(s_acctbal), max(s_acctbal), NULL, count(*) FROM supplier")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.column_profile(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"))


@register("units", "SELECT s AS name, CASE s WHEN 'VV_mean' THEN 'dB' WHEN 'NDVI_p90' THEN 'dimensionless' WHEN 'LST_C' THEN 'K' WHEN 'time' THEN 'date' ELSE 'unknown' END AS unit FROM (SELECT unnest(['VV_mean', 'NDVI_p90', 'LST_C', 'time', 'parcel_id']) AS s)")
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in ("VV_mean", "NDVI_p90", "LST_C", "time", "parcel_id")], "name string")
    return names.withColumn("unit", unit_column(F.col("name")))


@register("histogram", "WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(29, floor((l_extendedprice - lo) * 30 / (hi - lo))) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice", 30)


@register("log_histogram", "WITH v AS (SELECT log10(o_totalprice) AS x FROM orders WHERE o_totalprice > 0), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v) SELECT CAST(least(19, floor((x - lo) * 20 / (hi - lo))) AS INTEGER) AS bin, count(*) AS n FROM v, e GROUP BY 1")
def log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.histogram(read(spark, sf_dir, "orders").where("o_totalprice > 0").select(F.log10("o_totalprice").alias("x")), "x", 20)


@register("ecdf", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) / CAST(count(*) OVER () AS DOUBLE) AS share FROM orders")
def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ecdf(read(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"]).select("o_orderkey", "share")


@register("boxplot_stats", "SELECT event_type, min(value) AS lo, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS hi FROM events GROUP BY 1")
def boxplot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.box(read(spark, sf_dir, "events"), ["event_type"], "value").withColumns({c: F.round(c, 6) for c in ("q1", "q2", "q3")})


@register("describe", "SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.05), 4) AS p5, round(median(o_totalprice), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, max(o_totalprice) AS max FROM orders")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded6(P.describe(read(spark, sf_dir, "orders"), "o_totalprice", (0.05, 0.5, 0.95)), 4)


@register("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@register("threshold_counts", "SELECT count(*) FILTER (o_totalprice > 200000) AS high, count(*) FILTER (o_totalprice < 1000) AS low, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders")
def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").agg(F.count_if(F.col("o_totalprice") > 200000).alias("high"), F.count_if(F.col("o_totalprice") < 1000).alias("low"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))


@register("batch_slice", "SELECT s_suppkey, CAST(ntile(7) OVER (ORDER BY s_suppkey) AS INTEGER) AS batch FROM supplier")
def batch_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batch(read(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], 7)


@register("evenly_spaced", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM r WHERE r IN (0, floor(1 * (n - 1) / 3.0), floor(2 * (n - 1) / 3.0), n - 1)")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evenly_spaced(read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["ts", "event_id"], 4, ["user_id"]).select("user_id", "event_id")


@register("array_tasks", "SELECT s_suppkey, sensor, CAST(3 * (row_number() OVER (ORDER BY s_suppkey, i) - 1) // 3 AS BIGINT) AS task_id FROM supplier, (VALUES (0, 'S1'), (1, 'S2'), (2, 'S3')) t(i, sensor)")
def array_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.array_tasks(read(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], ["S1", "S2", "S3"]).select("s_suppkey", "sensor", F.col("task_id").cast("long").alias("task_id"))


@register("first_rows", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_rows(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@register("nearest_time", "SELECT o_custkey, first(o_orderkey ORDER BY abs(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-06-01')), o_orderdate, o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def nearest_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest_time(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", F.lit("1998-06-01"), ["o_orderkey"]).select("o_custkey", "o_orderkey")


@register("date_window", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-06-01' GROUP BY 1")
def date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1997-03-01' AND o_orderdate < TIMESTAMP_NTZ '1997-06-01'").groupBy("o_custkey").agg(F.count("*").alias("n"))


@register("month_windows", "SELECT n_nationkey, CAST(d AS DATE) AS date_from, CAST(last_day(d) AS DATE) AS date_to FROM nation, (SELECT unnest(generate_series(DATE '2021-01-01', DATE '2022-12-01', INTERVAL 1 MONTH)) AS d)")
def month_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", R.literal_list(F.lit("[2022, 2021]")).alias("years"))
    return pipelines.month_windows(n).drop("years")


@register("acquisition_tasks", "SELECT n_nationkey, sensor, CAST(d AS DATE) AS date_from, CAST(last_day(d) AS DATE) AS date_to FROM nation, (SELECT unnest(['S1', 'S2']) AS sensor), (SELECT unnest(generate_series(DATE '2021-01-01', DATE '2021-12-01', INTERVAL 1 MONTH)) AS d)")
def acquisition_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.array(F.lit(2021)).alias("years"))
    return pipelines.acquisition_tasks(n, ["S1", "S2"]).drop("years")


@register("split_range", "WITH r AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1), w AS (SELECT *, CAST(i AS INTEGER) AS win, CAST(floor((date_diff('day', a, b) + 1) / 4.0) AS INTEGER) AS s FROM r, (SELECT unnest(range(0, 4)) AS i)) SELECT o_custkey, win AS \"window\", CAST(a + win * s AS DATE) AS date_from, CASE WHEN win = 3 THEN b ELSE CAST(a + (win + 1) * s - 1 AS DATE) END AS date_to FROM w")
def split_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return pipelines.split_range(r, "a", "b", 4).drop("a", "b")


@register("split_temporal", "SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1998 THEN 'train' WHEN year(o_orderdate) = 1998 THEN 'val' WHEN year(o_orderdate) = 1999 THEN 'test' END AS split FROM orders")
def split_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", R.split_by_year(F.year("o_orderdate"), 1998, 1999).alias("split"))


@register("split_hash", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders), t AS (SELECT *, CAST(ceil(n * 0.2) AS BIGINT) AS a FROM r) SELECT o_orderkey, CASE WHEN r <= a THEN 'test' WHEN r <= a + CAST(ceil((n - a) * 0.2) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM t")
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split_by_hash(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@register("sample_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY md5('42|' || o_custkey), o_custkey LIMIT 100)")
def sample_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample_keys(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 100)


@register("sample_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 50")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample_rows(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 50, seed=7)


_ERR = "e AS (SELECT c_mktsegment AS variety, o_totalprice AS gt, o_totalprice * 0.9 + o_custkey AS p FROM orders JOIN customer ON c_custkey = o_custkey)"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return o.select(F.col("c_mktsegment").alias("variety"), F.col("o_totalprice").alias("gt_y"), (F.col("o_totalprice") * 0.9 + F.col("o_custkey")).alias("predicted_y"))


@register("reg_metrics", f"WITH {_ERR} SELECT round(avg(abs(gt - p)), 3) AS mae, round(sqrt(avg((gt - p) * (gt - p))), 3) AS rmse, round(1 - sum((gt - p) * (gt - p)) / (var_pop(gt) * count(*)), 6) AS r2, round(avg(abs(gt - p) / greatest(abs(gt), 2.220446049250313e-16)), 6) AS mape, round(avg(CAST(abs(p - gt) / CASE WHEN gt = 0 THEN 1 ELSE gt END <= 0.10 AS INTEGER)), 6) AS within_10 FROM e")
def reg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ml.metrics(_predicted(spark, sf_dir), "y")
    return out.select(F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), *[F.round(c, 6).alias(c) for c in ("r2", "mape", "within_10")])


@register("error_by_group", f"WITH {_ERR}, d AS (SELECT variety, round_even(p - gt, 4) AS error, round_even(abs(p - gt) / nullif(gt, 0) * 100, 4) AS pct FROM e) SELECT variety, count(*) AS n, round(round_even(avg(abs(error)), 3), 2) AS mae, round(round_even(avg(error), 3), 2) AS me, round(round_even(sqrt(avg(error * error)), 3), 2) AS rmse, round(round_even(avg(pct), 3), 2) AS mape FROM d GROUP BY 1")
def error_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = variety_errors(ml.with_errors(_predicted(spark, sf_dir), "y"))
    return out.withColumns({c: F.round(c, 2) for c in ("mae", "me", "rmse", "mape")})


@register("status_rollup", "WITH s AS (SELECT user_id, count(*) FILTER (event_id % 3 = 0) AS succeeded, count(*) AS total FROM events GROUP BY 1, event_type) SELECT user_id, CAST(sum(succeeded) AS BIGINT) AS succeeded, CAST(sum(total - succeeded) AS BIGINT) AS failed, CAST(sum(total) AS BIGINT) AS total, CASE WHEN sum(succeeded) = sum(total) THEN 'completed' WHEN sum(succeeded) > 0 THEN 'partial' ELSE 'failed' END AS status FROM s GROUP BY 1")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.status_rollup(read(spark, sf_dir, "events").withColumn("exit_code", (F.col("event_id") % 3).cast("int")), ["user_id"])


@register("log_progress", "SELECT user_id AS file, CASE WHEN count(*) FILTER (lower(event_type) LIKE '%purchase%') > 0 THEN 'failed' WHEN count(*) FILTER (lower(event_type) LIKE '%view%') > 0 THEN 'done' ELSE 'running' END AS status FROM events GROUP BY 1")
def log_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.when(F.col("event_type").contains("purchase"), "FAILED").when(F.col("event_type").contains("view"), "Done").otherwise("...").alias("value"))
    return P.log_progress(lines)


@register("quality_json", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def quality_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", readers.json_path(F.col("props"), "k").cast("long").alias("k"))


@register("processed_scan", "SELECT user_id, ts AS time, CAST(year(ts) AS INTEGER) AS year, CAST(dayofyear(ts) AS INTEGER) AS doy, value FROM events WHERE event_id % 4 <> 0")
def processed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 4 == 0, "never").otherwise(F.col("ts").cast("string")).alias("time"), F.col("value").cast("string").alias("value"))
    return readers.read_processed(e, "user_id", "time", ["value"]).withColumn("time", F.col("time").cast("timestamp_ntz"))


@register("band_prefix", "SELECT page_id, string_split(regexp_replace('B0' || (page_id % 9) || '_S2A_' || url, '_(S[123][AB]_|granule_|ERA5L_|__tmp_)', chr(1)), chr(1))[1] AS band FROM pages")
def band_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", readers.band_prefix(F.concat(F.lit("B0"), F.col("page_id") % 9, F.lit("_S2A_"), F.col("url"))).alias("band"))


@register("scene_bands", "WITH b AS (SELECT user_id AS scene_id, list_sort(list(DISTINCT 'B0' || CAST(value AS BIGINT) % 9)) AS bands FROM events GROUP BY 1) SELECT scene_id, array_to_string(CASE WHEN list_has_all(bands, ['B02', 'B03', 'B04']) THEN list_concat(['RGB'], bands) ELSE bands END, ',') AS bands FROM b")
def scene_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("scene_id"), F.concat(F.lit("B0"), F.rint("value").cast("bigint") % 9).alias("band"))
    return readers.bands_of(e).select("scene_id", F.array_join("bands", ",").alias("bands"))


@register("code_names", "SELECT c_custkey, CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS name FROM customer")
def code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", R.code_names(F.col("c_nationkey"), {1: "one", 2: "two"}).alias("name"))


@register("scalars", """SELECT l_orderkey, l_linenumber, least(greatest(l_extendedprice, -100), 20000) AS clipped, round_even(l_tax * 1000 / 7, 4) AS even, round(log10(l_extendedprice), 6) AS log10, round(ln(l_extendedprice), 6) AS log, round(exp(l_tax), 6) AS exp, CAST(dayofyear(l_shipdate) AS INTEGER) AS doy, CAST(last_day(l_shipdate) AS DATE) AS month_end,
 round((l_extendedprice - l_quantity) / nullif(l_quantity, 0) * 100, 4) AS diff_pct, l_discount / nullif(l_tax, 0) AS ratio, CASE WHEN l_tax = 0 THEN 1 ELSE l_tax END AS guarded, strftime(l_shipdate, '%d %b') AS label, regexp_extract('m' || l_partkey, '(\\d+)', 1) AS digits FROM lineitem""")
def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    price, tax = c("l_extendedprice"), c("l_tax")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.least(F.greatest(price, F.lit(-100)), F.lit(20000)).alias("clipped"), F.bround(tax * 1000 / 7, 4).alias("even"), F.round(F.log10(price), 6).alias("log10"), F.round(F.ln(price), 6).alias("log"),
        F.round(F.exp(tax), 6).alias("exp"), F.dayofyear("l_shipdate").alias("doy"), F.last_day("l_shipdate").alias("month_end"), F.round(R.difference_percent(price, c("l_quantity")), 4).alias("diff_pct"),
        R.ratio(c("l_discount"), tax).alias("ratio"), F.when(tax == 0, 1).otherwise(tax).alias("guarded"), F.date_format("l_shipdate", "dd MMM").alias("label"), F.regexp_extract(F.concat(F.lit("m"), c("l_partkey")), r"(\d+)", 1).alias("digits"),
    )


@register("arrays", "SELECT c_custkey, len(a) AS n, array_to_string(CASE WHEN len(list_distinct(a)) = 1 THEN a[1:1] ELSE a END, ',') AS collapsed FROM (SELECT c_custkey, [c_nationkey, CAST(c_custkey % 25 AS INTEGER)] AS a FROM customer)")
def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array(F.col("c_nationkey"), (F.col("c_custkey") % 25).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.size(a).cast("long").alias("n"), F.array_join(F.when(F.size(F.array_distinct(a)) == 1, F.slice(a, 1, 1)).otherwise(a).cast("array<string>"), ",").alias("collapsed"))


@register("names_normalised", "SELECT page_id, trim(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM pages")
def names_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim("url")), "[^a-z0-9]", "_"), "_+", "_")
    return read(spark, sf_dir, "pages").select("page_id", F.trim(plain, F.lit("_")).alias("name"))


@register("union_by_name", "SELECT s_suppkey AS id, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS balance")
    return s.unionByName(read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance", "c_mktsegment AS segment"), allowMissingColumns=True)


@register("monthly_totals", "WITH s AS (SELECT l_suppkey AS parcel_id, l_shipdate AS t, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2) SELECT parcel_id, CAST(year(t) AS INTEGER) AS year, CAST(month(t) AS INTEGER) AS month, round(sum(m), 6) AS total FROM s GROUP BY 1, 2, 3")
def monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "parcel_id").withColumn("year", F.year("l_shipdate"))
    return rounded6(P.monthly_totals(s, ["parcel_id", "year"], "l_shipdate", "l_discount"))


@register("yearly_targets", "WITH s AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(avg(l_discount), 6) AS mean, min(l_discount) AS min, max(l_discount) AS max, count(l_discount) AS n, round(sum(l_quantity), 2) AS n_samples FROM lineitem GROUP BY 1), t AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, max(o_totalprice) AS target FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT s.*, target FROM s LEFT JOIN t USING (year)")
def yearly_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.year("o_orderdate").alias("year")).agg(F.max("o_totalprice").alias("target"))
    return P.with_targets(processed_yearly(spark, sf_dir), targets)


@register("book_join", "SELECT c_custkey, c_nationkey, s_suppkey, s_name FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey")
def book_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = read(spark, sf_dir, "supplier").selectExpr("s_nationkey AS c_nationkey", "s_suppkey", "s_name")
    return R.with_book(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), book, "c_nationkey")


@register("processed_yearly", "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(avg(l_discount), 6) AS mean, min(l_discount) AS min, max(l_discount) AS max, count(l_discount) AS n, round(sum(l_quantity), 2) AS n_samples FROM lineitem GROUP BY 1")
def processed_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.yearly_values(read(spark, sf_dir, "lineitem"), "l_shipdate", "l_discount", "l_quantity").withColumns({"mean": F.round("mean", 6), "n_samples": F.round("n_samples", 2)})


@register("timestep_stats", "SELECT l_shipdate AS time, min(l_tax) AS min, max(l_tax) AS max, round(avg(l_tax), 6) AS mean, round(stddev_pop(l_tax), 6) AS std FROM (SELECT l_shipdate, nullif(l_tax, 0) AS l_tax FROM lineitem) GROUP BY 1 HAVING count(l_tax) > 0")
def timestep_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_shipdate", F.nullif(F.col("l_tax"), F.lit(0.0)).alias("v"))
    return P.timestep_values(rows, "l_shipdate", "v").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@register("dry_run", "SELECT count(*) FILTER (y < 1998) AS n_train, count(*) FILTER (y = 1998) AS n_val, count(*) FILTER (y = 1999) AS n_test, count(*) FILTER (y <= 1998 AND v IS NULL) AS nulls_v, 'v' AS targets, 'absent' AS missing_targets FROM (SELECT year(l_shipdate) AS y, nullif(l_tax, 0) AS v FROM lineitem)")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(R.split_by_year(F.year("l_shipdate"), 1998, 1999).alias("split"), F.nullif(F.col("l_tax"), F.lit(0.0)).alias("v"))
    return ml.dry_run(rows, ["v"], ["v", "absent"])


@register("group_quantiles", "SELECT l_suppkey AS parcel_id, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS {n}" for n, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))) + " FROM lineitem GROUP BY 1")
def group_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("parcel_id"), "l_extendedprice")
    return rounded(quantiles_by(rows, ["parcel_id"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95}), 6)


@register("density", """WITH e AS (SELECT l_returnflag AS flag, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS n, stddev_samp(l_extendedprice) * pow(count(*), -0.2) AS h FROM lineitem GROUP BY 1),
g AS (SELECT flag, n, h, low - 3 * h AS start, (high - low + 6 * h) / 63 AS step FROM e), b AS (SELECT flag, n, h, start, step, (l_extendedprice - start) / step AS place FROM lineitem JOIN g ON flag = l_returnflag),
w AS (SELECT flag, n, h, start, step, floor(place) AS i, sum(1 - (place - floor(place))) AS w FROM b GROUP BY ALL UNION ALL SELECT flag, n, h, start, step, floor(place) + 1, sum(place - floor(place)) FROM b GROUP BY ALL)
SELECT flag, CAST(point AS INTEGER) AS point, round(start + point * step, 4) AS x, round(1e6 * sum(w * exp(-0.5 * pow((i - point) * step / h, 2))) / (sqrt(2 * pi()) * h * n), 6) AS density
FROM w, (SELECT unnest(range(0, 64)) AS point) GROUP BY flag, point, start, step, h, n""")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of prices in millionths."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return P.density(rows, ["flag"], "l_extendedprice", points=64).select("flag", "point", F.round("x", 4).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density"))


@register("incomplete_rows", "SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN tax IS NULL THEN 'tax' END, CASE WHEN discount IS NULL THEN 'discount' END) AS missing FROM (SELECT l_orderkey, l_linenumber, nullif(l_tax, 0) AS tax, nullif(l_discount, 0) AS discount FROM lineitem) WHERE tax IS NULL OR discount IS NULL")
def incomplete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "nullif(l_tax, 0) AS tax", "nullif(l_discount, 0) AS discount")
    return R.incomplete(rows, ["l_orderkey", "l_linenumber"], ["tax", "discount"]).withColumn("missing", F.array_join("missing", ","))


@register("suspicious_areas", "SELECT c_custkey, round((c_acctbal - 5000) / 50, 6) AS percent FROM customer WHERE abs((c_acctbal - 5000) / 50) > 20 ORDER BY (c_acctbal - 5000) / 50, c_custkey LIMIT 20")
def suspicious_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the twenty keys that fall short of 5,000 most: balances as areas."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_acctbal") - 5000) / 50).alias("percent"))
    return rounded(R.beyond(rows, "percent", 20.0, ["percent", "c_custkey"], 20), 6)
