"""Micro fixtures with values worked out by hand."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from parcelcube.functions import bands as B
from parcelcube.functions import geometry as G
from parcelcube.functions import raster as V
from parcelcube.functions.indices import Calculator, compute_indices, index, resolve
from parcelcube.operators import features as X
from parcelcube.operators import ml
from parcelcube.operators import profile as P
from parcelcube.operators import relational as R
from parcelcube.operators import spatial as S
from parcelcube.operators import temporal as T
from parcelcube.plans import pipelines
from parcelcube.plans.config import DatasetConfig, FeaturesConfig, RunConfig, Sensor, Temporal
from parcelcube.sources import readers, sinks
from parcelcube.streaming.buckets import stream_months

DATES = [date(2021, 7, 1), date(2021, 7, 10), date(2021, 7, 20), date(2021, 8, 5), date(2021, 8, 15), date(2021, 9, 10)]
CURVE = [0.20, 0.35, 0.60, 0.80, 0.80, 0.50, 0.30, 0.15]


def series(spark, values=CURVE, start=3, parcel="p", year=2021):
    return spark.createDataFrame([(parcel, year, start + i, v) for i, v in enumerate(values)], "parcel_id string, year int, month int, v double")


def one(df):
    return df.first().asDict()


def test_resample_and_rolling(spark):
    df = spark.createDataFrame([("P1", d, float(i + 1)) for i, d in enumerate(DATES)], "parcel_id string, time date, v double")
    monthly = T.resample(df, ["parcel_id"], ["v"], "ME", "median").orderBy("bucket")
    assert [r["v"] for r in monthly.collect()] == [2.0, 4.5, 6.0]
    assert monthly.first()["bucket"] == date(2021, 7, 31)
    assert [r["v"] for r in T.rolling_trailing(monthly, ["parcel_id"], ["v"], 2).orderBy("bucket").collect()] == [2.0, 3.25, 5.25]
    daily = T.rolling_trailing(df, ["parcel_id"], ["v"], 3, order="time").orderBy("time")
    assert [r["v"] for r in daily.collect()] == [1, 1.5, 2, 3, 4, 5]


def test_resample_gap_is_a_null_row_and_empty_sum_is_zero(spark):
    df = spark.createDataFrame([("P", date(2021, 1, 15), 1.0), ("P", date(2021, 3, 10), None)], "parcel_id string, time date, v double")
    assert [(r["bucket"], r["v"]) for r in T.resample(df, ["parcel_id"], ["v"], "ME", "sum", densify=True).orderBy("bucket").collect()] == [(date(2021, 1, 31), 1.0), (date(2021, 2, 28), None), (date(2021, 3, 31), 0.0)]
    with pytest.raises(ValueError):
        T.resample(df, ["parcel_id"], ["v"], "7D")
    with pytest.raises(ValueError):
        T.resample(df, ["parcel_id"], ["v"], "ME", "mode")


def test_centred_window_stays_in_its_year(spark):
    rows = [(2020, 11, 2.0), (2020, 12, 4.0), (2021, 1, 10.0), (2021, 2, 20.0)]
    df = spark.createDataFrame([("p", date(y, m, 1), v) for y, m, v in rows], "parcel_id string, bucket date, v double")
    assert [r["v"] for r in T.rolling_centered(df, ["parcel_id"], ["v"], 2).orderBy("bucket").collect()] == [2, 3, 10, 15]


def test_spatial_stats(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0, 8.0, None)] + [("b", None)], "k string, v double")
    got = {r["k"]: r for r in S.spatial_stats(df, ["k"], ["v"], list(S.STATS)).collect()}
    a = got["a"]
    assert (a["v_mean"], a["v_median"], a["v_p25"], a["v_p75"], a["v_min"], a["v_max"]) == (3.75, 3, 1.75, 5, 1, 8)
    assert a["v_std"] == pytest.approx(2.680951, abs=1e-6) and a["v_p90"] == pytest.approx(6.8)
    assert all(got["b"][f"v_{s}"] is None for s in S.STATS)
    with pytest.raises(ValueError):
        S.stat_columns(["v"], ["mode"])


def test_fuse_takes_first_value_by_order(spark):
    df = spark.createDataFrame([("p", 1, 0, None, 5.0), ("p", 1, 1, 2.0, 6.0), ("p", 1, 2, 3.0, None)], "k string, m int, r int, a double, b double")
    assert one(S.fuse(df, ["k", "m"], ["a", "b"], ["r"])) == {"k": "p", "m": 1, "a": 2.0, "b": 5.0}


def test_indices(spark):
    df = spark.createDataFrame([(0.5, 0.1, 0.1, 0.02), (0.0, 0.0, 0.0, 0.0)], "B08 double, B04 double, VV double, VH double")
    a, b = df.select(*[index(n).alias(n) for n in ("NDVI", "SAVI", "EVI2", "RVI", "VH_VV", "DpRVI")]).collect()
    assert [round(x, 6) for x in a] == [0.666667, 0.545455, 0.574713, 0.666667, 0.2, 0.111111]
    assert b["NDVI"] is None and b["RVI"] is None and b["VH_VV"] is None
    with pytest.raises(ValueError, match="NBR2"):
        resolve(["NBR2"])
    assert resolve(["own"], [Calculator("own", ("B08",), lambda c: c)])[0].name == "own"


def test_ireci_with_zero_denominators(spark):
    df = spark.createDataFrame([(0.5, 0.1, 0.2, 0.0), (0.5, 0.1, 0.0, 0.3), (0.5, 0.1, 0.2, 0.4)], "B07 double, B04 double, B05 double, B06 double")
    assert [None if r[0] is None else round(r[0], 6) for r in df.select(index("IRECI")).collect()] == [0.0, None, 0.8]


def test_compute_indices_keeps_native_values_per_cube(spark):
    df = spark.createDataFrame([("a", "s", 0.5, 0.1, 0.9), ("a", "s", 0.5, 0.1, None), ("b", "s", 0.5, 0.1, None)], "parcel_id string, sensor string, B08 double, B04 double, NDVI double")
    got = compute_indices(df, ["NDVI", "NDRE"]).orderBy("parcel_id", F.desc_nulls_last("NDVI")).collect()
    assert [None if r["NDVI"] is None else round(r["NDVI"], 4) for r in got] == [0.9, None, 0.6667] and "NDRE" not in got[0].asDict()


def test_bands(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "v double")
    assert [r[0] for r in df.select(B.finite(F.col("v"))).collect()] == [None, None, 1.0, None]
    assert spark.range(1).select(B.decibel(F.lit(0.0))).first()[0] == -100.0
    cubes = spark.createDataFrame([("a", "s", 1.0), ("a", "s", 0.5), ("b", "s", 20000.0), ("b", "s", None)], "parcel_id string, sensor string, v double")
    assert [(r["parcel_id"], r["v"]) for r in B.scale_reflectance(cubes, ["v"]).orderBy("parcel_id", F.desc_nulls_last("v")).collect()] == [("a", 1.0), ("a", 0.5), ("b", 1.0), ("b", None)]


def test_speckle_repeats_the_edge(spark):
    df = spark.createDataFrame([("p", "s", 1, 0, x, float(v)) for x, v in enumerate([1, 9, 3])], "parcel_id string, sensor string, time int, y int, x int, v double")
    assert [r["v"] for r in B.speckle_median(df, ["v"]).orderBy("x").collect()] == [1.0, 3.0, 3.0]


def test_speckle_on_a_sparse_grid(spark):
    """A neighbour without a row is no neighbour: the pixel itself stands in, not the next row there is."""
    df = spark.createDataFrame([("p", "s", 1, 0, x, float(v)) for x, v in ((0, 1), (1, 9), (5, 100), (9, 7))], "parcel_id string, sensor string, time int, y int, x int, v double")
    assert {r["x"]: r["v"] for r in B.speckle_median(df, ["v"]).collect()} == {0: 1.0, 1: 9.0, 5: 100.0, 9: 7.0}


def test_fuse_sums_samples_and_nearest_time(spark):
    df = spark.createDataFrame([("p", 1, None, 3), ("p", 2, 5.0, 4), ("q", 1, 1.0, None)], "k string, r int, a double, n_samples int")
    assert {r["k"]: (r["a"], r["n_samples"]) for r in S.fuse(df, ["k"], ["a", "n_samples"], ["r"], totals=["n_samples"]).collect()} == {"p": (5.0, 7), "q": (1.0, None)}
    times = spark.createDataFrame([("p", "2020-01-01", 1), ("p", "2020-01-09", 2), ("p", None, 3), ("q", None, 4)], "k string, t string, v int").withColumn("t", F.to_timestamp("t"))
    got = S.nearest_time(times, ["k"], "t", F.lit("2020-01-05"), ["v"]).collect()
    assert [(r["k"], r["v"]) for r in got] == [("p", 1)]


def test_samples_repeat_and_cover(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 10)
    assert R.sample_rows(df, ["id"], 7).count() == 7 and R.sample_rows(df, ["id"], 700).count() == 100
    assert {r["id"] for r in R.sample_rows(df, ["id"], 7).collect()} == {r["id"] for r in R.sample_rows(df.repartition(3), ["id"], 7).collect()}
    assert R.sample_keys(df, "k", 3).groupBy("k").count().where("count = 10").count() == 3


def test_season_metrics(spark):
    got = one(X.season_metrics(series(spark), ["v"]))
    expected = {"POS": 6, "AOS": 0.615, "SOS": 4, "EOS": 9, "LOS": 5, "ROG": 0.25, "ROS": -0.30, "integral": 3.35}
    assert {k: pytest.approx(v) for k, v in expected.items()} == {k: got[f"v_{k}"] for k in expected}


@pytest.mark.parametrize(("values", "pos", "sos", "eos", "rog", "ros"), [([0.9, 0.5, 0.1], 3, None, 5, None, -0.4), ([0.1, 0.5, 0.9], 5, 4, None, 0.4, None), ([0.1, None, 0.2], None, None, None, None, None), ([None] * 4, None, None, None, None, None)])
def test_season_edges(spark, values, pos, sos, eos, rog, ros):
    got = one(X.season_metrics(series(spark, values), ["v"]))
    assert (got["v_POS"], got["v_SOS"], got["v_EOS"]) == (pos, sos, eos)
    assert (got["v_ROG"], got["v_ROS"]) == (rog if rog is None else pytest.approx(rog), ros if ros is None else pytest.approx(ros))


def test_season_against_plain_python(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(str(p), 2020, m, float(round(rng.random(), 3)) if rng.random() > 0.2 else None) for p in range(40) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "parcel_id string, year int, month int, v double")
    got = {r["parcel_id"]: r for r in X.season_metrics(df, ["v"]).collect()}
    for p in range(40):
        s = [(m, v) for q, _, m, v in rows if q == str(p) and v is not None]
        m, v = np.array([a for a, _ in s]), np.array([b for _, b in s])
        pos, base = int(v.argmax()), np.percentile(v, 10)
        least = base + 0.2 * (v.max() - base)
        up, down = [i for i in range(pos) if v[i] >= least], [i for i in range(pos, len(v)) if v[i] < least]
        assert got[str(p)]["v_POS"] == m[pos] and got[str(p)]["v_SOS"] == (m[up[0]] if up else None) and got[str(p)]["v_EOS"] == (m[down[0]] if down else None)
        if up and down:
            assert got[str(p)]["v_integral"] == pytest.approx(v[(m >= m[up[0]]) & (m <= m[down[0]])].sum())


def test_phase_features(spark):
    got = one(series(spark).groupBy(*X.K).agg(*X.phase_aggregates(["v"]), *X.phase_deltas(["v"]), *X.phase_integrals(["v"]), *X.peak(["v"]), *X.boolean_flags(["v"]), *X.monthly_pivot(["v"])))
    means = {"dormancy": None, "budbreak": 0.275, "flowering": 0.70, "veraison": 0.65, "harvest": 0.40, "postharvest": 0.15}
    assert {p: got[f"v_{p}_mean"] for p in means} == {p: v if v is None else pytest.approx(v) for p, v in means.items()}
    assert got["v_dormancy_to_budbreak_delta"] is None and got["v_budbreak_to_flowering_delta"] == pytest.approx(0.425) and got["v_veraison_to_harvest_delta"] == pytest.approx(-0.25)
    assert got["v_flowering_integral"] == pytest.approx(0.70) and got["v_veraison_integral"] == pytest.approx(0.65)
    assert (got["v_peak"], got["v_peak_month"]) == (0.80, 6)
    assert [got[f"v_{f}"] for f in ("early_peak", "peak_in_veraison", "stress_flowering", "harvest_drop", "veraison_dominant")] == [1, 0, 0, 1, 0]
    assert got["v_m3"] == 0.20 and "v_m10" not in got
    assert [c._jc.toString() for c in X.phase_aggregates(["v"], strict=True)] == []


def test_flags_without_values_are_null(spark):
    got = one(series(spark, [None, None]).groupBy(*X.K).agg(*X.boolean_flags(["v"])))
    assert set(got.values()) == {"p", 2021, None}


def test_deltas_interpolation_and_trapezoid(spark):
    got = X.temporal_deltas(series(spark), ["v"]).orderBy("month").collect()
    assert [None if r["v_delta"] is None else round(r["v_delta"], 2) for r in got] == [None, 0.15, 0.25, 0.20, 0.0, -0.30, -0.20, -0.15]
    filled = S.interpolate(series(spark, [1.0, None, 9.0, None]), X.K, ["v"])
    assert [r["v"] for r in filled.orderBy("month").collect()] == [1, 5, 9, 9]
    assert one(filled.groupBy(*X.K).agg(*X.phase_integrals(["v"], ["all"], {"all": range(1, 13)})))["v_all_integral"] == 19
    assert one(S.interpolate(series(spark, [None]), X.K, ["v"]))["v"] is None


def test_harvest(spark):
    df = series(spark).withColumn("time", F.last_day(F.make_date("year", "month", F.lit(1)))).withColumn("harvest_date", F.lit(date(2021, 9, 7)))
    got = one(X.harvest_features(df, ["v"]))
    assert (got["harvest_doy"], got["harvest_month"], got["v_at_harvest"], got["v_pre_harvest_30d_mean"]) == (250, 9, 0.50, 0.50)
    assert got["v_pre_harvest_60d_mean"] == pytest.approx(0.65) and got["v_peak_to_harvest_delta"] == pytest.approx(0.30) and got["v_peak_to_harvest_months"] == 3
    assert X.harvest_features(df.withColumn("harvest_date", F.lit(None).cast("date")), ["v"]).count() == 0


def test_static_and_sparse_columns(spark):
    df = spark.createDataFrame([(1, 2020, "b", True, 2000), (2, 2020, None, False, None), (3, 2020, "a", None, 1990), (4, 2020, "b", True, 2020)], "parcel_id int, year int, variety string, rainfed boolean, planting_date int")
    got = X.static_features(df).orderBy("parcel_id").collect()
    assert [r["variety_enc"] for r in got] == [1, None, 0, 1] and [r["rainfed"] for r in got] == [1, 0, 0, 1] and [r["vine_age"] for r in got] == [20, None, 30, 0]
    wide = spark.createDataFrame([(i, 1.0 if i < 700 else None, 1.0 if i < 699 else None, None) for i in range(1000)], "k int, a double, b double, split string")
    assert X.drop_sparse_columns(wide, 30).columns == ["k", "a", "split"]


def test_merge_targets_multiplies_duplicates(spark):
    targets = spark.createDataFrame([("p", 2021, 1.0, "train"), ("p", 2021, 2.0, "val")], "parcel_id string, year int, y double, split string")
    out = X.merge_targets(series(spark).groupBy(*X.K).agg(F.max("v").alias("v")), targets, ["y", "absent"])
    assert sorted(r["y"] for r in out.collect()) == [1.0, 2.0] and "split" in out.columns


def test_tables(spark):
    assert R.normalise_name("  Año / Nº_Parcela ") == "ano_no_parcela" or R.normalise_name("  Año / Nº_Parcela ").startswith("ano")
    assert spark.range(1).select(R.normalise_ids(F.lit(" L2,L1 "))).first()[0] == "L1,L2"
    assert spark.range(1).select(R.literal_list(F.lit("[2022, 2021]"))).first()[0] == [2021, 2022]
    assert [r["v"] for r in R.round_even(spark.createDataFrame([(2.5,), (3.5,)], "v double"), 0).collect()] == [2, 4]
    sizes = R.batch(spark.range(8), ["id"], 3).groupBy("batch").count().orderBy("batch")
    assert [r["count"] for r in sizes.collect()] == [3, 3, 2]
    assert R.batch(spark.range(2), ["id"], 5, 4).count() == 0
    assert [r["id"] for r in R.evenly_spaced(spark.range(10), ["id"], 4).orderBy("id").collect()] == [0, 3, 6, 9]
    split = R.split_by_hash(spark.range(11), ["id"]).groupBy("split").count()
    assert {r["split"]: r["count"] for r in split.collect()} == {"test": 3, "val": 2, "train": 6}
    assert R.drop_empty_columns(spark.createDataFrame([(1, None)], "a int, b int")).columns == ["a"]
    assert R.feature_columns(spark.createDataFrame([(1, 2, 1.0, True, "x", 3.0)], "parcel_id int, year int, f double, g boolean, s string, y double"), ["y"]) == ["f", "g"]


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), (None, 0.0, 1.0)], "k string, y double, p double")
    rows = {r["column"]: r for r in P.column_profile(df).collect()}
    assert rows["k"]["n_unique"] == 1 and (rows["y"]["min"], rows["y"]["max"]) == (0, 3)
    assert df.agg(P.within("y", "p")).first()[0] == pytest.approx(1 / 3)
    assert [r["n"] for r in P.histogram(spark.createDataFrame([(float(v),) for v in (0, 1, 2, 10)], "v double"), "v", 2).orderBy("bin").collect()] == [3, 1]
    codes = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 2)], "p string, exit_code int")
    assert {r["p"]: r["status"] for r in P.status_rollup(codes, ["p"]).collect()} == {"a": "partial", "b": "completed", "c": "failed"}


def test_geometry(spark):
    row = spark.createDataFrame([("POLYGON ((0 0, 40 0, 40 30, 0 30, 0 0))", None, "LINESTRING (0 0, 1 1)")], "a string, b string, c string")
    got = row.select(G.parse_wkt(F.col("a")).alias("a"), G.parse_wkt(F.col("b")).alias("b"), G.parse_wkt(F.col("c")).alias("c"))
    r = got.select(G.ring_area(F.get("a", F.lit(0))).alias("area"), G.bounds(F.col("a"), 5).alias("box"), G.contains(F.col("a"), F.lit(1.0), F.lit(1.0)).alias("inside"), G.distance_to_edge(F.col("a"), F.lit(50.0), F.lit(10.0)).alias("far"), F.col("b").isNull().alias("b"), F.col("c").isNull().alias("c")).first()
    assert r["area"] == 1200 and tuple(r["box"]) == (-5, -5, 45, 35) and r["inside"] and r["far"] == 10 and r["b"] and r["c"]
    x, y = 150000.0, 5070000.0
    lon, lat = spark.range(1).select(G.to_lon(F.lit(x)), G.to_lat(F.lit(y))).first()
    assert spark.range(1).select(G.to_x(F.lit(lon)), G.to_y(F.lit(lat))).first()[0] == pytest.approx(x)
    east = spark.range(1).select(G.to_utm(F.struct(F.lit(math.radians(3.0) * G.EARTH).alias("x"), F.lit(0.0).alias("y")))).first()[0]
    assert east["x"] == pytest.approx(500000, abs=1e-3) and east["y"] == pytest.approx(0, abs=1e-3)


def test_mask_falls_back_to_the_nearest_pixel(spark):
    cells = spark.createDataFrame([("p", "s", x, y, 100.0 * x, 100.0 * y, 1.0) for x in range(3) for y in range(3)], "parcel_id string, sensor string, x int, y int, x_coord double, y_coord double, v double")
    shape = cells.withColumn("shape", G.parse_wkt(F.lit("POLYGON ((110 90, 112 90, 112 92, 110 92, 110 90))")))
    assert [(r["x"], r["y"]) for r in G.mask(shape, "shape", 1.0, 2.0, bands=("v",)).collect()] == [(1, 1)]


def test_composites(spark):
    black = spark.createDataFrame([(0.0, 0.0, None)], "r double, g double, b double")
    black = V.true_colour(black, F.col("r"), F.col("g"), F.col("b")).first()
    assert tuple(black) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        V.tracking_rvi(spark.createDataFrame([("p", datetime(2021, 3, 1), 0.5)], "p string, time timestamp_ntz, RVI double"), ["p"], "2021-03-01", "2021-06-01")


def test_configs():
    base = Temporal("ME", "median", 2)
    assert Temporal(agg="sum").over(base) == Temporal("ME", "sum", 2) and Temporal(agg="sum").over(base, strict=True).window is None
    config = DatasetConfig.of({"stats": ["mean"], "temporal": {"freq": "ME"}, "sensors": {"sentinel2": {"indices": ["NDVI"], "stats": ["p90"], "mask": False}, "era5": None}})
    assert config.stats_for("sentinel2") == ("p90",) and config.stats_for("era5") == ("mean",) and not config.mask_for("sentinel2") and config.mask_for("era5")
    for bad in (lambda: Temporal("7D"), lambda: Sensor(stats=("mode",)), lambda: Sensor(indices=("NBR2",)), lambda: DatasetConfig.of({"oops": 1}), lambda: FeaturesConfig(("v",), max_null_pct=101), lambda: RunConfig({"S2": {"cloud_cover": 101}}), lambda: RunConfig({"S9": {}})):
        with pytest.raises(ValueError):
            bad()
    assert RunConfig({"S1": {}, "S2": None}).enabled() == {"S1": {"polarizations": ["VV", "VH"]}}


def test_dataset_pipeline(spark):
    rows = [("p", "sentinel2", datetime(2021, m, d), y, x, 10.0 * y, 10.0 * x, 5000.0 + 100 * d, 1000.0) for m in (5, 6) for d in (1, 20) for y in range(2) for x in range(2)]
    cube = spark.createDataFrame(rows, "parcel_id string, sensor string, time timestamp_ntz, y int, x int, y_coord double, x_coord double, B08 double, B04 double")
    era = spark.createDataFrame([("p", "era5", datetime(2021, 5, 3), 0, 0, 0.0, 0.0, 0.25)], "parcel_id string, sensor string, time timestamp_ntz, y int, x int, y_coord double, x_coord double, tp double")
    config = DatasetConfig.of({"temporal": {"freq": "ME", "agg": "median", "window": 2}, "sensors": {"sentinel2": {"indices": ["NDVI"], "output_bands": ["NDVI"]}, "era5": {"indices": ["TP_MM"], "output_bands": ["TP_MM"], "mask": False, "temporal": {"agg": "sum"}}}})
    aoi = spark.createDataFrame([("p", "POLYGON ((-5 -5, 15 -5, 15 15, -5 15, -5 -5))")], "parcel_id string, wkt string").withColumn("shape", G.parse_wkt(F.col("wkt")))
    got = {r["month"]: r for r in pipelines.dataset({"sentinel2": cube, "era5": era}, config, aoi).collect()}
    assert got[5]["NDVI"] == pytest.approx((0.605 - 0.1) / 0.705) and got[5]["TP_MM"] == pytest.approx(20.0) and got[6]["TP_MM"] is None


def test_feature_and_training_pipelines(spark):
    rows = [(f"p{k}", y, m, (m % 7) / 10 + k / 100) for k in range(12) for y in (2020, 2021, 2022) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "parcel_id string, year int, month int, v double")
    targets = spark.createDataFrame([(f"p{k}", y, 1.0 + k + y - 2020, {2020: "train", 2021: "val", 2022: "test"}[y]) for k in range(12) for y in (2020, 2021, 2022)], "parcel_id string, year int, yield double, split string")
    table = pipelines.features(df, targets, FeaturesConfig(("v",), ("yield",), interpolate=True, monthly=True, phase_aggs=("mean",), peak=True, season=True, flags=True, max_null_pct=50, integrals={"flowering": (4, 5, 6)}))
    assert table.count() == 36 and {"v_POS", "v_peak", "v_flowering_integral", "split"} <= set(table.columns)
    from parcelcube.plans.config import TrainingConfig

    out = pipelines.training(table.select("parcel_id", "year", "v_peak", "v_m5", "yield", "split"), TrainingConfig(("yield",), {"rf": {"numTrees": 3, "maxDepth": [2, 3], "seed": 1}}))
    result = out["rf", "yield"]
    assert len(result["trials"]) == 2 and set(result["metrics"]) == {"val", "test"} and result["metrics"]["test"]["mae"] >= 0
    no_test = pipelines.training(table.where("split != 'test'").select("parcel_id", "year", "v_peak", "yield", "split"), TrainingConfig(("yield",), {"rf": {"numTrees": 2, "maxDepth": 2, "seed": 1}}))
    assert set(no_test["rf", "yield"]["metrics"]) == {"val"}
    assert ml.param_grid({"b": [1, 2], "a": [3, 4], "c": 5})[1] == {"c": 5, "a": 3, "b": 2}


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", 1.5, [1, 2])], "parcel_id string, VV_mean double, l array<int>")
    path = sinks.export(df.drop("l"), str(tmp_path), "dataset", {"a": 1})
    assert readers.read_csv(spark, path).first()["parcel_id"] == "p"
    assert '"unit": "dB"' in spark.read.text(f"{path}_metadata").first()["value"]
    sinks.export_quoted(df, str(tmp_path / "q"))
    assert readers.read_csv(spark, str(tmp_path / "q")).first()["l"] == "[1,2]"
    assert sinks.unit_of("LST_C") == "K" and sinks.unit_of("LST_C", strict=False) == "°C"
    pixels = spark.createDataFrame([("p", "s", part, datetime(2021, 1, 1), v, 0, 0, 0.0, 0.0, x) for part, v, x in (("1", "B04", 1.0), ("2", "B04", 2.0), ("2", "B08", float("nan")))], readers.PIXELS)
    pixels.write.partitionBy("sensor").parquet(str(tmp_path / "px"))
    got = readers.PixelTable(spark, str(tmp_path / "px")).cube("s", ["B04", "B08"]).first()
    assert got["B04"] == 1.0 and got["B08"] is None
    assert readers.PixelTable(spark, str(tmp_path / "px")).load("none").count() == 0
    parts = readers.read_parts(spark, [str(tmp_path / "px"), str(tmp_path / "px")])
    assert parts.count() == 6
    (tmp_path / "aoi.csv").write_text('﻿parcel_id,geometry,years\np,"POLYGON ((0 0, 1 0, 1 1, 0 0))","[2022, 2021]"\n', encoding="utf-8")
    aoi = readers.read_aoi(spark, str(tmp_path / "aoi.csv")).first()
    assert aoi["years"] == [2021, 2022] and len(aoi["shape"][0]) == 4
    meta = sinks.run_metadata({"a": 1}, {"p": {}}, datetime(2021, 1, 1), datetime(2021, 1, 1, 0, 0, 2))
    assert meta["duration_seconds"] == 2.0 and meta["run_id"] == "20210101_000000"


def test_streaming_months_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([("p", datetime(2021, 1, d), float(d)) for d in (1, 2, 3)] + [("p", datetime(2021, 2, 1), 7.0)], "parcel_id string, time timestamp, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = stream_months(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["parcel_id"], ["v"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("months").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["month"].month, r["v"], r["n"]) for r in spark.table("months").collect()) == [(1, 2.0, 3), (2, 7.0, 1)]


def test_rows_are_numbered_as_a_whole(spark):
    values = [None, 3, 3, None, 7, *range(500), *([5] * 300)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7)
    rows = R.number_rows(df, ["v", "i"]).collect()
    expected = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert {r["i"]: r["__r"] for r in rows} == {i: nth for nth, i in enumerate(expected)}
    assert {r["__rows"] for r in rows} == {len(values)}
    assert R.number_rows(df.limit(0), ["v"]).count() == 0
