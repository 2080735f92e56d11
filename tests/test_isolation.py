"""A broken parcel stops no other, and the report names it."""

from datetime import datetime

from pyspark.sql import functions as F

from parcelcube.functions import geometry as G
from parcelcube.plans.config import DatasetConfig
from parcelcube.plans.pipelines import dataset, isolated_dataset

SCHEMA = "parcel_id string, sensor string, time timestamp_ntz, y int, x int, y_coord double, x_coord double"
CONFIG = DatasetConfig.of({"temporal": {"freq": "ME"}, "sensors": {"sentinel2": {"indices": ["NDVI"], "output_bands": ["NDVI"]}, "era5": {"output_bands": ["tp"], "mask": False}}})


def cubes(spark, parcels):
    def rows(sensor, *values):
        return [(p, sensor, datetime(2021, 5, d), y, x, 10.0 * y, 10.0 * x, *values) for p in parcels for d in (1, 20) for y in range(2) for x in range(2)]

    return {"sentinel2": spark.createDataFrame(rows("sentinel2", 5000.0, 1000.0), f"{SCHEMA}, B08 double, B04 double"), "era5": spark.createDataFrame(rows("era5", 0.25), f"{SCHEMA}, tp double")}


def areas(spark, texts):
    return spark.createDataFrame(list(texts.items()), "parcel_id string, wkt string").select("parcel_id", G.parse_wkt(F.col("wkt")).alias("shape"))


GOOD = "POLYGON ((-5 -5, 15 -5, 15 15, -5 15, -5 -5))"


def test_a_broken_parcel_stops_no_other(spark):
    held = cubes(spark, ["a", "b", "flat", "blank", "torn", "late", "unlisted", "twice"])
    held["sentinel2"] = held["sentinel2"].withColumn("x_coord", F.when((F.col("parcel_id") != "torn") | (F.col("x") > 0), F.col("x_coord"))).where("parcel_id != 'b'")
    held["era5"] = held["era5"].withColumn("time", F.when(F.col("parcel_id") != "late", F.col("time")))
    texts = {p: GOOD for p in ("a", "b", "torn", "late", "absent")} | {"flat": "POLYGON ((0 0, 5 0, 0 0))", "blank": "POLYGON ((0 0, oops, 5 5, 0 0))"}
    aoi = areas(spark, texts).union(areas(spark, {"twice": GOOD})).union(areas(spark, {"twice": GOOD}))
    run = isolated_dataset(held, CONFIG, aoi)
    report = {(r["parcel_id"], r["sensor"]): (r["status"], r["stage"], r["reason"]) for r in run.report.collect()}
    done, missing, skipped = [(s, None, None) for s in ("done", "missing", "skipped")]
    assert report == {
        ("a", "sentinel2"): done, ("a", "era5"): done, ("b", "sentinel2"): missing, ("b", "era5"): done, ("absent", "sentinel2"): missing, ("absent", "era5"): missing,
        ("flat", "sentinel2"): ("failed", "mask", "no area"), ("flat", "era5"): skipped, ("blank", "sentinel2"): ("failed", "mask", "points without coordinates"), ("blank", "era5"): skipped,
        ("torn", "sentinel2"): ("failed", "scan", "4 pixels without a time or a place"), ("torn", "era5"): skipped, ("late", "sentinel2"): done, ("late", "era5"): ("failed", "scan", "8 pixels without a time or a place"),
        ("unlisted", "sentinel2"): ("failed", "mask", "no shape"), ("unlisted", "era5"): skipped, ("twice", "sentinel2"): ("failed", "mask", "more than one shape"), ("twice", "era5"): skipped,
    }
    rows = {r["parcel_id"]: (r["NDVI"] is not None, r["tp"] is not None) for r in run.rows.collect()}
    assert rows == {"a": (True, True), "b": (False, True), "late": (True, False)}
    assert run.counts.get == {"n_rows": 3, "n_parcels": 3}


def test_sound_parcels_are_those_of_the_plain_pipeline(spark):
    held, aoi = cubes(spark, ["a", "b"]), areas(spark, {"a": GOOD, "b": GOOD})
    run = isolated_dataset(held, CONFIG, aoi)
    plain = dataset(held, CONFIG, aoi)
    assert run.rows.columns == plain.columns and sorted(run.rows.collect()) == sorted(plain.collect())
    nothing = isolated_dataset({s: c.limit(0) for s, c in held.items()}, CONFIG, aoi.limit(0))
    assert nothing.report.count() == 0 and nothing.rows.count() == 0
