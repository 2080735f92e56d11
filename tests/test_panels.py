"""Panels: resolution by bands, time picks, values against plain sums; steps and their configurations; the closing of stream windows."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelcube.plans import panels as N
from parcelcube.plans import pipelines
from parcelcube.streaming.buckets import stream_stats

OPTICAL = ["B02", "B03", "B04", "B08"]


def names(columns, extra=()):
    found, unknown = N.resolve_panels(columns, extra)
    return [(p.name, p.kind) for p in found], unknown


def test_panels_follow_the_bands():
    assert names(OPTICAL) == ([("RGB", "optical"), ("NDVI", "index")], [])
    assert names(["VV", "VH"], ["VV", "RVI", "nothing"]) == ([("SAR_RGB", "radar"), ("VV", "decibel"), ("RVI", "index")], ["nothing"])
    assert names(["NDVI"], ["NDVI"]) == ([("NDVI", "band")], [])
    assert names([], ["EVI"]) == ([], ["EVI"])
    assert [p.title for p in N.resolve_panels(["VV", "B11"], ["VV", "B11"])[0]] == ["VV (dB)", "B11"]


@pytest.fixture
def cube(spark):
    days = (1, 5, 9)
    rows = [("p", "s", datetime(2021, 1, d), y, x, 0.1 * d, 0.2, 0.3, 0.4 + x) for d in days for y in (0, 1) for x in (0, 1)]
    rows += [("q", "s", datetime(2021, 1, 3), 0, 0, None, 0.2, 0.3, 0.4), ("q", "s", None, 0, 1, 0.1, 0.2, 0.3, 0.4)]
    return spark.createDataFrame(rows, "parcel_id string, sensor string, time timestamp, y int, x int, B02 double, B03 double, B04 double, B08 double")


def test_time_by_number_and_by_nearest(cube):
    def days(time):
        return {(r["parcel_id"], r["time"].day) for r in N.at_time(cube, time).collect()}

    assert days(0) == {("p", 1), ("q", 3)} and days(1) == {("p", 5)} and days(-1) == {("p", 9), ("q", 3)} and days(-4) == set() == days(3)
    assert days("2021-01-03") == {("p", 1), ("q", 3)}, "the earlier of two as near"
    assert days(datetime(2022, 1, 1)) == {("p", 9), ("q", 3)}


def test_snapshot_of_optical_cubes(cube):
    shot = N.snapshot(cube, 0, ["B08", "what"])
    assert [p.name for p in shot.panels] == ["RGB", "NDVI", "B08"] and shot.unknown == ["what"]
    colours = {(r["parcel_id"], r["x"]): r["a"] for r in shot.frames[0].collect()}
    assert colours["p", 0] == 255 and colours["q", 0] == 0
    index = {(r["parcel_id"], r["y"], r["x"]): r for r in shot.frames[1].collect()}
    assert index["p", 0, 1]["value"] == pytest.approx(1.1 / 1.7) and index["p", 0, 1]["shade"] == pytest.approx((1.1 / 1.7 + 1) / 2)
    band = {(r["parcel_id"], r["y"], r["x"]): r["shade"] for r in shot.frames[2].collect()}
    assert band == {("p", 0, 0): 0.0, ("p", 1, 0): 0.0, ("p", 0, 1): 1.0, ("p", 1, 1): 1.0, ("q", 0, 0): 0.0}
    assert [p.name for p in N.snapshot(cube, 0, primary=True).panels] == ["RGB"]
    assert N.mosaic([(cube, 0, ["B08"]), (cube, 0, [])])[1] == 3 and N.mosaic([]) == ([], 0)
    with pytest.raises(ValueError, match="no composite"):
        N.snapshot(cube.drop("B02"), primary=True)
    with pytest.raises(ValueError, match="no panel"):
        N.snapshot(cube.select("parcel_id", "sensor", "time", "y", "x"))


def test_an_index_that_a_cube_holds_is_shown_as_it_is(cube):
    held = cube.withColumn("NDVI", F.when((F.col("parcel_id") == "p") & (F.dayofmonth("time") == 9), F.lit(0.25)))
    values = {(r["parcel_id"], r["y"], r["x"]): r["value"] for r in N.snapshot(held, 0).frames[1].collect()}
    assert values["p", 0, 0] is None, "held by the cube, though not at this time"
    assert values["q", 0, 0] == pytest.approx(0.1 / 0.7)


def test_radar_images_become_decibels_if_they_are_numbers(spark):
    raw = [[100.0, 200.0, 300.0], [400.0, 500.0, 600.0], [700.0, 800.0, 900.0]]
    rows = [(i, y, x, raw[y][x] if i == 0 else -raw[y][x] / 50) for i in (0, 1) for y in range(3) for x in range(3)]
    rows += [(2, 0, x, v) for x, v in enumerate((-4.0, 4.0))] + [(3, 0, x, v) for x, v in enumerate((-4.0, 5.0))]
    df = spark.createDataFrame(rows, "image int, y int, x int, VV double").repartition(3)
    out = {(r["image"], r["y"], r["x"]): r["VV"] for r in N.decibels(df, ["VV"], ["image"]).collect()}
    padded = np.pad(np.array(raw), 1, mode="edge") ** 2 / 1e9
    for y in range(3):
        for x in range(3):
            assert out[0, y, x] == pytest.approx(10 * math.log10(np.median(padded[y : y + 3, x : x + 3])))
            assert out[1, y, x] == -raw[y][x] / 50
    assert out[2, 0, 0] == -4.0, "a median of 0 is not above 0"
    assert out[3, 0, 0] != -4.0
    assert N.decibels(df.limit(0), ["VV"], ["image"]).count() == 0


def test_radar_panels(spark):
    rows = [("p", "s1", datetime(2021, 1, 1), y, x, -10.0 - x, -15.0 - y) for y in range(3) for x in range(3)]
    df = spark.createDataFrame(rows, "parcel_id string, sensor string, time timestamp, y int, x int, VV double, VH double")
    shot = N.snapshot(df, 0, ["VH"])
    assert [p.name for p in shot.panels] == ["SAR_RGB", "VH"] and all(f.count() == 9 for f in shot.frames)
    assert {(r["y"], r["x"]): r["r"] for r in shot.frames[0].collect()}[0, 0] == 255


def test_steps_find_their_configuration(tmp_path):
    own, usual = tmp_path / "own", tmp_path / "usual"
    own.mkdir()
    usual.mkdir()
    (own / "dataset.yml").write_text("a: 1\n")
    (usual / "dataset.yml").write_text("a: 2\n")
    (usual / "features.yml").write_text("")
    assert pipelines.resolve_config("dataset", own, usual) == own / "dataset.yml" and pipelines.resolve_config("dataset", None, usual) == usual / "dataset.yml"
    assert pipelines.resolve_config("training", own, usual) is None
    with pytest.raises(ValueError, match="unknown step"):
        pipelines.resolve_config("other", own)
    ran = pipelines.run_steps({"dataset": lambda c: c["a"], "features": lambda c: c, "training": lambda c: 1 / 0}, own, usual)
    assert [(s, r["status"], r.get("result")) for s, r in ran.items()] == [("dataset", "done", 1), ("features", "done", {}), ("training", "skipped", None)]
    with pytest.raises(ZeroDivisionError):
        pipelines.run_steps({"dataset": lambda c: 1 / 0}, own)


def test_stream_windows_close_behind_the_watermark(spark, tmp_path):
    """Late rows of an open window count, rows of a closed one do not; a window is given once."""
    source = tmp_path / "in"
    kind = "parcel_id string, time timestamp, v double"

    def feed(n, *rows):
        spark.createDataFrame([("p", datetime(2021, m, d), v) for m, d, v in rows], kind).coalesce(1).write.parquet(str(source / str(n)))

    feed(1, (1, 4, 1.0), (1, 5, 3.0))
    stream = stream_stats(spark.readStream.schema(kind).parquet(str(source / "*")), ["parcel_id"], ["v"], "10 days", "2 days")
    q = stream.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        feed(2, (1, 6, 8.0))
        q.processAllAvailable()
        assert spark.table("windows").count() == 0
        feed(3, (2, 20, 5.0))
        q.processAllAvailable()
        feed(4, (1, 6, 1000.0), (2, 21, 7.0))
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.table("windows").collect()
    assert [(r["v"], r["n"]) for r in rows] == [(4.0, 3)]
