"""Order of sums, halves, and unions, clips, stores and points at sizes that the forms before did not bear."""

import datetime
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelcube import catalog
from parcelcube.functions import geometry as G
from parcelcube.functions import raster as V
from parcelcube.operators.dissolve import SHAPE, dissolve, edges_of, inside, rings_of, signed, united
from parcelcube.operators.relational import with_book
from parcelcube.sources import zarr as Z
from tests.oracle import connect, rows_of_spark, rows_of_sql
from tests.test_shapes import box


def test_scene_bands_round_halves_to_even(spark, tmp_path):
    rows = [(1, 2.5), (1, 3.0), (1, 4.0), (2, 0.5), (2, 1.5), (3, 8.5), (3, 9.5)]
    spark.createDataFrame(rows, "user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = rows_of_spark(catalog.queries()["scene_bands"](spark, str(tmp_path)))
    assert found == [("B00,B02", "2"), ("B01,B08", "3"), ("RGB,B02,B03,B04", "1")]
    c = connect(str(tmp_path / "none"))
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert found == rows_of_sql(c, catalog.oracle_sql()["scene_bands"])[1]


@pytest.mark.parametrize("name", ["growth_stage", "tracking_rvi"])
def test_month_bytes_do_not_depend_on_the_deal(spark, name):
    # 0.1 + 0.2 + 0.3 is above 0.6, 0.3 + 0.2 + 0.1 is not: the bytes of such sums differ by one
    value = "NDVI" if name == "growth_stage" else "RVI"
    rows = [(p, datetime.datetime(1997, m, 1), n, [0.1, 0.2, 0.3, 0.7, 0.4, 0.6][(p * k + n) % 6]) for p, k in ((p, 1 + p % 5) for p in range(300)) for m in (4, 5, 6) for n in range(3 + p % 9)]
    df = spark.createDataFrame(rows, f"parcel_id int, time timestamp_ntz, n int, {value} double")
    bytes_of = lambda d: sorted(getattr(V, name)(d, ["parcel_id"], "1997-03-01", "1997-07-01", order=("time", "n")).collect())
    found = bytes_of(df.coalesce(1))
    assert found == bytes_of(df.repartition(7, "n")) == bytes_of(df.repartition(5, F.rand(3)).sortWithinPartitions(F.desc("n")))
    assert len(found) == 300 and {r["a"] for r in found} == {255}
    low, high, bias = (0.1, 0.7, 0.0) if name == "growth_stage" else (0.25, 0.75, 0.2)
    for r in found:
        for c, m in (("r", 4), ("g", 5), ("b", 6)):
            total, n = 0.0, 0
            for _, t, _, v in (x for x in rows if x[0] == r["parcel_id"]):
                if t.month == m:
                    total, n = total + v, n + 1
            assert r[c] == int(max(0.0, min(1.0, ((bias + total) / n - low) / (high - low))) * 255)


def test_union_of_many_boxes_does_not_grow_with_their_square():
    rng = random.Random(2)
    boxes = [(rng.randrange(190), rng.randrange(170), rng.randrange(1, 10), rng.randrange(1, 8)) for _ in range(2500)]
    ground = np.zeros((200, 180), dtype=bool)
    for x, y, w, h in boxes:
        ground[x : x + w, y : y + h] = True
    shape = [[{"x": float(a), "y": float(b)} for a, b in box(*b)] for b in boxes]
    began = time.process_time()
    found = united(rings_of(shape))
    assert time.process_time() - began < 8  # 0.5 s; the form before took 2.2 s for 800 boxes, and grew with their square
    assert sum(signed(np.array(r)) / 2 for p in found for r in p) == ground.sum()


def test_dissolve_is_dealt_to_tasks_by_number(spark):
    rows = [(k, [[{"x": float(a), "y": float(b)} for a, b in box(3 * k + i, i % 5, 2)]]) for k in range(6) for i in range(20)]
    df = spark.createDataFrame(rows, f"k int, shape {SHAPE}")
    out = dissolve(df, ["k"])
    # Spark must not put its small partitions together, whose work is not small
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: len(r["shape"]) for r in out.collect()}.keys() == set(range(6))


def test_points_meet_edges_worked_out_once(spark):
    rng = random.Random(4)
    shape = [[{"x": float(a), "y": float(b)} for a, b in r] for r in (box(0, 0, 20), box(5, 5, 6)[::-1], [(30, 2), (41, 9), (33, 17), (30, 2)])]
    points = [(rng.uniform(-2, 45), rng.choice([0.0, 2.0, 5.0, rng.uniform(-2, 22)])) for _ in range(300)]
    df = spark.createDataFrame([(shape, x, y) for x, y in points], f"shape {SHAPE}, x double, y double")
    lines = df.withColumn("crossed", G.crossings(G.steep_edges(F.col("shape")), F.col("y")))
    found = [r[0] for r in lines.select(G.among(F.col("crossed"), F.col("x"))).collect()]
    expected = np.logical_or.reduce([inside(edges_of(p), np.array(points)) for p in rings_of(shape)])
    assert found == expected.tolist() == [r[0] for r in df.select(G.contains(F.col("shape"), F.col("x"), F.col("y"))).collect()]
    # a table of one file is dealt over all tasks before each shape becomes 1,600 points
    assert "REPARTITION_BY_NUM" in catalog.queries()["multipart_contains"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["polygon_clip", "polygon_clip_eroded"])
def test_cells_are_not_broadcast(spark, name):
    # the file of shapes is small, the cells that come from it are many
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_times_of_a_long_cube_do_not_come_with_its_pixels(spark, tmp_path):
    start = datetime.datetime(2020, 1, 1)
    rows = [("S2", p, start + datetime.timedelta(hours=7 * t), b, float(y), 5.0, t + y / 4 if (t + y) % 5 else None) for p, n in (("a", 600), ("b", 5)) for t in range(n) for b in ("B1", "B2") for y in (0, 1)]
    rows += [("S2", "a", start, "B1", 0.0, 5.0, -3.0), ("S2", "a", start, "B1", 0.0, 5.0, None), ("S2", "a", start, "B1", 0.0, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "sensor string, parcel_id string, time timestamp_ntz, variable string, y_coord double, x_coord double, value double").repartition(3, F.rand(1))
    path = tmp_path / "cubes"
    Z.write_cubes(df, str(path), steps=4)
    assert len([f for f in (path / "S2/a/cube.zarr/time").iterdir() if f.name.isdigit()]) == 150
    back = Z.read_cubes(spark, str(path))
    assert back.rdd.getNumPartitions() <= 80 and back.count() == (600 + 5) * 4
    columns = ["parcel_id", "time", "variable", "y_coord", "x_coord"]
    want = {tuple(r) for r in df.where("value IS NOT NULL").groupBy(*columns).agg(F.min("value")).collect()}
    assert {tuple(r) for r in back.where("value IS NOT NULL").select(*columns, "value").collect()} == want


def test_a_hot_key_of_a_book_is_dealt_over_tasks(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") < 390, 1).when(F.col("id") < 395, 2).otherwise(F.lit(None)).alias("k")).coalesce(1)
    book = spark.createDataFrame([(1, f"e{i}") for i in range(30)] + [(3, "none"), (None, "null")], "k int, name string").coalesce(1)
    found = with_book(rows, book, "k")
    assert found.columns == ["k", "id", "name"]
    assert sorted((r["id"], r["name"] or "") for r in found.collect()) == sorted([(i, f"e{j}") for i in range(390) for j in range(30)] + [(i, "") for i in range(390, 400)])
    assert found.where("k = 1").select(F.spark_partition_id()).distinct().count() > 4


@pytest.mark.parametrize("name", ["polygon_mask", "polygon_mask_eroded"])
def test_masked_cells_are_not_broadcast(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
