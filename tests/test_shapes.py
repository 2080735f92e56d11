"""Unions and clips of random shapes against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelcube.functions import geometry as G
from parcelcube.operators.clip import clip, depth, touched
from parcelcube.operators.dissolve import SHAPE, dissolve, edges_of, inside, rings_of, signed, united


def rings(*points):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in points]


def box(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def star(rng, reach=45):
    n, cx, cy = rng.randrange(5, 12), rng.uniform(20, 80), rng.uniform(20, 80)
    turned = [(rng.uniform(5, reach), (k + rng.uniform(0, 0.9)) * 2 * np.pi / n) for k in range(n)]
    ring = [(cx + r * np.cos(a), cy + r * np.sin(a)) for r, a in turned]
    return [*ring, ring[0]]


def area(parts):
    return sum(signed(np.array(r)) / 2 for p in parts for r in p)


def edges(parts):
    return [edges_of([np.array(r) for r in p]) for p in parts]


@pytest.mark.parametrize(
    ("shape", "expected", "n_rings"),
    [
        (rings(box(0, 0, 10), box(5, 5, 10)), 175, [1]),
        (rings(box(0, 0, 10), box(10, 0, 10)), 200, [1]),  # a side in common
        (rings(box(0, 0, 10), box(10, 10, 10)), 200, [1, 1]),  # a corner in common
        (rings(box(0, 0, 10), box(2, 2, 3)), 100, [1]),
        (rings(box(0, 0, 10), box(20, 0, 5)), 125, [1, 1]),
        (rings(box(0, 0, 10), box(0, 0, 10)), 100, [1]),
        (rings(box(0, 0, 30, 10), box(0, 20, 30, 10), box(0, 0, 10, 30), box(20, 0, 10, 30)), 800, [2]),  # they enclose a hole
        (rings(box(0, 0, 10), box(2, 2, 4)[::-1], box(3, 3, 1)), 85, [2, 1]),  # an island in a hole
        (rings(box(0, 0, 10), box(2, 2, 4)[::-1], box(2, 2, 4)), 100, [1]),  # a hole that another part fills
        (rings(box(0, 0, 0), [(0, 0), (1, 1)]), 0, []),
    ],
)
def test_union_of_parts(shape, expected, n_rings):
    found = united(rings_of(shape))
    assert area(found) == expected and [len(p) for p in found] == n_rings


def test_union_of_random_shapes():
    rng = random.Random(1)
    for _ in range(60):
        boxes = [(rng.randrange(12), rng.randrange(12), rng.randrange(1, 6), rng.randrange(1, 6)) for _ in range(rng.randrange(1, 9))]
        ground = np.zeros((20, 20), dtype=bool)
        for x, y, w, h in boxes:
            ground[x : x + w, y : y + h] = True
        found = united(rings_of(rings(*[box(1e6 + x, 5e6 + y, w, h) for x, y, w, h in boxes])))
        centres = np.array([(1e6 + i + 0.5, 5e6 + j + 0.5) for i in range(20) for j in range(20)])
        assert area(found) == pytest.approx(ground.sum(), abs=1e-6)
        assert (sum(inside(e, centres).astype(int) for e in edges(found)) == ground.reshape(-1)).all()
    for _ in range(30):
        parts = rings_of(rings(*[star(rng) for _ in range(rng.randrange(2, 6))]))
        points = np.array([(rng.uniform(-60, 160), rng.uniform(-60, 160)) for _ in range(1000)])
        expected = np.logical_or.reduce([inside(edges_of(p), points) for p in parts])
        assert (sum(inside(e, points).astype(int) for e in edges(united(parts))) == expected).all()


def test_dissolve_rows(spark):
    rows = [(1, rings(box(0, 0, 10))), (1, rings(box(5, 5, 10))), (1, None), (1, rings(box(0, 0, 10))), (2, None), (None, rings(box(0, 0, 2)))]
    rows += [(3, rings(box(i, 0, 2))) for i in range(200)]
    df = spark.createDataFrame(rows, f"k int, shape {SHAPE}")
    for rounds in (1, 2, 3):
        found = {r["k"]: r["a"] for r in dissolve(df, ["k"], rounds=rounds, salts=4).select("k", G.area(F.col("shape")).alias("a")).collect()}
        assert found == {1: 175.0, 2: 0.0, None: 4.0, 3: 402.0}
    assert dissolve(df.limit(0), ["k"]).count() == 0


def test_touched_cells_equal_dense_points():
    rng = random.Random(5)
    for _ in range(8):
        shape = rings(*[star(rng) for _ in range(rng.randrange(1, 4))])
        cell = rng.choice([5.0, 10.0])
        xs, ys = np.arange(0, 100, cell) + 0.37, np.arange(0, 110, cell) + 0.11
        k = 16
        step = (np.arange(k) / (k - 1) - 0.5) * cell
        points = np.array([(x + i, y + j) for y in ys for x in xs for i in step for j in step])
        deepest = depth(edges(united(rings_of(shape))), points).reshape(len(ys), len(xs), -1).max(axis=2)
        slack = cell / (k - 1) * 0.75
        for grow, shrink in ((0.0, 0.0), (cell, 0.0), (0.0, 0.7 * cell)):
            need = shrink or -grow
            if shrink and deepest.max() < need + slack:
                continue
            hit = touched(shape, xs, ys, cell, grow, shrink)
            assert hit[deepest >= need].all() and not hit[deepest < need - slack].any()


def _cube(spark, shape, values=lambda x, y: 1.0, flip=False):
    rows = [("p", "S2", y, x, float(10 * ((9 - y) if flip else y) + 5), float(10 * x + 5), values(x, y), t) for x in range(10) for y in range(10) for t in (1, 2)]
    df = spark.createDataFrame(rows, "parcel_id string, sensor string, y int, x int, y_coord double, x_coord double, v double, t int")
    return df, spark.createDataFrame([("p", shape), ("none", None)], f"parcel_id string, shape {SHAPE}")


def test_clip_keeps_touching_pixels(spark):
    df, aoi = _cube(spark, rings(box(31, 31, 18)), flip=True)
    found = clip(df, aoi, 10.0)
    assert found.columns == df.columns and found.count() == 2 * found.select("x", "y").distinct().count()
    # 31..49 grown by 10 touches the cells from 20 to 60, but not those at the corners beyond the round
    assert {(r["x"], 9 - r["y"]) for r in found.collect()} == {(x, y) for x in range(2, 6) for y in range(2, 6)}
    # nothing is 10 deep in a box of 18, so it is taken as it is
    assert {(r["x"], 9 - r["y"]) for r in clip(df, aoi, 10.0, 1.0).collect()} == {(3, 3), (3, 4), (4, 3), (4, 4)}
    # rings and parts of different lengths
    ragged, aoi = _cube(spark, rings(box(31, 31, 18), [(31, 31), (39, 31), (49, 40), (49, 49), (40, 49), (31, 39), (31, 31)], box(33, 33, 2)[::-1]), flip=True)
    assert clip(ragged, aoi, 10.0).exceptAll(found).count() == 0 and clip(ragged, aoi, 10.0).count() == 32
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and found.filter("t = 1").count() == 16


def test_clip_falls_back_to_the_nearest_pixel(spark):
    far, aoi = _cube(spark, rings(box(1000, 42, 4)))
    assert {(r["x"], r["y"]) for r in clip(far, aoi, 10.0).collect()} == {(9, 4)}
    # all that touch are without a value: the pixel at the centroid stays, though it has none
    blank, aoi = _cube(spark, rings(box(31, 31, 18)), values=lambda x, y: None if x < 7 else 1.0)
    assert {(r["x"], r["y"]) for r in clip(blank, aoi, 10.0, bands=("v",)).collect()} == {(3, 3)}
    assert clip(blank.withColumn("parcel_id", F.lit("none")), aoi, 10.0).count() == 0
    assert clip(blank.limit(0), aoi, 10.0).count() == 0
    odd = far.limit(3).withColumn("x_coord", F.lit(None).cast("double"))
    assert clip(odd, aoi, 10.0).count() == 0
