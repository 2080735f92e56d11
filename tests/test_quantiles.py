"""Rank selection against sorting, with ranges small enough that several rounds are needed."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelcube.functions.bands import scale_reflectance
from parcelcube.operators import profile as P
from parcelcube.operators import quantiles as Q
from parcelcube.operators import relational as R

FRACTIONS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0)


@pytest.fixture
def many_rounds(monkeypatch):
    monkeypatch.setattr(Q, "BOUNDS", 5)
    monkeypatch.setattr(Q, "DRAWN", 40)
    monkeypatch.setattr(Q, "LISTED", 3)


@pytest.mark.parametrize("kind", ["spread", "hot", "two", "signs"])
def test_quantiles_equal_sorting(spark, many_rounds, kind):
    rng = random.Random(4)
    values = {
        "spread": [rng.lognormvariate(0, 9) for _ in range(700)],
        "hot": [7.0 if rng.random() < 0.9 else rng.uniform(-5, 20) for _ in range(700)],
        "two": [float(rng.randrange(2)) for _ in range(301)],
        "signs": [rng.choice([-1, 1]) * rng.choice([0.0, 1e-300, 3.5, 1e300]) for _ in range(300)] + [-math.inf, math.inf, None],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    held = sorted(v for v in values if v is not None)
    found = Q.quantiles(df, "v", FRACTIONS)
    for f, q in zip(FRACTIONS, found, strict=True):
        at = (len(held) - 1) * f
        low, high = held[math.floor(at)], held[math.ceil(at)]
        assert q == low if low == high else q == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-9)


def test_quantiles_of_odd_columns(spark, many_rounds):
    empty = spark.createDataFrame([], "v double")
    assert Q.quantiles(empty, "v", (0.5, 0.9)) == [None, None] == Q.quantiles(spark.createDataFrame([(None,)], "v double"), "v", (0.5, 0.9))
    late = Q.quantiles(spark.createDataFrame([(1.0,)] * 10 + [(math.nan,)] * 30, "v double"), "v", (0.0, 0.2, 0.9))
    assert late[:2] == [1.0, 1.0] and math.isnan(late[2])
    assert Q.quantiles(spark.createDataFrame([(3,)], "v int"), "v", (0.0, 0.5, 1.0)) == [3.0] * 3
    assert R.quantile_band(empty, "v").count() == 0 and R.iqr_outliers(empty, "v").count() == 0 and R.iqr_normalise(empty, "v", "z").count() == 0
    assert P.describe(empty, "v").first().asDict() == {"n": 0, "mean": None, "std": None, "min": None, "p25": None, "p50": None, "p75": None, "max": None}


def test_outliers_of_the_whole_table(spark):
    df = spark.range(100).select(F.when(F.col("id") == 0, 1e6).otherwise(F.col("id")).alias("v"))
    assert [r["v"] for r in R.iqr_outliers(df, "v").collect()] == [1e6]


def test_scale_guard_equals_the_median(spark):
    rng = random.Random(9)
    cubes = {i: [rng.choice([None, 0.5, 0.9, 1.0, 1.1, 1.5, 900.0, 5000.0]) for _ in range(rng.randrange(1, 7))] for i in range(120)}
    df = spark.createDataFrame([(str(i), "S2", v) for i, held in cubes.items() for v in held], "parcel_id string, sensor string, v double")
    found = {}
    for r in scale_reflectance(df, ["v"]).collect():
        found.setdefault(int(r["parcel_id"]), []).append(r["v"])
    for i, held in cubes.items():
        known = [v for v in held if v is not None]
        scaled = bool(known) and np.median(known) <= 1.0
        expected = [v if v is None or scaled else min(max(v / 10_000, 0.0), 1.0) for v in held]
        assert sorted(found[i], key=str) == sorted(expected, key=str)
