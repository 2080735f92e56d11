"""Quantiles per group, density and forests of medians against sums and sorting in plain Python; speckle with holes."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelcube.functions import bands as B
from parcelcube.operators import ml
from parcelcube.operators import profile as P
from parcelcube.operators.group_quantiles import quantiles_by
from parcelcube.sources.sinks import load_model, save_model


def test_quantiles_by_group_equal_sorting(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), rng.choice([1.0, 1.0, 2.0, rng.uniform(-9, 9), None])) for _ in range(2000)] + [("d", None), ("e", 4.0), ("f", math.nan), ("f", 1.0), ("f", 2.0)]
    fractions = {"least": 0.0, "third": 0.3, "middle": 0.5, "most": 1.0}
    got = {r["k"]: r for r in quantiles_by(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", fractions).collect()}
    assert set(got) == {"a", "b", "c", None, "e", "f"}
    for k in ("a", "b", "c", None, "e"):
        held = [v for g, v in rows if g == k and v is not None]
        for name, f in fractions.items():
            assert got[k][name] == pytest.approx(np.quantile(held, f))
    assert (got["f"]["least"], got["f"]["middle"]) == (1.0, 2.0) and math.isnan(got["f"]["most"])
    assert quantiles_by(spark.createDataFrame([], "k string, v double"), ["k"], "v", fractions).count() == 0


def test_density_equals_direct_sums(spark):
    rng = random.Random(2)
    rows = [(g, rng.gauss(0, 1) + (5 if rng.random() < 0.3 else 0)) for g in "aab" for _ in range(150)] + [("one", 2.0), ("same", 1.0), ("same", 1.0), ("a", None), ("a", math.inf), (None, 1.0), (None, 3.0)]
    out = P.density(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", points=512).collect()
    assert {r["k"] for r in out} == {"a", "b", None}
    for g in ("a", "b", None):
        held = np.array([v for k, v in rows if k == g and v is not None and math.isfinite(v)])
        h = held.std(ddof=1) * len(held) ** -0.2
        found = sorted((r["x"], r["density"]) for r in out if r["k"] == g)
        xs = np.linspace(held.min() - 3 * h, held.max() + 3 * h, 512)
        direct = np.exp(-0.5 * ((xs[:, None] - held) / h) ** 2).sum(1) / (math.sqrt(2 * math.pi) * h * len(held))
        assert np.allclose([x for x, _ in found], xs)
        assert np.abs(np.array([d for _, d in found]) - direct).max() < 1e-3 * direct.max(), "linear binning errs by the square of the step"
    whole = P.density(spark.createDataFrame([(1.0,), (2.0,)], "v double"), [], "v", points=16, bandwidth=0.5)
    assert whole.count() == 16
    with pytest.raises(ValueError, match="bandwidth"):
        P.density(whole, [], "x", bandwidth=-1.0)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(rng.random(), rng.random(), rng.lognormvariate(0, 1.5) * (1 + (i % 3))) for i in range(400)]
    df = spark.createDataFrame([(a, b, y * (1 + 3 * (a > 0.5)), "val" if i % 4 == 0 else "train") for i, (a, b, y) in enumerate(rows)], "a double, b double, y double, split string")
    return ml.temporal_split(ml.assemble(df.repartition(3), ["a", "b"], "y"))[:2]


PARAMS = {"numTrees": 5, "maxDepth": 3, "seed": 42}


def test_leaves_answer_with_medians_of_their_rows(spark, skewed, tmp_path):
    train, val = skewed
    model = ml.fit("rf", train, ml.ABSOLUTE, **PARAMS)
    rows = train.select("__x", "__y").collect()
    expected = {}
    for t, tree in enumerate(model.forest.trees):
        for r in rows:
            expected.setdefault((t, int(tree.predictLeaf(r["__x"]))), []).append(r["__y"])
    leaves = {(r["tree"], r["leaf"]): (r["median"], r["n"]) for r in model.leaves.collect()}
    assert leaves == {k: (pytest.approx(statistics.median(v)), len(v)) for k, v in expected.items()}
    for r in model.transform(val).collect():
        answers = [leaves[t, int(tree.predictLeaf(r["__x"]))][0] for t, tree in enumerate(model.forest.trees)]
        assert r["__p"] == pytest.approx(sum(answers) / len(answers))
    save_model(model, str(tmp_path / "m"))
    again = load_model("rf_median", str(tmp_path / "m"))
    assert [r["__p"] for r in again.transform(val).orderBy("a").collect()] == pytest.approx([r["__p"] for r in model.transform(val).orderBy("a").collect()])


def test_medians_err_less_than_means(skewed):
    train, val = skewed

    def error(model):
        return model.transform(train).agg(F.avg(F.abs(F.col("__y") - F.col("__p"))).alias("e")).first()["e"]

    assert error(ml.fit("rf", train, ml.ABSOLUTE, **PARAMS)) < error(ml.fit("rf", train, **PARAMS))
    found = ml.grid_search("rf", train, val, {**PARAMS, "maxDepth": [2, 3], "criterion": ml.ABSOLUTE})
    assert isinstance(found.model, ml.MedianForest) and len(found.trials) == 2 and found.model.featureImportances.size == 2
    with pytest.raises(ValueError, match="criterion"):
        ml.fit("gbt", train, ml.ABSOLUTE)


def test_speckle_with_holes_equals_brute_force(spark):
    rng = random.Random(5)
    px = {(y, x): None if rng.random() < 0.1 else rng.uniform(0, 9) for y in range(9) for x in range(9) if rng.random() < 0.6}
    df = spark.createDataFrame([(1, y, x, v, "kept") for (y, x), v in px.items()], "im int, y int, x int, v double, other string").repartition(5)
    out = B.speckle_median(df, ["v"], ["im"])
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == len(px)
    for r in rows:
        y, x, near = r["y"], r["x"], []
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                near.append(next(px[at] for at in ((y + dy, x + dx), (y, x + dx), (y + dy, x), (y, x)) if at in px))
        held = [v for v in near if v is not None]
        assert r["v"] == (pytest.approx(statistics.median(held)) if held else None)
