"""Boosting: losses of rounds against sums of trees, the cut at the best round, models written and read."""

import random

import pytest
from pyspark.sql import functions as F

from parcelcube.operators import ml
from parcelcube.sources.sinks import load_model, save_model


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(3)
    rows = [(rng.random(), rng.random(), s) for s in ("train", "val") for _ in range(60)]
    df = spark.createDataFrame([(a, b, 10 * a + rng.gauss(0, 3) + (4 * b if s == "val" else 0), s) for a, b, s in rows], "a double, b double, y double, split string")
    train, val, _ = ml.temporal_split(ml.assemble(df.repartition(2), ["a", "b"], "y"))
    return train.cache(), val.cache()


PARAMS = {"maxIter": 12, "maxDepth": 4, "stepSize": 0.5}


def test_losses_of_rounds_equal_sums_of_trees(sides):
    model = ml.make("gbt", seed=42, **PARAMS).fit(sides[0])
    rounds = ml.boosting_rounds(model, *sides)
    assert [r["round"] for r in rounds] == list(range(1, 13))
    for name, side in zip(("train", "val"), sides, strict=True):
        rows = side.select("__x", "__y").collect()
        for k in (1, 5, 12):
            sums = [sum(w * t.predict(r["__x"]) for w, t in zip(model.treeWeights[:k], model.trees[:k], strict=True)) for r in rows]
            assert rounds[k - 1][f"{name}_absolute"] == pytest.approx(sum(abs(r["__y"] - s) for r, s in zip(rows, sums, strict=True)) / len(rows))


def test_a_model_is_cut_at_its_best_round(spark, sides, tmp_path):
    whole = ml.make("gbt", seed=42, **PARAMS).fit(sides[0])
    model, rounds = ml.fit_boosted(*sides, **PARAMS)
    losses = [r["val_absolute"] for r in rounds]
    best = losses.index(min(losses)) + 1
    assert len(rounds) == 12 and best < 12, "the fixture overfits"
    assert model.getNumTrees == best and [t.toDebugString.split("\n", 1)[1] for t in model.trees] == [t.toDebugString.split("\n", 1)[1] for t in whole.trees[:best]]
    mae = model.transform(sides[1]).agg(F.avg(F.abs(F.col("__y") - F.col("__p")))).first()[0]
    assert mae == pytest.approx(min(losses))
    table = ml.rounds_table(spark, rounds).orderBy("round").collect()
    assert [r["round"] for r in table if r["best"]] == [best] and [r["val_absolute"] for r in table] == losses

    save_model(model, str(tmp_path / "gbt"))
    again = load_model("gbt", str(tmp_path / "gbt"))
    assert again.transform(sides[1]).select("__p").collect() == model.transform(sides[1]).select("__p").collect()
    forest = ml.make("rf", numTrees=3, seed=1).fit(sides[0])
    save_model(forest, str(tmp_path / "rf"))
    assert load_model("rf", str(tmp_path / "rf")).getNumTrees == 3
    with pytest.raises(ValueError, match="unknown model"):
        load_model("svm", str(tmp_path / "rf"))


def test_search_with_early_stopping(sides):
    found = ml.grid_search("gbt", *sides, {**PARAMS, "maxDepth": [2, 4], "seed": 42, "stop_early": True})
    assert len(found.trials) == 2 and found.trials[0]["rounds"] == found.model.getNumTrees and [r["best"] for r in found.rounds].index(True) + 1 == found.model.getNumTrees
    assert found.trials[0]["val_mae"] == pytest.approx(min(r["val_absolute"] for r in found.rounds))
    assert "stop_early" not in found.params and "maxDepth" in found.params
    with pytest.raises(ValueError, match="no rounds"):
        ml.grid_search("rf", *sides, {"stop_early": True})
    with pytest.raises(ValueError, match="no rows"):
        ml.fit_boosted(sides[0], sides[1].limit(0), **PARAMS)
