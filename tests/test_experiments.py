"""Files of an experiment: what each model and target leaves, read back; rows left out; sorted reports."""

import json
import random

import pytest

from parcelcube.operators import features as X
from parcelcube.operators import relational as R
from parcelcube.plans import pipelines
from parcelcube.plans.config import TrainingConfig
from parcelcube.sources import sinks


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(11)
    rows = [(f"p{i}", 2018 + i % 3, ("train", "val", "test")[i % 3], "ab"[i % 2], rng.random(), None if i in (3, 10) else rng.random(), 1 + rng.random()) for i in range(90)]
    return spark.createDataFrame(rows, "parcel_id string, year int, split string, variety string, a double, b double, y double")


def test_an_experiment_is_written_and_read_back(spark, table, tmp_path):
    config = TrainingConfig(targets=("y",), models={"rf": {"numTrees": 3, "maxDepth": [2, 3], "seed": 1}, "gbt": {"maxIter": 2, "maxDepth": 2, "seed": 1}})
    results = pipelines.training(table, config)
    assert {(r["parcel_id"], r["year"], tuple(r["missing"])) for r in results["rf", "y"]["dropped"].collect()} == {("p3", 2018, ("b",)), ("p10", 2019, ("b",))}
    sinks.save_training(spark, str(tmp_path), results)
    for name in ("rf", "gbt"):
        place = f"{tmp_path}/{name}/y"
        for split, n in (("val", 29), ("test", 30)):
            held = spark.read.option("header", True).csv(f"{place}/{split}/predictions")
            assert held.count() == n and {"parcel_id", "year", "variety", "gt_y", "predicted_y", "error"} <= set(held.columns)
            assert {r["variety"] for r in spark.read.option("header", True).csv(f"{place}/{split}/error_by_variety").collect()} == {"a", "b"}
        shares = [float(r["importance"]) for r in spark.read.option("header", True).csv(f"{place}/importance").collect()]
        assert shares == sorted(shares, reverse=True) and len(shares) == len(results[name, "y"]["features"])
        assert sinks.load_model(name, f"{place}/model").featureImportances.size == len(shares)
        kept = json.loads(spark.read.text(f"{place}/result").first()[0])
        assert kept["metrics"]["val"] == pytest.approx(results[name, "y"]["metrics"]["val"]) and kept["params"] == results[name, "y"]["params"]
        assert spark.read.option("header", True).csv(f"{place}/dropped").count() == 2


def test_summary_and_experiment_files(spark, table, tmp_path):
    one = {"target": "y", "model": "rf", "n_train": 3, "n_val": 2, "params": {"b": 1, "a": [2]}, "mae": 1, "rmse": 2, "r2": 0.5, "mape": 0.1}
    row = sinks.summary(spark, [one]).first()
    assert (row["params"], row["mae"], row["n_val"]) == ('{"a": [2], "b": 1}', 1.0, 2)
    sinks.save_experiment(spark, str(tmp_path), table, {"k": 1}, {"done": True})
    assert spark.read.option("header", True).csv(f"{tmp_path}/dataset").count() == 90
    assert json.loads(spark.read.text(f"{tmp_path}/config").first()[0]) == {"k": 1} and json.loads(spark.read.text(f"{tmp_path}/run_log").first()[0]) == {"done": True}


def test_codes_are_positions_among_all_values(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "v string").repartition(3)
    assert sorted((r["v"] or "", r["v_enc"]) for r in X.label_codes(df, ["v"]).collect()) == [("", None), ("a", 0.0), ("b", 1.0), ("b", 1.0), ("c", 2.0)]


def test_incomplete_and_far_rows(spark):
    df = spark.createDataFrame([(1, None, None, -30.0), (2, 1, None, 25.0), (3, 1, 1, -40.0), (4, 1, 1, None), (5, 1, 1, 20.0)], "k int, a int, b int, d double")
    assert [(r["k"], r["missing"]) for r in R.incomplete(df, ["k"], ["a", "b"]).orderBy("k").collect()] == [(1, ["a", "b"]), (2, ["b"])]
    assert R.incomplete(df.limit(0), ["k"], ["a"]).count() == 0
    assert [r["k"] for r in R.beyond(df, "d", 20.0, ["d"]).collect()] == [3, 1, 2] and [r["k"] for r in R.beyond(df, "d", 20.0, ["d"], 1).collect()] == [3]
