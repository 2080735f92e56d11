"""Regression on feature tables with Spark ML: grids, selection on a validation split, reports."""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcube.operators.group_quantiles import quantiles_by
from parcelcube.operators.profile import regression_metrics, within

MODELS: dict[str, type] = {"gbt": GBTRegressor, "rf": RandomForestRegressor}


def make(name: str, **params: Any) -> Any:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known are {sorted(MODELS)}")
    return MODELS[name](featuresCol="__x", labelCol="__y", predictionCol="__p", **params)


def param_grid(params: dict[str, Any]) -> list[dict[str, Any]]:
    """Lists are crossed in the order of their sorted names, other values are fixed."""
    names = sorted(k for k, v in params.items() if isinstance(v, list))
    fixed = {k: v for k, v in params.items() if k not in names}
    return [fixed | dict(zip(names, values, strict=True)) for values in itertools.product(*[params[n] for n in names])]


def assemble(df: DataFrame, features: Iterable[str], target: str, log: bool = False) -> DataFrame:
    """Rows with all features and the target as a vector and a label."""
    features = list(features)
    label = F.ln(F.col(target)) if log else F.col(target).cast("double")
    rows = df.dropna("any", subset=[*features, target]).withColumn("__y", label).where(F.col("__y").isNotNull())
    return VectorAssembler(inputCols=features, outputCol="__x").transform(rows)


@dataclass
class Search:
    """Result of a grid search: the model of the least validation error, first in the grid's order, every trial, and the rounds of a boosted model that was stopped early."""

    model: Any
    params: dict[str, Any]
    trials: list[dict[str, Any]] = field(default_factory=list)
    rounds: list[dict[str, Any]] = field(default_factory=list)


def boosting_rounds(model: Any, train: DataFrame, val: DataFrame, loss: str = "absolute") -> list[dict[str, Any]]:
    """Mean loss on both sides after each round of a boosted model, one job a side; nulls for a side without rows."""
    sides = {s: [None] * len(model.treeWeights) if d.isEmpty() else model.evaluateEachIteration(d, loss) for s, d in (("train", train), ("val", val))}
    return [{"round": i, f"train_{loss}": t, f"val_{loss}": v} for i, (t, v) in enumerate(zip(sides["train"], sides["val"], strict=True), 1)]


def fit_boosted(train: DataFrame, val: DataFrame, loss: str = "absolute", **params: Any) -> tuple[Any, list[dict[str, Any]]]:
    """A boosted model of as many rounds as have the least validation loss, the fewest of equals, and the losses of all rounds.

    The first rounds of a longer run are a shorter run of the same seed, so the model is fitted again with the best number of rounds.
    """
    params = {"seed": 42} | params
    model = make("gbt", **params).fit(train)
    rounds = boosting_rounds(model, train, val, loss)
    if any(r[f"val_{loss}"] is None for r in rounds):
        raise ValueError("the validation split has no rows to choose by")
    best = min(rounds, key=lambda r: (r[f"val_{loss}"], r["round"]))["round"]
    for r in rounds:
        r["best"] = r["round"] == best
    return (model if best == len(rounds) else make("gbt", **params | {"maxIter": best}).fit(train)), rounds


def rounds_table(spark: Any, rounds: list[dict[str, Any]], loss: str = "absolute") -> DataFrame:
    """The losses of a run as rows: round, both losses, and whether it is the best round."""
    return spark.createDataFrame([(r["round"], r[f"train_{loss}"], r[f"val_{loss}"], r["best"]) for r in rounds], f"round int, train_{loss} double, val_{loss} double, best boolean")


@dataclass
class MedianForest:
    """A grown forest whose leaves answer with medians: forest as it was grown, leaves as a table (tree, leaf, median, n)."""

    forest: Any
    leaves: DataFrame

    @property
    def featureImportances(self) -> Any:  # noqa: N802
        return self.forest.featureImportances

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return self.forest.getNumTrees

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the mean over the trees of the medians of a row's leaves as __p. The medians travel as one row of as many numbers as the model has leaves."""
        one = self.leaves.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("leaf", "median"))).alias("of"))
        one = one.agg(F.transform(F.sort_array(F.collect_list(F.struct("tree", "of"))), lambda t: t["of"]["median"]).alias("__medians"))
        rows = self.forest.setLeafCol("__leaf").transform(df).drop("__p").withColumn("__leaf", vector_to_array("__leaf")).join(F.broadcast(one), F.lit(True))
        met = F.transform("__leaf", lambda leaf, tree: F.get(F.get("__medians", tree), leaf.cast("int")))
        return rows.withColumn("__p", F.aggregate(met, F.lit(0.0), lambda a, m: a + m) / F.size("__leaf")).drop("__leaf", "__medians")

    def save(self, path: str) -> None:
        self.forest.write().overwrite().save(f"{path}/forest")
        self.leaves.write.mode("overwrite").parquet(f"{path}/leaves")

    @staticmethod
    def load(spark: Any, path: str) -> MedianForest:
        from pyspark.ml.regression import RandomForestRegressionModel

        return MedianForest(RandomForestRegressionModel.load(f"{path}/forest"), spark.read.parquet(f"{path}/leaves"))


def leaf_labels(forest: Any, df: DataFrame) -> DataFrame:
    """A row for each tree and row: tree, leaf, __y. Every leaf has at least one row of those the forest was grown from."""
    rows = forest.setLeafCol("__leaf").transform(df).select("__y", vector_to_array("__leaf").alias("__leaf"))
    return rows.select("__y", F.posexplode("__leaf").alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))


def fit_median_forest(train: DataFrame, **params: Any) -> MedianForest:
    """A forest for the least absolute error: splits are those of the least variance, each leaf then answers with the median of its rows.

    A leaf's rows are all rows of train that reach it, not only those drawn for its tree. Medians are exact and no task holds a leaf's rows.
    The table of leaves is kept cached: it is as large as the model.
    """
    forest = make("rf", **params).fit(train)
    labels = leaf_labels(forest, train)
    sizes = labels.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    leaves = quantiles_by(labels, ["tree", "leaf"], "__y", {"median": 0.5}).join(sizes, ["tree", "leaf"]).select("tree", "leaf", "median", "n")
    return MedianForest(forest, leaves.cache())


# The names of a forest's criteria in configurations.
SQUARED, ABSOLUTE = "squared_error", "absolute_error"


def fit(name: str, train: DataFrame, criterion: str = SQUARED, **params: Any) -> Any:
    """A model of a kind; a forest may ask for the criterion of absolute error."""
    if criterion == SQUARED:
        return make(name, **params).fit(train)
    if name != "rf" or criterion != ABSOLUTE:
        raise ValueError(f"{name!r} knows no criterion {criterion!r}")
    return fit_median_forest(train, **params)


def grid_search(name: str, train: DataFrame, val: DataFrame, grid: dict[str, Any]) -> Search:
    """Every combination of the grid is fitted on train and judged on val. stop_early=True cuts boosted models at their best round."""
    stop_early = bool(grid.get("stop_early"))
    if stop_early and name != "gbt":
        raise ValueError(f"{name!r} has no rounds to stop at")
    train, val = train.cache(), val.cache()
    best: Search | None = None
    trials, least = [], None
    try:
        for params in param_grid({k: v for k, v in grid.items() if k != "stop_early"}):
            if stop_early:
                model, rounds = fit_boosted(train, val, **params)
            else:
                model, rounds = fit(name, train, **params), []
            mae = model.transform(val).agg(F.avg(F.abs(F.col("__y") - F.col("__p"))).alias("mae")).first()["mae"]
            trials.append(params | {"val_mae": mae} | ({"rounds": model.getNumTrees} if stop_early else {}))
            loser = model
            if mae is not None and (least is None or mae < least):
                loser, best, least = best and best.model, Search(model, params, rounds=rounds), mae
            if isinstance(loser, MedianForest):
                loser.leaves.unpersist()
    finally:
        train.unpersist()
        val.unpersist()
    if best is None:
        raise ValueError("the validation split has no rows to choose by")
    best.trials = sorted(trials, key=lambda t: (t["val_mae"] is None, t["val_mae"]))
    return best


def predict(model: Any, df: DataFrame, target: str, log: bool = False) -> DataFrame:
    """ground truth, prediction and errors, in the target's own units."""
    p = F.exp("__p") if log else F.col("__p")
    rows = model.transform(df).withColumns({f"gt_{target}": F.col(target), f"predicted_{target}": p}).drop("__x", "__y", "__p")
    return with_errors(rows, target)


def with_errors(df: DataFrame, target: str) -> DataFrame:
    e = F.col(f"predicted_{target}") - F.col(f"gt_{target}")
    pct = F.try_divide(F.abs(e), F.nullif(F.col(f"gt_{target}"), F.lit(0.0))) * 100
    return df.withColumns({"error": F.bround(e, 4), "abs_error": F.bround(F.abs(e), 4), "pct_error": F.bround(pct, 4)})


def metrics(df: DataFrame, target: str) -> DataFrame:
    return df.agg(*regression_metrics(df, f"gt_{target}", f"predicted_{target}"), within(f"gt_{target}", f"predicted_{target}").alias("within_10"))


def importance(model: Any, features: Iterable[str], spark: Any) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def dry_run(df: DataFrame, features: Iterable[str], targets: Iterable[str], split: str = "split") -> DataFrame:
    """Rows per split and missing values per feature over train and val, in one pass."""
    known: Column = F.col(split).isin("train", "val")
    found = [t for t in targets if t in df.columns]
    return df.agg(
        *[F.count_if(F.col(split) == s).alias(f"n_{s}") for s in ("train", "val", "test")],
        *[F.count_if(known & F.col(c).isNull()).alias(f"nulls_{c}") for c in features],
        F.lit(",".join(found)).alias("targets"), F.lit(",".join(t for t in targets if t not in found)).alias("missing_targets"),
    )


def temporal_split(df: DataFrame, split: str = "split") -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(df.where(F.col(split) == s) for s in ("train", "val", "test"))
