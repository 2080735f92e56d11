"""Writers. Tables go through DataFrame writers; what the driver writes itself is small JSON."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterable, Mapping
from dataclasses import asdict, is_dataclass
from datetime import datetime
from typing import Any

from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelcube.operators.ml import MedianForest, importance
from parcelcube.operators.profile import column_profile, error_by

# Units of bands and indices, and of meta columns.
UNITS = {
    "VV": "dB", "VH": "dB", "RVI": "dimensionless", "VH_VV": "dimensionless", "DpRVI": "dimensionless",
    "B02": "reflectance", "B03": "reflectance", "B04": "reflectance", "B08": "reflectance", "B11": "reflectance", "B12": "reflectance",
    "NDVI": "dimensionless", "EVI": "dimensionless", "SAVI": "dimensionless", "NBR2": "dimensionless", "NDWI": "dimensionless",
    "LST": "K", "LST_C": "°C", "tp": "m", "TP_MM": "mm/period",
    "ET_500m": "mm/day", "PET_500m": "mm/day", "LE_500m": "J/m²/day", "PLE_500m": "J/m²/day", "ET_RATIO": "dimensionless",
}
META = {"time": "date", "parcel_key": "identifier", "sensor": "identifier", "n_samples": "count"}


LOADED: dict[str, type] = {"gbt": GBTRegressionModel, "rf": RandomForestRegressionModel}


def unit_of(column: str, strict: bool = True) -> str:
    """strict: the name without its last part decides, so single-stat names may miss; else the whole name comes first."""
    if column in META:
        return META[column]
    if not strict and column in UNITS:
        return UNITS[column]
    return UNITS.get(column.rsplit("_", 1)[0], "unknown")


def unit_column(c: Column) -> Column:
    """unit_of as an expression over column names."""
    table = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    meta = F.create_map(*[F.lit(x) for pair in META.items() for x in pair])
    return F.coalesce(F.try_element_at(meta, c), F.try_element_at(table, F.regexp_replace(c, "_[^_]*$", "")), F.lit("unknown"))


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    """One JSON document, through Spark, so any file system works."""
    spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def export(df: DataFrame, directory: str, name: str, config: Any = None, kind: str = "csv") -> str:
    """Table, metadata (rows, ranges, units) and configuration side by side; returns the table's path."""
    spark, path = df.sparkSession, f"{directory.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)
    profile = [r.asDict() | {"unit": unit_of(r["column"])} for r in column_profile(df).collect()]  # one row per column
    write_json(spark, {"rows": profile[0]["rows"] if profile else df.count(), "columns": profile, "created": datetime.now().isoformat()}, f"{path}_metadata")
    if config is not None:
        write_json(spark, asdict(config) if is_dataclass(config) else config, f"{path}_config")
    return path


def export_quoted(df: DataFrame, path: str) -> None:
    """Lists as JSON text, everything quoted."""
    text = {c: F.to_json(c) for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))}
    df.withColumns(text).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def save_predictions(df: DataFrame, path: str, target: str, by: str = "variety") -> None:
    columns = [c for c in ("parcel_id", "year", by, f"gt_{target}", f"predicted_{target}", "error", "abs_error", "pct_error") if c in df.columns]
    df.select(*columns).write.mode("overwrite").option("header", True).csv(f"{path}/predictions")
    if by in df.columns:
        variety_errors(df, by).write.mode("overwrite").option("header", True).csv(f"{path}/error_by_{by}")


def variety_errors(df: DataFrame, by: str = "variety") -> DataFrame:
    out = error_by(df, by)
    return out.withColumns({c: F.bround(c, 3) for c in ("mae", "me", "rmse", "mape")}).orderBy(F.desc("mae"), by)


def save_importance(df: DataFrame, path: str) -> None:
    df.orderBy(F.desc("importance"), "feature").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def summary(spark: SparkSession, rows: Iterable[dict[str, Any]]) -> DataFrame:
    """One row per target: sizes, parameters as JSON, metrics."""
    flat = [(r["target"], r["model"], int(r["n_train"]), int(r["n_val"]), json.dumps(r["params"], sort_keys=True), *[float(r[m]) for m in ("mae", "rmse", "r2", "mape")]) for r in rows]
    return spark.createDataFrame(flat, "target string, model string, n_train long, n_val long, params string, mae double, rmse double, r2 double, mape double")


def save_experiment(spark: SparkSession, directory: str, dataset: DataFrame, config: Any, log: dict[str, Any]) -> None:
    dataset.write.mode("overwrite").option("header", True).csv(f"{directory}/dataset")
    write_json(spark, asdict(config) if is_dataclass(config) else config, f"{directory}/config")
    write_json(spark, log, f"{directory}/run_log")


def save_training(spark: SparkSession, directory: str, results: Mapping[tuple[str, str], Mapping[str, Any]], by: str = "variety") -> None:
    """What a training made, a folder per model and target: predictions per split, importances, the model, the rows left out, and its figures as JSON."""
    for (name, target), r in results.items():
        place = f"{directory.rstrip('/')}/{name}/{target}"
        for split, df in r["predictions"].items():
            save_predictions(df, f"{place}/{split}", target, by)
        save_importance(importance(r["model"], r["features"], spark), f"{place}/importance")
        save_model(r["model"], f"{place}/model")
        r["dropped"].withColumn("missing", F.array_join("missing", ",")).write.mode("overwrite").option("header", True).csv(f"{place}/dropped")
        write_json(spark, {k: r[k] for k in ("params", "trials", "rounds", "features", "metrics")}, f"{place}/result")


def write_cube(df: DataFrame, path: str, bands: Iterable[str]) -> None:
    """Pixels with their bands sorted by name, partitioned by sensor."""
    rest = [c for c in df.columns if c not in set(bands)]
    df.select(*rest, *sorted(bands)).write.mode("overwrite").partitionBy("sensor").parquet(path)


def run_metadata(config: Any, results: dict[str, Any], started: datetime, finished: datetime, dry: bool = False) -> dict[str, Any]:
    return {
        "run_id": f"{started:%Y%m%d_%H%M%S}", "config": asdict(config) if is_dataclass(config) else config, "dry_run": dry, "started_at": started.isoformat(), "finished_at": finished.isoformat(),
        "duration_seconds": round((finished - started).total_seconds(), 1), "parcels_total": len(results), "parcels": results,
    }


def save_model(model: Any, path: str) -> None:
    if isinstance(model, MedianForest):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_model(name: str, path: str) -> Any:
    """A model that save_model() wrote; name is that of its kind in operators.ml."""
    if name == "rf_median":
        return MedianForest.load(SparkSession.active(), path)
    if name not in LOADED:
        raise ValueError(f"unknown model {name!r}; known are {sorted([*LOADED, 'rf_median'])}")
    return LOADED[name].load(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where it is unset, a local one in local mode (as in tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="parcelcube-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
