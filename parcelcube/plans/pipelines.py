"""The pipelines as plans: pixels to a statistics table, series to features, features to models."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from parcelcube.functions import bands as B
from parcelcube.functions import geometry as G
from parcelcube.functions.indices import compute_indices
from parcelcube.operators import features as X
from parcelcube.operators import ml
from parcelcube.operators.clip import clip
from parcelcube.operators.relational import feature_columns, incomplete
from parcelcube.operators.spatial import fuse, interpolate, spatial_stats
from parcelcube.operators.temporal import composite
from parcelcube.plans.config import DatasetConfig, FeaturesConfig, TrainingConfig
from parcelcube.sources.readers import read_yaml

PIXEL = ["parcel_id", "sensor", "y", "x", "y_coord", "x_coord"]
BEFORE: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {
    "sentinel2": lambda df, bands: B.scale_reflectance(df, bands),
    "era5": lambda df, bands: df.withColumns({b: B.deaccumulate(F.col(b)) for b in bands if b == "tp"}),
}
AFTER: dict[str, Callable[[DataFrame], DataFrame]] = {"sentinel1": lambda df: df.withColumns({b: B.decibel(F.col(b)) for b in ("VV", "VH") if b in df.columns})}


def sensor_series(cube: DataFrame, sensor: str, config: DatasetConfig, aoi: DataFrame | None = None, bands: list[str] | None = None) -> DataFrame:
    """One sensor's pixels to one row per (parcel, year, month): calibrate, mask, composite, indices, decibels, statistics."""
    own = config.sensors[sensor]
    bands = bands or [c for c in cube.columns if c not in {*PIXEL, "time"}]
    df = BEFORE.get(sensor, lambda d, _: d)(cube, bands)
    if config.mask_for(sensor) and aoi is not None:
        df = clip(df, aoi, config.cell, config.erosion_for(sensor), bands=tuple(bands))
    t = config.temporal_for(sensor)
    at = "time"
    if t.freq or t.window:
        df = composite(df, PIXEL, bands, t.freq, t.agg or "median", t.window, t.rolling_agg)
        at = "bucket" if t.freq else "time"
    df = AFTER.get(sensor, lambda d: d)(compute_indices(df, own.indices))
    layers = [*bands, *[i for i in own.indices if i in df.columns and i not in bands]]
    keys = ["parcel_id", "sensor", F.year(at).alias("year"), F.month(at).alias("month"), F.col(at).alias("time")]
    return spatial_stats(df, keys, layers, config.stats_for(sensor), own.output_bands)


def dataset(cubes: Mapping[str, DataFrame], config: DatasetConfig, aoi: DataFrame | None = None) -> DataFrame:
    """All sensors, united by name; fused: one row per (parcel, year, month), sensors in the order of the configuration."""
    out: DataFrame | None = None
    for rank, (sensor, cube) in enumerate(cubes.items()):
        rows = sensor_series(cube, sensor, config, aoi).withColumn("__rank", F.lit(rank))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sensor is given")
    if not config.fuse:
        return out.drop("__rank", "time")
    values = [c for c in out.columns if c not in {"parcel_id", "sensor", "year", "month", "time", "__rank"}]
    return fuse(out, ["parcel_id", "year", "month"], values, ["__rank", "time"], totals=["n_samples"])


@dataclass
class Run:
    """Rows of the parcels that went through, what became of every parcel and sensor, and the counts of the run.

    counts.get waits until rows has been read; it holds n_rows and n_parcels, the latter to within about 5 %.
    """

    rows: DataFrame
    report: DataFrame
    counts: Observation = field(default_factory=Observation)


def parcel_report(cubes: Mapping[str, DataFrame], config: DatasetConfig, aoi: DataFrame) -> DataFrame:
    """One row per parcel and sensor: status (done, missing, failed, skipped), stage and reason of a failure, number of pixels.

    Parcels are those of aoi and of the cubes. Missing is a parcel without pixels of a sensor: no fault. Failed are pixels without a time or
    a place, and where a sensor is masked, a parcel without a shape, with points that have no coordinates, without area, or with two shapes. What
    follows a failure in the order of the sensors is skipped. Only keys and places of the pixels are read.
    """
    sensors = list(cubes)
    ranks = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("sensor"), F.lit(config.mask_for(s)).alias("masked")) for i, s in enumerate(sensors)])
    seen: DataFrame | None = None
    for sensor, cube in cubes.items():
        lost = F.greatest(*[F.col(c).isNull() for c in ("time", "y", "x", "y_coord", "x_coord")])
        found = cube.groupBy("parcel_id").agg(F.count("*").alias("n_pixels"), F.count_if(lost).alias("n_lost")).withColumn("sensor", F.lit(sensor))
        seen = found if seen is None else seen.unionByName(found)
    if seen is None:
        raise ValueError("no sensor is given")
    blank = F.exists("shape", lambda ring: ring.isNull() | F.exists(ring, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"])))
    fault = F.when(F.col("shape").isNull(), "no shape").when(blank, "points without coordinates").when(G.area(F.col("shape")) <= 0, "no area")
    shapes = aoi.groupBy("parcel_id").agg(F.count("*").alias("n"), F.max(fault).alias("fault"))
    shapes = shapes.select("parcel_id", F.when(F.col("n") > 1, "more than one shape").otherwise(F.col("fault")).alias("fault"), F.lit(True).alias("listed"))
    parcels = seen.select("parcel_id").union(aoi.select("parcel_id")).where("parcel_id IS NOT NULL").distinct().join(shapes, "parcel_id", "left")
    asked = parcels.select("parcel_id", F.when(F.col("listed"), F.col("fault")).otherwise("no shape").alias("fault"), F.inline(ranks))
    met = asked.join(seen, ["parcel_id", "sensor"], "left").withColumn("n_pixels", F.coalesce("n_pixels", F.lit(0)))
    stage = F.when(F.col("n_pixels") == 0, None).when(F.col("n_lost") > 0, "scan").when(F.col("masked") & F.col("fault").isNotNull(), "mask")
    reason = F.when(stage == "scan", F.concat(F.col("n_lost"), F.lit(" pixels without a time or a place"))).when(stage == "mask", F.col("fault"))
    first = F.min(F.when(F.col("stage").isNotNull(), F.col("rank"))).over(Window.partitionBy("parcel_id"))  # a parcel has as many rows as there are sensors
    judged = met.withColumns({"stage": stage, "reason": reason}).withColumn("first", first)
    status = F.when(F.col("n_pixels") == 0, "missing").when(F.col("rank") > F.col("first"), "skipped").when(F.col("rank") == F.col("first"), "failed").otherwise("done")
    failed = status == "failed"
    return judged.select("parcel_id", "sensor", status.alias("status"), F.when(failed, F.col("stage")).alias("stage"), F.when(failed, F.col("reason")).alias("reason"), "n_pixels")


def isolated_dataset(cubes: Mapping[str, DataFrame], config: DatasetConfig, aoi: DataFrame) -> Run:
    """dataset() without the pixels of failed and skipped parcels and sensors, so that a broken parcel stops no other."""
    report = parcel_report(cubes, config, aoi)
    gone = report.where(F.col("status").isin("failed", "skipped")).select("parcel_id", "sensor")
    kept = {s: cube.join(gone.where(F.col("sensor") == s).select("parcel_id"), "parcel_id", "left_anti").where("parcel_id IS NOT NULL") for s, cube in cubes.items()}
    run = Run(dataset(kept, config, aoi.where("shape IS NOT NULL").dropDuplicates(["parcel_id"])), report)
    run.rows = run.rows.observe(run.counts, F.count("*").alias("n_rows"), F.approx_count_distinct("parcel_id").alias("n_parcels"))
    return run


def extract_features(series: DataFrame, config: FeaturesConfig, months: list[int] | None = None) -> DataFrame:
    """One groupBy over (parcel, year) for all extractors; later ones win equal names."""
    columns = [c for c in config.columns if c in series.columns]
    if "time" in series.columns and "month" not in series.columns:
        series = series.withColumns({"year": F.year("time"), "month": F.month("time")})
    if config.interpolate:
        series = interpolate(series, X.K, columns)
    phases = config.phases or X.PHASES
    aggs = []
    if config.monthly:
        aggs += X.monthly_pivot(columns, months or range(3, 10))
    if config.phase_aggs:
        aggs += X.phase_aggregates(columns, config.phase_aggs, phases)
    if config.deltas:
        series = X.temporal_deltas(series, columns)
        aggs += [F.max(F.when(F.col("month") == m, F.col(f"{c}_delta"))).alias(f"{c}_delta_month{m}") for c in columns for m in (months or range(1, 13))]
    if config.peak:
        aggs += X.peak(columns)
    if config.season:
        aggs += X.season_points(columns)
    if config.phase_delta:
        aggs += X.phase_deltas(columns, "mean", phases)
    if config.integrals:
        aggs += X.phase_integrals(config.integral_columns or columns, list(config.integrals), config.integrals)
    if config.flags:
        aggs += X.boolean_flags(columns, phases)
    out = series.groupBy(*X.K).agg(*aggs) if aggs else series.select(*X.K).distinct()
    return X.season_columns(out, columns) if config.season else out


def features(series: DataFrame, targets: DataFrame, config: FeaturesConfig) -> DataFrame:
    out = X.merge_targets(extract_features(series, config), targets, config.targets, config.merge)
    if config.static:
        out = X.static_features(out)
    return X.drop_sparse_columns(out, config.max_null_pct, (*config.merge, *config.targets))


def training(table: DataFrame, config: TrainingConfig) -> dict[tuple[str, str], dict[str, Any]]:
    """Per model and target: chosen parameters, trials, predictions with their metrics on val and test, and the rows left out for want of a feature."""
    out: dict[tuple[str, str], dict[str, Any]] = {}
    columns = feature_columns(table, config.targets)
    dropped = incomplete(table, [c for c in ("parcel_id", "year") if c in table.columns], columns)
    for name, grid in config.models.items():
        for target in config.targets:
            train, val, test = ml.temporal_split(ml.assemble(table, columns, target, config.log_target), config.split)
            found = ml.grid_search(name, train, val, dict(grid))
            predictions = {s: ml.predict(found.model, d, target, config.log_target) for s, d in (("val", val), ("test", test)) if not d.isEmpty()}
            out[name, target] = {"model": found.model, "params": found.params, "trials": found.trials, "rounds": found.rounds, "features": columns, "dropped": dropped, "predictions": predictions, "metrics": {s: ml.metrics(d, target).first().asDict() for s, d in predictions.items()}}
    return out


def month_windows(df: DataFrame, years: str = "years") -> DataFrame:
    """One row per month of every listed year: first and last day."""
    return df.select("*", F.explode(years).alias("__y")).select("*", F.explode(F.sequence(F.make_date("__y", F.lit(1), F.lit(1)), F.make_date("__y", F.lit(12), F.lit(1)), F.expr("interval 1 month"))).alias("date_from")).withColumn("date_to", F.last_day("date_from")).drop("__y")


def split_range(df: DataFrame, start: str, end: str, n: int) -> DataFrame:
    """n windows of equal days over [start, end]; the remainder goes to the last one."""
    days = F.datediff(end, start) + 1
    size = F.floor(days / n).cast("int")
    out = df.withColumns({"__size": size}).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("window"))
    first = F.date_add(F.col(start), F.col("window") * F.col("__size"))
    last = F.when(F.col("window") == n - 1, F.col(end)).otherwise(F.date_add(F.col(start), (F.col("window") + 1) * F.col("__size") - 1))
    return out.withColumns({"date_from": first, "date_to": last}).drop("__size")


def acquisition_tasks(parcels: DataFrame, sensors: list[str]) -> DataFrame:
    """parcel x sensor x month windows."""
    return month_windows(parcels.select("*", F.explode(F.array(*[F.lit(s) for s in sensors])).alias("sensor")))


STEPS: dict[str, Callable[..., Any]] = {"dataset": dataset, "isolated_dataset": isolated_dataset, "features": features, "training": training}


def run_step(name: str, *args: Any, **kwargs: Any) -> Any:
    """Runs a step by name; errors are raised."""
    if name not in STEPS:
        raise ValueError(f"unknown step {name!r}; known are {sorted(STEPS)}")
    return STEPS[name](*args, **kwargs)


def resolve_config(step: str, experiment: str | Path | None = None, defaults: str | Path | None = None) -> Path | None:
    """The configuration file of a step: that of the experiment's folder, else that of the defaults, else none."""
    if step not in STEPS:
        raise ValueError(f"unknown step {step!r}; known are {sorted(STEPS)}")
    found = (Path(d) / f"{step}.yml" for d in (experiment, defaults) if d is not None)
    return next((f for f in found if f.is_file()), None)


def run_steps(runners: Mapping[str, Callable[[dict[str, Any]], Any]], experiment: str | Path | None = None, defaults: str | Path | None = None) -> dict[str, dict[str, Any]]:
    """Runs each step's function on its configuration, in order: per step its file, seconds and result, or the status skipped where it has no file.

    A runner gets the content of the YAML file. Its errors stop the run.
    """
    out: dict[str, dict[str, Any]] = {}
    files = {step: resolve_config(step, experiment, defaults) for step in runners}
    for step, file in files.items():
        if file is None:
            out[step] = {"status": "skipped", "config": None}
            continue
        started = time.monotonic()
        result = runners[step](read_yaml(str(file)))
        out[step] = {"status": "done", "config": str(file), "seconds": round(time.monotonic() - started, 1), "result": result}
    return out


def session(app: str = "parcelcube", partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    return (builder.config("spark.sql.shuffle.partitions", partitions) if partitions else builder).getOrCreate()
