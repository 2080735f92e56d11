"""Readers. Raster stores come in as long pixel tables; everything numeric is cleared of NaN and infinities."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelcube.functions.bands import finite
from parcelcube.functions.geometry import parse_wkt
from parcelcube.operators.spatial import unpack
from parcelcube.operators.temporal import first_per_time

PIXELS = "parcel_id string, sensor string, part string, time timestamp_ntz, variable string, y int, x int, y_coord double, x_coord double, value double"
AOI = "parcel_id string, geometry string, parcel_geometry string, years string, municipality string"


class Loader(Protocol):
    """Anything that gives the pixels of some parcels and a sensor."""

    def load(self, sensor: str, parcels: Iterable[str] | None = None) -> DataFrame: ...


def without_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


class PixelTable:
    """Pixel table in Parquet, partitioned by sensor; a missing sensor gives no rows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.df = without_nan(spark.read.parquet(path))

    def load(self, sensor: str, parcels: Iterable[str] | None = None) -> DataFrame:
        out = self.df.where(F.col("sensor") == sensor)
        return out if parcels is None else out.where(F.col("parcel_id").isin(list(parcels)))

    def cube(self, sensor: str, variables: Iterable[str], parcels: Iterable[str] | None = None) -> DataFrame:
        """One column per band; of overlapping parts the first wins."""
        keys = ["parcel_id", "sensor", "time", "y", "x", "y_coord", "x_coord"]
        rows = self.load(sensor, parcels)
        if "part" in rows.columns:
            rows = first_per_time(rows, ["parcel_id", "sensor", "time", "variable", "y", "x"], ["part"])
        return unpack(rows, keys, variables)


def read_parts(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Parts of a split store, united by column names, numbered in the order of their sorted paths."""
    parts = [spark.read.parquet(p).withColumn("part", F.lit(f"{i:06d}")) for i, p in enumerate(sorted(paths))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header; without a schema every column is text."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_aoi(spark: SparkSession, path: str) -> DataFrame:
    """Areas of interest with their rings parsed and years as sorted numbers."""
    rows = read_csv(spark, path)
    first = rows.columns[0].lstrip("﻿")
    rows = rows.withColumnRenamed(rows.columns[0], first)
    shape = F.coalesce(F.col("parcel_geometry"), F.col("geometry")) if "parcel_geometry" in rows.columns else F.col("geometry")
    out = rows.withColumn("shape", parse_wkt(shape))
    return out.withColumn("years", F.array_sort(F.from_json("years", "array<int>"))) if "years" in rows.columns else out


def read_processed(df: DataFrame, key: str = "parcel_id", time: str = "time", numeric: Iterable[str] = ()) -> DataFrame:
    """Values that do not parse become null; rows without key or time go; year and day of year are added."""
    out = df.withColumn(time, F.try_to_timestamp(F.col(time).cast("string"))).withColumns({c: F.col(c).try_cast("double") for c in numeric})
    return out.dropna(subset=[key, time]).withColumns({"year": F.year(time), "doy": F.dayofyear(time)})


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """Quality documents, one per file."""
    return spark.read.option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def json_path(c: Column, *path: str) -> Column:
    """A chain of keys into JSON text, null where one is missing."""
    return F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path))


def catalog(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Distinct entries of a table of files."""
    return df.select(*keys).distinct()


def bands_of(df: DataFrame, scene: str = "scene_id", band: str = "band") -> DataFrame:
    """Sorted bands per scene; RGB is added where its three bands exist."""
    found = df.groupBy(scene).agg(F.array_sort(F.collect_set(band)).alias("bands"))
    whole = F.size(F.array_intersect("bands", F.array(*[F.lit(b) for b in ("B02", "B03", "B04")]))) == 3
    return found.withColumn("bands", F.when(whole, F.concat(F.array(F.lit("RGB")), "bands")).otherwise(F.col("bands")))


def band_prefix(stem: Column) -> Column:
    """The band at the start of a raster's file name."""
    return F.get(F.split(stem, r"_(S[123][AB]_|granule_|ERA5L_|__tmp_)", 2), F.lit(0))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("file", F.input_file_name())


def read_yaml(path: str) -> dict:
    """A configuration file as a dict."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}
