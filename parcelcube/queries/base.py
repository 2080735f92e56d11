"""The test tables seen as pixels, monthly series, deliveries and grids, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelcube.functions.indices import index

DIGITS = 6


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a small table dealt over all tasks, before each becomes many; the number is given, or else Spark would put them together again."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Sums in another order differ in their last bits."""
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


BANDS = {
    "B02": "l_discount * 100000", "B03": "nullif(l_tax, 0) * 100000", "B04": "l_quantity * 1000", "B05": "l_quantity * 700", "B06": "l_extendedprice * 0.6D", "B07": "l_extendedprice * 0.8D",
    "B08": "l_extendedprice", "B8A": "l_extendedprice * 0.9D", "B11": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice * 0.3D END",
    "VV": "l_discount", "VH": "l_tax", "LST": "l_quantity + 250", "tp": "l_discount", "ET_500m": "l_quantity", "PET_500m": "l_tax",
}


#: Where a row stands in its table.
PLACE = ("_metadata.file_path AS file", "_metadata.row_index AS row")


def pixels(spark: SparkSession, sf_dir: str, bands: Iterable[str] | None = None, more: Iterable[str] = ()) -> DataFrame:
    """lineitem as pixels: a supplier is a parcel, a row a pixel."""
    wanted = BANDS if bands is None else {b: BANDS[b] for b in bands}
    rows = read(spark, sf_dir, "lineitem")
    return rows.selectExpr("l_orderkey AS o", "l_linenumber AS ln", "l_suppkey AS parcel_id", "l_shipdate AS time", "year(l_shipdate) AS year", "month(l_shipdate) AS month", *[f"{e} AS {b}" for b, e in wanted.items()], *more)


PX = "px AS (SELECT l_orderkey AS o, l_linenumber AS ln, l_suppkey AS parcel_id, l_shipdate AS time, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, " + ", ".join(f"{e.replace('D END', ' END').replace('6D', '6').replace('8D', '8').replace('9D', '9')} AS {b}" for b, e in BANDS.items()) + " FROM lineitem)"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean NDVI (v, with gaps) and VV (w) per parcel and month."""
    px = pixels(spark, sf_dir, ("B08", "B04", "VV")).withColumn("ndvi", index("NDVI"))
    out = px.groupBy("parcel_id", "year", "month").agg(F.round(F.avg("ndvi"), DIGITS).alias("v"), F.round(F.avg("VV"), DIGITS).alias("w"))
    return out.withColumn("v", F.when((F.col("parcel_id") + F.col("month")) % 7 != 0, F.col("v")))


M = PX + """, m0 AS (SELECT parcel_id, year, month, round(avg((B08 - B04) / nullif(B08 + B04, 0)), 6) AS v, round(avg(VV), 6) AS w FROM px GROUP BY 1, 2, 3),
m AS (SELECT parcel_id, year, month, CASE WHEN (parcel_id + month) % 7 <> 0 THEN v END AS v, w FROM m0)"""


def grid(spark: SparkSession, sf_dir: str, rows: str = "vec_id") -> DataFrame:
    """embeddings as 8 x 8 images: y, x and a value per pixel."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    return e.select("vec_id", "label", (F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.col("e").cast("double").alias("v"))


G = "g AS (SELECT vec_id, label, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, unnest(range(0, 64)) AS i FROM embeddings))"
