"""Geometry, composites and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelcube.catalog import register
from parcelcube.functions import geometry as G
from parcelcube.functions import raster as V
from parcelcube.operators import ml
from parcelcube.operators.clip import clip
from parcelcube.operators.dissolve import dissolve
from parcelcube.operators.relational import split_by_year
from parcelcube.operators.spatial import nearest_pixel
from parcelcube.plans import panels, pipelines
from parcelcube.plans.config import DatasetConfig
from parcelcube.queries.base import G as GRID
from parcelcube.queries.base import PLACE, grid, pixels, read, spread

_BOX = "b AS (SELECT s_suppkey AS parcel_id, CAST(100000 + s_suppkey * 10 AS DOUBLE) AS x0, CAST(5000000 + s_suppkey * 20 AS DOUBLE) AS y0, CAST(100050 + s_suppkey * 11 AS DOUBLE) AS x1, CAST(5000040 + s_suppkey * 23 AS DOUBLE) AS y1 FROM supplier)"


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS parcel_id", "100000D + s_suppkey * 10 AS x0", "5000000D + s_suppkey * 20 AS y0", "100050D + s_suppkey * 11 AS x1", "5000040D + s_suppkey * 23 AS y1")
    wkt = F.expr("concat('POLYGON ((', x0, ' ', y0, ', ', x1, ' ', y0, ', ', x1, ' ', y1, ', ', x0, ' ', y1, ', ', x0, ' ', y0, '))')")
    return s.withColumn("wkt", wkt).withColumn("shape", G.parse_wkt(F.col("wkt")))


@register("wkt_bbox", f"WITH {_BOX} SELECT parcel_id, x0 - 500 AS minx, y0 - 500 AS miny, x1 + 500 AS maxx, y1 + 500 AS maxy FROM b")
def wkt_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir).select("parcel_id", G.bounds(F.col("shape"), 500).alias("b")).select("parcel_id", "b.*")


@register("polygon_area", f"WITH {_BOX} SELECT parcel_id, round((x1 - x0) * (y1 - y0), 3) AS area FROM b")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir).select("parcel_id", F.round(G.ring_area(F.get("shape", F.lit(0))), 3).alias("area"))


_LONLAT = "degrees({x} / 6378137.0) AS lon, degrees(2 * atan(exp({y} / 6378137.0)) - pi() / 2) AS lat"


@register("mercator_to_wgs84", f"WITH {_BOX} SELECT parcel_id, round(lon, 9) AS lon, round(lat, 9) AS lat FROM (SELECT parcel_id, {_LONLAT.format(x='x0', y='y0')} FROM b)")
def mercator_to_wgs84(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir).select("parcel_id", F.round(G.to_lon(F.col("x0")), 9).alias("lon"), F.round(G.to_lat(F.col("y0")), 9).alias("lat"))


@register("wgs84_to_mercator", f"WITH {_BOX} SELECT parcel_id, round(x0, 3) AS x, round(y0, 3) AS y FROM b")
def wgs84_to_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir).select("parcel_id", F.round(G.to_x(G.to_lon(F.col("x0"))), 3).alias("x"), F.round(G.to_y(G.to_lat(F.col("y0"))), 3).alias("y"))


_N = 1 / 298.257222101 / (2 - 1 / 298.257222101)
_E = 2 * _N**0.5 / (1 + _N)
_A = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_R = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


@register("utm_points", f"""WITH {_BOX}, l AS (SELECT parcel_id, radians(lon - 3) AS dl, radians(lat) AS p FROM (SELECT parcel_id, {_LONLAT.format(x='x0', y='y0')} FROM b)), t AS (SELECT *, sinh(atanh(sin(p)) - {_E!r} * atanh({_E!r} * sin(p))) AS t FROM l),
u AS (SELECT parcel_id, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t)
SELECT parcel_id, round(500000 + {0.9996 * _R!r}::DOUBLE * (eta + {' + '.join(f'{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)' for j, a in enumerate(_A, 1))}), 3) AS x, round({0.9996 * _R!r}::DOUBLE * (xi + {' + '.join(f'{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)' for j, a in enumerate(_A, 1))}), 3) AS y FROM u""")
def utm_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _shapes(spark, sf_dir).select("parcel_id", G.to_utm(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))).alias("p"))
    return p.select("parcel_id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@register("geojson", f"WITH {_BOX} SELECT parcel_id, '{{\"type\":\"Polygon\",\"coordinates\":[[[' || printf('%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f', x0/1e5*100000, y0/1e5*100000, x1, y0, x1, y1, x0, y1, x0, y0) || ']]]}}' AS g FROM (SELECT parcel_id, CAST(x0 - 100000 AS DOUBLE) AS x0, CAST(y0 - 5000000 AS DOUBLE) AS y0, CAST(x1 - 100000 AS DOUBLE) AS x1, CAST(y1 - 5000000 AS DOUBLE) AS y1 FROM b)")
def geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shapes(spark, sf_dir).withColumn("shape", F.transform("shape", lambda r: F.transform(r, lambda p: F.struct((p["x"] - 100000).alias("x"), (p["y"] - 5000000).alias("y")))))
    return s.select("parcel_id", G.geojson(F.col("shape")).alias("g"))


def _many_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping boxes of a side that grows with the supplier's number, the first with a hole; every third one drawn clockwise."""
    s = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS parcel_id", "CAST(s_suppkey AS double) AS x0", "40D + s_suppkey % 7 AS side")
    box = lambda x, y, side, back="false": f"""CASE WHEN {back} THEN concat('(', {x}, ' ', {y}, ',', {x}, ' ', {y} + {side}, ', ', {x} + {side}, ' ', {y} + {side}, ', ', {x} + {side}, ' ', {y}, ',', {x}, ' ', {y}, ')')
        ELSE concat('(', {x}, ' ', {y}, ', ', {x} + {side}, ' ', {y}, ', ', {x} + {side}, ' ', {y} + {side}, ', ', {x}, ' ', {y} + {side}, ', ', {x}, ' ', {y}, ')') END"""  # noqa: E731
    wkt = f"concat('MULTIPOLYGON ((', {box('x0', '0D', 'side', 'parcel_id % 3 = 0')}, ', ', {box('x0 + 10', '10D', '10D', 'parcel_id % 2 = 0')}, '), (', {box('x0 + 30', '15D', 'side')}, '))')"
    return s.withColumn("shape", G.parse_wkt(F.expr(wkt)))


@register("multipart_area", "SELECT s_suppkey AS parcel_id, CAST(2 * side * side - 100 AS DOUBLE) AS area FROM (SELECT s_suppkey, 40 + s_suppkey % 7 AS side FROM supplier)")
def multipart_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _many_parts(spark, sf_dir).select("parcel_id", G.area(F.col("shape")).alias("area"))


@register("multipart_contains", """SELECT s_suppkey AS parcel_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT s_suppkey, 40 + s_suppkey % 7 AS side FROM supplier), (SELECT unnest(range(0, 40)) * 2.5 + 0.25 AS x), (SELECT unnest(range(0, 40)) * 2.5 + 0.25 AS y)
WHERE (x BETWEEN 0 AND side AND y BETWEEN 0 AND side AND NOT (x BETWEEN 10 AND 20 AND y BETWEEN 10 AND 20)) OR (x BETWEEN 30 AND 30 + side AND y BETWEEN 15 AND 15 + side) GROUP BY 1""")
def multipart_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = spread(_many_parts(spark, sf_dir), "parcel_id").select("parcel_id", "x0", G.steep_edges(F.col("shape")).alias("steep"))
    lines = shapes.select("parcel_id", "x0", "steep", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("j")).select("parcel_id", "x0", G.crossings(F.col("steep"), F.col("j") * 2.5 + 0.25).alias("crossed"))
    points = lines.select("parcel_id", "x0", "crossed", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i"))
    return points.where(G.among(F.col("crossed"), F.col("x0") + F.col("i") * 2.5 + 0.25)).groupBy("parcel_id").agg(F.count("*").alias("n"))


@register("multipart_geojson", """SELECT s_suppkey AS parcel_id, 'MultiPolygon' AS kind, CAST(2 AS INTEGER) AS n_parts, CAST(2 AS INTEGER) AS n_rings, true AS same FROM supplier""")
def multipart_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and holes stay where they are on the way to GeoJSON and back."""
    text = _many_parts(spark, sf_dir).withColumn("text", G.geojson(F.col("shape")))
    back = text.withColumn("again", G.parse_wkt(G.wkt_of_geojson(F.col("text"))))
    first = F.get(F.from_json(F.get_json_object("text", "$.coordinates"), "array<array<array<array<double>>>>"), F.lit(0))
    listed = F.from_json(F.get_json_object("text", "$.coordinates"), "array<array<array<array<double>>>>")
    return back.select("parcel_id", F.get_json_object("text", "$.type").alias("kind"), F.size(listed).alias("n_parts"), F.size(first).alias("n_rings"), (F.col("again") == F.col("shape")).alias("same"))


_CELLS = "c AS (SELECT parcel_id, x0, y0, x1, y1, CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, x0 - 33.5 + 10 * i AS px, y0 - 33.5 + 10 * j AS py FROM b, (SELECT unnest(range(0, 12)) AS i), (SELECT unnest(range(0, 12)) AS j)), d AS (SELECT *, greatest(x0 - px, 0, px - x1) AS dx, greatest(y0 - py, 0, py - y1) AS dy, least(px - x0, x1 - px, py - y0, y1 - py) AS depth FROM c)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spread(_shapes(spark, sf_dir), "parcel_id").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return s.withColumns({"x_coord": F.col("x0") - 33.5 + 10 * F.col("x"), "y_coord": F.col("y0") - 33.5 + 10 * F.col("y"), "sensor": F.lit("S2")})


@register("polygon_mask", f"WITH {_BOX}, {_CELLS} SELECT parcel_id, x, y FROM d WHERE depth > 0 OR sqrt(dx * dx + dy * dy) <= 15")
def polygon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mask(_cells(spark, sf_dir), "shape", 10.0).select("parcel_id", "x", "y")


@register("polygon_mask_eroded", f"WITH {_BOX}, {_CELLS}, h AS (SELECT *, depth > 0 AND depth >= 15 AS hit FROM d), k AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY parcel_id) AS n, first_value(x) OVER (PARTITION BY parcel_id ORDER BY abs(px - (x0 + x1) / 2), x) AS nx, first_value(y) OVER (PARTITION BY parcel_id ORDER BY abs(py - (y0 + y1) / 2), y) AS ny FROM h) SELECT parcel_id, x, y FROM k WHERE CASE WHEN n > 0 THEN hit ELSE x = nx AND y = ny END")
def polygon_mask_eroded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mask(_cells(spark, sf_dir), "shape", 10.0, 2.0).select("parcel_id", "x", "y")


@register("polygon_clip", f"WITH {_BOX}, {_CELLS} SELECT parcel_id, x, y FROM d WHERE pow(greatest(dx - 5, 0), 2) + pow(greatest(dy - 5, 0), 2) <= 100")
def polygon_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that touch a box grown by a cell, round at its corners."""
    return clip(_cells(spark, sf_dir), _shapes(spark, sf_dir), 10.0).select("parcel_id", "x", "y")


@register("polygon_clip_eroded", f"WITH {_BOX}, {_CELLS} SELECT parcel_id, x, y FROM d WHERE px + 5 >= x0 + 20 AND px - 5 <= x1 - 20 AND py + 5 >= y0 + 20 AND py - 5 <= y1 - 20")
def polygon_clip_eroded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip(_cells(spark, sf_dir), _shapes(spark, sf_dir), 10.0, 2.0).select("parcel_id", "x", "y")


_LOTS = "c_nationkey, CAST(c_custkey * 31 % 197 AS INTEGER) AS x0, CAST(c_custkey * 17 % 179 AS INTEGER) AS y0, CAST(1 + c_custkey % 9 AS INTEGER) AS w, CAST(1 + c_custkey % 7 AS INTEGER) AS h"


@register("dissolve_area", f"""WITH l AS (SELECT {_LOTS} FROM customer), c AS (SELECT DISTINCT c_nationkey, x, y0 + unnest(range(0, h)) AS y FROM (SELECT c_nationkey, y0, h, x0 + unnest(range(0, w)) AS x FROM l))
SELECT c_nationkey AS nation, CAST(count(*) AS DOUBLE) AS area, CAST(min(x) AS DOUBLE) AS minx, CAST(min(y) AS DOUBLE) AS miny, CAST(max(x) + 1 AS DOUBLE) AS maxx, CAST(max(y) + 1 AS DOUBLE) AS maxy FROM c GROUP BY 1""")
def dissolve_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as boxes on whole coordinates, which overlap, touch and nest: area and bounds of their union per nation."""
    lots = read(spark, sf_dir, "customer").selectExpr(*_LOTS.split(", "))
    at = lambda x, y: F.struct((F.col("x0") + x).cast("double").alias("x"), (F.col("y0") + y).cast("double").alias("y"))
    w, h, o = F.col("w"), F.col("h"), F.lit(0)
    boxes = lots.select(F.col("c_nationkey").alias("nation"), F.array(F.array(at(o, o), at(w, o), at(w, h), at(o, h), at(o, o))).alias("shape"))
    united = dissolve(boxes, ["nation"])
    return united.select("nation", F.round(G.area(F.col("shape")), 6).alias("area"), G.bounds(F.col("shape")).alias("b")).select("nation", "area", "b.*")


@register("nearest_pixel", f"WITH {_BOX}, {_CELLS} SELECT parcel_id, first(x ORDER BY abs(px - 100100), x) AS x, first(y ORDER BY abs(py - 5000123), y) AS y FROM c GROUP BY 1")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_pixel(_cells(spark, sf_dir), ["parcel_id"], F.lit(100100), F.lit(5000123))


_LON, _LAT = "round(degrees({} / 6378137.0), 9)", "round(degrees(2 * atan(exp({} / 6378137.0)) - pi() / 2), 9)"


@register("raster_bounds", f"WITH {_BOX}, {_CELLS} SELECT parcel_id, {_LON.format('(min(px) - 5)')} AS west, {_LAT.format('(min(py) - 5)')} AS south, {_LON.format('(max(px) + 5)')} AS east, {_LAT.format('(max(py) + 5)')} AS north FROM c GROUP BY 1")
def raster_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.raster_bounds(_cells(spark, sf_dir), ("parcel_id",))
    return b.select("parcel_id", *[F.round(c, 9).alias(c) for c in ("west", "south", "east", "north")])


@register("world_to_pixel", f"WITH {_BOX} SELECT parcel_id, round((x1 - (x0 - 33.5)) / 110 * 11, 6) AS column_position FROM b")
def world_to_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("x0") - 33.5
    return _shapes(spark, sf_dir).select("parcel_id", F.round(G.world_to_pixel(F.col("x1"), first, first + 110, F.lit(12)), 6).alias("column_position"))


_CURVE = "(pow(({a} * ({a} * (0.13 / 3.0) - 1.0)) / ({a} * (2.0 * (0.13 / 3.0) - 1.0) - 0.13 / 3.0) + 0.01, 1.8) - pow(0.01, 1.8)) / (pow(1.01, 1.8) - pow(0.01, 1.8))"


@register("rgb_composite", f"""WITH {GRID}, s AS (SELECT vec_id, y, x, least(greatest(v / 3.0, 0), 1) AS r0, least(greatest(v * 2 / 3.0, 0), 1) AS g0, least(greatest((v + 0.2) / 3.0, 0), 1) AS b0 FROM g), c AS (SELECT vec_id, y, x, {_CURVE.format(a='r0')} AS r, {_CURVE.format(a='g0')} AS g, {_CURVE.format(a='b0')} AS b FROM s),
e AS (SELECT vec_id, y, x, unnest(['r', 'g', 'b']) AS k, unnest([r, g, b]) * 1.2 + (r + g + b) / 3.0 * (1.0 - 1.2) AS z FROM c), w AS (SELECT *, least(greatest(z, 0), 1) AS q FROM e), f AS (SELECT *, CASE WHEN q <= 0.0031308 THEN 12.92 * q ELSE 1.055 * pow(q, 0.41666666666) - 0.055 END AS o FROM w)
SELECT vec_id, y, x, CAST(max(floor(least(greatest(o, 0), 1) * 255)) FILTER (k = 'r') AS INTEGER) AS r, CAST(max(floor(least(greatest(o, 0), 1) * 255)) FILTER (k = 'g') AS INTEGER) AS g, CAST(max(floor(least(greatest(o, 0), 1) * 255)) FILTER (k = 'b') AS INTEGER) AS b, 255 AS a FROM f GROUP BY 1, 2, 3""")
def rgb_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return V.true_colour(g.select("vec_id", "y", "x", "v"), F.col("v"), F.col("v") * 2, F.col("v") + 0.2).select("vec_id", "y", "x", "r", "g", "b", "a")


@register("sar_rgb", f"""WITH {GRID}, c AS (SELECT vec_id, y, x, v AS r, v * v AS g, v - v * v AS b FROM g), q AS (SELECT vec_id, {', '.join(f'quantile_cont({k}, 0.02) AS {k}0, quantile_cont({k}, 0.98) AS {k}1' for k in 'rgb')} FROM c GROUP BY 1)
SELECT c.vec_id, y, x, {', '.join(f'CAST(floor(least(greatest(({k} - {k}0) / nullif({k}1 - {k}0, 0), 0), 1) * 255) AS INTEGER) AS {k}' for k in 'rgb')}, 255 AS a FROM c JOIN q USING (vec_id)""")
def sar_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).select("vec_id", "y", "x", F.col("v").alias("VV"), (F.col("v") * F.col("v")).alias("VH"))
    return V.radar_false_colour(g, ["vec_id"]).select("vec_id", "y", "x", "r", "g", "b", "a")


@register("stretch_together", f"WITH {GRID}, q AS (SELECT vec_id, quantile_cont(w, 0.02) AS a, quantile_cont(w, 0.98) AS b FROM (SELECT vec_id, v AS w FROM g UNION ALL SELECT vec_id, v * v FROM g) GROUP BY 1) SELECT g.vec_id, y, x, round(least(greatest((v - a) / nullif(b - a, 0), 0), 1), 6) AS r, round(least(greatest((v * v - a) / nullif(b - a, 0), 0), 1), 6) AS s FROM g JOIN q USING (vec_id)")
def stretch_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).select("vec_id", "y", "x", F.col("v").alias("r"), (F.col("v") * F.col("v")).alias("s"))
    return V.stretch_together(g, ["r", "s"], ["vec_id"]).select("vec_id", "y", "x", F.round("r", 6).alias("r"), F.round("s", 6).alias("s"))


@register("overlay", f"WITH {GRID}, c AS (SELECT vec_id, y, x, CASE WHEN v > 0 THEN v END AS v FROM g), q AS (SELECT vec_id, quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM c GROUP BY 1) SELECT c.vec_id, y, x, CASE WHEN v IS NOT NULL THEN CAST(floor(coalesce(least(greatest((v - a) / nullif(b - a, 0), 0), 1), 0) * 255) AS INTEGER) END AS v, CASE WHEN v IS NULL THEN 0 ELSE 255 END AS a FROM c JOIN q USING (vec_id)")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).select("vec_id", "y", "x", F.when(F.col("v") > 0, F.col("v")).alias("v"))
    return V.overlay(g, "v", ["vec_id"]).select("vec_id", "y", "x", "v", "a")


def _months(value: str, bias: float, low: float, high: float) -> str:
    band = f"CAST(floor(least(greatest((({bias} + coalesce(sum(v) FILTER (m = {{k}}), 0)) / greatest(count(*) FILTER (m = {{k}}), 1) - {low}) / ({high} - {low}), 0), 1) * 255) AS INTEGER)"
    return f"SELECT parcel_id, {', '.join(f'{band.format(k=k)} AS {c}' for c, k in zip('rgb', (4, 5, 6), strict=True))}, 255 AS a FROM (SELECT l_suppkey AS parcel_id, month(l_shipdate) AS m, {value} AS v FROM lineitem WHERE l_shipdate >= '1997-03-01' AND l_shipdate < '1997-07-01') GROUP BY 1"


@register("tracking_rvi", _months("l_discount * 10", 0.2, 0.25, 0.75))
def tracking_rvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tracking_rvi(pixels(spark, sf_dir, ("VV",), PLACE).withColumn("RVI", F.col("VV") * 10), ["parcel_id"], "1997-03-01", "1997-07-01", order=("file", "row"))


@register("growth_stage", _months("l_tax * 10", 0.0, 0.1, 0.7))
def growth_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.growth_stage(pixels(spark, sf_dir, ("VH",), PLACE).withColumn("NDVI", F.col("VH") * 10), ["parcel_id"], "1997-03-01", "1997-07-01", order=("file", "row"))


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("parcel_id"), F.year("l_shipdate").alias("year")).agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"), F.avg("l_tax").alias("c"), F.avg("l_extendedprice").alias("y"))
    return rows.withColumn("split", split_by_year(F.col("year"), 1999, 2000))


def _fit(spark: SparkSession, sf_dir: str, name: str, grid: dict) -> DataFrame:
    train, val, test = ml.temporal_split(ml.assemble(_table(spark, sf_dir), ["a", "b", "c"], "y", log=True))
    found = ml.grid_search(name, train, val, grid)
    return ml.predict(found.model, test, "y", log=True).select("parcel_id", "year", "gt_y", "predicted_y", "error", "abs_error", "pct_error")


@register("train_gbt")
def train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, "gbt", {"maxIter": 8, "maxDepth": [2, 3], "stepSize": 0.3, "seed": 42, "lossType": "absolute"})


@register("boost_rounds")
def boost_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of both sides after every round, and the round a model is cut at."""
    train, val, _ = ml.temporal_split(ml.assemble(_table(spark, sf_dir), ["a", "b", "c"], "y", log=True))
    found = ml.grid_search("gbt", train, val, {"maxIter": 10, "maxDepth": 3, "stepSize": 0.3, "seed": 42, "lossType": "absolute", "stop_early": True})
    return ml.rounds_table(spark, found.rounds)


@register("train_rf")
def train_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, "rf", {"numTrees": 10, "maxDepth": [3, 5], "subsamplingRate": 0.8, "seed": 42})


@register("train_rf_median")
def train_rf_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, "rf", {"numTrees": 10, "maxDepth": 4, "subsamplingRate": 0.8, "seed": 42, "criterion": "absolute_error"})


@register("snapshot", """WITH p AS (SELECT l_suppkey AS parcel_id, l_shipdate AS time, l_orderkey AS y, l_linenumber AS x, l_extendedprice AS nir, l_quantity * 1000 AS red FROM lineitem),
t AS (SELECT parcel_id, arg_min(time, (abs(epoch_us(CAST(time AS TIMESTAMP)) - epoch_us(TIMESTAMP '1995-06-17')), time)) AS time FROM p GROUP BY 1),
s AS (SELECT p.* FROM p JOIN t USING (parcel_id, time)), q AS (SELECT parcel_id, time, quantile_cont(nir, 0.02) AS low, quantile_cont(nir, 0.98) AS high FROM s GROUP BY 1, 2)
SELECT 'NDVI' AS panel, parcel_id, time, y, x, round((nir - red) / nullif(nir + red, 0), 9) AS value, round(greatest(least(((nir - red) / nullif(nir + red, 0) + 1) / 2, 1), 0), 9) AS shade FROM s UNION ALL
SELECT 'B08', parcel_id, time, y, x, round(nir, 9), round(greatest(least(coalesce((nir - low) / nullif(high - low, 0), 0), 1), 0), 9) FROM s JOIN q USING (parcel_id, time)""")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cubes, at the day nearest to one: the index and a band."""
    px = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS parcel_id", "'s2' AS sensor", "l_shipdate AS time", "l_orderkey AS y", "l_linenumber AS x", "l_extendedprice AS B08", "l_quantity * 1000 AS B04")
    shot = panels.snapshot(px, "1995-06-17", ["B08"])
    first, second = (f.select(F.lit(p.name).alias("panel"), "parcel_id", "time", "y", "x", F.round("value", 9).alias("value"), F.round("shade", 9).alias("shade")) for p, f in zip(shot.panels, shot.frames, strict=True))
    return first.unionByName(second)


_LOST = "l_quantity = 1 AND l_tax = 0.08"


def _report_inputs(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DatasetConfig, DataFrame]:
    """Two sensors over lineitem: the second has few pixels; some pixels lack a time; suppliers in debt have no shape, those of region 0 a flat one."""
    px = read(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS parcel_id", f"CASE WHEN NOT ({_LOST}) THEN CAST(l_shipdate AS timestamp_ntz) END AS time", "CAST(l_linenumber AS int) AS y", "CAST(l_orderkey % 8 AS int) AS x",
        "5000000D + 10 * l_linenumber AS y_coord", "100000D + 10 * (l_orderkey % 8) AS x_coord", "l_discount AS tp", "l_quantity", "l_discount",
    )
    first = px.select(px.columns[:7]).withColumn("sensor", F.lit("era5"))
    second = px.where("l_quantity = 50 AND l_discount = 0.1").select("parcel_id", "time", "y", "x", "y_coord", "x_coord", F.col("l_quantity").alias("ET"), F.lit("modis").alias("sensor"))
    at = "100000 {0}, 100050 {0}, 100050 {1}, 100000 {1}, 100000 {0}"
    text = F.expr(f"CASE WHEN s_acctbal < 0 THEN 'none' WHEN s_nationkey < 5 THEN 'POLYGON (({at.format(5000000, 5000000)}))' ELSE 'POLYGON (({at.format(5000000, 5000050)}))' END")
    aoi = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("parcel_id"), G.parse_wkt(text).alias("shape"))
    config = DatasetConfig.of({"sensors": {"modis": {"mask": True}, "era5": {"mask": False}}, "fuse": False})
    return {"modis": second, "era5": first}, config, aoi


_REPORT = f"""WITH p AS (SELECT s_suppkey AS parcel_id, CASE WHEN s_acctbal < 0 THEN 'no shape' WHEN s_nationkey < 5 THEN 'no area' END AS fault FROM supplier),
n AS (SELECT l_suppkey AS parcel_id, count(*) AS n1, count(*) FILTER ({_LOST}) AS lost1, count(*) FILTER (l_quantity = 50 AND l_discount = 0.1) AS n0 FROM lineitem GROUP BY 1),
j AS (SELECT p.parcel_id, fault, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1, coalesce(lost1, 0) AS lost1 FROM p LEFT JOIN n USING (parcel_id)),
r AS (SELECT parcel_id, 'modis' AS sensor, CASE WHEN n0 = 0 THEN 'missing' WHEN fault IS NOT NULL THEN 'failed' ELSE 'done' END AS status, fault AS reason, 'mask' AS stage, n0 AS n_pixels FROM j UNION ALL
SELECT parcel_id, 'era5', CASE WHEN n1 = 0 THEN 'missing' WHEN n0 > 0 AND fault IS NOT NULL THEN 'skipped' WHEN lost1 > 0 THEN 'failed' ELSE 'done' END, lost1 || ' pixels without a time or a place', 'scan', n1 FROM j)
"""


@register("parcel_report", _REPORT + "SELECT parcel_id, sensor, status, CASE WHEN status = 'failed' THEN stage END AS stage, CASE WHEN status = 'failed' THEN reason END AS reason, n_pixels FROM r")
def parcel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.parcel_report(*_report_inputs(spark, sf_dir))


@register("isolated_dataset", _REPORT + """SELECT l_suppkey AS parcel_id, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(count(*) AS BIGINT) AS n_times, round(sum(tp), 6) AS tp FROM
(SELECT l_suppkey, l_shipdate, avg(l_discount) AS tp FROM lineitem JOIN r ON r.parcel_id = l_suppkey AND sensor = 'era5' AND status = 'done' GROUP BY 1, 2) GROUP BY 1, 2, 3""")
def isolated_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the parcels that went through, the second sensor's means per month."""
    run = pipelines.isolated_dataset(*_report_inputs(spark, sf_dir))
    kept = run.rows.where("sensor = 'era5'").groupBy("parcel_id", "year", "month")
    return kept.agg(F.count("*").alias("n_times"), F.round(F.sum("tp") * 12.5, 6).alias("tp"))
