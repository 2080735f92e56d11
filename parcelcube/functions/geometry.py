"""Geometry in projected metres (EPSG:3857 unless said otherwise) as expressions over rings.

A ring is array<struct<x,y>>; a shape is an array of rings, parts one after another: the first ring of a part is its outline, those
that follow are its holes. parse_wkt() writes outlines counter-clockwise and holes clockwise, so that the turn of a ring tells where
a part starts. A point is inside a shape if it is inside one of its parts; inside a part holes count by the even-odd rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH = 6378137.0


def turned(ring: Column, outline: Column) -> Column:
    """The ring, counter-clockwise as an outline, clockwise as a hole."""
    return F.when((signed_area(ring) < 0) == outline, F.reverse(ring)).otherwise(ring)


def parse_wkt(wkt: Column) -> Column:
    """POLYGON or MULTIPOLYGON text to its rings, in the turn that tells outlines from holes; null for other text, and for coordinates that are no numbers."""
    point = lambda p: F.struct(*[F.get(F.split(p, r"\s+"), F.lit(i)).try_cast("double").alias(c) for i, c in enumerate("xy")])
    # an outline follows two open brackets, a hole follows a comma
    texts = F.regexp_extract_all(wkt, F.lit(r"(\(\s*\([^()]+|,\s*\([^()]+)\)"), F.lit(1))
    ring = lambda t: F.transform(F.split(F.trim(F.regexp_replace(t, r"^[\s,(]+", "")), r"\s*,\s*"), point)
    rings = F.transform(texts, lambda t: F.transform(F.array(ring(t)), lambda r: turned(r, ~t.startswith(",")))[0])
    return F.when(F.upper(F.trim(wkt)).rlike(r"^(MULTI)?POLYGON\s*\("), rings)


def parts(shape: Column) -> Column:
    """array<shape>: each outline with the holes that follow it. A first ring starts a part whatever its turn."""
    starts = F.filter(F.sequence(F.lit(0), F.size(shape) - 1), lambda i: (i == 0) | (signed_area(F.get(shape, i)) >= 0))
    # bound to a name, as an expression it would be worked out again for every part
    listed = F.transform(F.array(starts), lambda found: F.transform(found, lambda s, k: F.slice(shape, s + 1, F.coalesce(F.get(found, k + 1), F.size(shape)) - s)))[0]
    return F.when(F.size(shape) > 0, listed).otherwise(F.array().cast("array<array<array<struct<x:double,y:double>>>>"))


def vertices(shape: Column) -> Column:
    return F.flatten(shape)


def bounds(shape: Column, margin: float = 0.0) -> Column:
    """minx, miny, maxx, maxy with a margin; null for a null or empty shape."""
    x, y = F.transform(vertices(shape), lambda p: p["x"]), F.transform(vertices(shape), lambda p: p["y"])
    box = F.struct((F.array_min(x) - margin).alias("minx"), (F.array_min(y) - margin).alias("miny"), (F.array_max(x) + margin).alias("maxx"), (F.array_max(y) + margin).alias("maxy"))
    return F.when(F.size(vertices(shape)) > 0, box)


def box_wkt(box: Column) -> Column:
    corners = (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))
    text = F.concat_ws(", ", *[F.concat_ws(" ", box[x].cast("string"), box[y].cast("string")) for x, y in corners])
    return F.when(box.isNotNull(), F.concat(F.lit("POLYGON (("), text, F.lit("))")))


def edges(ring: Column) -> Column:
    return F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, positive if it turns counter-clockwise."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda t, e: t + (e["x0"] * e["y1"] - e["x1"] * e["y0"])) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def area(shape: Column) -> Column:
    """Planar area: outlines less their holes; parts are added, so where they overlap it counts twice."""
    part_area = lambda part: F.aggregate(F.slice(part, F.lit(2), F.size(part)), ring_area(F.get(part, F.lit(0))), lambda t, r: t - ring_area(r))
    return F.aggregate(F.transform(parts(shape), part_area), F.lit(0.0), lambda t, a: t + a)


def to_lon(x: Column) -> Column:
    return F.degrees(x / EARTH)


def to_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2)


def to_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH


def to_y(lat: Column) -> Column:
    return F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * EARTH


def to_utm(point: Column, central: float = 3.0) -> Column:
    """Mercator metres to transverse Mercator (GRS80, zone of the central meridian), by Krueger's series to third order."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alphas = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    lon, lat = F.radians(to_lon(point["x"])) - math.radians(central), F.radians(to_lat(point["y"]))
    t = F.sinh(F.atanh(F.sin(lat)) - e * F.atanh(e * F.sin(lat)))
    xi, eta = F.atan2(t, F.cos(lon)), F.atanh(F.sin(lon) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alphas, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500_000 + 0.9996 * radius * east).alias("x"), (0.9996 * radius * north).alias("y"))


def area_hectares(shape: Column, central: float = 3.0) -> Column:
    """True area: rings in transverse Mercator, outlines less their holes; parts are added, so where they overlap it counts twice."""
    return area(F.transform(shape, lambda r: F.transform(r, lambda p: to_utm(p, central)))) / 10_000


def geojson(shape: Column) -> Column:
    """Polygon of one part with its holes, MultiPolygon of several, as coordinate lists."""
    listed = F.transform(parts(shape), lambda part: F.transform(part, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(listed, F.lit(0)).alias("coordinates")))
    return F.when(F.size(parts(shape)) == 1, one).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), listed.alias("coordinates"))))


def wkt_of_geojson(text: Column) -> Column:
    """GeoJSON Polygon or MultiPolygon to WKT; null for other text."""
    line = "array<array<double>>"
    number = lambda p: F.concat_ws(" ", F.transform(F.slice(p, 1, 2), lambda c: c.cast("string")))
    ring = lambda r: F.concat(F.lit("("), F.concat_ws(", ", F.transform(r, number)), F.lit(")"))
    body = lambda rings: F.concat(F.lit("("), F.concat_ws(", ", F.transform(rings, ring)), F.lit(")"))
    coordinates = F.get_json_object(text, "$.coordinates")
    kind = F.get_json_object(text, "$.type")
    return F.when(kind == "Polygon", F.concat(F.lit("POLYGON "), body(F.from_json(coordinates, f"array<{line}>")))).when(
        kind == "MultiPolygon", F.concat(F.lit("MULTIPOLYGON ("), F.concat_ws(", ", F.transform(F.from_json(coordinates, f"array<array<{line}>>"), body)), F.lit(")"))
    )


def centroid_mean(shape: Column) -> Column:
    """Mean of the distinct vertices of a closed first ring."""
    ring = F.slice(F.get(shape, F.lit(0)), F.lit(2), F.greatest(F.size(F.get(shape, F.lit(0))) - 1, F.lit(0)))
    n = F.size(ring)
    return F.struct((F.aggregate(ring, F.lit(0.0), lambda t, p: t + p["x"]) / n).alias("x"), (F.aggregate(ring, F.lit(0.0), lambda t, p: t + p["y"]) / n).alias("y"))


def steep_edges(shape: Column) -> Column:
    """array<array<struct>>: of each part the edges that a level line can cross, as a start and a way. Worked out once for all points of a shape."""
    edge = lambda e: F.struct(e["x0"], e["y0"], e["y1"], (e["x1"] - e["x0"]).alias("dx"), (e["y1"] - e["y0"]).alias("dy"))
    return F.transform(parts(shape), lambda part: F.transform(F.filter(F.flatten(F.transform(part, edges)), lambda e: e["y0"] != e["y1"]), edge))


def crossings(steep: Column, y: Column) -> Column:
    """array<array<double>>: where the line at y crosses each part. Worked out once for all points of a line."""
    at = lambda e: F.when((e["y0"] > y) != (e["y1"] > y), e["dx"] * (y - e["y0"]) / e["dy"] + e["x0"])
    return F.transform(steep, lambda part: F.array_compact(F.transform(part, at)))


def among(crossed: Column, x: Column) -> Column:
    """Whether a place on a line is inside one of the parts that the line crosses."""
    return F.exists(crossed, lambda part: F.size(F.filter(part, lambda c: x < c)) % 2 == 1)


def contains(shape: Column, x: Column, y: Column) -> Column:
    """Inside one of the parts: even-odd rule over the edges of each."""
    return among(crossings(steep_edges(shape), y), x)


def distance_to_edge(shape: Column, x: Column, y: Column) -> Column:
    def near(e: Column) -> Column:
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        t = F.coalesce(F.try_divide((x - e["x0"]) * dx + (y - e["y0"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.sqrt(F.pow(x - e["x0"] - t * dx, 2) + F.pow(y - e["y0"] - t * dy, 2))

    return F.array_min(F.transform(F.flatten(F.transform(shape, edges)), near))


def world_to_pixel(c: Column, first: Column, last: Column, n: Column) -> Column:
    """Position on an axis of n cells from the coordinates of its first and last cell centre."""
    return F.try_divide(c - first, last - first) * (n - 1)


def raster_bounds(df: DataFrame, cube: tuple[str, ...] = ("parcel_id", "sensor")) -> DataFrame:
    """Outer bounds of each image in degrees: cell centres and half a cell around."""
    ends = df.groupBy(*cube).agg(*[f(c).alias(f"{n}{c[0]}") for c in ("x_coord", "y_coord") for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count_distinct))])
    half = {a: F.coalesce(F.try_divide(F.col(f"hi{a}") - F.col(f"lo{a}"), F.col(f"n{a}") - 1), F.lit(0.0)) / 2 for a in "xy"}
    return ends.select(
        *cube, to_lon(F.col("lox") - half["x"]).alias("west"), to_lat(F.col("loy") - half["y"]).alias("south"), to_lon(F.col("hix") + half["x"]).alias("east"), to_lat(F.col("hiy") + half["y"]).alias("north"),
    )


def mask(df: DataFrame, shape: str, cell: float, erosion_cells: float = 0.0, cube: tuple[str, ...] = ("parcel_id", "sensor"), bands: tuple[str, ...] = ()) -> DataFrame:
    """Pixels that touch the parcel, grown by one cell or shrunk by some.

    A cell counts as touching within half a cell of its centre; at corners this may differ from exact
    polygon clipping by less than half a diagonal. A cube that would lose every pixel with a value keeps the
    pixel nearest to the parcel's centroid on each axis.
    """
    from pyspark.sql import Window

    x, y, s = F.col("x_coord"), F.col("y_coord"), F.col(shape)
    inside, far = contains(s, x, y), distance_to_edge(s, x, y)
    if erosion_cells > 0:
        hit = inside & (far >= (erosion_cells - 0.5) * cell)
    else:
        hit = inside | (far <= 1.5 * cell)
    # a cell is judged once, whatever the number of its times; shapes do not reach the window
    some = F.coalesce(*[F.col(b) for b in bands]).isNotNull() if bands else F.lit(True)
    place = [F.col(c) for c in cube]
    cells = df.groupBy(*place, "y", "x").agg(F.min("x_coord").alias("x_coord"), F.min("y_coord").alias("y_coord"), F.first(shape).alias(shape), F.max(some).alias("__some"))
    centre = centroid_mean(s)
    cells = cells.select(*cube, "y", "x", F.coalesce(hit, F.lit(False)).alias("__hit"), "__some", F.abs(x - centre["x"]).alias("__dx"), F.abs(y - centre["y"]).alias("__dy"))
    w = Window.partitionBy(*cube)
    cells = cells.withColumns({
        "__kept": F.max(F.col("__hit") & F.col("__some")).over(w),
        "__x": F.min(F.struct(F.col("__dx").alias("d"), F.col("x").alias("v"))).over(w)["v"],
        "__y": F.min(F.struct(F.col("__dy").alias("d"), F.col("y").alias("v"))).over(w)["v"],
    })
    kept = cells.where(F.when(F.col("__kept"), F.col("__hit")).otherwise((F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y")))).select(*cube, "y", "x")
    # merged: by the size of the file of shapes Spark would broadcast the cells that come from it
    return df.join(kept.hint("merge"), [*cube, "y", "x"], "left_semi").select(df.columns)
