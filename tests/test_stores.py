"""Cube stores written and read, files of a store built byte by byte, polygon parts, and numbering of whole tables."""

import json
import zlib
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelcube.functions import geometry as G
from parcelcube.operators.relational import number_rows
from parcelcube.sources import zarr as Z

KEYS = ["sensor", "parcel_id", "time", "variable", "y_coord", "x_coord", "value"]


@pytest.fixture(scope="module")
def pixels(spark):
    """Two cubes of 10 and 3 times, with a gap, a null and a NaN."""
    rows = []
    for parcel, steps in (("a", 10), ("b", 3)):
        for t in range(steps):
            for v, y, x in np.ndindex(2, 3, 2):
                if (t, v, y, x) != (4, 1, 0, 0):
                    value = None if (t, y) == (1, 2) else float("nan") if (t, x) == (2, 1) else t + v / 2 + y / 4 + x / 8
                    rows.append(("S2", parcel, datetime(2021, 1, 1 + t, 6), f"B{2 - v}", 100.0 - 10 * y, 5.0 + 10 * x, value))
    return spark.createDataFrame(rows, "sensor string, parcel_id string, time timestamp_ntz, variable string, y_coord double, x_coord double, value double")


def values(df):
    return sorted(tuple(r) for r in df.where("value IS NOT NULL").select(*KEYS).collect())


def test_cubes_come_back_as_written(spark, pixels, tmp_path):
    path = str(tmp_path / "cubes")
    Z.write_cubes(pixels, path, steps=4)
    back = Z.read_cubes(spark, path)
    want = sorted(tuple(r) for r in pixels.where("value IS NOT NULL AND NOT isnan(value)").select(*KEYS).collect())
    assert values(back) == want and back.count() == (10 + 3) * 12
    assert back.rdd.getNumPartitions() == 3 + 1
    assert back.select("y", "y_coord").distinct().orderBy("y").collect() == [(0, 80.0), (1, 90.0), (2, 100.0)]
    meta = json.loads(Path(path, "S2/a/cube.zarr/data/.zarray").read_text())
    assert meta["dtype"] == "<f4" and meta["shape"] == [10, 2, 3, 2] and meta["fill_value"] == "NaN" and not list(Path(path).glob("_writing*"))
    Z.write_cubes(pixels.where("parcel_id = 'b' AND variable = 'B1'"), path)  # replaces one cube, keeps the other
    assert {(r["parcel_id"], r["variable"]) for r in Z.read_cubes(spark, path).select("parcel_id", "variable").distinct().collect()} == {("a", "B1"), ("a", "B2"), ("b", "B1")}
    Z.write_cubes(pixels.where("parcel_id = 'none'"), path)
    assert Z.read_cubes(spark, path).where("parcel_id = 'a'").count() == 120


def test_what_a_scan_does_not_ask_for_is_not_opened(spark, pixels, tmp_path):
    path = str(tmp_path / "cubes")
    Z.write_cubes(pixels, path, steps=4)
    asked = {"parcels": ["a"], "start": datetime(2021, 1, 6), "end": datetime(2021, 1, 7)}
    want = values(Z.read_cubes(spark, path, **asked))
    assert {r[2].day for r in want} == {6}
    for spoilt in ("S2/a/cube.zarr/data/0.0.0.0", "S2/a/cube.zarr/data/2.0.0.0", "S2/b/cube.zarr/data/0.0.0.0"):
        Path(path, spoilt).write_bytes(b"not a chunk")
    assert values(Z.read_cubes(spark, path, **asked)) == want
    assert values(Z.CubeStores(spark, path).load("S1")) == []
    with pytest.raises(Exception, match="decompress"):
        Z.read_cubes(spark, path).count()


def test_stores_of_bands_and_parts(spark, tmp_path):
    """One array per band, big-endian and column-major, a chunk that is missing, chunks that overlap the edge, days as times."""

    def array(store, name, data, chunks, dims, **meta):
        top = store / name
        top.mkdir(parents=True)
        (top / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": list(data.shape), "chunks": chunks, "dtype": data.dtype.str, "fill_value": -1, "order": "C", "compressor": None, "filters": None} | meta))
        (top / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims} | ({"units": "days since 2000-01-01"} if name == "time" else {})))
        return top

    for part, days in (("p1", [0, 1, 2]), ("p2", [2, 3])):
        store = tmp_path / "ERA5" / "x" / part / "cube.zarr"
        cells = (np.arange(len(days) * 6).reshape(len(days), 2, 3) + (100 if part == "p2" else 0)).astype(">i2")
        tp = array(store, "tp", cells, [2, 2, 2], ["time", "y", "x"], order="F", compressor={"id": "zlib", "level": 1}, dimension_separator="-")
        for t, x in np.ndindex(2, 2):
            if (part, t, x) != ("p1", 1, 0) and t * 2 < len(days):
                chunk = np.zeros((2, 2, 2), ">i2")
                piece = cells[2 * t : 2 * t + 2, :, 2 * x : 2 * x + 2]
                chunk[: piece.shape[0], :, : piece.shape[2]] = piece
                (tp / f"{t}-0-{x}").write_bytes(zlib.compress(chunk.tobytes("F")))
        for name, v in (("time", np.array(days, "<i8")), ("y", np.array([1.0, 2.0])), ("x", np.array([1.0, 2.0, 3.0]))):
            (array(store, name, v, [len(v)], [name]) / "0").write_bytes(v.tobytes())
        (store / ".zgroup").write_text('{"zarr_format": 2}')
    rows = Z.read_cubes(spark, str(tmp_path)).collect()
    got = {(r["part"], r["time"].day, r["y"], r["x"]): r["value"] for r in rows}
    assert len(rows) == 18 + 12 and {r["variable"] for r in rows} == {"tp"}
    assert got["000000", 1, 1, 2] == 5 and got["000000", 3, 0, 0] == -1 and got["000000", 3, 0, 2] == 14 and got["000001", 4, 1, 0] == 109
    first = Z.CubeStores(spark, str(tmp_path)).cube("ERA5", ["tp"]).collect()
    assert len(first) == 4 * 6 and {r["time"].day: r["tp"] for r in first if (r["y"], r["x"]) == (0, 2)} == {1: 2, 2: 8, 3: 14, 4: 108}


def test_a_failed_write_leaves_no_store(spark, pixels, tmp_path):
    path = str(tmp_path / "cubes")
    broken = pixels.withColumn("value", F.when(F.col("parcel_id") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("value")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        Z.write_cubes(broken, path)
    assert not list(Path(path).glob("**/.zgroup")) and Z.at(path)[0].get_file_info(path).type.name in ("NotFound", "Directory")


def test_parts_holes_and_areas(spark):
    def shape(text):
        return spark.range(1).select(G.parse_wkt(F.lit(text)).alias("s"))

    outer, hole = "0 0, 1000 0, 1000 1000, 0 1000, 0 0", "250 250, 250 750, 750 750, 750 250, 250 250"
    for texts in ((outer, hole), (", ".join(reversed(outer.split(", "))), ", ".join(reversed(hole.split(", "))))):
        s = shape(f"POLYGON (({texts[0]}),({texts[1]}))").cache()
        assert s.select(G.area("s")).first()[0] == 750_000 and s.select(F.size(G.parts(F.col("s")))).first()[0] == 1
        hectares = s.select(G.area_hectares(F.col("s"))).first()[0]
        whole = shape(f"POLYGON (({outer}))").select(G.area_hectares(F.col("s"))).first()[0]
        assert hectares == pytest.approx(0.75 * whole, rel=1e-4)
        assert [s.select(G.contains(F.col("s"), F.lit(float(p)), F.lit(float(p)))).first()[0] for p in (100, 500, 900, 1100)] == [True, False, True, False]
    both = shape("MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0)), ((5 5, 15 5, 15 15, 5 15, 5 5)))").cache()
    assert [both.select(G.contains(F.col("s"), F.lit(float(p)), F.lit(float(p)))).first()[0] for p in (2, 7, 12, 16)] == [True, True, True, False]
    text = both.select(G.geojson(F.col("s"))).first()[0]
    assert json.loads(text) == {"type": "MultiPolygon", "coordinates": [[[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]], [[[5, 5], [15, 5], [15, 15], [5, 15], [5, 5]]]]}
    again = both.select((G.parse_wkt(G.wkt_of_geojson(F.lit(text))) == F.col("s"))).first()[0]
    assert again and shape("POINT (1 2)").first()[0] is None


def test_numbering_spreads_a_frequent_value(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("v"), "id")
    numbered = number_rows(df, ["v"]).cache()
    assert sorted(r["__r"] for r in numbered.select("__r").collect()) == list(range(20_000)) and numbered.select("__rows").distinct().collect() == [(20_000,)]
    ordered = [r["v"] for r in numbered.orderBy("__r").select("v").collect()]
    assert ordered == sorted(ordered)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    nulls = number_rows(spark.createDataFrame([(None,), (2,), (None,), (1,)], "v int"), ["v"]).orderBy("__r").collect()
    assert [r["v"] for r in nulls] == [None, None, 1, 2] and number_rows(df.limit(0), ["v"]).count() == 0
