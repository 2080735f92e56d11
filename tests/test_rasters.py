"""GeoTIFF and NetCDF files built byte by byte."""

import math
import struct
import zlib

import numpy as np
import pytest

from parcelcube.functions.geometry import raster_bounds
from parcelcube.sources import rasters as R


def packed_lzw(data: bytes) -> bytes:
    """Plain codes, with a clear code often enough that they stay nine bits wide."""
    codes = []
    for i in range(0, len(data), 200):
        codes += [256, *data[i : i + 200]]
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


PACK = {1: bytes, 5: packed_lzw, 8: zlib.compress}


def tiff(cells, order="<", compression=1, predictor=1, rows=2, tile=None, nodata=None):
    """cells: (height, width, samples); upper left corner at (100, 50), cells of 10 by 5."""
    height, width, samples = cells.shape
    blocks = []
    if tile:
        for y in range(0, height, tile):
            for x in range(0, width, tile):
                block = np.zeros((tile, tile, samples), cells.dtype)
                part = cells[y : y + tile, x : x + tile]
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(block)
    else:
        blocks = [cells[y : y + rows] for y in range(0, height, rows)]
    if predictor == 2:
        blocks = [np.concatenate([b[:, :1], np.diff(b, axis=1)], 1) for b in blocks]
    kind = np.dtype(cells.dtype).newbyteorder(order)
    raw = [PACK[compression](b.astype(kind).tobytes()) for b in blocks]
    at, places = 8, []
    for b in raw:
        places.append(at)
        at += len(b)
    tags = [(256, 3, [width]), (257, 3, [height]), (258, 3, [8 * kind.itemsize] * samples), (259, 3, [compression]), (277, 3, [samples]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * samples), (33550, 12, [10.0, 5.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 50.0, 0.0])]
    sizes = list(map(len, raw))
    tags += [(322, 3, [tile]), (323, 3, [tile]), (324, 4, places), (325, 4, sizes)] if tile else [(273, 4, places), (278, 3, [rows]), (279, 4, sizes)]
    tags += [(42113, 2, [nodata.encode() + b"\0"])] if nodata else []
    form = {2: "s", 3: "H", 4: "I", 12: "d"}
    extra, entries, base = b"", [], at + 2 + 12 * len(tags) + 4
    for tag, field, values in sorted(tags):
        data = values[0] if field == 2 else struct.pack(f"{order}{len(values)}{form[field]}", *values)
        n = len(data) if field == 2 else len(values)
        if len(data) > 4:
            entries.append(struct.pack(f"{order}HHII", tag, field, n, base + len(extra)))
            extra += data
        else:
            entries.append(struct.pack(f"{order}HHI", tag, field, n) + data.ljust(4, b"\0"))
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at)
    return head + b"".join(raw) + struct.pack(f"{order}H", len(tags)) + b"".join(entries) + struct.pack(f"{order}I", 0) + extra


def netcdf(values, records, extra_record=False):
    """Variables lon, lat and short t(time, lat, lon) or t(lat, lon), with scale, offset and fill value."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    height, width = values.shape[-2:]
    dims = [("time", 0), ("lat", height), ("lon", width)]
    attrs = lambda items: struct.pack(">ii", 12, len(items)) + b"".join(name(k) + struct.pack(">ii", kind, 1) + struct.pack(form, v).ljust(4, b"\0") for k, kind, form, v in items)
    own = attrs([("scale_factor", 6, ">d", 0.5), ("add_offset", 6, ">d", 10.0), ("_FillValue", 3, ">h", -9)])
    lon, lat = np.arange(width) * 0.25 + 1, 40 - np.arange(height) * 0.5
    data = [("lon", [2], struct.pack(">ii", 0, 0), 6, lon.astype(">f8").tobytes(), False), ("lat", [1], struct.pack(">ii", 0, 0), 6, lat.astype(">f8").tobytes(), False)]
    if extra_record:
        data.append(("time", [0], struct.pack(">ii", 0, 0), 3, struct.pack(">h", 7).ljust(4, b"\0"), True))
    data.append(("t", [0, 1, 2] if records else [1, 2], own, 3, None, records))

    def header(begins):
        out = b"CDF\x01" + struct.pack(">i", len(values) if records else 0) + struct.pack(">ii", 10, 3) + b"".join(name(d) + struct.pack(">i", n) for d, n in dims) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, len(data))
        for (n, of, a, kind, _, _), begin in zip(data, begins, strict=True):
            out += name(n) + struct.pack(f">i{len(of)}i", len(of), *of) + a + struct.pack(">iii", kind, 0, begin)
        return out

    size = len(header([0] * len(data)))
    begins, body, at = [], b"", size
    for _, _, _, _, raw, record in data:
        begins.append(at)
        if raw is None:
            break
        at += len(raw)
        body += b"" if record else raw
    if records:
        for step in values:
            body += (struct.pack(">h", 7).ljust(4, b"\0") if extra_record else b"") + step.astype(">i2").tobytes().ljust(-(-step.size * 2 // 4) * 4 if extra_record else 0, b"\0")
    else:
        body += values.astype(">i2").tobytes()
    return header(begins) + body


def save(top, scene, file, raw):
    (top / scene).mkdir(exist_ok=True)
    (top / scene / file).write_bytes(raw)


def cells_of(df):
    return {(r["y"], r["x"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("layout", [{"rows": 2}, {"rows": 7}, {"tile": 4}])
@pytest.mark.parametrize("compression", [1, 5, 8])
def test_geotiff_layouts(spark, tmp_path, layout, compression):
    cells = np.random.default_rng(1).integers(0, 60_000, (7, 5, 2)).astype("u2")
    save(tmp_path, "s1", "B04_x.tif", tiff(cells, order=">", compression=compression, predictor=2, **layout))
    got = cells_of(R.read_rasters(spark, str(tmp_path), ["B04"]))
    assert got == {(y, x): float(cells[y, x, 0]) for y, x in np.ndindex(7, 5)}


def test_geotiff_coordinates_window_and_missing_cells(spark, tmp_path):
    cells = np.arange(48.0, dtype="f4").reshape(8, 6, 1)
    cells[0, 0], cells[7, 5] = -99, np.nan
    save(tmp_path, "s1", "B04_x.tif", tiff(cells, nodata="-99", rows=2))
    df = R.read_rasters(spark, str(tmp_path), ["B04", "B99"])
    got = {(r["y"], r["x"]): (r["x_coord"], r["y_coord"], r["value"]) for r in df.collect()}
    assert got[0, 0] == (105.0, 47.5, None) and got[7, 5] == (155.0, 12.5, None) and got[3, 2] == (125.0, 32.5, 20.0) and len(got) == 48
    part = R.read_rasters(spark, str(tmp_path), ["B04"], window=(100, 26, 130, 36))
    assert set(cells_of(part)) == {(y, x) for y in (3, 4) for x in (0, 1, 2)} and part.rdd.getNumPartitions() == 2
    box = raster_bounds(df.withColumnsRenamed({"scene_id": "parcel_id", "band": "sensor"})).first()
    assert box["east"] - box["west"] == pytest.approx(math.degrees(60 / 6378137))  # six cells of 10, half a cell around the centres


@pytest.mark.parametrize("records", [True, False])
def test_netcdf_first_variable_and_step(spark, tmp_path, records, monkeypatch):
    values = np.arange(30).reshape(2, 5, 3) if records else np.arange(15).reshape(5, 3)
    values[..., 4, 2] = -9
    first = values[0] if records else values
    for extra in (False, True) if records else (False,):
        save(tmp_path, "s1", "tp_y.nc", netcdf(values, records, extra))
        rows = R.read_rasters(spark, str(tmp_path), ["tp"]).collect()
        assert {(r["y"], r["x"]): r["value"] for r in rows} == {(y, x): None if first[y, x] == -9 else first[y, x] * 0.5 + 10 for y, x in np.ndindex(5, 3)}
        assert {(r["x_coord"], r["y_coord"]) for r in rows} == {(1 + 0.25 * x, 40 - 0.5 * y) for y, x in np.ndindex(5, 3)}


def test_geotiff_comes_before_netcdf(spark, tmp_path):
    save(tmp_path, "s1", "B1_b.tif", tiff(np.full((1, 1, 1), 2, "u1")))
    save(tmp_path, "s1", "B1_a.tif", tiff(np.full((1, 1, 1), 1, "u1")))
    save(tmp_path, "s1", "B1_a.nc", netcdf(np.full((1, 1), 3), False))
    save(tmp_path, "s2", "B1_a.nc", netcdf(np.full((1, 1), 4), False))
    save(tmp_path, "s3", "B11_a.nc", netcdf(np.full((1, 1), 5), False))
    assert {(r["scene_id"], r["file"], r["value"]) for r in R.read_rasters(spark, str(tmp_path), ["B1"]).collect()} == {("s1", "B1_a.tif", 1.0), ("s2", "B1_a.nc", 12.0)}
    save(tmp_path, "s4", "B1_a.nc", b"\x89HDF\r\n\x1a\n")
    with pytest.raises(Exception, match="classic NetCDF"):
        R.read_rasters(spark, str(tmp_path), ["B1"]).count()
