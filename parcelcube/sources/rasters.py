"""Single-band images, GeoTIFF or classic NetCDF, as a Spark data source of cells.

Layout: base/SCENE/BAND_*.tif or .nc. For each scene and band the first GeoTIFF by name is taken, or else the first NetCDF. A partition is a
strip or tile of a GeoTIFF, or some rows of a NetCDF variable; a task reads just its bytes. A window in the image's coordinates
prunes blocks that lie outside. Of a GeoTIFF the first sample is read (raw, deflate or LZW, with or without differencing); of a NetCDF the
first data variable and its first step. Cells without data become null.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parcelcube.sources.zarr import at, folders

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "parcelcube_rasters"
CELLS = "scene_id string, band string, file string, y int, x int, y_coord double, x_coord double, value double"
#: Cells of a NetCDF variable that a partition reads.
NC_CELLS = 1 << 20
# TIFF tags and field types, NetCDF types and names that are no data.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_SIZES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, KIND, SCALE, TIE, NODATA = (
    256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339, 33550, 33922, 42113,
)
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q"}
NC_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
NO_DATA_NAMES = ("x", "y", "lat", "lon", "spatial_ref")


@dataclass
class Block(InputPartition):
    """A rectangle of an image and where its bytes are."""

    def __init__(self, scene: str, band: str, file: str, offset: int, size: int, rows: tuple[int, int], columns: tuple[int, int], how: dict) -> None:
        super().__init__(None)
        self.scene, self.band, self.file, self.offset, self.size, self.rows, self.columns, self.how = scene, band, file, offset, size, rows, columns, how


def lzw(data: bytes) -> bytes:
    """TIFF's variant: most significant bit first, codes widen one early."""
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def tiff_tags(f: pa.NativeFile) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first image."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    f.seek(struct.unpack(f"{order}{'Q' if big else 'I'}", head[8:16] if big else head[4:8])[0])
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", f.read(8 if big else 2))[0]
    entry, inside = (20, 8) if big else (12, 4)
    raw, tags = f.read(n * entry), {}
    for i in range(n):
        tag, kind, count = struct.unpack(f"{order}HH{'Q' if big else 'I'}", raw[i * entry : i * entry + entry - inside])
        if kind not in FIELD:
            continue
        form = f"{order}{count}s" if FIELD[kind] == "s" else f"{order}{count * len(FIELD[kind])}{FIELD[kind][0]}"
        value, size = raw[(i + 1) * entry - inside : (i + 1) * entry], struct.calcsize(form)
        if size > inside:
            f.seek(struct.unpack(f"{order}{'Q' if big else 'I'}", value)[0])
            value = f.read(size)
        tags[tag] = struct.unpack(form, value[:size])
    return order, tags


def tiff_blocks(f: pa.NativeFile) -> tuple[dict, list[tuple[int, int, tuple[int, int], tuple[int, int]]]]:
    """How to decode, and (offset, bytes, rows, columns) of each strip or tile of the first sample."""
    order, tags = tiff_tags(f)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    height, width, samples = one(HEIGHT), one(WIDTH), one(SAMPLES, 1)
    kind = {1: "u", 2: "i", 3: "f"}[one(KIND, 1)]
    scale, tie = tags.get(SCALE, (1.0, -1.0, 0.0)), tags.get(TIE, (0.0,) * 6)
    apart = one(PLANAR, 1) == 2
    tall, wide = (one(TILE_HEIGHT), one(TILE_WIDTH)) if TILES in tags else (min(one(ROWS, height), height), width)
    nodata = tags[NODATA][0].split(b"\0")[0].strip() if NODATA in tags else b""
    how = {
        "kind": f"{order}{kind}{one(BITS, 1) // 8}", "packed": one(COMPRESSION, 1), "differences": one(PREDICTOR, 1), "samples": 1 if apart else samples, "shape": (tall, wide), "tiled": TILES in tags,
        "west": tie[3] - tie[0] * scale[0], "north": tie[4] + tie[1] * scale[1], "dx": scale[0], "dy": -scale[1], "nodata": float(nodata) if nodata else None,
    }
    across = -(-width // wide)
    places = zip(tags[TILES if TILES in tags else STRIPS], tags[TILE_SIZES if TILES in tags else STRIP_SIZES], strict=True)
    out = []
    for i, (offset, size) in enumerate(places):
        y, x = i // across * tall, i % across * wide
        if y < height:  # blocks of further samples follow where they are kept apart
            out.append((offset, size, (y, min(y + tall, height)), (x, min(x + wide, width))))
    return how, out


def tiff_cells(raw: bytes, block: Block) -> np.ndarray:
    how = block.how
    unpack = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress}.get(how["packed"])
    if unpack is None or how["differences"] not in (1, 2):
        raise ValueError(f"cannot decode compression {how['packed']} with predictor {how['differences']} in {block.file}")
    rows = how["shape"][0] if how["tiled"] else block.rows[1] - block.rows[0]
    cells = np.frombuffer(unpack(raw), how["kind"])[: rows * how["shape"][1] * how["samples"]].reshape(rows, how["shape"][1], how["samples"])
    if how["differences"] == 2:
        cells = np.cumsum(cells, axis=1, dtype=cells.dtype)
    return cells[: block.rows[1] - block.rows[0], : block.columns[1] - block.columns[0], 0]


class NcHeader:
    """Dimensions, variables and record layout of a classic NetCDF file."""

    def __init__(self, f: pa.NativeFile) -> None:
        self.f = f
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.count, self.place = (">q" if magic[3] == 5 else ">i"), (">i" if magic[3] == 1 else ">q")
        self.records = max(0, self._number(self.count))
        self.dims = [(self._name(), self._number(self.count)) for _ in range(self._length())]
        self.attrs = self._attributes()
        self.vars = [self._variable() for _ in range(self._length())]
        own = [v for v in self.vars if v["record"]]
        self.stride = own[0]["exact"] if len(own) == 1 else sum(-(-v["exact"] // 4) * 4 for v in own)

    def _number(self, form: str) -> int:
        return struct.unpack(form, self.f.read(struct.calcsize(form)))[0]

    def _name(self) -> str:
        return self._padded(self._number(self.count)).decode()

    def _padded(self, size: int) -> bytes:
        return self.f.read(-(-size // 4) * 4)[:size]

    def _length(self) -> int:
        self._number(">i")  # the list's tag, 0 if absent
        return self._number(self.count)

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._length()):
            name, kind, n = self._name(), NC_TYPES[self._number(">i")], self._number(self.count)
            raw = self._padded(n * np.dtype(kind).itemsize)
            out[name] = raw.decode("utf-8", "replace") if kind == "S1" else np.frombuffer(raw, kind).tolist()
        return out

    def _variable(self) -> dict:
        name = self._name()
        dims = [self._number(self.count) for _ in range(self._number(self.count))]
        attrs, kind = self._attributes(), NC_TYPES[self._number(">i")]
        self._number(self.count)  # the stored size, which may be cut off for large variables
        begin, record = self._number(self.place), bool(dims) and self.dims[dims[0]][1] == 0
        shape = [self.dims[d][1] for d in dims]
        inner = shape[1:] if record else shape
        return {"name": name, "dims": [self.dims[d][0] for d in dims], "shape": [self.records, *inner] if record else shape, "attrs": attrs, "kind": kind, "begin": begin, "record": record, "exact": int(np.prod(inner, dtype=np.int64)) * np.dtype(kind).itemsize}

    def values(self, name: str) -> np.ndarray | None:
        """A coordinate along one dimension that has no records."""
        for v in self.vars:
            if v["name"] == name and len(v["shape"]) == 1 and not v["record"]:
                self.f.seek(v["begin"])
                return np.frombuffer(self.f.read(v["exact"]), v["kind"]).astype(float)
        return None


def nc_blocks(f: pa.NativeFile) -> tuple[dict, list[tuple[int, int, tuple[int, int], tuple[int, int]]]]:
    """How to decode, and runs of rows of the first step of the first data variable."""
    header = NcHeader(f)
    data = [v for v in header.vars if v["name"] not in NO_DATA_NAMES and v["name"] not in v["dims"] and len(v["shape"]) in (2, 3)]
    if not data:
        raise ValueError("no data variable")
    v = data[0]
    height, width = v["shape"][-2:]
    axes = next((pair for pair in (("x", "y"), ("lon", "lat")) if all(header.values(a) is not None for a in pair)), None)
    xs, ys = (header.values(a) for a in axes) if axes else (np.arange(width, dtype=float), np.arange(height, dtype=float))
    fill = (v["attrs"].get("_FillValue") or v["attrs"].get("missing_value") or [None])[0]
    how = {"kind": v["kind"], "xs": xs, "ys": ys, "nodata": fill, "scale": (v["attrs"].get("scale_factor") or [1.0])[0], "add": (v["attrs"].get("add_offset") or [0.0])[0]}
    if len(v["shape"]) == 3 and v["shape"][0] == 0:
        return how, []
    line = width * np.dtype(v["kind"]).itemsize
    step = max(1, NC_CELLS // max(1, width))
    return how, [(v["begin"] + y * line, (min(y + step, height) - y) * line, (y, min(y + step, height)), (0, width)) for y in range(0, height, step)]


def centres(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of the rows and columns of a block."""
    how, (y0, y1), (x0, x1) = block.how, block.rows, block.columns
    if "xs" in how:
        return how["ys"][y0:y1], how["xs"][x0:x1]
    return how["north"] + (np.arange(y0, y1) + 0.5) * how["dy"], how["west"] + (np.arange(x0, x1) + 0.5) * how["dx"]


class Rasters(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> RasterReader:  # noqa: ANN001
        return RasterReader(self.options["path"], json.loads(self.options["bands"]), json.loads(self.options.get("window", "null")))


class RasterReader(DataSourceReader):
    def __init__(self, path: str, bands: list[str], window: list[float] | None) -> None:
        self.path, self.bands, self.window = path, bands, window

    def partitions(self) -> list[Block]:
        files, base = at(self.path)
        out = []
        for scene in folders(files, base):
            names = sorted(x.base_name for x in files.get_file_info(pafs.FileSelector(f"{base}/{scene}")) if x.type == pafs.FileType.File)
            for band in self.bands:
                found = next((n for end in (".tif", ".nc") for n in names if re.fullmatch(rf"{re.escape(band)}_.*{re.escape(end)}", n)), None)
                if found:
                    with files.open_input_file(f"{base}/{scene}/{found}") as f:
                        how, blocks = (tiff_blocks if found.endswith(".tif") else nc_blocks)(f)
                    out += [b for b in (Block(scene, band, found, *rest, how) for rest in blocks) if self.wanted(b)]
        return out

    def wanted(self, block: Block) -> bool:
        if self.window is None:
            return True
        (ys, xs), (west, south, east, north) = centres(block), self.window
        return bool(((xs >= west) & (xs <= east)).any() and ((ys >= south) & (ys <= north)).any())

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        files, base = at(self.path)
        with files.open_input_file(f"{base}/{partition.scene}/{partition.file}") as f:
            f.seek(partition.offset)
            raw = f.read(partition.size)
        how, (ys, xs) = partition.how, centres(partition)
        cells = np.frombuffer(raw, how["kind"]).reshape(len(ys), len(xs)) if "xs" in how else tiff_cells(raw, partition)
        value = cells.astype(np.float64)
        missing = ~np.isfinite(value) | ((value == how["nodata"]) if how["nodata"] is not None else False)
        value = value * how.get("scale", 1.0) + how.get("add", 0.0)
        y, x = (i.ravel() for i in np.indices(value.shape, np.int32))
        same = lambda text: pa.array([text] * value.size, pa.string())
        columns = [
            same(partition.scene), same(partition.band), same(partition.file), pa.array(y + np.int32(partition.rows[0])), pa.array(x + np.int32(partition.columns[0])),
            pa.array(ys[y]), pa.array(xs[x]), pa.array(value.ravel(), mask=missing.ravel()),
        ]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CELLS.split(", ")])


def read_rasters(spark: SparkSession, path: str, bands: Iterable[str], window: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Cells of these bands of all scenes below path, or of a window (west, south, east, north) that holds their centres; a band that a scene lacks gives no rows."""
    spark.dataSource.register(Rasters)
    out = spark.read.format(FORMAT).option("bands", json.dumps(list(bands))).option("window", json.dumps(window)).load(path)
    if window is None:
        return out
    west, south, east, north = window
    return out.where(F.col("x_coord").between(west, east) & F.col("y_coord").between(south, north))
