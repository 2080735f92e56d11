"""Clipping of cubes to parcels: the cells a shape touches are listed once per cube, pixels meet them by their cell numbers.

Rings travel once per cube, never with a pixel. A cell is a square around its centre; it touches a shape grown by a distance
if it is no farther than that from it, and a shape shrunk by a distance if one of its points lies so deep inside. The first is exact, the second to
1/1024 of a cell (a cell closer than that to the shrunk shape counts).
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcube.operators.dissolve import BLOCK, SHAPE, Ring, edges_of, inside, rings_of, united

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Halvings of a cell in the search for its deepest point.
HALVINGS = 10


def to_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of points to a segment; all arrays end in x, y."""
    d = b - a
    t = np.clip(((p - a) * d).sum(axis=-1) / (d * d).sum(axis=-1), 0.0, 1.0)
    return np.hypot(*np.moveaxis(p - a - t[..., None] * d, -1, 0))


def square_to_segment(centres: np.ndarray, half: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of squares to a segment, 0 where they meet."""
    d = b - a
    with np.errstate(divide="ignore", invalid="ignore"):
        first, last = (centres - half - a) / d, (centres + half - a) / d
    level = np.abs(centres - a) <= half
    enter = np.where(d == 0, np.where(level, -np.inf, np.inf), np.minimum(first, last)).max(axis=1)
    leave = np.where(d == 0, np.where(level, np.inf, -np.inf), np.maximum(first, last)).min(axis=1)
    met = np.maximum(enter, 0.0) <= np.minimum(leave, 1.0)
    ends = [np.hypot(*np.maximum(np.abs(centres - p) - half, 0.0).T) for p in (a, b)]
    corners = [to_segment(centres + half * np.array(c), a, b) for c in ((-1, -1), (-1, 1), (1, -1), (1, 1))]
    return np.where(met, 0.0, np.minimum.reduce([*ends, *corners]))


def near_edges(edges: np.ndarray, xs: np.ndarray, ys: np.ndarray, half: float, reach: float) -> np.ndarray:
    """Cells of ascending axes no farther than reach from an edge. A row of cells is asked only where the edge passes it."""
    hit = np.zeros((len(ys), len(xs)), dtype=bool)
    wide = half + reach
    for x0, y0, x1, y1 in edges:
        rows = np.arange(np.searchsorted(ys, min(y0, y1) - wide), np.searchsorted(ys, max(y0, y1) + wide, side="right"))
        if y0 == y1:
            left, right = np.full(len(rows), min(x0, x1)), np.full(len(rows), max(x0, x1))
        else:
            at = [x0 + (x1 - x0) * np.clip((ys[rows] + s * wide - y0) / (y1 - y0), 0.0, 1.0) for s in (-1, 1)]
            left, right = np.minimum(*at), np.maximum(*at)
        low, high = np.searchsorted(xs, left - wide), np.searchsorted(xs, right + wide, side="right")
        n = np.maximum(high - low, 0)
        r = np.repeat(rows, n)
        c = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        fresh = ~hit[r, c]
        r, c = r[fresh], c[fresh]
        hit[r, c] = square_to_segment(np.column_stack([xs[c], ys[r]]), half, np.array([x0, y0]), np.array([x1, y1])) <= reach
    return hit


def within(parts: list[np.ndarray], xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Cells whose centre is inside a part, by the crossings of each row's line."""
    hit = np.zeros((len(ys), len(xs)), dtype=bool)
    for edges in parts:
        x0, y0, x1, y1 = edges.T
        slope = (x1 - x0) / np.where(y1 == y0, 1.0, y1 - y0)
        first, last = np.searchsorted(ys, [edges[:, 1::2].min(), edges[:, 1::2].max()])
        for j in range(first, last):
            cut = (y0 > ys[j]) != (y1 > ys[j])
            crossings = np.sort(slope[cut] * (ys[j] - y0[cut]) + x0[cut])
            hit[j] |= (len(crossings) - np.searchsorted(crossings, xs, side="right")) % 2 == 1
    return hit


def depth(parts: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    """Distance to the outline, negative outside."""
    edges = np.vstack(parts)
    far = np.full(len(points), np.inf)
    step = max(1, BLOCK * 64 // len(edges))
    for at in range(0, len(points), step):
        far[at : at + step] = to_segment(points[at : at + step, None], edges[None, :, :2], edges[None, :, 2:]).min(axis=1)
    return np.where(np.logical_or.reduce([inside(p, points) for p in parts]), far, -far)


def deep(parts: list[np.ndarray], centres: np.ndarray, half: float, need: float) -> np.ndarray:
    """Which squares hold a point at least so deep: quarters are asked as long as they may."""
    found = np.zeros(len(centres), dtype=bool)
    owner, at = np.arange(len(centres)), centres
    for nth in range(HALVINGS + 1):
        d = depth(parts, at)
        found[owner[d >= need]] = True
        may = (d + half * np.sqrt(2) >= need) & ~found[owner]
        owner, at = owner[may], at[may]
        if not len(owner) or half == 0:
            return found
        if nth == HALVINGS:
            found[owner] = True
            return found
        half /= 2
        owner = np.repeat(owner, 4)
        at = np.repeat(at, 4, axis=0) + half * np.tile(np.array([(-1, -1), (-1, 1), (1, -1), (1, 1)]), (len(at), 1))
    return found


def touched(shape: Iterable, xs: np.ndarray, ys: np.ndarray, cell: float, grow: float, shrink: float) -> np.ndarray:
    """Cells (row, column) of ascending axes that touch the shape grown or shrunk by a distance.

    A shape that shrinking leaves nothing of counts as it is.
    """
    return _touched(united(rings_of(shape)), xs, ys, cell, grow, shrink)


def _touched(whole: list[list[Ring]], xs: np.ndarray, ys: np.ndarray, cell: float, grow: float, shrink: float) -> np.ndarray:
    """touched() of a union of parts."""
    parts = [edges_of([np.array(r) for r in part]) for part in whole]
    hit = np.zeros((len(ys), len(xs)), dtype=bool)
    if not parts:
        return hit
    half = cell / 2
    if shrink > 0:
        every = np.vstack(parts)
        low, high = every[:, :2].min(axis=0), every[:, :2].max(axis=0)
        around = max(high - low) / 2
        if deep(parts, (low + high)[None] / 2, around, shrink)[0]:
            may = within(parts, xs, ys) | near_edges(np.vstack(parts), xs, ys, half, 0.0)
            r, c = np.nonzero(may)
            hit[r, c] = deep(parts, np.column_stack([xs[c], ys[r]]), half, shrink)
            return hit
        grow = 0.0
    return within(parts, xs, ys) | near_edges(np.vstack(parts), xs, ys, half, grow)


def centroid(whole: list[list[Ring]]) -> np.ndarray | None:
    """Centre of gravity of a union of parts."""
    total, moment = 0.0, np.zeros(2)
    for part in whole:
        for ring in part:
            r = np.array(ring)
            o = r[0]
            (x, y), (u, v) = (r[:-1] - o).T, (r[1:] - o).T
            cross = x * v - u * y
            total += cross.sum() / 2
            moment += o * cross.sum() / 2 + np.array([((x + u) * cross).sum(), ((y + v) * cross).sum()]) / 6
    return moment / total if total else None


def _axis(pairs: Iterable) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and coordinates of an axis by ascending coordinate; a number has its least coordinate."""
    least: dict[int, float] = {}
    for p in pairs:
        if p["n"] is not None and p["c"] is not None and np.isfinite(p["c"]):
            least[p["n"]] = min(p["c"], least.get(p["n"], np.inf))
    order = sorted(least, key=lambda n: (least[n], n))
    return np.array(order, dtype=np.int64), np.array([least[n] for n in order], dtype=float)


def _cells(batches: Iterator[pa.RecordBatch], cube: list[str], cell: float, erosion: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for nth in range(batch.num_rows):
            (columns, xs), (rows, ys) = (_axis(batch[c][nth].as_py()) for c in ("__xs", "__ys"))
            whole = united(rings_of(batch["__shape"][nth].as_py()))
            centre = centroid(whole)
            if not len(xs) or not len(ys) or centre is None:
                continue
            hit = _touched(whole, xs, ys, cell, 0.0 if erosion > 0 else cell, erosion * cell)
            # of two that are as near, the one with the smaller number
            i, j = (min(range(len(a)), key=lambda k, a=a, n=n, c=c: (abs(a[k] - c), n[k])) for a, n, c in ((xs, columns, centre[0]), (ys, rows, centre[1])))
            r, c = np.nonzero(hit | ((np.arange(len(ys)) == j)[:, None] & (np.arange(len(xs)) == i)))
            same = pa.array(np.full(len(r), nth))
            found = [pa.array(v) for v in (rows[r], columns[c], hit[r, c], (r == j) & (c == i))]
            yield pa.RecordBatch.from_arrays([*[batch[n].take(same) for n in cube], *found], [*cube, "y", "x", "__hit", "__near"])


def clip(df: DataFrame, shapes: DataFrame, cell: float, erosion_cells: float = 0.0, cube: tuple[str, ...] = ("parcel_id", "sensor"), bands: tuple[str, ...] = (), key: str = "parcel_id", shape: str = "shape") -> DataFrame:
    """Pixels whose cell touches their parcel, grown by one cell or shrunk by some: the columns of df, its rows as they are.

    shapes holds one row per key. A parcel that shrinking leaves nothing of is taken as it is. A cube that would lose every pixel with a
    value in bands keeps the pixel nearest to the parcel's centroid on each axis. Pixels without cell numbers or
    coordinates, and parcels without a shape, are left out. An image's axes must fit in memory, its pixels need not.
    """
    cube_columns = list(cube)
    pair = lambda n, c: F.collect_set(F.struct(F.col(n).cast("long").alias("n"), F.col(c).cast("double").alias("c")))
    axes = df.groupBy(*cube_columns).agg(pair("x", "x_coord").alias("__xs"), pair("y", "y_coord").alias("__ys"))
    # joins are merged, none is broadcast: what Spark takes a table of cells for is the size of the file of shapes it comes from
    outlines = shapes.select(key, F.col(shape).cast(SHAPE).alias("__shape")).where("__shape IS NOT NULL")
    held = axes.join(outlines.hint("merge"), key).repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *cube_columns)
    kinds = ", ".join(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in cube_columns)
    cells = held.select(*cube_columns, "__xs", "__ys", "__shape").mapInArrow(lambda batches: _cells(batches, cube_columns, cell, erosion_cells), f"{kinds}, y long, x long, __hit boolean, __near boolean")
    cells = cells.withColumns({c: F.col(c).cast(df.schema[c].dataType) for c in ("y", "x")})
    some = F.coalesce(*[F.col(b) for b in bands]).isNotNull() if bands else F.lit(True)
    on = [*cube_columns, "y", "x"]
    alive = df.where(some).select(*on).join(cells.where("__hit").select(*on).hint("merge"), on).select(*cube_columns).distinct().withColumn("__alive", F.lit(True))
    kept = cells.join(alive.hint("merge"), cube_columns, "left").where(F.when(F.col("__alive"), F.col("__hit")).otherwise(F.col("__near")))
    return df.join(kept.select(*on).hint("merge"), on).select(df.columns)
