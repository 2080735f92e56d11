"""Union of shapes: the parts of a parcel become one shape without overlaps.

Edges are split where they meet; how often the edges wind around each side of a piece tells whether there is ground, and pieces with ground on
one side only are the outline of the union. Points closer than 1e-10 of the extent are one point. Shapes are arrays of rings as in functions.geometry; no ring crosses itself.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Ring = list[tuple[float, float]]
SHAPE = "array<array<struct<x:double,y:double>>>"
#: Points tested against the edges of a part at a time.
BLOCK = 4096
#: Pairs of edges looked at at a time.
PAIRS = 500_000


def signed(ring: np.ndarray) -> float:
    """Twice the area of a closed ring, positive if it turns counter-clockwise."""
    x, y = (ring - ring[0]).T
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]))


def rings_of(shape: Iterable) -> list[list[np.ndarray]]:
    """Parts of a shape as closed arrays of points; rings without area are left out. A ring that turns counter-clockwise starts a part."""
    parts: list[list[np.ndarray]] = []
    for ring in shape if shape is not None else ():
        points = np.array([(p["x"], p["y"]) for p in ring], dtype=float).reshape(-1, 2)
        if len(points) and (points[0] != points[-1]).any():
            points = np.vstack([points, points[:1]])
        if len(points) < 4 or not np.isfinite(points).all() or signed(points) == 0:
            continue
        if signed(points) > 0 or not parts:
            parts.append([points if signed(points) > 0 else points[::-1]])
        else:
            parts[-1].append(points)
    return parts


def edges_of(rings: Iterable[np.ndarray]) -> np.ndarray:
    """x0, y0, x1, y1 of every edge that has a length."""
    edges = np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings])
    return edges[(edges[:, :2] != edges[:, 2:]).any(axis=1)]


def inside(edges: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Even-odd rule of one part's edges."""
    found = np.zeros(len(points), dtype=bool)
    x0, y0, x1, y1 = edges.T
    slope = (x1 - x0) / np.where(y1 == y0, 1.0, y1 - y0)
    for at in range(0, len(points), BLOCK):
        x, y = points[at : at + BLOCK].T[:, :, None]
        found[at : at + BLOCK] = (((y0 > y) != (y1 > y)) & (x < slope * (y - y0) + x0)).sum(axis=1) % 2 == 1
    return found


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, n numbers."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def neighbours(edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of edges whose boxes grown by one meet, each pair once, some at a time: by strips along y, within a strip by x."""
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    bounds = np.sort(low[:, 1])[:: max(16, int(np.sqrt(len(edges))))][1:]
    first, last = np.searchsorted(bounds, low[:, 1] - 1, side="right"), np.searchsorted(bounds, high[:, 1] + 1, side="right")
    held = np.repeat(np.arange(len(edges)), last - first + 1)
    strip = _ranges(first, last - first + 1)
    origin = low[:, 0].min()
    wide = high[:, 0].max() - origin + 4
    place = strip * wide + low[held, 0] - origin
    order = np.argsort(place, kind="stable")
    held, strip, place = held[order], strip[order], place[order]
    after = np.arange(1, len(held) + 1)
    n = np.searchsorted(place, strip * wide + high[held, 0] - origin + 1, side="right") - after
    ends = np.cumsum(n)
    at = 0
    while at < len(held):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + PAIRS, side="right")))
        i, j = np.repeat(held[at:to], n[at:to]), held[_ranges(after[at:to], n[at:to])]
        near = (low[i, 1] <= high[j, 1] + 1) & (low[j, 1] <= high[i, 1] + 1) & (np.repeat(strip[at:to], n[at:to]) == np.maximum(first[i], first[j]))
        yield i[near], j[near]
        at = to


def meetings(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges and points on whole numbers where they are met by others: crossings, and ends that lie on them."""
    owners, points = [np.zeros(0, dtype=np.int64)], [np.zeros((0, 2))]
    for pair in neighbours(edges):
        for i, j in (pair, pair[::-1]):  # ends of i on j
            c, e = edges[j, :2], edges[j, 2:] - edges[j, :2]
            for p in (edges[i, :2], edges[i, 2:]):
                t = ((p - c) * e).sum(axis=1) / (e * e).sum(axis=1)
                on = (t > 0) & (t < 1) & (np.abs(p - c - t[:, None] * e).max(axis=1, initial=0) <= 1)
                owners.append(j[on])
                points.append(p[on])
        i, j = pair
        a, d, c, e = edges[i, :2], edges[i, 2:] - edges[i, :2], edges[j, :2], edges[j, 2:] - edges[j, :2]
        cross = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
        safe = np.where(cross == 0, 1.0, cross)
        w = c - a
        t, u = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / safe, (w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]) / safe
        met = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        p = np.rint(a[met] + t[met, None] * d[met])
        owners += [i[met], j[met]]
        points += [p, p]
    return np.concatenate(owners), np.vstack(points)


def pieces(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges split where they meet, from the lesser to the greater end, each once, and how many more go so than back; not those that cancel out."""
    n = np.arange(len(edges))
    met, at = meetings(edges)
    owner, points = np.concatenate([n, met, n]), np.vstack([edges[:, :2], at, edges[:, 2:]])
    along = ((points - edges[owner, :2]) * (edges[owner, 2:] - edges[owner, :2])).sum(axis=1)
    order = np.lexsort((along, np.repeat([0, 1, 2], [len(n), len(met), len(n)]), owner))
    owner, points = owner[order], points[order].astype(np.int64)
    p, q = points[:-1], points[1:]
    real = (owner[:-1] == owner[1:]) & (p != q).any(axis=1)
    p, q = p[real], q[real]
    back = (p[:, 0] > q[:, 0]) | ((p[:, 0] == q[:, 0]) & (p[:, 1] > q[:, 1]))
    lines = np.where(back[:, None], np.hstack([q, p]), np.hstack([p, q]))
    order = np.lexsort(lines.T[::-1])
    lines = lines[order]
    fresh = np.ones(len(lines), dtype=bool)
    fresh[1:] = (lines[1:] != lines[:-1]).any(axis=1)
    net = np.zeros(int(fresh.sum()), dtype=np.int64)
    np.add.at(net, np.cumsum(fresh) - 1, np.where(back[order], -1, 1))
    return lines[fresh][net != 0], net[net != 0]


def beyond(lines: np.ndarray, weights: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """From the middle of each asked line (by number) along x: the sum of weights of the lines further on. Strips along y hold the lines that pass them."""
    x0, y0, x1, y1 = lines.astype(float).T
    x, y = (x0[asked] + x1[asked]) / 2, (y0[asked] + y1[asked]) / 2
    total = np.zeros(len(asked), dtype=np.int64)
    steep = np.flatnonzero(y0 != y1)
    if not len(asked) or not len(steep):
        return total
    bounds = np.sort(y)[:: max(16, int(np.sqrt(len(y))))][1:]
    strip = np.searchsorted(bounds, y, side="right")
    first, last = np.searchsorted(bounds, np.minimum(y0, y1)[steep], side="right"), np.searchsorted(bounds, np.maximum(y0, y1)[steep], side="right")
    held, of = np.repeat(steep, last - first + 1), _ranges(first, last - first + 1)
    held = held[np.argsort(of, kind="stable")]
    points = np.argsort(strip, kind="stable")
    n = len(bounds) + 1
    held_to, points_to = np.cumsum(np.bincount(of, minlength=n)), np.cumsum(np.bincount(strip, minlength=n))
    for k in range(n):
        j = held[held_to[k - 1] if k else 0 : held_to[k]]
        inside_strip = points[points_to[k - 1] if k else 0 : points_to[k]]
        step = max(1, BLOCK * 64 // max(1, len(j)))
        for at in range(0, len(inside_strip), step):
            i = inside_strip[at : at + step]
            px, py = x[i, None], y[i, None]
            met = ((y0[j] > py) != (y1[j] > py)) & (px < (x1[j] - x0[j]) * (py - y0[j]) / (y1[j] - y0[j]) + x0[j]) & (asked[i, None] != j)
            total[i] = met @ weights[j]
    return total


def outline(edges: np.ndarray, ground: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Pieces of directed edges on whole numbers with ground on their left only; ground tells it from how often the edges wind around a place."""
    if not len(edges):
        return np.zeros((0, 4), dtype=np.int64)
    lines, net = pieces(edges)
    up = np.sign(lines[:, 3] - lines[:, 1])
    level = up == 0
    right, left = np.zeros(len(lines), dtype=np.int64), np.zeros(len(lines), dtype=np.int64)
    # a ray to the east meets what goes up once more, one to the north what goes west
    steep = np.flatnonzero(~level)
    east = beyond(lines, net * up, steep)
    west = east + (net * up)[steep]
    left[steep], right[steep] = np.where(up[steep] > 0, west, east), np.where(up[steep] > 0, east, west)
    flat = np.flatnonzero(level)
    left[flat] = beyond(lines[:, [1, 0, 3, 2]], -net, flat)
    right[flat] = left[flat] - net[flat]
    left, right = ground(left), ground(right)
    return np.vstack([lines[left & ~right], lines[right & ~left][:, [2, 3, 0, 1]]])


def stitch(edges: list[tuple[tuple[int, int], tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Rings of edges with ground on their left, by the sharpest left turn; a ring that meets itself is parted there."""
    leaving: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b in sorted(edges):
        leaving.setdefault(a, []).append(b)
    rings = []
    for a in sorted(leaving):
        while leaving[a]:
            path, seen = [a], {a: 0}
            at, last = leaving[a].pop(), a
            while True:
                if at in seen:
                    ring = path[seen[at] :]
                    for p in ring[1:]:
                        del seen[p]
                    path = path[: seen[at] + 1]
                    rings.append(ring)
                    if at == a and len(path) == 1:
                        break
                else:
                    seen[at] = len(path)
                    path.append(at)
                outs = leaving.get(at, [])
                if not outs:  # points that became one have closed it already
                    break
                back = math.atan2(last[1] - at[1], last[0] - at[0])
                turns = [(back - math.atan2(q[1] - at[1], q[0] - at[0])) % (2 * math.pi) or 2 * math.pi for q in outs] if len(outs) > 1 else [0.0]
                last, at = at, outs.pop(turns.index(min(turns)))
    return rings


def straightened(ring: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ring from its least point on, without points amid a straight line."""
    n = len(ring)
    before, after, left = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)], n
    for i, p in enumerate(ring):
        (ax, ay), (bx, by) = ring[before[i]], ring[after[i]]
        if left > 3 and abs((p[0] - ax) * (by - ay) - (p[1] - ay) * (bx - ax)) <= 2 * max(abs(bx - ax), abs(by - ay)):
            after[before[i]], before[after[i]] = after[i], before[i]
            after[i], left = -1, left - 1
    first = i = min((i for i in range(n) if after[i] >= 0), key=lambda i: ring[i])
    kept = [ring[first]]
    while (i := after[i]) != first:
        kept.append(ring[i])
    return kept


def united(parts: list[list[np.ndarray]]) -> list[list[Ring]]:
    """Parts that do not overlap: outlines counter-clockwise, each followed by its holes; in the order of their least points."""
    if not parts:
        return []
    every = np.vstack([r for part in parts for r in part])
    origin = every.min(axis=0)
    # a power of two, so that coordinates in whole or half metres stay what they are
    unit = 2.0 ** np.floor(np.log2(max(float((every.max(axis=0) - origin).max()), 1e-9) * 1e-10))
    whole = [[np.rint((r - origin) / unit) for r in part] for part in parts]
    exact: dict[tuple[int, int], tuple[float, float]] = {}
    for part, grid in zip(parts, whole, strict=True):
        for ring, points in zip(part, grid, strict=True):
            for (x, y), (i, j) in zip(ring, points, strict=True):
                exact.setdefault((int(i), int(j)), (float(x), float(y)))
    # within a part holes count by the even-odd rule, parts add up
    edges = [outline(edges_of(grid), lambda w: w % 2 == 1) if len(grid) > 1 else edges_of(grid) for grid in whole]
    kept = [((a, b), (c, d)) for a, b, c, d in outline(np.vstack(edges).astype(float), lambda w: w > 0).tolist()]
    outlines, holes = [], []
    for ring in stitch(kept):
        if len(ring) < 3:
            continue
        ring = straightened(ring)
        points = np.array([*ring, ring[0]], dtype=float)
        double = signed(points)
        if double:
            (outlines if double > 0 else holes).append((ring, points, abs(double)))
    found = {n: [] for n in range(len(outlines))}
    amid = np.array([(points[0] + points[1]) / 2 for _, points, _ in holes]).reshape(-1, 2)
    least, around = np.full(len(holes), np.inf), np.full(len(holes), -1)
    for n, (_, points, double) in enumerate(outlines):
        near = np.flatnonzero((double < least) & (amid >= points.min(axis=0)).all(axis=1) & (amid <= points.max(axis=0)).all(axis=1))
        near = near[inside(edges_of([points]), amid[near])] if len(near) else near
        least[near], around[near] = double, n
    for (ring, _, _), n in zip(holes, around.tolist(), strict=True):
        if n >= 0:
            found[n].append(ring)
    point = lambda p: exact.get(p) or (float(origin[0] + p[0] * unit), float(origin[1] + p[1] * unit))
    closed = lambda ring: [point(p) for p in [*ring, ring[0]]]
    order = sorted(range(len(outlines)), key=lambda n: outlines[n][0])
    return [[closed(outlines[n][0]), *[closed(h) for h in sorted(found[n])]] for n in order]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    for batch in batches:
        shapes = [united([p for shape in held for p in rings_of(shape)]) for held in batch["shapes"].to_pylist()]
        rings = [[[{"x": x, "y": y} for x, y in ring] for part in s for ring in part] or None for s in shapes]
        names = [n for n in batch.schema.names if n != "shapes"]
        yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(rings, kind)], [*names, "shape"])


def dissolve(df: DataFrame, keys: Iterable[str], shape: str = "shape", rounds: int = 2, salts: int = 16) -> DataFrame:
    """One shape per key, the union of the shapes of its rows: keys and `shape`.

    Nulls and rings without area add nothing; a key without ground has a null shape. Rows of a key that many share are united in groups
    by a hash first, in all rounds but the last, so that one task sees whole shapes of parts only, never every row of a hot key.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(shape).cast(SHAPE).alias("shape"))
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.drop("shape").dtypes)
    n = 4 * df.sparkSession.sparkContext.defaultParallelism
    for nth in range(rounds):
        last = nth == rounds - 1
        salt = [] if last else [F.pmod(F.xxhash64("shape"), F.lit(salts ** (rounds - 1 - nth))).alias("__salt")]
        # a number of its own, as uniting costs more than its bytes tell and small partitions would be put together
        dealt = rows.select("*", *salt).repartition(n, *keys, *(["__salt"] if salt else []))
        held = dealt.groupBy(*keys, *(["__salt"] if salt else [])).agg(F.collect_list("shape").alias("shapes"))
        rows = held.select(*keys, "shapes").mapInArrow(_rows, f"{kinds}, shape {SHAPE}")
    return rows
