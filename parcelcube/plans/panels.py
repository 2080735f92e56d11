"""Panels of a snapshot as frames: which ones a cube can show, at which time, and their values per pixel. Drawing is left to others."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcube.functions import bands as B
from parcelcube.functions import raster as V
from parcelcube.functions.indices import REGISTRY, compute_indices

# The ends of the scale an index is shown with; one not listed is stretched between its 2 and 98 % quantiles.
SCALES: dict[str, tuple[float, float]] = {
    **dict.fromkeys(("NDVI", "EVI", "SAVI", "NDWI", "EVI2", "GVMI", "GNDVI", "NDRE"), (-1.0, 1.0)), "IRECI": (0.0, 3.0), "S2REP": (700.0, 750.0),
    **dict.fromkeys(("RVI", "DpRVI", "ET_RATIO"), (0.0, 1.0)), "LST_C": (-10.0, 50.0), "TP_MM": (0.0, 50.0),
}
RADAR = ("VV", "VH")
CUBE = ("parcel_id", "sensor")


@dataclass(frozen=True)
class Panel:
    """kind is optical or radar (four colour values a pixel), index, band or decibel (one value)."""

    name: str
    kind: str
    bands: tuple[str, ...]

    @property
    def title(self) -> str:
        return f"{self.name} (dB)" if self.kind == "decibel" else self.name


COMPOSITES = (Panel("RGB", "optical", ("B04", "B03", "B02")), Panel("SAR_RGB", "radar", RADAR))


def resolve_panels(columns: Iterable[str], extra: Iterable[str] = ()) -> tuple[list[Panel], list[str]]:
    """The panels that columns allow, in order: composites, NDVI, then those asked for by name; and the names that nothing is known of.

    A name is an index where the columns hold all its bands, else a band. Repeats stay.
    """
    held, unknown = set(columns), []
    panels = [p for p in COMPOSITES if held.issuperset(p.bands)]
    if held.issuperset(REGISTRY["NDVI"].bands):
        panels.append(Panel("NDVI", "index", REGISTRY["NDVI"].bands))
    for name in extra:
        if name in REGISTRY and held.issuperset(REGISTRY[name].bands):
            panels.append(Panel(name, "index", REGISTRY[name].bands))
        elif name in held:
            panels.append(Panel(name, "decibel" if name in RADAR else "band", (name,)))
        else:
            unknown.append(name)
    return panels, unknown


def at_time(df: DataFrame, time: int | str | datetime, cube: Iterable[str] = CUBE) -> DataFrame:
    """Each cube's pixels of one time step: the one of a number, from 0 or backwards from -1, or the one nearest to a time, the earlier of two as near.

    Cubes without a step of that number have no rows, as have pixels without a time.
    """
    keys = list(cube)
    steps = df.where("time IS NOT NULL").select(*keys, "time").distinct().groupBy(*keys)
    if isinstance(time, int):
        seen = F.sort_array(F.collect_list("time"))  # a cube has as many as it has time steps
        chosen = steps.agg(F.get(seen, F.lit(time) if time >= 0 else F.size(seen) + time).alias("__t"))
    else:
        gap = F.abs(F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.lit(time).cast("timestamp")))
        chosen = steps.agg(F.min_by("time", F.struct(gap, F.col("time"))).alias("__t"))
    chosen = chosen.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    near = [F.col("time") == F.col("__t"), *[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]]
    return df.join(chosen, near, "left_semi")


def decibels(df: DataFrame, bands: Iterable[str], image: Iterable[str]) -> DataFrame:
    """Radar bands in decibels: an image whose median is above 0 holds digital numbers and is calibrated and filtered, others are taken as they are.

    The median's sign follows from how many values are above 0, and if these are just half from the two values around 0.
    """
    keys, bands = list(image), list(bands)

    def raw(b: str) -> Column:
        v = F.col(b)
        above, n = F.count_if(v > 0), F.count(v)
        return F.when(2 * above == n, F.min(F.when(v > 0, v)) + F.max(F.when(v <= 0, v)) > 0).otherwise(2 * above > n)

    guard = df.groupBy(*keys).agg(*[raw(b).alias(f"__raw_{b}") for b in bands]).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    filtered = B.speckle_median(df.withColumns({f"__db_{b}": B.sigma_nought(F.col(b)) for b in bands}), [f"__db_{b}" for b in bands], keys)
    out = filtered.join(guard, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return out.withColumns({b: F.when(F.col(f"__raw_{b}"), B.decibel(F.col(f"__db_{b}"))).otherwise(F.col(b)) for b in bands}).select(df.columns)


def render(df: DataFrame, panel: Panel, image: Iterable[str] = (*CUBE, "time")) -> DataFrame:
    """The pixels of some images as one panel: image, y, x, and r, g, b, a of a composite, else value and its shade from 0 to 1 on the panel's scale."""
    keys = list(image)
    held = [*keys, "y", "x"]
    if panel.kind == "optical":
        return V.true_colour(df.select(*held, *panel.bands), *[F.col(b) for b in panel.bands]).select(*held, "r", "g", "b", "a")
    if panel.kind == "radar":
        return V.radar_false_colour(decibels(df.select(*held, *panel.bands), panel.bands, keys), keys).select(*held, "r", "g", "b", "a")
    rows = decibels(df.select(*held, panel.name), panel.bands, keys) if panel.kind == "decibel" else df
    rows = rows.select(*held, F.col(panel.name).alias("value")).withColumn("shade", F.col("value"))
    if panel.kind == "index" and panel.name in SCALES:
        low, high = SCALES[panel.name]
        return rows.withColumn("shade", B.clip((F.col("value") - low) / (high - low), 0.0, 1.0))
    return V.stretch(rows, ["shade"], keys).select(*held, "value", "shade")


@dataclass(frozen=True)
class Snapshot:
    """Panels in order with a frame for each, and the names that could not be resolved."""

    panels: list[Panel]
    frames: list[DataFrame]
    unknown: list[str]


def snapshot(df: DataFrame, time: int | str | datetime = 0, extra: Iterable[str] = (), primary: bool = False, cube: Iterable[str] = CUBE) -> Snapshot:
    """Every cube at one time as panels; primary gives the first composite alone. An index that a cube holds already is shown as it is there.

    Raises ValueError where there is nothing to show. Frames are lazy, and each reads its own bands only.
    """
    panels, unknown = resolve_panels(df.columns, () if primary else extra)
    panels = [p for p in panels if p in COMPOSITES][:1] if primary else panels
    if not panels:
        raise ValueError("these bands allow no composite" if primary else "these bands allow no panel")
    keys = list(cube)
    frames = []
    for p in panels:
        bands = [*p.bands, *([p.name] if p.kind == "index" and p.name in df.columns and p.name not in p.bands else [])]
        rows = df.select(*keys, "time", "y", "x", *bands)
        rows = compute_indices(rows, [p.name], keys) if p.kind == "index" else rows
        frames.append(render(at_time(rows, time, keys), p, [*keys, "time"]))
    return Snapshot(panels, frames, unknown)


def mosaic(rows: Iterable[tuple[DataFrame, int | str | datetime, Iterable[str]]]) -> tuple[list[Snapshot], int]:
    """A snapshot for each (pixels, time, extra), and the most panels of one: the columns of a mosaic."""
    shots = [snapshot(df, time, extra) for df, time, extra in rows]
    return shots, max((len(s.panels) for s in shots), default=0)
