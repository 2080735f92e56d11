"""Spectral and radar indices as expressions over band columns.

A calculator names the bands it needs and builds a Column; every ratio is null where its denominator is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ratio = F.try_divide


@dataclass(frozen=True)
class Calculator:
    name: str
    bands: tuple[str, ...]
    build: Callable[..., Column]

    def __call__(self, **columns: Column) -> Column:
        return self.build(*(columns.get(b, F.col(b)) for b in self.bands))


def _difference(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


def savi(nir: Column, red: Column, soil: float = 0.5) -> Column:
    return ratio((1 + soil) * (nir - red), nir + red + soil)


def _ireci(b07: Column, b04: Column, b05: Column, b06: Column) -> Column:
    """A zero B06 makes the inner ratio infinite, hence 0; a zero inner ratio gives null."""
    inner = ratio(b05, b06)
    return F.when((b06 == 0) & (b05 != 0), F.when(b07.isNotNull() & b04.isNotNull(), F.lit(0.0))).otherwise(ratio(b07 - b04, inner))


def _dprvi(vv: Column, vh: Column) -> Column:
    total = vv + vh
    return (1 - ratio(vv, total)) * ratio(4 * vh, total)


def _gvmi(b08: Column, b11: Column) -> Column:
    return ratio((b08 + 0.1) - (b11 + 0.02), (b08 + 0.1) + (b11 + 0.02))


REGISTRY: dict[str, Calculator] = {
    c.name: c
    for c in (
        Calculator("NDVI", ("B08", "B04"), _difference),
        Calculator("EVI", ("B08", "B04", "B02"), lambda n, r, b: ratio(2.5 * (n - r), n + 6 * r - 7.5 * b + 1)),
        Calculator("SAVI", ("B08", "B04"), savi),
        Calculator("NDWI", ("B03", "B08"), _difference),
        Calculator("EVI2", ("B08", "B04"), lambda n, r: ratio(2.5 * (n - r), n + 2.4 * r + 1)),
        Calculator("GVMI", ("B08", "B11"), _gvmi),
        Calculator("GNDVI", ("B08", "B03"), _difference),
        Calculator("NDRE", ("B8A", "B05"), _difference),
        Calculator("IRECI", ("B07", "B04", "B05", "B06"), _ireci),
        Calculator("S2REP", ("B04", "B05", "B06", "B08"), lambda r, e1, e2, n: 705 + 35 * ratio((r + n) / 2 - e1, e2 - e1)),
        Calculator("RVI", ("VV", "VH"), lambda vv, vh: ratio(4 * vh, vv + vh)),
        Calculator("VH_VV", ("VV", "VH"), lambda vv, vh: ratio(vh, vv)),
        Calculator("DpRVI", ("VV", "VH"), _dprvi),
        Calculator("LST_C", ("LST",), lambda k: k - 273.15),
        Calculator("TP_MM", ("tp",), lambda m: m * 1000),
        Calculator("ET_RATIO", ("ET_500m", "PET_500m"), lambda e, p: ratio(e, p)),
    )
}
#: The indices a sensor's cubes get when none are named.
DEFAULTS: dict[str, tuple[str, ...]] = {
    "sentinel2": ("NDVI", "EVI", "SAVI", "NDWI", "EVI2", "GVMI", "GNDVI", "NDRE", "IRECI", "S2REP"),
    "sentinel1": ("RVI", "VH_VV", "DpRVI"),
    "sentinel3": ("LST_C",),
    "era5": ("TP_MM",),
    "modis": ("ET_RATIO",),
}


def index(name: str) -> Column:
    """The index over columns named as its bands."""
    return resolve([name])[0]()


def resolve(names: Iterable[str], extra: Iterable[Calculator] = ()) -> list[Calculator]:
    known = REGISTRY | {c.name: c for c in extra}
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown indices {unknown}; known are {sorted(known)}")
    return [known[n] for n in names]


def compute_indices(df: DataFrame, names: Iterable[str], cube: Iterable[str] = ("parcel_id", "sensor"), extra: Iterable[Calculator] = ()) -> DataFrame:
    """Adds indices in order. One whose bands are missing is skipped; one that exists is kept for cubes where it has a value."""
    for calc in resolve(list(names), extra):
        if not set(calc.bands) <= set(df.columns):
            continue
        value = calc()
        if calc.name in df.columns:
            held = F.count(calc.name).over(Window.partitionBy(*cube))
            value = F.when(held > 0, F.col(calc.name)).otherwise(value)
        df = df.withColumn(calc.name, value)
    return df
