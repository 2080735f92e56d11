"""Validated configurations. Sensor values that are None fall back to the global ones."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from parcelcube.functions.indices import resolve
from parcelcube.operators.features import PHASES
from parcelcube.operators.spatial import STATS
from parcelcube.operators.temporal import AGGREGATES, FREQUENCIES


def _build(cls: type, raw: Mapping[str, Any] | None) -> Any:
    raw = dict(raw or {})
    known = {f.name for f in fields(cls)}
    if extra := sorted(set(raw) - known):
        raise ValueError(f"{cls.__name__}: unknown keys {extra}; known are {sorted(known)}")
    return cls(**raw)


@dataclass(frozen=True)
class Temporal:
    """freq and agg of the resampling, window and its own aggregate of the smoothing; each may be None."""

    freq: str | None = None
    agg: str | None = None
    window: int | None = None
    rolling_agg: str | None = None

    def __post_init__(self) -> None:
        if self.freq is not None and self.freq not in FREQUENCIES:
            raise ValueError(f"freq must be one of {FREQUENCIES}, not {self.freq!r}")
        for a in (self.agg, self.rolling_agg):
            if a is not None and a not in AGGREGATES:
                raise ValueError(f"aggregate must be one of {sorted(AGGREGATES)}, not {a!r}")
        if self.window is not None and self.window < 1:
            raise ValueError("window must be at least 1")

    def over(self, base: Temporal, strict: bool = False) -> Temporal:
        """A sensor's settings over the global ones; strict: the window is not inherited."""
        return Temporal(self.freq or base.freq, self.agg or base.agg, self.window if strict else self.window or base.window, self.rolling_agg or (None if strict else base.rolling_agg))


@dataclass(frozen=True)
class Sensor:
    stats: tuple[str, ...] | None = None
    indices: tuple[str, ...] = ()
    output_bands: tuple[str, ...] | None = None
    mask: bool | None = None
    erosion: float | None = None
    temporal: Temporal | None = None

    def __post_init__(self) -> None:
        resolve(self.indices)
        if self.stats is not None and (bad := set(self.stats) - set(STATS)):
            raise ValueError(f"unknown stats {sorted(bad)}; known are {sorted(STATS)}")


@dataclass(frozen=True)
class DatasetConfig:
    sensors: Mapping[str, Sensor] = field(default_factory=dict)
    stats: tuple[str, ...] = ("mean",)
    mask: bool = True
    erosion: float = 0.0
    fuse: bool = True
    temporal: Temporal = Temporal()
    cell: float = 10.0

    @classmethod
    def of(cls, raw: Mapping[str, Any]) -> DatasetConfig:
        raw = dict(raw)
        sensors = {name: _build(Sensor, {k: (_build(Temporal, v) if k == "temporal" else tuple(v) if isinstance(v, list) else v) for k, v in (s or {}).items()}) for name, s in dict(raw.pop("sensors", {})).items()}
        temporal = _build(Temporal, raw.pop("temporal", None))
        return _build(cls, raw | {"sensors": sensors, "temporal": temporal, "stats": tuple(raw.get("stats", ("mean",)))})

    def stats_for(self, sensor: str) -> tuple[str, ...]:
        own = self.sensors[sensor].stats
        return self.stats if own is None else own

    def mask_for(self, sensor: str) -> bool:
        own = self.sensors[sensor].mask
        return self.mask if own is None else own

    def erosion_for(self, sensor: str) -> float:
        own = self.sensors[sensor].erosion
        return self.erosion if own is None else own

    def temporal_for(self, sensor: str, strict: bool = False) -> Temporal:
        own = self.sensors[sensor].temporal
        return self.temporal if own is None else own.over(self.temporal, strict)


@dataclass(frozen=True)
class FeaturesConfig:
    columns: tuple[str, ...]
    targets: tuple[str, ...] = ()
    merge: tuple[str, ...] = ("parcel_id", "year")
    max_null_pct: float = 100.0
    interpolate: bool = False
    monthly: bool = False
    phases: Mapping[str, tuple[int, ...]] | None = None
    phase_aggs: tuple[str, ...] | None = None
    deltas: bool = False
    peak: bool = False
    season: bool = False
    phase_delta: bool = False
    integrals: Mapping[str, tuple[int, ...]] | None = None
    integral_columns: tuple[str, ...] | None = None
    flags: bool = False
    static: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.max_null_pct <= 100:
            raise ValueError("max_null_pct must be within 0 and 100")
        for months in (self.phases or PHASES).values():
            if not set(months) <= set(range(1, 13)):
                raise ValueError("months must be within 1 and 12")


@dataclass(frozen=True)
class TrainingConfig:
    targets: tuple[str, ...]
    models: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    log_target: bool = False
    split: str = "split"
    dry_run: bool = False


# The customary acquisition defaults.
SENSOR_DEFAULTS: dict[str, dict[str, Any]] = {
    "S1": {"polarizations": ["VV", "VH"]}, "S2": {"bands": ["B04", "B08", "NDVI"], "cloud_cover": 20}, "S3": {"products": ["lst-in"]}, "ERA5": {"variable": "tp", "daily_agg": "sum"}, "MODIS": {"products": ["ET_500m", "PET_500m"]},
}


@dataclass(frozen=True)
class RunConfig:
    sensors: Mapping[str, Mapping[str, Any] | None]
    max_parallel: int = 3
    buffer_m: int = 100
    target_res_m: int | None = None

    def __post_init__(self) -> None:
        if bad := set(self.sensors) - set(SENSOR_DEFAULTS):
            raise ValueError(f"unknown sensors {sorted(bad)}; known are {sorted(SENSOR_DEFAULTS)}")
        if self.max_parallel < 1 or self.buffer_m < 0:
            raise ValueError("max_parallel must be at least 1 and buffer_m at least 0")
        cover = self.enabled().get("S2", {}).get("cloud_cover", 0)
        if not 0 <= cover <= 100:
            raise ValueError("cloud_cover must be within 0 and 100")
        if self.enabled().get("ERA5", {}).get("daily_agg", "sum") not in ("sum", "mean", "min", "max"):
            raise ValueError("daily_agg must be sum, mean, min or max")

    def enabled(self) -> dict[str, dict[str, Any]]:
        return {s: SENSOR_DEFAULTS[s] | dict(v) for s, v in self.sensors.items() if v is not None}
