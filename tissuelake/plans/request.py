"""Requests: what to extract, validated, and the hashes that identify it."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields, replace

from tissuelake.functions.identity import config_hash

SCHEMA_VERSION = "0.1"
#: Fields that don't change what is computed.
RUNTIME = frozenset({"device", "batch", "read_block", "shard_index", "shard_count"})
#: Content fields that belong to a model's output, not to its grid.
OUTPUT = frozenset({"models", "amp", "multiplex", "percentiles", "aggregation", "markers", "bounds_px"})


@dataclass(frozen=True)
class Request:
    models: tuple[str, ...]
    mpp: float = 1.0
    patch_px: int = 224
    step_px: int | None = None
    segmenter: str = "otsu"
    patcher: str = "grid"
    no_segmentation: bool = False
    threshold: float = 0.1
    tolerance: float = 0.001
    snap: bool = False
    upsample: bool = False
    source_mpp: float | None = None
    stain: str | None = None
    amp: str = "fp32"
    half: bool = True
    multiplex: str | None = None
    percentiles: tuple[float, float] = (1.0, 99.0)
    aggregation: str = "mean"
    markers: tuple[str, ...] | None = None
    bounds_px: int = 2048
    device: str = "cpu"
    batch: int = 256
    read_block: int = 8
    shard_index: int = 0
    shard_count: int = 1

    def __post_init__(self) -> None:
        def positive(name: str) -> None:
            value = getattr(self, name)
            if value is not None and (isinstance(value, bool) or not math.isfinite(value) or value <= 0):
                raise ValueError(f"{name} must be finite and over zero")

        if not self.models:
            raise ValueError("at least one model is needed")
        for name in ("mpp", "patch_px", "step_px", "source_mpp", "batch", "read_block", "shard_count", "bounds_px"):
            positive(name)
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must be between 0 and 1")
        if not 0 <= self.percentiles[0] < self.percentiles[1] <= 100:
            raise ValueError("percentiles must rise and lie between 0 and 100")
        if self.stain not in (None, "macenko", "reinhard", "vahadane"):
            raise ValueError(f"unknown stain method {self.stain!r}")
        if self.aggregation not in ("mean", "concat"):
            raise ValueError(f"unknown aggregation {self.aggregation!r}")
        if self.multiplex is None and (self.percentiles != (1.0, 99.0) or self.aggregation != "mean" or self.markers):
            raise ValueError("multiplex options need a multiplex strategy")
        if not 0 <= self.shard_index < self.shard_count:
            raise ValueError("shard_index must lie in 0 .. shard_count - 1")

    def _content(self, grid: bool) -> dict:
        out = {k: v for k, v in asdict(self).items() if k not in RUNTIME and not (grid and k in OUTPUT)}
        out["segmenter"] = "none" if self.no_segmentation else "nuclear" if self.multiplex else self.segmenter
        out["step_px"] = self.step_px or self.patch_px
        if self.source_mpp is None:
            out.pop("source_mpp")
        if self.multiplex is None:
            for k in ("multiplex", "percentiles", "aggregation", "markers", "bounds_px"):
                out.pop(k, None)
        if "models" in out:
            out["models"] = sorted(out["models"])
        return out | {"schema_version": SCHEMA_VERSION}

    def grid_hash(self) -> str:
        """Identity of the grid: the same for any models on it."""
        return config_hash(self._content(True))

    def content_hash(self) -> str:
        return config_hash(self._content(False))

    def at(self, **changes: object) -> Request:
        return replace(self, **changes)


def run_hash(requests: list[Request]) -> str:
    """Identity of several grids' requests, in any order."""
    return config_hash(sorted(r.content_hash() for r in requests))


def content_fields() -> set[str]:
    return {f.name for f in fields(Request)} - RUNTIME
