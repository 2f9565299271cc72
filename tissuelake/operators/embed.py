"""Patch embedding: one decoded scan for all models of a geometry, transforms shared by equal preprocessing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuelake.functions.pixels import model_input

FEATURES = "slide_id string, patch_idx long, model string, vec array<float>, error string"


class Embedder(Protocol):
    """What a model must offer: its name, its preprocessing's signature, the preprocessing, and the forward pass."""

    name: str
    dim: int

    def signature(self) -> tuple: ...

    def prepare(self, patch: np.ndarray) -> np.ndarray: ...

    def embed(self, batch: np.ndarray) -> np.ndarray: ...


@dataclass
class _Rgb:
    name: str
    dim: int = 8
    size: int = 64
    mean: tuple = (0.5, 0.5, 0.5)
    std: tuple = (0.5, 0.5, 0.5)
    crop: float | None = None
    how: str = "bilinear"

    def signature(self) -> tuple:
        return ("rgb", self.size, self.mean, self.std, self.crop, self.how)

    def prepare(self, patch: np.ndarray) -> np.ndarray:
        return model_input(patch, self.size, self.mean, self.std, self.crop, self.how)


@dataclass
class MeanEmbedder(_Rgb):
    """The mean of the normalised patch, repeated, plus a bias: deterministic, for tests."""

    bias: float = 0.0

    def embed(self, batch: np.ndarray) -> np.ndarray:
        return np.repeat(batch.mean(axis=(1, 2, 3))[:, None], self.dim, axis=1) + self.bias


@dataclass
class HistogramEmbedder(_Rgb):
    """Shares of intensities in equal bins of each colour."""

    def embed(self, batch: np.ndarray) -> np.ndarray:
        bins = max(1, self.dim // 3)
        v = np.clip((batch * np.asarray(self.std)[:, None, None] + np.asarray(self.mean)[:, None, None]) * bins, 0, bins - 1).astype(int)
        out = [np.bincount((np.arange(3)[:, None] * bins + p.reshape(3, -1)).ravel(), minlength=3 * bins) / p[0].size for p in v]
        return np.pad(np.array(out), ((0, 0), (0, self.dim - 3 * bins)))


@dataclass
class ProjectionEmbedder(_Rgb):
    """A seeded random projection of the patch shrunk to 8 x 8."""

    seed: int = 0
    _matrix: np.ndarray | None = field(default=None, repr=False)

    def embed(self, batch: np.ndarray) -> np.ndarray:
        if self._matrix is None:
            self._matrix = np.random.default_rng(self.seed).standard_normal((3 * 64, self.dim)) / np.sqrt(3 * 64)
        k = self.size // 8
        small = batch[:, :, : 8 * k, : 8 * k].reshape(len(batch), 3, 8, k, 8, k).mean(axis=(3, 5))
        return small.reshape(len(batch), -1) @ self._matrix


def embed(patches: DataFrame, models: list[Embedder], half: bool = True, batch: int = 256) -> DataFrame:
    """slide_id, patch_idx, model and vec for every patch and model; half keeps half precision's values.

    Pixels are decoded once for all models, and prepared once for all models of one signature. Patches that came with
    an error, or whose batch a model fails on, have it in place of a vector.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[tuple, list[Embedder]] = {}
        for m in models:
            groups.setdefault(m.signature(), []).append(m)
        def failed(rows: pd.DataFrame, names: list[str], why) -> Iterator[pd.DataFrame]:
            for name in names:
                yield pd.DataFrame({"slide_id": rows["slide_id"].to_numpy(), "patch_idx": rows["patch_idx"].to_numpy(), "model": name, "vec": None, "error": why})

        for pdf in batches:
            bad = pdf["pixels"].isna()
            yield from failed(pdf[bad], [m.name for m in models] if bad.any() else [], pdf.loc[bad, "error"].to_numpy())
            good = pdf[~bad]
            for at in range(0, len(good), batch):
                some = good.iloc[at : at + batch]
                images = [np.frombuffer(p, t).reshape(h, w, c) for p, t, h, w, c in zip(some["pixels"], some["dtype"], some["height"], some["width"], some["channels"], strict=True)]
                for group in groups.values():
                    try:
                        ready = np.stack([group[0].prepare(i) for i in images])
                        for m in group:
                            vectors = m.embed(ready).astype(np.float32)
                            vectors = vectors.astype(np.float16).astype(np.float32) if half else vectors
                            yield pd.DataFrame({"slide_id": some["slide_id"].to_numpy(), "patch_idx": some["patch_idx"].to_numpy(), "model": m.name, "vec": list(vectors), "error": None})
                    except Exception as e:  # noqa: BLE001 - one slide's failure must not stop a cohort
                        yield from failed(some, [m.name for m in group], f"{type(e).__name__}: {e}")

    error = F.col("error") if "error" in patches.columns else F.lit(None).cast("string").alias("error")
    return patches.select("slide_id", "patch_idx", "height", "width", "channels", "dtype", "pixels", error).mapInPandas(run, FEATURES)
