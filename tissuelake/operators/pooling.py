"""Pooling patch vectors to slide vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def by_dimension(features: DataFrame, keys: list[str], vec: str, reduce: Callable[[Column], Column]) -> DataFrame:
    """keys, dim and v: one value a dimension. Partial aggregation by (keys, dim) spreads even one huge slide."""
    spread = features.select(*keys, F.posexplode(vec).alias("dim", "v"))
    return spread.groupBy(*keys, "dim").agg(reduce(F.col("v").cast("double")).alias("v"))


def assembled(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys and vec from keys, dim and v."""
    ordered = F.array_sort(F.collect_list(F.struct("dim", "v")))
    return values.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"].cast("float")).alias("vec"))


def mean_pool(features: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    return assembled(by_dimension(features, keys, vec, F.avg), keys)


def max_pool(features: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    return assembled(by_dimension(features, keys, vec, F.max), keys)


def meanmax_pool(features: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """The mean of every dimension, then the largest of every dimension."""
    both = features.select(*keys, F.posexplode(vec).alias("dim", "v")).groupBy(*keys, "dim").agg(F.avg(F.col("v").cast("double")).alias("m"), F.max(F.col("v").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "m", "x")))
    return both.groupBy(*keys).agg(ordered.alias("o")).select(*keys, F.concat(F.transform("o", lambda s: s["m"].cast("float")), F.transform("o", lambda s: s["x"].cast("float"))).alias("vec"))


def softmax_pool(scored: DataFrame, keys: list[str], score: str = "score", vec: str = "vec") -> DataFrame:
    """The mean of vectors weighted by the softmax of their scores within the keys.

    The largest score joins back as one row a key, and weights and weighted sums add up map-side.
    """
    top = scored.groupBy(*keys).agg(F.max(score).alias("top_"))
    weighted = scored.join(top, keys).withColumn("w_", F.exp(F.col(score) - F.col("top_")))
    sums = weighted.select(*keys, "w_", F.posexplode(vec).alias("dim", "v")).groupBy(*keys, "dim").agg((F.sum(F.col("v").cast("double") * F.col("w_")) / F.sum("w_")).alias("v"))
    return assembled(sums, keys)


def softmax_weights(scored: DataFrame, keys: list[str], score: str = "score") -> Column:
    own = Window.partitionBy(*keys)
    e = F.exp(F.col(score) - F.max(score).over(own))
    return e / F.sum(e).over(own)


def gated_scores(features: DataFrame, weights: dict[str, np.ndarray], vec: str = "vec") -> DataFrame:
    """features with score: gated attention over a hidden layer, c(tanh(Ah) * sigmoid(Bh)) with h = relu(Wx).

    weights: w, wb, a, ab, b, bb, c, cb. Their size is the model's, fixed.
    """
    shared = features.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        w = shared.value
        x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, w["w"].shape[1]))
        h = np.maximum(x @ w["w"].T + w["wb"], 0)
        gate = np.tanh(h @ w["a"].T + w["ab"]) / (1 + np.exp(-(h @ w["b"].T + w["bb"])))
        return pd.Series((gate @ w["c"].T + w["cb"]).ravel())

    return features.withColumn("score", score(F.col(vec)))


def gated_attention_pool(features: DataFrame, keys: list[str], weights: dict[str, np.ndarray], vec: str = "vec") -> DataFrame:
    """Gated-attention pooling of the original vectors."""
    return softmax_pool(gated_scores(features, weights, vec), keys, vec=vec)


def multihead_pool(features: DataFrame, keys: list[str], embed: Callable[[np.ndarray], np.ndarray], heads: list[Callable[[np.ndarray], np.ndarray]], project: Callable[[np.ndarray], np.ndarray], vec: str = "vec") -> DataFrame:
    """Attention with several heads: embed gives (patches, hidden, heads), heads score each slice, project joins them.

    Patches are embedded and scored where they lie; only (head, hidden) sums, weighted by exp(score) under a running
    largest score, leave a task, and merge by slide. A slide of any size costs one row a task.
    """
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in features.select(*keys).schema)

    def partial(batches):
        sums: dict[tuple, list] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                e = embed(np.stack(part[vec].to_numpy()).astype(np.float64))
                s = np.stack([head(e[:, :, k]).ravel() for k, head in enumerate(heads)], axis=1)
                top = s.max(0)
                w = np.exp(s - top)
                _merge(sums, key if isinstance(key, tuple) else (key,), [top, w.sum(0), np.einsum("nh,ndh->dh", w, e)])
        yield pd.DataFrame([(*k, v[0], v[1], v[2].ravel()) for k, v in sums.items()], columns=[*keys, "top", "weight", "total"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        sums: dict[tuple, list] = {}
        for _, r in pdf.iterrows():
            _merge(sums, (), [np.array(r["top"]), np.array(r["weight"]), np.array(r["total"]).reshape(-1, len(heads))])
        _, weight, total = sums[()]
        return pd.DataFrame([(*pdf.iloc[0][keys], project((total / weight).ravel()).astype(np.float32))], columns=[*keys, "vec"])

    parts = features.select(*keys, vec).mapInPandas(partial, f"{names}, top array<double>, weight array<double>, total array<double>")
    return parts.groupBy(*keys).applyInPandas(merge, f"{names}, vec array<float>")


def _merge(sums: dict, key: tuple, new: list) -> None:
    old = sums.get(key)
    if old is None:
        sums[key] = new
        return
    top = np.maximum(old[0], new[0])
    a, b = np.exp(old[0] - top), np.exp(new[0] - top)
    sums[key] = [top, old[1] * a + new[1] * b, old[2] * a + new[2] * b]


def position_cells(patches: DataFrame, side: str = "level0_patch", per_axis: int = 1000, checked: bool = True) -> DataFrame:
    """patches with cell, the position id of a slide encoder with per_axis cells an axis; beyond them an error.

    Unchecked, for rows that were chosen before, the id is what the formula gives.
    """
    cx, cy = F.floor(F.col("x") / F.col(side)), F.floor(F.col("y") / F.col(side))
    cell = cx * per_axis + cy + 1
    if checked:
        inside = cx.between(0, per_axis - 1) & cy.between(0, per_axis - 1)
        cell = F.when(inside, cell).otherwise(F.raise_error(F.lit("a patch lies beyond the encoder's grid")).cast(T.LongType()))
    return patches.withColumn("cell", cell)


def output_width(pooling: str, patch_dim: int, fixed: int | None = None) -> int:
    return fixed if fixed else patch_dim * (2 if pooling == "meanmax" else 1)
