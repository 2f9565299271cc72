"""Quality control: patch scores, slide burdens, cohort ranks and filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes of the artifact raster: clean tissue, five artifacts, background.
CLASSES = {1: "clean_tissue", 2: "fold", 3: "darkspot", 4: "pen", 5: "bubble", 6: "out_of_focus", 7: "background"}
ARTIFACTS = [2, 3, 4, 5, 6]
#: Micrometres a pixel at which classifiers of tiles work.
SCALES = (1.0, 1.5, 2.0)


def without_canvas(pixels: DataFrame, cls: str = "cls") -> DataFrame:
    """Class 0 on the black canvas around a scan."""
    return pixels.withColumn(cls, F.when(F.greatest("r", "g", "b") < 10, F.lit(0)).otherwise(F.col(cls)))


def burdens(scores: DataFrame, keys: list[str], artifacts: list[str], limit: float = 0.25) -> DataFrame:
    """Of each slide: the mean artifact share of its patches, the percentage of patches at limit or more, and means."""
    burden = sum((F.col(a).cast("double") for a in artifacts), F.lit(0.0))
    return scores.withColumn("burden_", burden).groupBy(*keys).agg(F.avg("burden_").alias("mean_burden"), F.avg(F.when(F.col("burden_") >= limit, 100.0).otherwise(0.0)).alias("pct_bad"), *(F.avg(a).alias(f"mean_{a}") for a in artifacts))


def class_shares(class_px: DataFrame, keys: list[str], classes: list[int], cls: str = "cls") -> DataFrame:
    """Of each slide: tissue pixels (classes 1 to 6) and each class's share of them."""
    tissue = F.count_if(F.col(cls).between(1, 6))
    return class_px.groupBy(*keys).agg(tissue.alias("tissue_px"), *((F.count_if(F.col(cls) == k) / F.greatest(tissue, F.lit(1))).alias(f"frac_{k}") for k in classes))


def ranked(slides: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n worst slides (ties by key): a top-k, never a full sort."""
    return slides.orderBy(F.desc(by), key).limit(n)


def above_median(slides: DataFrame, value: str) -> DataFrame:
    """Slides at or above the cohort's median of a value."""
    median = slides.agg(F.percentile(value, F.lit(0.5)).alias("m_"))
    return slides.crossJoin(F.broadcast(median)).where(F.col(value) >= F.col("m_")).drop("m_")


def best_per_class(scores: DataFrame, cls: str, score: str, order: list[str]) -> DataFrame:
    """The patch of highest score of each class (ties: by order). max_by keeps one row a class and task."""
    fields = [F.col(c) for c in scores.columns if c != cls]
    return scores.groupBy(cls).agg(F.min_by(F.struct(*fields), F.struct(-F.col(score), *order)).alias("b")).select(cls, "b.*")


def usable(features: DataFrame, scores: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """features of the patches whose scores pass."""
    return features.join(scores.where(keep).select(*keys), keys, "left_semi")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def qc_layer(fractions: DataFrame, tool: str, classes: dict[int, str], usable_class: str = "clean_tissue", least: float = 0.8) -> DataFrame:
    """The store's quality rows from class shares: scores by class name, the largest class, and whether it is usable."""
    scores = F.create_map(*(x for k, name in classes.items() for x in (F.lit(name), F.col(f"class_{k}").cast("float"))))
    best = F.array_max(F.array(*(F.struct(F.col(f"class_{k}").alias("share"), F.lit(-k).alias("k")) for k in classes)))
    return fractions.select("slide_id", "grid_key", F.col("patch_idx").cast("long").alias("patch_idx"), scores.alias("scores"), (-best["k"]).cast("short").alias("label"), (F.element_at(scores, usable_class) >= F.lit(least).cast("float")).alias("usable"), F.lit(tool).alias("tool"))


def rule_classes(image: np.ndarray) -> np.ndarray:
    """Classes of an RGB image by simple rules, where no trained classifier is plugged in."""
    from tissuelake.functions.pixels import gaussian, grey, saturation

    level, colour = grey(image).astype(int), saturation(image).astype(int)
    r, g, b = (image[..., k].astype(int) for k in range(3))
    v = np.pad(level, 1, mode="edge")
    detail = np.abs(4 * level - v[:-2, 1:-1] - v[2:, 1:-1] - v[1:-1, :-2] - v[1:-1, 2:])
    sharp = gaussian(np.minimum(detail, 255).astype(np.uint8), 9)
    out = np.full(level.shape, 1, np.uint8)
    out[sharp < 2] = 6
    out[(colour > 120) & ((b > r + 60) | (g > r + 40))] = 4
    out[level < 40] = 3
    out[(level > 220) & (colour < 20)] = 7
    return out


def tiled_classes(image: np.ndarray, classify=rule_classes, tile: int = 512) -> np.ndarray:
    """Classes of an image of any size by a classifier of square tiles; border tiles are filled up with their edges."""
    h, w = image.shape[:2]
    out = np.zeros((h, w), np.uint8)
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            own = image[y : y + tile, x : x + tile]
            full = np.pad(own, ((0, tile - own.shape[0]), (0, tile - own.shape[1]), (0, 0)), mode="edge")
            out[y : y + tile, x : x + tile] = classify(full)[: own.shape[0], : own.shape[1]]
    out[image.max(-1) < 10] = 0  # the black canvas around a scan
    return out
