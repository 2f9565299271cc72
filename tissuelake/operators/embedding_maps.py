"""Views of a slide's features: centring, principal components, similarity and the feature map."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissuelake.functions import vectors as V
from tissuelake.operators.pooling import by_dimension


def mean_vectors(features: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    values = by_dimension(features, keys, vec, F.avg)
    return values.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("mean_"))


def centred(features: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """features with each vector less its slide's mean."""
    joined = features.join(mean_vectors(features, keys, vec), keys) if keys else features.crossJoin(F.broadcast(mean_vectors(features, keys, vec)))
    return joined.withColumn(vec, V.minus(F.col(vec), F.col("mean_"))).drop("mean_")


def principal_components(features: DataFrame, k: int = 3, vec: str = "vec") -> tuple[DataFrame, np.ndarray]:
    """features with pc, the first k components of the centred vectors, and the shares of variance they explain.

    A component's sign is set so that its largest loading is positive.
    """
    rows = centred(features, [], vec).withColumn("v_", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="v_", outputCol="pc_").fit(rows)
    loads = model.pc.toArray()
    signs = np.sign(loads[np.abs(loads).argmax(0), np.arange(k)])
    flip = F.array(*(F.lit(float(s)) for s in signs))
    return model.transform(rows).withColumn("pc", F.zip_with(vector_to_array("pc_"), flip, lambda x, s: x * s)).drop("v_", "pc_"), np.asarray(model.explainedVariance.toArray())


def as_colours(components: DataFrame, keys: list[str], pc: str = "pc", k: int = 3) -> DataFrame:
    """components with rgb: each component scaled to [0, 1] within its slide."""
    own = Window.partitionBy(*keys) if keys else Window.partitionBy()
    scaled = [((F.get(pc, F.lit(i)) - F.min(F.get(pc, F.lit(i))).over(own)) / (F.max(F.get(pc, F.lit(i))).over(own) - F.min(F.get(pc, F.lit(i))).over(own) + V.TINY)) for i in range(k)]
    return components.withColumn("rgb", F.array(*scaled))


def similarity_to(features: DataFrame, reference: DataFrame, vec: str = "vec") -> DataFrame:
    """features with cosine: to the one vector of reference, whose single row is broadcast."""
    one = reference.limit(1).select(F.col(vec).alias("ref_"))
    return features.crossJoin(F.broadcast(one)).withColumn("cosine", V.cosine(F.col(vec), F.col("ref_"))).drop("ref_")


def most_distinctive(features: DataFrame, keys: list[str], idx: str = "patch_idx", vec: str = "vec") -> DataFrame:
    """keys, patch and distance: the patch furthest from its slide's mean (ties: the smallest number)."""
    far = centred(features, keys, vec).withColumn("d", F.round(V.norm(F.col(vec)), 6))
    return far.groupBy(*keys).agg(F.max_by(idx, F.struct("d", -F.col(idx))).alias(idx), F.max("d").alias("distance"))


def lattice(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All rows and columns up to the last used ones with the value of the cell's patch, null where there is none."""
    extent = cells.groupBy(*keys).agg(F.max("row").alias("r"), F.max("col").alias("c"))
    full = extent.select(*keys, "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r").cast("long"))).alias("row")).select(*keys, "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c").cast("long"))).alias("col"))
    return full.join(cells.select(*keys, "row", "col", value), [*keys, "row", "col"], "left")
