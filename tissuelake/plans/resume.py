"""What is complete and what still has to run, from the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuelake.functions.vectors import all_finite, any_nonzero
from tissuelake.operators.quality import latest

GRID = ["slide_id", "grid_key"]


def complete_models(patches: DataFrame, features: DataFrame, outputs: DataFrame) -> DataFrame:
    """slide_id, grid_key, model and digest of models that are whole.

    A model is whole if it has a vector for each patch, all of the declared width and finite, a last one that isn't
    all zero (a cut-off writer leaves zeros at the end), and a commit row whose digest says what made it.
    """
    n = patches.groupBy(*GRID).agg(F.count("*").alias("n_patches"))
    last = F.max_by(any_nonzero(F.col("vec")), "patch_idx")
    seen = features.groupBy(*GRID, "model").agg(F.count("*").alias("n"), F.count_distinct("patch_idx").alias("n_distinct"), F.min(F.size("vec")).alias("narrow"), F.max(F.size("vec")).alias("wide"), F.bool_and(all_finite(F.col("vec"))).alias("finite"), last.alias("ended"))
    joined = outputs.join(n, GRID).join(seen, [*GRID, "model"], "left")
    whole = (F.coalesce("n", F.lit(0)) == F.col("n_patches")) & (F.coalesce("n_distinct", F.lit(0)) == F.col("n_patches"))
    sound = (F.col("n_patches") == 0) | ((F.col("narrow") == F.col("embedding_dim")) & (F.col("wide") == F.col("embedding_dim")) & F.col("finite") & F.col("ended"))
    return joined.where(whole & sound).select(*GRID, "model", "digest")


def missing(requested: DataFrame, complete: DataFrame) -> DataFrame:
    """Requested (slide_id, grid_key, model, digest) without a whole output of the same digest."""
    return requested.join(complete, [*GRID, "model", "digest"], "left_anti")


def latest_receipts(receipts: DataFrame) -> DataFrame:
    return latest(receipts, ["slide_id"], [F.desc("finished_utc")])


def bound_elsewhere(grids: DataFrame, wanted: DataFrame) -> DataFrame:
    """slide_ids that have a grid made from another source than the one wanted (slide_id, source_uri)."""
    own = wanted.select("slide_id", F.col("source_uri").alias("asked_")).distinct()
    return grids.join(own, "slide_id").where(~F.col("source_uri").eqNullSafe(F.col("asked_"))).select("slide_id").distinct()


def complete_slides(receipts: DataFrame, wanted: DataFrame, complete: DataFrame, grids: DataFrame | None = None) -> DataFrame:
    """slide_ids that may be skipped: the latest receipt matches the request and all its models are whole.

    wanted: a row of slide_id, grid_key, model and digest for each output of each geometry, with config_hash, source_uri
    and output_uri of the request. With grids, all grids of the slide must be of that source.
    """
    last = latest_receipts(receipts).where("status = 'complete'").select("slide_id", F.col("config_hash").alias("h_"), F.col("source_uri").alias("s_"), F.col("output_uri").alias("o_"), F.array_sort(F.array_distinct("models")).alias("m_"))
    asked = wanted.groupBy("slide_id").agg(F.array_sort(F.collect_set("model")).alias("models"), *(F.first(c).alias(c) for c in ("config_hash", "source_uri", "output_uri")))
    agree = asked.join(last, "slide_id").where((F.col("config_hash") == F.col("h_")) & (F.col("source_uri") == F.col("s_")) & (F.col("output_uri") == F.col("o_")) & (F.col("models") == F.col("m_"))).select("slide_id")
    lacking = missing(wanted, complete).select("slide_id").distinct()
    found = agree.join(lacking, "slide_id", "left_anti")
    return found if grids is None else found.join(bound_elsewhere(grids, wanted), "slide_id", "left_anti")


def without_dependents(slide_vectors: DataFrame, replaced: DataFrame) -> DataFrame:
    """Slide vectors left when patch models are replaced: those made from other models."""
    gone = replaced.select("slide_id", "grid_key", F.col("model").alias("patch_model")).distinct()
    return slide_vectors.join(gone, ["slide_id", "grid_key", "patch_model"], "left_anti")


def complete_slide_vectors(slide_vectors: DataFrame, complete: DataFrame) -> DataFrame:
    """Slide vectors of whole patch models, of their declared width, finite and with the patch output's digest."""
    models = complete.select(*GRID, F.col("model").alias("patch_model"), F.col("digest").alias("patch_digest"))
    return slide_vectors.where((F.size("vec") == F.col("dim")) & all_finite(F.col("vec"))).join(models, [*GRID, "patch_model", "patch_digest"], "left_semi")


def complete_tools(qc: DataFrame, patches: DataFrame, status: DataFrame) -> DataFrame:
    """slide_id, grid_key and tool of QC layers that were finished and have each patch once."""
    n = patches.groupBy(*GRID).agg(F.count("*").alias("n_patches"))
    seen = qc.groupBy(*GRID, "tool").agg(F.count_distinct("patch_idx").alias("n"), F.count("*").alias("rows"))
    done = status.where("complete").select(*GRID, "tool")
    return seen.join(n, GRID).where("n = n_patches and rows = n_patches").join(done, [*GRID, "tool"], "left_semi").select(*GRID, "tool")


def missing_tools(requested: DataFrame, complete: DataFrame) -> DataFrame:
    """Requested (slide_id, grid_key, tool) whose layer isn't whole."""
    return requested.join(complete, [*GRID, "tool"], "left_anti")


def labelled(grids: DataFrame, requested: DataFrame) -> DataFrame:
    """requested (slide_id, grid_hash, base key) with grid_key, the stored grid of that hash; null if none or several fit.

    A grid with the hash comes first; without one, a slide's only grid of the base key that has no hash is taken.
    """
    own = grids.select("slide_id", "grid_key", F.col("grid_hash").alias("has_"))
    fit = requested.join(own, "slide_id", "left").withColumn("rank_", F.when(F.col("has_") == F.col("grid_hash"), 0).when(F.col("has_").isNull() & (F.col("grid_key") == F.col("base_key")), 1))
    best = fit.groupBy("slide_id", "grid_hash", "base_key").agg(F.min("rank_").alias("r"), F.collect_list(F.when(F.col("rank_").isNotNull(), F.struct("rank_", "grid_key"))).alias("all_"))
    first = F.filter("all_", lambda x: x["rank_"] == F.col("r"))
    return best.select("slide_id", "grid_hash", F.when(F.size(first) == 1, F.get(first, F.lit(0))["grid_key"]).alias("grid_key"))


def receipt_totals(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy("status").agg(F.count("*").alias("n"))
