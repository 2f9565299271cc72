"""Exports of a grid: training layouts, spatial tables, polygons and thumbnails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuelake.functions.geometry import magnification
from tissuelake.functions.identity import tile_id
from tissuelake.functions.numerics import dequantised

LAYOUTS = ("trident", "clam", "stamp")


def selected_models(features: DataFrame, models: list[str] | None) -> list[str]:
    have = sorted(r[0] for r in features.select("model").distinct().collect())
    if unknown := sorted(set(models or []) - set(have)):
        raise KeyError(f"no features of {', '.join(unknown)}; there are {', '.join(have)}")
    return models or have


def layout(patches: DataFrame, features: DataFrame, grids: DataFrame, kind: str = "trident") -> DataFrame:
    """Vectors with coordinates and the layout's attributes, one row a patch and model.

    trident and clam: level-0 pixels (64 or 32 bit) and magnifications. stamp: half-precision values and micrometres
    from the slide's corner, without the stage origin.
    """
    if kind not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    keys = ["slide_id", "grid_key"]
    rows = features.join(patches.select(*keys, "patch_idx", "x", "y"), [*keys, "patch_idx"]).join(grids.select(*keys, "level0_patch", "achieved_mpp", "mpp_level0", "scale_x", "scale_y", "patch_px"), keys)
    base = ["slide_id", "model", "patch_idx"]
    if kind == "stamp":
        scale = lambda c: F.coalesce(F.col(f"scale_{c}"), F.col("mpp_level0")).cast("float")
        checked = lambda c: F.when(scale(c) > 0, scale(c)).otherwise(F.raise_error(F.lit("this layout needs the source's scale")).cast("float"))
        return rows.select(*base, F.col("vec").alias("feats"), (F.col("x").cast("float") * checked("x")).cast("float").alias("x_um"), (F.col("y").cast("float") * checked("y")).cast("float").alias("y_um"), (F.col("patch_px") * F.col("achieved_mpp")).alias("tile_size_um"), F.col("patch_px").alias("tile_size_px"))
    whole = "int" if kind == "clam" else "long"
    return rows.select(*base, F.col("vec").alias("features"), F.col("x").cast(whole).alias("x"), F.col("y").cast(whole).alias("y"), F.col("level0_patch").cast("int").alias("patch_size_level0"), magnification(F.col("achieved_mpp")).alias("target_magnification"), magnification(F.col("mpp_level0")).alias("level0_magnification"))


def write_layout(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """One folder a model and slide, as Parquet with the layout's columns."""
    rows.write.mode("overwrite" if overwrite else "error").partitionBy("model", "slide_id").parquet(path)


def tiles(patches: DataFrame, grids: DataFrame, geometry: str = "square") -> DataFrame:
    """One shape a tile with its identity: a square's polygon or a circle, in level-0 pixels, as text."""
    keys = ["slide_id", "grid_key"]
    rows = patches.join(grids.select(*keys, "level0_patch"), keys)
    own = Window.partitionBy(*keys)
    width = F.length(F.max(F.greatest("x", "y")).over(own).cast("string"))
    s = F.col("level0_patch")
    point = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    x, y = F.col("x"), F.col("y")
    square = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", point(x, y), point(x + s, y), point(x + s, y + s), point(x, y + s), point(x, y)), F.lit("))"))
    circle = F.concat(F.lit("POINT ("), point(x + s / 2, y + s / 2), F.lit(")"))
    if geometry not in ("square", "circle"):
        raise ValueError(f"geometry must be square or circle, not {geometry!r}")
    return rows.select(*keys, "patch_idx", tile_id(x, y, width).alias("instance_id"), (square if geometry == "square" else circle).alias("geometry"), (s / 2).alias("radius"))


def observations(patches: DataFrame, grids: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """The table that goes with tiles: places, level, scale, centres and the stored tissue fraction."""
    keys = ["slide_id", "grid_key"]
    rows = patches.drop("tissue_frac").join(grids.select(*keys, "level0_patch", "read_level", "achieved_mpp", "scale_x", "scale_y", "origin_x", "origin_y"), keys)
    if cells is not None:
        rows = rows.join(cells.select(*keys, "row", "col", dequantised(F.col("mask_u8")).alias("tissue_frac")), [*keys, "row", "col"], "left")
    half = F.col("level0_patch") / 2
    um = lambda c: (F.col(c) + half) * F.col(f"scale_{c}") + F.coalesce(f"origin_{c}", F.lit(0.0))
    return rows.select(*keys, "patch_idx", "x", "y", F.col("read_level").alias("level"), F.col("achieved_mpp").alias("mpp"), F.col("row").alias("array_row"), F.col("col").alias("array_col"), (F.col("x") + half).alias("center_x"), (F.col("y") + half).alias("center_y"), um("x").alias("x_um"), um("y").alias("y_um"), *(["tissue_frac"] if cells is not None else []))


def panel_table(panels: DataFrame) -> DataFrame:
    """One row a kept channel: panels has model and mapping, an array of channel records."""
    return panels.select("model", F.explode("mapping").alias("e")).select("model", F.col("e.source_name").alias("channel"), F.col("e.source_index").alias("channel_index"), F.coalesce("e.marker", "e.source_name").alias("marker"), F.col("e.marker_id").alias("marker_id"))


def feature_json(x: Column, y: Column, side: Column) -> Column:
    """One patch as a closed square in GeoJSON."""
    p = lambda a, b: F.array(a.cast("long"), b.cast("long"))
    ring = F.array(p(x, y), p(x + side, y), p(x + side, y + side), p(x, y + side), p(x, y))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(F.lit("tile").alias("objectType")).alias("properties")))


def geojson_lines(patches: DataFrame, side: Column) -> DataFrame:
    """One feature a line, in patch order within each slide: of any size, written by all tasks."""
    return patches.select("slide_id", "patch_idx", feature_json(F.col("x"), F.col("y"), side).alias("feature"))


def write_geojson(patches: DataFrame, side: Column, path: str, overwrite: bool = False) -> None:
    """A folder a slide of feature collections, each a task's part of the slide: text files that no task has to hold whole.

    The rows of a slide go to tasks by runs of patches, sorted; a line that opens and one that closes the collection
    go first and last in each file.
    """
    runs = geojson_lines(patches, side).withColumn("run", F.expr("patch_idx div 100000"))
    last = runs.groupBy("slide_id", "run").agg(F.max("patch_idx").alias("last"))
    joined = runs.join(last, ["slide_id", "run"])
    head = F.when(F.col("patch_idx") == F.col("run") * 100000, '{"type":"FeatureCollection","features":[').otherwise("")
    tail = F.when(F.col("patch_idx") == F.col("last"), "]}").otherwise(",")
    lines = joined.select("slide_id", "run", "patch_idx", F.concat(head, "feature", tail).alias("value"))
    dealt = lines.repartition("slide_id", "run").sortWithinPartitions("slide_id", "run", "patch_idx")
    dealt.select("slide_id", "run", "value").write.mode("overwrite" if overwrite else "error").partitionBy("slide_id", "run").text(path)
