"""Reading pixels: patches in blocks, and coarse levels whole, by the tasks that use them.

No plane is shuffled: what moves are the places to read. A task opens the image and reads the chunks that its
patches touch, and keeps those used last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuelake.functions.geometry import mapped, nearest_level
from tissuelake.functions.pixels import resized, three_channels, to_uint8
from tissuelake.sources.omezarr import Image, opened

PATCH = "slide_id string, patch_idx long, height int, width int, channels int, dtype string, pixels binary, error string"
#: Patches that one task reads, and slides whose coarse level one task does.
TASK_PATCHES, MOST_TASKS = 2048, 100_000
#: Longest side of a level that is held whole, and rows of pixels averaged at a time where it is longer.
WHOLE_PX, BAND = 12_000, 2048


def read_windows(patches: DataFrame, levels: DataFrame) -> DataFrame:
    """patches with lx and ly, their place on the level that they are read from. levels: slide_id, level, ds_x, ..."""
    joined = patches.join(levels.withColumnRenamed("level", "read_level"), ["slide_id", "read_level"])
    return joined.withColumn("lx", mapped(F.col("x"), F.col("ds_x"), F.col("off_x"))).withColumn("ly", mapped(F.col("y"), F.col("ds_y"), F.col("off_y")))


def overlaps(windows: DataFrame, chunk_h: Column, chunk_w: Column) -> DataFrame:
    """windows once for each chunk place that they touch: cy and cx, clipped to the level."""
    span = lambda at, side, size, extent: F.sequence(F.floor(F.greatest(at, F.lit(0)) / size), F.floor((F.least(at + side, extent) - 1) / size))
    touching = windows.where((F.col("lx") + F.col("read_w") > 0) & (F.col("ly") + F.col("read_h") > 0) & (F.col("lx") < F.col("level_w")) & (F.col("ly") < F.col("level_h")))
    rows = touching.withColumn("cy", F.explode(span(F.col("ly"), F.col("read_h"), chunk_h, F.col("level_h"))))
    return rows.withColumn("cx", F.explode(span(F.col("lx"), F.col("read_w"), chunk_w, F.col("level_w"))))


def blocks(windows: DataFrame, side: int) -> DataFrame:
    """windows with bx and by: blocks of side x side patches that are read at once."""
    n = F.greatest(F.lit(1), F.lit(side) * F.col("read_w"))
    return windows.withColumn("bx", F.floor(F.col("lx") / n)).withColumn("by", F.floor(F.col("ly") / n))


def as_rgb(image: np.ndarray, inside: np.ndarray, float_scale: float | None) -> np.ndarray:
    """Three 8-bit channels, white off the level."""
    out = np.ascontiguousarray(three_channels(to_uint8(image, float_scale)))
    out[~inside] = 255
    return out


def read_patches(windows: DataFrame, side: int, n_patches: int, rgb: bool = True, out_px: int | None = None) -> DataFrame:
    """One row a window with its pixels: RGB bytes padded with white, or all channels in their type padded with 0.

    windows: slide_id, path, patch_idx, read_level, lx, ly, read_w, read_h, float_scale. Blocks of side x side patches
    are read as one rectangle each and cut; the side changes no pixel. Rows of blocks are dealt to tasks whole, so that
    chunks between neighbouring blocks are decoded once. What can't be read comes back with its error in place of pixels.
    """
    read = uuid.uuid4().hex

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        y, x = int(pdf["ly"].min()), int(pdf["lx"].min())
        h, w = int((pdf["ly"] + pdf["read_h"]).max()) - y, int((pdf["lx"] + pdf["read_w"]).max()) - x
        rows = []
        try:
            image, inside = opened(first["path"], read).window(int(first["read_level"]), y, x, h, w)
            if rgb:
                image = as_rgb(image, inside, None if pd.isna(first["float_scale"]) else float(first["float_scale"]))
            for r in pdf.itertuples():
                own = image[r.ly - y : r.ly - y + r.read_h, r.lx - x : r.lx - x + r.read_w]
                own = resized(own, out_px) if out_px else own
                rows.append((r.slide_id, r.patch_idx, *own.shape, own.dtype.name, own.tobytes(), None))
        except Exception as e:  # noqa: BLE001 - one unreadable slide must not stop a cohort
            rows = [(s, i, 0, 0, 0, "", None, f"{type(e).__name__}: {e}") for s, i in zip(pdf["slide_id"], pdf["patch_idx"], strict=True)]
        return pd.DataFrame(rows, columns=["slide_id", "patch_idx", "height", "width", "channels", "dtype", "pixels", "error"])

    tasks = max(1, min(MOST_TASKS, -(-n_patches // TASK_PATCHES)))
    wanted = blocks(windows.select("slide_id", "path", "patch_idx", F.col("read_level").cast("int").alias("read_level"), *(F.col(c).cast("long").alias(c) for c in ("lx", "ly", "read_w", "read_h")), "float_scale"), side)
    return wanted.repartition(tasks, "path", "read_level", "by").groupBy("path", "read_level", "by", "bx").applyInPandas(build, PATCH)


def read_level(image: Image, level: int, most: int = WHOLE_PX) -> tuple[np.ndarray, int]:
    """A level with all channels, averaged over squares if a side is over `most`; the squares' side.

    Long levels are read and averaged in bands, so that only the small image is ever whole.
    """
    _, w, h, *_ = image.levels[level]
    factor = -(-max(w, h) // most)
    if factor <= 1:
        return image.window(level, 0, 0, h, w)[0], 1
    bands = []
    for y in range(0, h, BAND * factor):
        n = min(BAND * factor, h - y)
        v = np.pad(image.window(level, y, 0, n, w)[0], ((0, -n % factor), (0, -w % factor), (0, 0)), mode="edge")
        small = v.reshape(v.shape[0] // factor, factor, v.shape[1] // factor, factor, -1).mean(axis=(1, 3), dtype=np.float64)
        bands.append((np.rint(small) if v.dtype.kind in "iu" else small).astype(v.dtype))
    return np.concatenate(bands), factor


Work = Callable[[dict, np.ndarray, float, np.ndarray], Iterator[pd.DataFrame]]


def map_coarse(slides: DataFrame, n_slides: int, mpp: float, work: Work, schema: str, rgb: bool = True, most: int = WHOLE_PX) -> DataFrame:
    """work(slide, image, downsample, raw) over one level of each slide, whole: read_level, or the one nearest to a scale.

    An image is read by the task that uses it and never becomes a row. A slide's failure is a row of its slide_id and
    error, which the schema has; other columns are null.
    """
    read = uuid.uuid4().hex
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf.to_dict("records"):
                try:
                    image = opened(s["path"], read)
                    raw, factor = read_level(image, int(s["read_level"]), most)
                    scale = None if pd.isna(s["float_scale"]) else float(s["float_scale"])
                    shown = as_rgb(raw, np.ones(raw.shape[:2], bool), scale) if rgb else raw
                    for part in work(s, shown, float(s["downsamples"][int(s["read_level"])]) * factor, raw):
                        yield part.assign(error=None).reindex(columns=names)
                except Exception as e:  # noqa: BLE001 - one unreadable slide must not stop a cohort
                    yield pd.DataFrame([{"slide_id": s["slide_id"], "error": f"{type(e).__name__}: {e}"}]).reindex(columns=names)

    picked = slides if "read_level" in slides.columns else slides.withColumn("read_level", nearest_level(F.col("mpp_level0"), F.col("downsamples"), F.lit(float(mpp))).cast("int"))
    return picked.repartition(max(1, min(MOST_TASKS, n_slides)), "slide_id").mapInPandas(run, schema)
