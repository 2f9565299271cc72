"""Tissue segmentation of one coarse level of each slide, and sums of its raster under a grid's cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from tissuelake.functions import pixels as P


def otsu_mask(image: np.ndarray, blur: int = 7, kernel: int = 4) -> np.ndarray:
    """Saturated pixels of an RGB image, smoothed, closed and opened."""
    colour = P.median(P.saturation(image), blur | 1)
    mask = colour > P.otsu_level(colour)
    return P.opened(P.closed(mask, kernel), kernel) if kernel else mask


def canny_mask(image: np.ndarray, blur: int = 5, low: float = 0.05, high: float = 0.15, widen: int = 3, close: int = 9, least: float = 0.001, largest_hole: float = 0.01) -> np.ndarray:
    """Regions enclosed by edges; large holes stay open. Areas are pixel counts."""
    edges = P.canny(P.gaussian(P.grey(image), blur | 1), round(low * 255), round(high * 255))
    for _ in range(2 if widen else 0):
        edges = P.dilate(edges, widen)
    if close:
        edges = P.closed(edges, close, 2)
    return P.filled(edges, least * edges.size, largest_hole * edges.size)


def combined_mask(image: np.ndarray, mode: str = "or") -> np.ndarray:
    if mode not in ("or", "and"):
        raise ValueError(f"mode must be 'or' or 'and', not {mode!r}")
    a, b = otsu_mask(image), canny_mask(image)
    if b.shape != a.shape:  # the second on the first's pixels, by the nearest
        b = b[np.arange(a.shape[0]) * b.shape[0] // a.shape[0]][:, np.arange(a.shape[1]) * b.shape[1] // a.shape[1]]
    return a & b if mode == "and" else a | b


def nuclear_mask(image: np.ndarray, channels: list[int], kernel: int = 4) -> np.ndarray:
    """Bright pixels of a multiplex image's nuclear channels, averaged in single precision."""
    signal = image[..., channels[0]] if len(channels) == 1 else image[..., channels].astype(np.float32).mean(-1, dtype=np.float32)
    level = P.min_max_uint8(signal)
    mask = level > P.otsu_level(level)
    return P.opened(P.closed(mask, kernel), kernel) if kernel else mask


SEGMENTERS: dict[str, Callable[..., np.ndarray]] = {"otsu": otsu_mask, "canny": canny_mask, "combined": combined_mask}


def zonal(raster: np.ndarray, classes: list[int], slide: dict, downsample: float, origin: tuple[float, float] = (0.0, 0.0)) -> Iterator[pd.DataFrame]:
    """row, col, x, y and the share of each class under each cell of a slide's grid, in float32; 0 off the raster.

    Sums over rectangles come from four places of a class's running sums, so that a cell costs the same at any size.
    The window is clipped to the raster, not padded. slide has xs, ys and level0_patch.
    """
    xs, ys = np.asarray(slide["xs"], np.int64), np.asarray(slide["ys"], np.int64)
    n = max(1, int(np.rint(slide["level0_patch"] / downsample)))
    low = lambda at, o, size: np.clip(np.rint((at - o) / downsample).astype(np.int64), 0, size)
    high = lambda at, o, size: np.clip(np.rint((at - o) / downsample).astype(np.int64) + n, 0, size)
    h, w = raster.shape
    x0, x1, y0, y1 = low(xs, origin[0], w), high(xs, origin[0], w), low(ys, origin[1], h), high(ys, origin[1], h)
    shares = []
    for k in classes:
        sums = np.zeros((h + 1, w + 1), np.int32)
        np.cumsum(raster == k, axis=0, dtype=np.int32, out=sums[1:, 1:])
        np.cumsum(sums[1:, 1:], axis=1, out=sums[1:, 1:])
        inside = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
        area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
        shares.append(np.where(area > 0, inside / np.maximum(area, 1), 0).astype(np.float32))
    for i in range(0, len(ys), max(1, 100_000 // max(1, len(xs)))):
        rows = slice(i, i + max(1, 100_000 // max(1, len(xs))))
        m = len(ys[rows])
        part = {"slide_id": slide["slide_id"], "row": np.repeat(np.arange(i, i + m), len(xs)), "col": np.tile(np.arange(len(xs)), m), "x": np.tile(xs, m), "y": np.repeat(ys[rows], len(xs))}
        yield pd.DataFrame(part | {f"class_{k}": s[rows].ravel() for k, s in zip(classes, shares, strict=True)})


def segmenter(name: str, channels: list[int] | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """A function from whole images to masks: one of this module's, or a plug-in's."""
    from tissuelake.plans import plugins

    run = plugins.get("segmenters", name)
    return (lambda image: run(image, channels)) if name == "nuclear" else run
