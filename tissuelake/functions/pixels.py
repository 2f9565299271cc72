"""NumPy kernels on images: filters, thresholds, morphology, components, colour, resampling and PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def _windows(image: np.ndarray, k: int, anchor: int, mode: str, value: float = 0) -> np.ndarray:
    pad = ((anchor, k - 1 - anchor),) * 2
    padded = np.pad(image, pad, mode=mode, **({"constant_values": value} if mode == "constant" else {}))
    return np.lib.stride_tricks.sliding_window_view(padded, (k, k))


def median(image: np.ndarray, k: int) -> np.ndarray:
    """Median filter with repeated borders."""
    out = np.empty_like(image)
    for y in range(0, image.shape[0], 256):  # strips bound the windows' memory
        top, end = max(0, y - k // 2), min(image.shape[0], y + 256 + k // 2)
        strip = np.median(_windows(image[top:end], k, k // 2, "edge"), axis=(2, 3)).astype(image.dtype)
        out[y : y + 256] = strip[y - top : y - top + 256]
    return out


def dilate(mask: np.ndarray, k: int, anchor: int | None = None) -> np.ndarray:
    a = k // 2 if anchor is None else anchor
    rows = np.lib.stride_tricks.sliding_window_view(np.pad(mask, ((a, k - 1 - a), (0, 0))), k, axis=0).max(-1)
    return np.lib.stride_tricks.sliding_window_view(np.pad(rows, ((0, 0), (a, k - 1 - a))), k, axis=1).max(-1)


def erode(mask: np.ndarray, k: int, anchor: int | None = None) -> np.ndarray:
    top = np.iinfo(mask.dtype).max if mask.dtype != bool else True
    a = k // 2 if anchor is None else anchor
    rows = np.lib.stride_tricks.sliding_window_view(np.pad(mask, ((a, k - 1 - a), (0, 0)), constant_values=top), k, axis=0).min(-1)
    return np.lib.stride_tricks.sliding_window_view(np.pad(rows, ((0, 0), (a, k - 1 - a)), constant_values=top), k, axis=1).min(-1)


def closed(mask: np.ndarray, k: int, rounds: int = 1) -> np.ndarray:
    for _ in range(rounds):
        mask = dilate(mask, k)
    for _ in range(rounds):
        mask = erode(mask, k)
    return mask


def opened(mask: np.ndarray, k: int) -> np.ndarray:
    return dilate(erode(mask, k), k)


def otsu_level(values: np.ndarray) -> int:
    """The 8-bit level of greatest variance between the classes (ties: the smallest); foreground is above it."""
    n = np.bincount(values.ravel(), minlength=256).astype(np.float64)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1 = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2, 0)
    return int(between.argmax())


def saturation(rgb: np.ndarray) -> np.ndarray:
    high, low = rgb.max(-1).astype(np.float64), rgb.min(-1).astype(np.float64)
    return np.rint(np.where(high > 0, 255 * (high - low) / np.maximum(high, 1), 0)).astype(np.uint8)


def grey(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb.astype(np.float64) @ [0.299, 0.587, 0.114]).astype(np.uint8)


def min_max_uint8(image: np.ndarray) -> np.ndarray:
    low, high = float(image.min()), float(image.max())
    return ((image.astype(np.float64) - low) * (255.0 / (high - low))).astype(np.uint8) if high > low else np.zeros(image.shape, np.uint8)


def gaussian(image: np.ndarray, k: int) -> np.ndarray:
    """Gaussian filter with the usual width for a kernel of k taps and mirrored borders."""
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    taps = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma**2))
    taps /= taps.sum()
    padded = np.pad(image.astype(np.float64), k // 2, mode="reflect") if min(image.shape) > k // 2 else np.pad(image.astype(np.float64), k // 2, mode="edge")
    rows = np.lib.stride_tricks.sliding_window_view(padded, k, axis=0) @ taps
    return np.rint(np.lib.stride_tricks.sliding_window_view(rows, k, axis=1) @ taps).astype(np.uint8)


def canny(image: np.ndarray, low: int, high: int) -> np.ndarray:
    """Edges: Sobel gradients, thinned across their direction, kept from high on and where joined to such from low on."""
    v = np.pad(image.astype(np.int32), 1, mode="edge")
    dx = (v[:-2, 2:] + 2 * v[1:-1, 2:] + v[2:, 2:]) - (v[:-2, :-2] + 2 * v[1:-1, :-2] + v[2:, :-2])
    dy = (v[2:, :-2] + 2 * v[2:, 1:-1] + v[2:, 2:]) - (v[:-2, :-2] + 2 * v[:-2, 1:-1] + v[:-2, 2:])
    size = np.pad(np.abs(dx) + np.abs(dy), 1)
    at = lambda y, x: size[1 + y : size.shape[0] - 1 + y, 1 + x : size.shape[1] - 1 + x]
    m = at(0, 0)
    flat, steep = np.abs(dy) < 0.4142 * np.abs(dx), np.abs(dy) > 2.4142 * np.abs(dx)
    same = (dx ^ dy) >= 0
    ridge = np.where(flat, (m > at(0, -1)) & (m >= at(0, 1)), np.where(steep, (m > at(-1, 0)) & (m >= at(1, 0)), np.where(same, (m > at(-1, -1)) & (m > at(1, 1)), (m > at(-1, 1)) & (m > at(1, -1)))))
    weak = ridge & (m > low)
    labels, n = components(weak, diagonal=True)
    strong = np.zeros(n + 1, bool)
    strong[labels[weak & (m > high)]] = True
    strong[0] = False
    return strong[labels]


def components(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """Labels from 1 of joined regions, by passes of the smallest neighbouring label over runs until nothing changes."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    if not mask.any():
        return labels, 0
    parent = np.arange(mask.size + 1)

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == parent[up]).all():
                return up
            parent[x] = parent[up]
            x = up

    steps = [(slice(None), slice(1, None), slice(None), slice(None, -1)), (slice(1, None), slice(None), slice(None, -1), slice(None))]
    if diagonal:
        steps += [(slice(1, None), slice(1, None), slice(None, -1), slice(None, -1)), (slice(1, None), slice(None, -1), slice(None, -1), slice(1, None))]
    edges = []
    for a, b, c, d in steps:
        both = mask[a, b] & mask[c, d]
        edges.append(np.stack([labels[a, b][both], labels[c, d][both]], axis=1))
    edges = np.concatenate(edges)
    while len(edges):
        x, y = find(edges[:, 0]), find(edges[:, 1])
        apart = x != y
        if not apart.any():
            break
        edges = edges[apart]
        np.minimum.at(parent, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
    roots = find(labels[mask])
    names, at = np.unique(roots, return_inverse=True)
    out = np.zeros(mask.shape, np.int64)
    out[mask] = at + 1
    return out, len(names)


def filled(mask: np.ndarray, least: float, largest_hole: float) -> np.ndarray:
    """Regions of at least `least` pixels (their holes counted), with holes up to largest_hole filled."""
    holes, n = components(~mask, diagonal=False)
    border = np.unique(np.concatenate([holes[0], holes[-1], holes[:, 0], holes[:, -1]]))
    sizes = np.bincount(holes.ravel(), minlength=n + 1)
    inner = np.ones(n + 1, bool)
    inner[border] = False
    inner[0] = False
    solid = mask | inner[holes]
    regions, m = components(solid, diagonal=True)
    keep = np.bincount(regions.ravel(), minlength=m + 1) >= least
    keep[0] = False
    return keep[regions] & ~(inner & (sizes > largest_hole))[holes]


_D65 = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def lab_from_rgb(rgb: np.ndarray) -> np.ndarray:
    """8-bit L*a*b* of 8-bit sRGB, L on 0..255 and a, b about 128."""
    c = rgb.astype(np.float64) / 255
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = linear @ _D65.T / _WHITE
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    lum = np.where(xyz[..., 1] > 0.008856, 116 * np.cbrt(xyz[..., 1]) - 16, 903.3 * xyz[..., 1])
    out = np.stack([lum * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def rgb_from_lab(lab: np.ndarray) -> np.ndarray:
    v = lab.astype(np.float64)
    lum, a, b = v[..., 0] * 100 / 255, v[..., 1] - 128, v[..., 2] - 128
    fy = np.where(lum > 903.3 * 0.008856, (lum + 16) / 116, 7.787 * lum / 903.3 + 16 / 116)
    f = np.stack([fy + a / 500, fy, fy - b / 200], axis=-1)
    xyz = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787) * _WHITE
    linear = np.clip(xyz @ np.linalg.inv(_D65).T, 0, 1)
    c = np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear)
    return np.clip(np.rint(c * 255), 0, 255).astype(np.uint8)


def _area_weights(n: int, out: int) -> np.ndarray:
    edges = np.arange(out + 1) * n / out
    low = np.maximum(edges[:-1, None], np.arange(n))
    high = np.minimum(edges[1:, None], np.arange(n) + 1)
    w = np.clip(high - low, 0, None)
    return w / w.sum(1, keepdims=True)


def _bilinear_weights(n: int, out: int) -> np.ndarray:
    at = np.clip((np.arange(out) + 0.5) * n / out - 0.5, 0, n - 1)
    low = np.minimum(np.floor(at).astype(int), max(n - 2, 0))
    w = np.zeros((out, n))
    w[np.arange(out), low] += 1 - (at - low)
    w[np.arange(out), np.minimum(low + 1, n - 1)] += at - low
    return w


def _filter_weights(n: int, out: int, how: str) -> np.ndarray:
    """Weights of a filter about each output pixel's centre, widened by what the image shrinks, which sum to one."""
    reach, f = {
        "triangle": (1.0, lambda t: 1 - t),
        "bicubic": (2.0, lambda t: np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, ((-0.5 * t + 2.5) * t - 4) * t + 2)),
        "lanczos": (3.0, lambda t: np.sinc(t) * np.sinc(t / 3)),
    }[how]
    wide = max(1.0, n / out)
    t = np.abs(np.arange(n) + 0.5 - ((np.arange(out) + 0.5) * n / out)[:, None]) / wide
    w = np.where(t < reach, f(t), 0.0)
    return w / w.sum(1, keepdims=True)


def resized(image: np.ndarray, out: int, how: str | None = None) -> np.ndarray:
    """An HWC image on out x out pixels: by area when it shrinks, else bilinear; channel by channel, any number.

    how: area, bilinear, nearest, or a filter that widens as the image shrinks (triangle, bicubic, lanczos).
    """
    h, w = image.shape[:2]
    if (h, w) == (out, out):
        return image
    how = how or ("area" if out < max(h, w) else "bilinear")
    if how == "nearest":
        return image[np.arange(out) * h // out][:, np.arange(out) * w // out]
    weights = {"area": _area_weights, "bilinear": _bilinear_weights}.get(how) or (lambda n, m: _filter_weights(n, m, how))
    v = np.einsum("oh,hwc,pw->opc", weights(h, out), image.reshape(h, w, -1).astype(np.float64), weights(w, out), optimize=True)
    info = np.iinfo(image.dtype) if np.issubdtype(image.dtype, np.integer) else None
    v = np.clip(np.rint(v), info.min, info.max) if info else v
    return v.astype(image.dtype).reshape(out, out, *image.shape[2:])


def model_input(patch: np.ndarray, size: int, mean: tuple, std: tuple, crop: float | None = None, how: str = "bilinear") -> np.ndarray:
    """An RGB patch as a normalised CHW array: resized (and cut from its middle) to the model's size."""
    if crop is not None:
        if not 0 < crop <= 1:
            raise ValueError("crop must be over zero and at most one")
        whole = round(size / crop)
        start = (whole - size) // 2
        patch = resized(patch, whole, how)[start : start + size, start : start + size]
    else:
        patch = resized(patch, size, how)
    v = patch.astype(np.float32).transpose(2, 0, 1) / np.float32(255)
    return (v - np.asarray(mean, np.float32)[:, None, None]) / np.asarray(std, np.float32)[:, None, None]


def to_uint8(block: np.ndarray, float_scale: float | None = None) -> np.ndarray:
    """Pixels on 0..255 by the range of their type; negative ones and NaN are 0."""
    if block.dtype == np.uint8:
        return block
    if block.dtype == bool or np.issubdtype(block.dtype, np.integer) and block.dtype != bool:
        if block.dtype == bool:
            raise ValueError("unsupported pixel type bool")
        v = np.clip(block.astype(np.float32), 0, None) * np.float32(255.0 / np.iinfo(block.dtype).max)
    elif np.issubdtype(block.dtype, np.floating):
        v = np.nan_to_num(block.astype(np.float32))
        scale = float_scale if float_scale is not None else 255.0 if v.size and v.max() <= 1 else 1.0
        v = np.clip(v, 0, 255.0 / scale) * scale
    else:
        raise ValueError(f"unsupported pixel type {block.dtype}")
    return np.clip(np.rint(v), 0, 255).astype(np.uint8)


def three_channels(image: np.ndarray) -> np.ndarray:
    """RGB of any number of channels: one repeats, two repeat the first, of more the first three count."""
    c = image.shape[-1]
    return np.repeat(image, 3, axis=-1) if c == 1 else np.concatenate([image, image[..., :1]], axis=-1) if c == 2 else image[..., :3]


def tinted(image: np.ndarray, mask: np.ndarray, colour: tuple[int, int, int], alpha: float = 0.3) -> np.ndarray:
    out = image.astype(np.float64)
    out[mask] = out[mask] * (1 - alpha) + np.array(colour) * alpha
    return out.astype(np.uint8)


def outlined(image: np.ndarray, boxes: list[tuple[int, int, int, int]], colour: tuple[int, int, int]) -> np.ndarray:
    out = image.copy()
    h, w = out.shape[:2]
    for x, y, bw, bh in boxes:
        x1, y1 = min(x + bw, w - 1), min(y + bh, h - 1)
        out[y, x : x1 + 1] = out[y1, x : x1 + 1] = colour
        out[y : y1 + 1, x] = out[y : y1 + 1, x1] = colour
    return out


def png(image: np.ndarray) -> bytes:
    """An RGB image as a PNG file."""
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")
