"""Pyramidal Zarr images as tables: one row a slide, and one row a chunk plane."""

from __future__ import annotations

import functools
import gzip
import itertools
import json
import math
import os
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tissuelake.sources.files import child, read_bytes

# Fixed values.
_MICROMETRES = {"nanometer": 1e-3, "micrometer": 1.0, "millimeter": 1e3, "centimeter": 1e4, "meter": 1e6, "nm": 1e-3, "um": 1.0, "µm": 1.0, "micron": 1.0, "mm": 1e3, "cm": 1e4, "m": 1e6}
SLIDES = "path string, mpp_level0 double, scale_x double, scale_y double, origin_x double, origin_y double, width long, height long, downsamples array<double>, levels array<struct<level:int,width:long,height:long,ds_x:double,ds_y:double,off_x:double,off_y:double,chunk_h:int,chunk_w:int>>, dtype string, channels int, channel_names array<string>, warnings array<string>, float_scale double, error string"
CHUNKS = "path string, level int, c int, cy int, cx int, y0 int, x0 int, h int, w int, dtype string, data binary"
#: Bytes of decoded chunks that a Python worker keeps; TISSUELAKE_CHUNK_MB sets another number, 0 none.
CACHE_MB = 128


def _json(path: str, name: str) -> dict:
    found = read_bytes(child(path, name))
    return json.loads(found) if found else {}


def attributes(path: str) -> dict:
    """A group's attributes, in either version of the format, out of their wrapper if they have one."""
    found = _json(path, ".zattrs") or _json(path, "zarr.json").get("attributes", {})
    return found.get("ome", found)


def _inflated(codec: str, raw: bytes, n: int) -> bytes:
    """n bytes out of a chunk by the name of its codec."""
    if codec in ("zlib", "gzip"):
        return (zlib if codec == "zlib" else gzip).decompress(raw)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=n)
    if codec == "lz4":
        return pa.decompress(raw[4:], n, "lz4_raw", asbytes=True)
    if codec == "blosc":
        return blosc(raw)
    raise ValueError(f"chunks compressed with {codec} can't be read here")


def blosc(raw: bytes) -> bytes:
    """A Blosc frame's bytes: blocks of LZ4, Snappy, zlib or Zstandard streams, shuffled by byte, by bit or not at all."""
    flags, size = raw[2], raw[3]
    n, block, _ = struct.unpack("<III", raw[4:16])
    if flags & 2:
        return raw[16 : 16 + n]
    codec = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}.get(flags >> 5)
    if codec is None:
        raise ValueError("chunks compressed with blosclz can't be read here")

    def stream(at: int, want: int) -> tuple[bytes, int]:
        (packed,) = struct.unpack_from("<i", raw, at)
        data = raw[at + 4 : at + 4 + packed]
        if packed != want:
            data = _inflated(codec, data, want) if codec in ("zlib", "zstd") else pa.decompress(data, want, codec, asbytes=True)
        return data, at + 4 + packed

    out = []
    for k, at in enumerate(struct.unpack_from(f"<{-(-n // block)}i", raw, 16)):
        own = min(block, n - k * block)
        splits = size if own == block and not flags & 16 else 1
        parts = []
        for _ in range(splits):
            data, at = stream(at, own // splits)
            parts.append(data)
        out.append(_unshuffled(b"".join(parts), size, flags))
    return b"".join(out)


def _unshuffled(data: bytes, size: int, flags: int) -> bytes:
    n = len(data) // size
    if flags & 1 and size > 1:
        whole = np.frombuffer(data, np.uint8, n * size)
        return whole.reshape(size, n).T.tobytes() + data[n * size :]
    if flags & 4:
        n -= n % 8
        planes = np.frombuffer(data, np.uint8, n * size).reshape(size * 8, n // 8)
        bits = np.unpackbits(planes, axis=1, bitorder="little").T
        return np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little").tobytes() + data[n * size :]
    return data


class Array:
    """An array of a Zarr store, read chunk by chunk; of a sharded one the inner chunks."""

    def __init__(self, path: str):
        self.path, self.shard, self.order, self.codec = path, None, None, None
        two, three = _json(path, ".zarray"), _json(path, "zarr.json")
        if two:
            if two.get("filters"):
                raise ValueError(f"{path}: filters can't be read here")
            self.shape, self.chunks, self.dtype = two["shape"], two["chunks"], np.dtype(two["dtype"])
            fill, self.codec = two.get("fill_value"), (two.get("compressor") or {}).get("id")
            self.order = list(range(len(self.shape)))[::-1] if two.get("order") == "F" else None
            self.name = lambda at: two.get("dimension_separator", ".").join(map(str, at))
        elif three:
            self.shape, self.dtype, fill = three["shape"], np.dtype(three["data_type"]), three.get("fill_value")
            self.chunks = three["chunk_grid"]["configuration"]["chunk_shape"]
            codecs = three.get("codecs", [])
            if codecs and codecs[0]["name"] == "sharding_indexed":
                inside = codecs[0]["configuration"]
                self.shard = [a // b for a, b in zip(self.chunks, inside["chunk_shape"], strict=True)]
                self.at_end = inside.get("index_location", "end") == "end"
                self.checked = any(c["name"] == "crc32c" for c in inside.get("index_codecs", []))
                self.chunks, codecs = inside["chunk_shape"], inside.get("codecs", [])
            for c in codecs:
                settings = c.get("configuration", {})
                if c["name"] == "bytes":
                    self.dtype = self.dtype.newbyteorder(">") if settings.get("endian") == "big" else self.dtype
                elif c["name"] == "transpose":
                    self.order = settings["order"]
                elif c["name"] == "crc32c":
                    self.tail = 4
                else:
                    self.codec = c["name"]
            separator = three.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
            self.name = lambda at: separator.join(["c", *map(str, at)])
        else:
            raise FileNotFoundError(f"{path} is not a Zarr array")
        self.fill = self.dtype.type(float(fill) if isinstance(fill, str) else fill or 0)

    tail = 0

    def _raw(self, at: tuple[int, ...]) -> bytes | None:
        if self.shard is None:
            return read_bytes(child(self.path, self.name(at)))
        file = child(self.path, self.name(tuple(i // n for i, n in zip(at, self.shard, strict=True))))
        size = 16 * math.prod(self.shard) + 4 * self.checked
        index = read_bytes(file, -size if self.at_end else 0, size)
        if index is None:
            return None
        k = int(np.ravel_multi_index([i % n for i, n in zip(at, self.shard, strict=True)], self.shard))
        start, length = struct.unpack_from("<QQ", index, 16 * k)
        return None if start == length == 2**64 - 1 else read_bytes(file, start, length)

    def chunk(self, at: tuple[int, ...]) -> np.ndarray:
        raw = self._raw(at)
        if raw is None:
            return np.full(self.chunks, self.fill, self.dtype)
        raw = raw[: len(raw) - self.tail]
        if self.codec is not None:
            raw = _inflated(self.codec, raw, math.prod(self.chunks) * self.dtype.itemsize)
        values = np.frombuffer(raw, self.dtype)
        if self.order is None:
            return values.reshape(self.chunks)
        return values.reshape([self.chunks[i] for i in self.order]).transpose(np.argsort(self.order))


class Image:
    """The pyramid of one image: axes, scales, levels and channels as its metadata have them."""

    read = ""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        for self.group in (self.path, child(self.path, "0"), child(self.path, "1")):
            meta = attributes(self.group)
            if meta.get("multiscales"):
                break
        else:
            raise ValueError(f"{path} has no multiscales metadata")
        scales = meta["multiscales"][0]
        self.axes = [(a if isinstance(a, str) else a["name"]) for a in scales.get("axes", ["t", "c", "z", "y", "x"])]
        units = {a["name"]: a.get("unit") for a in scales.get("axes", []) if isinstance(a, dict)}
        self.arrays = [Array(child(self.group, d["path"])) for d in scales["datasets"]]
        self.warnings: list[str] = []
        ix, iy = self.axes.index("x"), self.axes.index("y")
        steps = [self._vector(d.get("coordinateTransformations"), "scale", 1.0) for d in scales["datasets"]]
        moves = [self._vector(d.get("coordinateTransformations"), "translation", 0.0) for d in scales["datasets"]]
        shared = self._vector(scales.get("coordinateTransformations"), "scale", 1.0)
        moved = self._vector(scales.get("coordinateTransformations"), "translation", 0.0)
        factor = {k: None if units.get(k) is None else _MICROMETRES.get(units[k].lower(), 1.0) for k in "xy"}
        known = factor["x"] is not None and factor["y"] is not None
        self.scale = tuple(steps[0][i] * shared[i] * factor[k] for k, i in (("x", ix), ("y", iy))) if known else (None, None)
        self.mpp = sum(self.scale) / 2 if known else None
        if known and abs(self.scale[0] - self.scale[1]) / min(self.scale) > 1e-3:
            self.warnings.append("anisotropic pixels")
        origin = [(moves[0][i] * shared[i] + moved[i]) * (factor[k] or 1.0) for k, i in (("x", ix), ("y", iy))]
        self.origin = tuple(origin) if any(origin) else (None, None)
        self.levels = []
        for k, (array, step, move) in enumerate(zip(self.arrays, steps, moves, strict=True)):
            w, h = array.shape[ix], array.shape[iy]
            self.levels.append((k, w, h, step[ix] / steps[0][ix], step[iy] / steps[0][iy], (moves[0][ix] - move[ix]) / step[ix], (moves[0][iy] - move[iy]) / step[iy], array.chunks[iy], array.chunks[ix]))
        for axis, n in zip(self.axes, self.arrays[0].shape, strict=True):
            if axis not in "cyx" and n > 1:
                self.warnings.append(f"axis {axis} has {n} planes; the first is read")
        omero = meta.get("omero", {}).get("channels", [])
        self.channels = self.arrays[0].shape[self.axes.index("c")] if "c" in self.axes else 1
        self.names = [(c.get("label") or c.get("name") or "") if isinstance(c, dict) else "" for c in omero] or None

    def _vector(self, transforms: list[dict] | None, kind: str, default: float) -> list[float]:
        found = next((t[kind] for t in transforms or [] if t.get("type") == kind), None)
        return list(found) if found is not None else [default] * len(self.axes)

    def row(self) -> tuple:
        ds = [(lv[3] + lv[4]) / 2 for lv in self.levels]
        return (self.path, self.mpp, *self.scale, *self.origin, self.levels[0][1], self.levels[0][2], ds, self.levels, self.arrays[0].dtype.newbyteorder("=").name, self.channels, self.names, self.warnings, self.float_scale(), None)

    def float_scale(self) -> float | None:
        """What a float image's pixels are multiplied by: 1 if the fill value or a finite pixel of nine chunks is over 1, else 255."""
        if self.arrays[0].dtype.kind != "f":
            return None
        some = [sorted({0, (n - 1) // 2, n - 1}) for n in self.grid(0)]
        values = itertools.chain([np.array([self.arrays[0].fill])], (np.frombuffer(p[-1], p[-2]) for cy, cx in itertools.product(*some) for p in self.planes(0, cy, cx)))
        return 1.0 if any((v[np.isfinite(v)] > 1).any() for v in values) else 255.0

    def window(self, level: int, y: int, x: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        """All channels of a rectangle of a level (HWC, zeros off it), and which of its pixels lie on the level."""
        a = self.arrays[level]
        ch, cw = (a.chunks[self.axes.index(k)] for k in "yx")
        rows, columns = self.grid(level)
        out = np.zeros((h, w, self.channels), a.dtype.newbyteorder("="))
        inside = np.zeros((h, w), bool)
        for cy in range(max(0, y // ch), min(rows, -(-(y + h) // ch))):
            for cx in range(max(0, x // cw), min(columns, -(-(x + w) // cw))):
                block = _decoded(self, level, cy, cx)
                top, left = cy * ch - y, cx * cw - x
                to = (slice(max(top, 0), min(top + block.shape[0], h)), slice(max(left, 0), min(left + block.shape[1], w)))
                if to[0].start < to[0].stop and to[1].start < to[1].stop:
                    out[to] = block[to[0].start - top : to[0].stop - top, to[1].start - left : to[1].stop - left]
                    inside[to] = True
        return out, inside

    def grid(self, level: int) -> tuple[int, int]:
        """Rows and columns of chunks of a level."""
        a = self.arrays[level]
        return tuple(-(-a.shape[self.axes.index(k)] // a.chunks[self.axes.index(k)]) for k in "yx")

    def planes(self, level: int, cy: int, cx: int) -> Iterator[tuple]:
        """The chunk planes of all channels at one place of a level."""
        a = self.arrays[level]
        place = {k: self.axes.index(k) for k in self.axes}
        depth = a.chunks[place["c"]] if "c" in place else 1
        y0, x0 = cy * a.chunks[place["y"]], cx * a.chunks[place["x"]]
        for cc in range(-(-self.channels // depth)):
            at = tuple({"y": cy, "x": cx, "c": cc}.get(k, 0) for k in self.axes)
            block = a.chunk(at)
            block = block[tuple(slice(None) if k in "cyx" else 0 for k in self.axes)]
            kept = [k for k in self.axes if k in "cyx"]
            block = block.transpose([kept.index(k) for k in "cyx"]) if "c" in kept else block.transpose([kept.index(k) for k in "yx"])[None]
            h, w = min(block.shape[1], a.shape[place["y"]] - y0), min(block.shape[2], a.shape[place["x"]] - x0)
            for k in range(min(depth, self.channels - cc * depth)):
                yield self.path, level, cc * depth + k, cy, cx, y0, x0, h, w, a.dtype.newbyteorder("=").name, np.ascontiguousarray(block[k, :h, :w], a.dtype.newbyteorder("=")).tobytes()


_cache: OrderedDict[tuple, np.ndarray] = OrderedDict()


def _decoded(image: Image, level: int, cy: int, cx: int) -> np.ndarray:
    """The chunk at a place with all its channels (HWC); the ones used last stay decoded in this worker."""
    key = (image.path, image.read, level, cy, cx)
    if key in _cache:
        _cache.move_to_end(key)
        return _cache[key]
    planes = [np.frombuffer(p[-1], p[-2]).reshape(p[7], p[8]) for p in image.planes(level, cy, cx)]
    _cache[key] = block = np.stack(planes, axis=-1)
    most = int(os.environ.get("TISSUELAKE_CHUNK_MB", CACHE_MB)) << 20
    while _cache and sum(b.nbytes for b in _cache.values()) > most:
        _cache.popitem(last=False)
    return block


@functools.lru_cache(maxsize=256)
def opened(path: str, read: str) -> Image:
    """An image whose metadata this worker has read before for the same read, which has a name of its own."""
    image = Image(path)
    image.read = read
    return image


class _Part(InputPartition):
    def __init__(self, path: str, level: int | None = None, rows: tuple[int, int] = (0, 0)):
        self.path, self.level, self.rows = path, level, rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.table = options.get("table", "slides")
        self.levels = json.loads(options["levels"]) if "levels" in options else None

    def partitions(self) -> list[_Part]:
        if self.table == "slides":
            return [_Part(p) for p in self.paths]
        parts = []
        for p in self.paths:
            image = Image(p)
            for level in range(len(image.levels)) if self.levels is None else self.levels:
                parts += [_Part(p, level, (r, min(r + 4, image.grid(level)[0]))) for r in range(0, image.grid(level)[0], 4)]
        return parts

    def read(self, part: _Part) -> Iterator[tuple]:
        if part.level is None:
            try:
                yield Image(part.path).row()
            except Exception as e:  # noqa: BLE001 - a source that can't be opened is a row that says so
                yield (part.path, *[None] * 14, f"{type(e).__name__}: {e}")
            return
        image = Image(part.path)
        for cy, cx in itertools.product(range(*part.rows), range(image.grid(part.level)[1])):
            yield from image.planes(part.level, cy, cx)


class OmeZarr(DataSource):
    """spark.read.format("omezarr"): options path or paths (JSON), table (slides or chunks), levels (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "omezarr"

    def schema(self) -> str:
        return CHUNKS if self.options.get("table") == "chunks" else SLIDES

    def reader(self, schema: object) -> _Reader:
        return _Reader(dict(self.options))


def read_slides(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(OmeZarr)
    return spark.read.format("omezarr").option("paths", json.dumps(paths)).load()


def read_chunks(spark: SparkSession, paths: list[str], levels: list[int] | None = None) -> DataFrame:
    """Chunk planes; levels prunes what is read."""
    spark.dataSource.register(OmeZarr)
    reader = spark.read.format("omezarr").option("paths", json.dumps(paths)).option("table", "chunks")
    return (reader if levels is None else reader.option("levels", json.dumps(levels))).load()


def write_image(path: str, levels: list[np.ndarray], mpp: float | None, chunk: int = 256, names: list[str] | None = None, origin: tuple[float, float] | None = None) -> str:
    """A pyramid of (channels, height, width) arrays as an uncompressed image of five axes."""
    os.makedirs(path, exist_ok=True)
    space = {} if mpp is None else {"unit": "micrometer"}
    axes = [{"name": "t", "type": "time"}, {"name": "c", "type": "channel"}, *({"name": k, "type": "space"} | space for k in "zyx")]
    datasets = []
    for i, level in enumerate(levels):
        c, h, w = level.shape
        step = (mpp or 1.0) * levels[0].shape[2] / w
        moves = [{"type": "scale", "scale": [1.0, 1.0, 1.0, (mpp or 1.0) * levels[0].shape[1] / h, step]}]
        if origin:
            moves.append({"type": "translation", "translation": [0.0, 0.0, 0.0, origin[1], origin[0]]})
        datasets.append({"path": str(i), "coordinateTransformations": moves})
        folder = os.path.join(path, str(i))
        os.makedirs(folder, exist_ok=True)
        ch, cw = min(chunk, h), min(chunk, w)
        with open(os.path.join(folder, ".zarray"), "w") as f:
            json.dump({"zarr_format": 2, "shape": [1, c, 1, h, w], "chunks": [1, 1, 1, ch, cw], "dtype": level.dtype.newbyteorder("<").str, "compressor": None, "fill_value": 0, "order": "C", "filters": None}, f)
        for k, cy, cx in itertools.product(range(c), range(-(-h // ch)), range(-(-w // cw))):
            block = np.zeros((ch, cw), level.dtype)
            own = level[k, cy * ch : (cy + 1) * ch, cx * cw : (cx + 1) * cw]
            block[: own.shape[0], : own.shape[1]] = own
            with open(os.path.join(folder, f"0.{k}.0.{cy}.{cx}"), "wb") as f:
                f.write(block.tobytes())
    meta: dict = {"multiscales": [{"version": "0.4", "axes": axes, "datasets": datasets}]}
    if names is not None:
        meta["omero"] = {"channels": [{"label": n} for n in names]}
    with open(os.path.join(path, ".zattrs"), "w") as f:
        json.dump(meta, f)
    with open(os.path.join(path, ".zgroup"), "w") as f:
        json.dump({"zarr_format": 2}, f)
    return path


def write_sample(path: str, mpp: float = 0.5, size: int = 1024, levels: int = 3, seed: int = 0) -> str:
    """A synthetic stained section: a tissue ellipse of two compartments with ring-like glands on a white slide."""
    draw = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size] / size
    mix = x[..., None]
    tissue = np.array([120, 90, 165]) * (1 - mix) + np.array([205, 120, 165]) * mix
    for cy, cx, r in draw.uniform([0.2, 0.2, 0.03], [0.8, 0.8, 0.07], (max(6, size // 256), 3)):
        tissue = tissue - 70 * np.exp(-((np.hypot(y - cy, x - cx) - r) ** 2) / (2 * (0.3 * r) ** 2))[..., None]
    tissue = np.clip(tissue + draw.integers(-18, 18, tissue.shape), 0, 255)
    inside = (((y - 0.5) / 0.40) ** 2 + ((x - 0.5) / 0.32) ** 2 <= 1)[..., None]
    image = np.where(inside, tissue, 245).astype(np.uint8).transpose(2, 0, 1)
    return write_image(path, [image[:, :: 2**k, :: 2**k] for k in range(levels)], mpp)
