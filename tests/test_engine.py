"""Operators, plans and sources of the engine: hand-computed cases, NumPy twins and invariants."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from tissuelake import catalog
from tissuelake.functions import geometry as G
from tissuelake.functions import identity as I
from tissuelake.functions import numerics as N
from tissuelake.functions import pixels as P
from tissuelake.operators import embed as E
from tissuelake.operators import multiplex, pooling, quality, raster, regions, segment, stain, tiling
from tissuelake.plans import cohort, conformance, pipeline, registry
from tissuelake.plans.request import Request, run_hash
from tissuelake.sources import text
from tissuelake.sources.omezarr import Array, Image, read_chunks, read_slides, write_image, write_sample
from tissuelake.sources.store import Store, merged_names

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- registered queries --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, data, duck, name):
    found = catalog.queries()[name](spark, data)
    names = sorted(found.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert names == sorted(want.columns)
    rows = lambda it, cols: sorted((tuple(plain(r[cols.index(c)]) for c in names) for r in it), key=repr)
    assert rows(found.collect(), found.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 640
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


# --- scales and grids ----------------------------------------------------------------------------------------------

PYRAMID = [float(2**k) for k in range(8)]


def planned(spark, target, mpp0, downs=PYRAMID, px=224, **options):
    column = G.read_plan(F.lit(target), F.lit(mpp0), F.array(*map(F.lit, downs)), F.lit(px), **options)
    return one(spark, column.alias("p"))["p"]


@pytest.mark.parametrize(
    ("target", "mpp0", "downs", "options", "want"),
    [
        (1.0, 0.1112, PYRAMID, {}, (3, 252, True, 1.0)),
        (1.0, 0.25, [1.0, 2.000097, 4.0006608], {}, (2, 224, False, 1.0001652)),
        (1.0, 0.25, PYRAMID, {}, (2, 224, False, 1.0)),
        (0.25, 0.25, PYRAMID, {}, (0, 224, False, 0.25)),
        (0.25, 0.5, PYRAMID, {"upsample": True}, (0, 112, True, 0.25)),
        (1.0, 0.1112, PYRAMID, {"snap": True}, (3, 224, False, 0.8896)),
        (1.0, 0.1112, PYRAMID, {"tolerance": 0.15}, (3, 224, False, 0.8896)),
    ],
)
def test_read_plan(spark, target, mpp0, downs, options, want):
    p = planned(spark, target, mpp0, downs, **options)
    assert (p.level, p.read_px, p.needs_resample) == want[:3] and p.achieved_mpp == pytest.approx(want[3])


def test_plan_refuses_finer_targets_and_unknown_scales(spark):
    assert planned(spark, 0.25, 0.5) is None
    slides = spark.createDataFrame([("a", None, [1.0, 2.0], 100, 100)], "slide_id string, mpp_level0 double, downsamples array<double>, width long, height long")
    with pytest.raises(Exception, match="no readable level"):
        tiling.grids(slides, 1.0, 64).collect()


def test_rounding_and_thresholds(spark):
    r = one(spark, N.half_even(F.lit(2.5)), N.half_even(F.lit(3.5)), N.at_least(F.lit(0.7).cast("float"), 0.7), N.quantised(F.lit(0.999)), N.quantised(F.lit(1.5)), N.general(F.lit(0.5)), N.general(F.lit(12.0)), N.general(F.lit(0.2525)))
    assert tuple(r) == (2, 4, True, 254, 255, "0.5", "12", "0.2525")


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 900), st.integers(1, 300), st.integers(1, 300))
def test_axis_equals_range(extent, patch, step):
    assert list(range(0, max(extent - patch, 0) + 1, step)) == AXIS(extent, patch, step)


def AXIS(extent, patch, step):
    from pyspark.sql import SparkSession

    return one(SparkSession.getActiveSession(), G.axis(F.lit(extent), F.lit(patch), F.lit(step)).alias("a"))["a"]


def test_cell_fractions_equal_windows(spark):
    draw = np.random.default_rng(0)
    mask = draw.integers(0, 2, (20, 30))
    px = spark.createDataFrame(pd.DataFrame([("a", x, y, float(mask[y, x])) for y in range(20) for x in range(30)], columns=["slide_id", "mx", "my", "v"]))
    slides = spark.createDataFrame([("a", 0.5, [1.0, 2.0], 150, 97)], "slide_id string, mpp_level0 double, downsamples array<double>, width long, height long")
    grid = tiling.grids(slides, 0.5, 32).withColumn("mask_downsample", F.lit(4.7))
    found = {(r.row, r.col): r.tissue_frac for r in tiling.cell_fractions(tiling.cells(grid), px, ["slide_id"]).collect()}
    side = max(1, round(32 / 4.7))
    for (row, col), frac in found.items():
        y, x = round(row * 32 / 4.7), round(col * 32 / 4.7)
        window = mask[y : y + side, x : x + side]
        assert frac == pytest.approx(window.mean() if window.size else 0)
    kept = tiling.tile(grid, px, ["slide_id"], 0.5).orderBy("patch_idx").collect()
    assert [r.patch_idx for r in kept] == list(range(len(kept))) and [(r.row, r.col) for r in kept] == sorted(k for k, f in found.items() if np.float32(f) >= np.float32(0.5))


def test_class_fractions_clip_at_borders(spark):
    draw = np.random.default_rng(1)
    classes = draw.integers(1, 4, (12, 12))
    px = spark.createDataFrame(pd.DataFrame([("a", x, y, int(classes[y, x])) for y in range(12) for x in range(12)], columns=["slide_id", "rx", "ry", "cls"]))
    patches = [("a", i, x, y) for i, (x, y) in enumerate([(0, 0), (-8, -8), (30, 10), (44, 44), (100, 100), (-40, 0)])]
    found = raster.class_fractions(spark.createDataFrame(patches, "slide_id string, patch_idx int, x int, y int"), px, ["slide_id"], [1, 2, 3], F.lit(16), 4.0).collect()
    for r in found:
        x, y = round(r.x / 4), round(r.y / 4)
        window = classes[max(y, 0) : max(0, min(y + 4, 12)), max(x, 0) : max(0, min(x + 4, 12))]
        for k in (1, 2, 3):
            assert r[f"class_{k}"] == pytest.approx((window == k).mean() if window.size else 0)


# --- pixels --------------------------------------------------------------------------------------------------------


def test_otsu_as_table_and_kernel(spark):
    draw = np.random.default_rng(2)
    v = np.clip(np.concatenate([draw.normal(60, 10, 4000), draw.normal(180, 15, 1500)]), 0, 255).astype(np.uint8)
    rows = spark.createDataFrame(pd.DataFrame({"k": "a", "v": v.astype(int)}))
    assert raster.otsu(rows, "v", ["k"]).first()["threshold"] == P.otsu_level(v)
    assert 80 < P.otsu_level(v) < 150


def test_masks(spark):
    image = np.full((80, 80, 3), 245, np.uint8)
    image[20:60, 20:60] = (150, 60, 130)
    image[36:44, 36:44] = 245
    a, b = segment.otsu_mask(image), segment.canny_mask(image)
    assert a[30, 30] and not a[5, 5] and b[30, 30] and not b[2, 2]
    both, either = segment.combined_mask(image, "and"), segment.combined_mask(image, "or")
    assert not (both & ~a).any() and not (a & ~either).any() and not (b & ~either).any()
    with pytest.raises(ValueError):
        segment.combined_mask(image, "xor")
    stack = np.zeros((40, 40, 3), np.uint16)
    stack[10:30, 10:30, 1] = 5000
    assert segment.nuclear_mask(stack, [1])[20, 20] and not segment.nuclear_mask(stack, [1])[2, 2]
    assert segment.nuclear_mask(stack, [0, 1])[20, 20]


def test_components_and_holes():
    mask = np.zeros((30, 30), bool)
    mask[2:12, 2:12] = True
    mask[5:7, 5:7] = False
    mask[20:22, 20:22] = True
    labels, n = P.components(mask, diagonal=True)
    assert n == 2
    assert P.filled(mask, 10, 4)[5, 5] and not P.filled(mask, 10, 4)[20, 20]
    assert not P.filled(mask, 10, 3)[5, 5]


def test_colour_round_trip():
    draw = np.random.default_rng(3)
    rgb = draw.integers(0, 256, (16, 16, 3)).astype(np.uint8)
    assert np.abs(P.rgb_from_lab(P.lab_from_rgb(rgb)).astype(int) - rgb).mean() < 3
    assert P.saturation(np.array([[[10, 20, 40]]], np.uint8))[0, 0] == 191


def test_resizing():
    image = np.arange(64, dtype=np.uint8).reshape(8, 8, 1)
    assert P.resized(image, 4)[0, 0, 0] == round(np.mean([0, 1, 8, 9]))
    assert P.resized(image, 8) is image
    assert P.resized(np.zeros((4, 4, 7), np.uint16), 6).shape == (6, 6, 7)
    assert P.model_input(np.full((10, 10, 3), 255, np.uint8), 4, (0.5,) * 3, (0.5,) * 3).max() == 1


@pytest.mark.parametrize("how", ["triangle", "bicubic", "lanczos", "nearest"])
def test_resizing_filters(how):
    flat = np.full((9, 9, 3), 77, np.uint8)
    assert (P.resized(flat, 5, how) == 77).all() and (P.resized(flat, 17, how) == 77).all()
    ramp = np.repeat((np.arange(16) * 10)[None, :, None], 16, axis=0).astype(np.float64)
    small = P.resized(ramp, 8, how)[4, 1:-1, 0]
    assert np.allclose(np.diff(small), 20, atol=1.0)
    assert P.model_input(flat, 4, (0.5,) * 3, (0.5,) * 3, 0.8, how).shape == (3, 4, 4)


def test_registry_metadata():
    assert len(registry.PUBLISHED) == 41 and len(registry.PUBLISHED_SLIDE) == 13
    m = registry.PUBLISHED["conch_v1_5"]
    assert (m.dim, m.px, m.mpp, m.amp, m.gated) == (768, 512, 0.5, "fp16", True)
    assert registry.PUBLISHED["resnet50"].mpp is None and registry.PUBLISHED["resnet50"].amp == "fp32"
    assert all(s.requires in ("any", *registry.PUBLISHED) for s in registry.PUBLISHED_SLIDE.values())
    assert all(s.patch_dim == registry.PUBLISHED[s.requires].dim for s in registry.PUBLISHED_SLIDE.values() if s.requires != "any")
    assert [g.models for g in registry.geometries(["uni", "resnet50", "phikon"], catalog=registry.PUBLISHED)] == [("uni", "phikon"), ("resnet50",)]
    assert registry.json_object('{"a": 1}') == {"a": 1}
    for bad in ("[1]", '{"a": NaN}'):
        with pytest.raises(ValueError):
            registry.json_object(bad)


@pytest.mark.parametrize(("dtype", "value", "want"), [("uint16", 65535, 255), ("uint16", 257, 1), ("int16", -5, 0), ("int16", 32767, 255), ("float32", 0.5, 128)])
def test_to_uint8(dtype, value, want):
    assert P.to_uint8(np.array([[value, 0]], dtype))[0, 0] == want


def test_signed_to_uint8_query_on_values_beyond_the_type(spark, tmp_path):
    rows = [(k, v) for k, v in enumerate([370.71, 351.44, 490.02, 347.67, 347.68, 20.0, 0.01, -5.5, 5000.0, None])]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["signed_to_uint8"]).fetchall()
    assert max(u for _, u in want) > 255
    assert sorted(map(tuple, catalog.queries()["signed_to_uint8"](spark, str(tmp_path)).collect())) == sorted(want)
    # A pixel is never over 255, whatever its number.
    assert spark.range(1).select(N.to_uint8(F.lit(35071), "int16").alias("u")).first()["u"] == 255


def test_png_reads_back():
    import struct
    import zlib

    image = np.random.default_rng(4).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    data = P.png(image)
    assert struct.unpack(">II", data[16:24]) == (7, 5)
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
    assert (np.frombuffer(raw, np.uint8).reshape(5, 22)[:, 1:].reshape(5, 7, 3) == image).all()


def test_stains(spark):
    draw = np.random.default_rng(5)
    true = np.array([[0.65, 0.07], [0.70, 0.99], [0.29, 0.11]])
    images = {k: np.clip(240 * np.exp(-(true @ (draw.gamma(2, 0.4, (4000, 2)) * gain).T)).T - 1, 0, 255).astype(np.uint8) for k, gain in (("a", 1.0), ("b", 0.6))}
    table = spark.createDataFrame(pd.concat([stain.colours(v.reshape(40, 100, 3), k) for k, v in images.items()]), stain.COLOURS)
    found = {r.slide_id: r for r in stain.macenko(table, ["slide_id"], "n").collect()}
    for k, rgb in images.items():  # the definition, on the image
        od = -np.log((rgb.astype(float) + 1) / 240)
        tissue = od[(od >= 0.15).all(1) & (rgb.max(1) >= 10)]
        values, vectors = np.linalg.eigh(np.cov(tissue.T))
        angles = np.arctan2(tissue @ vectors[:, 2], tissue @ vectors[:, 1])
        ends = [vectors[:, 1:] @ [np.cos(t), np.sin(t)] for t in np.percentile(angles, [1, 99])]
        want = np.stack(sorted(ends, key=lambda e: -e[0]), axis=1)
        assert np.allclose(np.abs(np.reshape(found[k].stains, (3, 2))), np.abs(want), atol=1e-6)
        amounts = np.percentile(np.linalg.lstsq(want, od.T, rcond=None)[0], 99, axis=1)
        assert np.allclose(np.abs(found[k].largest), np.abs(amounts), rtol=1e-5)
    fits = {r.slide_id: np.array(r.fit) for r in stain.fits(table, "macenko").collect()}
    px = spark.createDataFrame(pd.DataFrame(images["a"].astype(int), columns=list("rgb")).assign(slide_id="a", i=range(4000)))
    brought = stain.stained(px, stain.macenko(table, ["slide_id"], "n"), ["slide_id"]).orderBy("i").select("r", "g", "b").toPandas().to_numpy()
    assert np.abs(stain.applied(images["a"].reshape(40, 100, 3), fits["a"]).reshape(-1, 3).astype(int) - brought).max() <= 1
    vahadane = stain.vahadane(table, ["slide_id"], "n", sample=2000).collect()
    assert len(vahadane) == 2 and all(min(r.stains) >= 0 for r in vahadane)
    flat = spark.createDataFrame([("w", 250, 250, 250, 20)], stain.COLOURS)
    assert stain.fits(flat, "macenko").count() == 0 and stain.fits(flat, "vahadane").count() == 0
    fit = stain.fits(table.where("slide_id = 'a'"), "reinhard").first().fit
    moved = P.lab_from_rgb(stain.applied(images["a"].reshape(40, 100, 3), np.array(fit))).astype(float)
    assert abs(moved[..., 0].mean() - 180) < 15
    assert stain.fits(flat, "reinhard").count() == 1  # too little tissue: all pixels count


# --- sources -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def slide(tmp_path_factory):
    return write_sample(str(tmp_path_factory.mktemp("slides") / "a.ome.zarr"), size=512)


def test_image_metadata(spark, slide, tmp_path):
    r = read_slides(spark, [slide]).first()
    assert (r.mpp_level0, r.width, r.downsamples, r.channels, r.dtype) == (0.5, 512, [1.0, 2.0, 4.0], 3, "uint8")
    plain = write_image(str(tmp_path / "p.zarr"), [np.zeros((2, 40, 50), np.uint16)], None, 16, ["DAPI", ""])
    r = read_slides(spark, [plain]).first()
    assert r.mpp_level0 is None and r.channel_names == ["DAPI", ""] and (r.width, r.height) == (50, 40)
    moved = write_image(str(tmp_path / "m.zarr"), [np.zeros((1, 8, 8), np.uint8)], 0.5, 8, origin=(10.0, 20.0))
    assert (Image(moved).origin) == (10.0, 20.0)


def blosc_frame(data, size, codec, shuffle, block=64, split=True):
    """A frame by the format's description, for codecs that are here."""
    import struct
    import zlib

    import pyarrow as pa
    import zstandard

    pack = {"lz4": lambda b: pa.compress(b, "lz4_raw", asbytes=True), "snappy": lambda b: pa.compress(b, "snappy", asbytes=True), "zlib": zlib.compress, "zstd": zstandard.ZstdCompressor().compress}[codec]
    flags = {"none": 0, "byte": 1, "bit": 4}[shuffle] | {"lz4": 1, "snappy": 2, "zlib": 3, "zstd": 4}[codec] << 5 | (0 if split else 16)
    blocks = []
    for at in range(0, len(data), block):
        own = data[at : at + block]
        n = len(own) // size
        if shuffle == "byte":
            own = bytes(own[i * size + k] for k in range(size) for i in range(n)) + own[n * size :]
        if shuffle == "bit":
            n -= n % 8
            bits = [[own[i * size + k] >> b & 1 for i in range(n)] for k in range(size) for b in range(8)]
            own = bytes(sum(row[8 * j + b] << b for b in range(8)) for row in bits for j in range(n // 8)) + own[n * size :]
        parts = size if split and len(own) == block else 1
        each = len(own) // parts
        streams = [own[k * each : (k + 1) * each] for k in range(parts)]
        blocks.append(b"".join(struct.pack("<i", len(min(x, pack(x), key=len))) + min(x, pack(x), key=len) for x in streams))
    starts, at = [], 16 + 4 * len(blocks)
    for b in blocks:
        starts.append(at)
        at += len(b)
    return bytes([2, 1, flags, size]) + struct.pack("<III", len(data), block, at) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(blocks)


@pytest.mark.parametrize("codec", ["lz4", "snappy", "zlib", "zstd"])
@pytest.mark.parametrize("shuffle", ["none", "byte", "bit"])
def test_blosc_frames(codec, shuffle):
    from tissuelake.sources.omezarr import blosc

    data = np.arange(100, dtype="<u2").tobytes() + b"\1" * 112
    for split in (True, False):
        assert blosc(blosc_frame(data, 2, codec, shuffle, split=split)) == data
    assert blosc(bytes([2, 1, 2, 2, 3, 0, 0, 0, 3, 0, 0, 0, 19, 0, 0, 0]) + b"abc") == b"abc"


@pytest.mark.parametrize("codec", [None, "zlib", "gzip", "zstd", "blosc"])
def test_chunk_codecs(tmp_path, codec):
    import gzip
    import json
    import zlib

    import zstandard

    path = write_image(str(tmp_path / "c.zarr"), [np.arange(64, dtype=np.uint16).reshape(1, 8, 8)], 1.0, 8)
    if codec:
        meta = json.load(open(f"{path}/0/.zarray")) | {"compressor": {"id": codec}}
        json.dump(meta, open(f"{path}/0/.zarray", "w"))
        raw = open(f"{path}/0/0.0.0.0.0", "rb").read()
        open(f"{path}/0/0.0.0.0.0", "wb").write({"zlib": zlib.compress, "gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress, "blosc": lambda b: blosc_frame(b, 2, "lz4", "byte")}[codec](raw))
    assert Array(f"{path}/0").chunk((0, 0, 0, 0, 0))[0, 0, 0, 7, 7] == 63


def test_shards_and_transposed_chunks(tmp_path):
    import json
    import struct

    whole = np.arange(64, dtype="<i4").reshape(8, 8)
    meta = {"zarr_format": 3, "shape": [8, 8], "data_type": "int32", "fill_value": 7, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 8]}}, "chunk_key_encoding": {"name": "default"}}
    inner = [{"name": "transpose", "configuration": {"order": [1, 0]}}, {"name": "bytes", "configuration": {"endian": "little"}}]
    meta["codecs"] = [{"name": "sharding_indexed", "configuration": {"chunk_shape": [4, 4], "codecs": inner, "index_codecs": [{"name": "bytes"}, {"name": "crc32c"}], "index_location": "end"}}]
    (tmp_path / "c" / "0").mkdir(parents=True)
    (tmp_path / "zarr.json").write_text(json.dumps(meta))
    part = np.ascontiguousarray(whole[:4, :4].T).tobytes()
    (tmp_path / "c" / "0" / "0").write_bytes(part + struct.pack("<QQQQ", 0, len(part), 2**64 - 1, 2**64 - 1) + b"crc.")
    a = Array(str(tmp_path))
    assert (a.chunk((0, 0)) == whole[:4, :4]).all() and (a.chunk((0, 1)) == 7).all() and (a.chunk((1, 0)) == 7).all()


def test_reads_over_http_with_a_query(spark, slide):
    import threading
    from functools import partial
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    class Handler(SimpleHTTPRequestHandler):
        def do_GET(self):
            if not self.path.endswith("?sig=abc"):
                self.send_error(403)
                return
            super().do_GET()

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(Handler, directory=os.path.dirname(slide)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        uri = f"http://127.0.0.1:{server.server_port}/{os.path.basename(slide)}?sig=abc"
        r = read_slides(spark, [uri, uri.replace("?sig=abc", "")]).orderBy(F.length("path").desc()).collect()
        assert r[0].width == 512 and r[0].error is None
        assert r[1].width is None and "403" in r[1].error
    finally:
        server.shutdown()


def test_float_images_have_one_scale(tmp_path):
    for top, fill, want in ((0.9, 0, 255.0), (3.0, 0, 1.0)):
        image = np.full((1, 64, 64), 0.5, np.float32)
        image[0, 0, 0], image[0, 40, 40] = top, np.nan
        assert Image(write_image(str(tmp_path / f"{top}.zarr"), [image], 1.0, 16)).float_scale() == want
    assert Image(write_image(str(tmp_path / "u.zarr"), [np.zeros((1, 8, 8), np.uint8)], 1.0, 8)).float_scale() is None


def test_blocks_and_patches_read_alike_and_borders_are_padded(spark, slide):
    whole = np.zeros((3, 512, 512), np.uint8)
    image = Image(slide)
    for cy in range(2):
        for cx in range(2):
            for _, _, c, _, _, y, x, h, w, _, data in image.planes(0, cy, cx):
                whole[c, y : y + h, x : x + w] = np.frombuffer(data, np.uint8).reshape(h, w)
    at = [(0, 0), (200, 230), (-20, -30), (480, 490), (700, 0)]
    windows = spark.createDataFrame([("s", slide, i, x, y) for i, (x, y) in enumerate(at)], "slide_id string, path string, patch_idx long, lx long, ly long").select("*", F.lit(64).alias("read_w"), F.lit(64).alias("read_h"), F.lit(0).alias("read_level"), F.lit(None).cast("double").alias("float_scale"))
    single = {r.patch_idx: r.pixels for r in regions.read_patches(windows, 1, 5).collect()}
    assert {r.patch_idx: r.pixels for r in regions.read_patches(windows, 8, 5000).collect()} == single
    padded = np.pad(whole.transpose(1, 2, 0), ((300, 300), (300, 300), (0, 0)), constant_values=255)
    for i, (x, y) in enumerate(at):
        assert (np.frombuffer(single[i], np.uint8).reshape(64, 64, 3) == padded[y + 300 : y + 364, x + 300 : x + 364]).all()
    native = {r.patch_idx: r for r in regions.read_patches(windows, 4, 5, rgb=False).collect()}
    assert np.frombuffer(native[2].pixels, np.uint8).reshape(64, 64, 3)[0, 0].tolist() == [0, 0, 0]
    gone = regions.read_patches(windows.withColumn("path", F.lit("/nowhere")), 4, 5).collect()
    assert len(gone) == 5 and all(r.pixels is None and r.error for r in gone)


def test_zonal_sums_equal_means_under_cells():
    draw = np.random.default_rng(11)
    raster = draw.integers(0, 3, (40, 50)).astype(np.uint8)
    slide = {"slide_id": "s", "xs": list(range(-20, 230, 35)), "ys": list(range(0, 200, 35)), "level0_patch": 35}
    found = pd.concat(segment.zonal(raster, [1, 2], slide, 4.0, (3.0, -2.0)))
    assert len(found) == len(slide["xs"]) * len(slide["ys"])
    for r in found.itertuples():
        y, x = round((r.y + 2) / 4), round((r.x - 3) / 4)
        own = raster[max(0, y) : max(0, y + 9), max(0, x) : max(0, x + 9)]
        for k, share in ((1, r.class_1), (2, r.class_2)):
            assert share == np.float32((own == k).mean() if own.size else 0)


def test_text_inputs(spark, tmp_path):
    put = lambda name, s: (tmp_path / name).write_text(s) and str(tmp_path / name)
    rows = text.read_manifest(spark, put("a.csv", "# cohort\npath,source_mpp\na.zarr,0.25\n\nb.zarr,\n")).collect()
    assert [tuple(r) for r in rows] == [("a.zarr", 0.25), ("b.zarr", None)]
    assert text.read_manifest(spark, put("b.csv", "a.zarr\nb.zarr,0.5\n")).count() == 2
    for bad in ("", "path\n", "a,-1\n", "a,x\n"):
        with pytest.raises(ValueError):
            text.read_manifest(spark, put("bad.csv", bad or "#\n"))
    assert text.read_extractions(spark, put("p.yaml", "extractions:\n- model: a\n  mpp: 0.5\n- {model: a, patch_px: 96}\n")) == [{"model": "a", "mpp": 0.5}, {"model": "a", "patch_px": 96}]
    with pytest.raises(ValueError):
        text.read_extractions(spark, put("q.yaml", "extractions: []\n"))
    assert text.read_channel_names(spark, put("c.csv", "marker\nDAPI\nCD3\n")) == ["DAPI", "CD3"]
    assert text.read_channel_names(spark, put("c.txt", "# x\nDAPI\n\nCD3\n")) == ["DAPI", "CD3"]
    for bad in ("DAPI\ndapi\n", "\n", "a,b\n"):
        with pytest.raises(ValueError):
            text.read_channel_names(spark, put("d.csv", bad))


# --- identities ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("uri", "want"),
    [
        ("https://u:p@h/a.zarr?x=1", "https://h/a.zarr?x=1"),
        ("https://h/a?token=t&keep=1;sig=2", "https://h/a?keep=1"),
        ("https://h/a?Expires=5&key=2", "https://h/a?Expires=5&key=2"),
        ("https://h/a?Expires=5&Signature=s&AWSAccessKeyId=k&v=1", "https://h/a?v=1"),
        ("https://x.blob.core.windows.net/c/a?sv=1&se=2&v=3", "https://x.blob.core.windows.net/c/a?v=3"),
        ("https://h/a#access_token=t", "https://h/a"),
        ("HTTPS://H/a#series-1", "HTTPS://H/a#series-1"),
        ("s3://b/a.zarr?X-Amz-Date=1&a=b;c=d", "s3://b/a.zarr?a=b;c=d"),
    ],
)
def test_credentials_go(uri, want):
    assert I.source_uri_of(uri) == want


def test_slide_ids():
    assert I.slide_id_of("/data/a.ome.zarr") == "a" and I.slide_id_of("b.embeddings.zarr/") == "b" and I.slide_id_of("c.ZARR") == "c.ZARR"
    signed, plain = I.slide_id_of("https://h/x/a.zarr/0?token=1"), I.slide_id_of("https://h/x/a.zarr/0")
    assert signed == plain and plain.startswith("a-") and len(plain) == 18
    assert I.slide_id_of("https://h/y/a.zarr/0") != plain and I.slide_id_of("/d/a.zarr/0").startswith("a-")
    assert I.slide_id_of("file:///d/a%20b.zarr") == "a b"


def test_remote_ids_in_expressions(spark):
    uris = ["https://h.example/x/825?page=2#top", "http://h.example", "https://h/x/a b.ome.zarr", "s3://b/__x__.zarr/"]
    rows = spark.createDataFrame([(u,) for u in uris], "u string").select(I.slide_id("u").alias("a"), I.remote_slide_id(F.col("u")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_redaction():
    assert I.redacted("see (https://u:p@h/a?sig=1&b=2), ok") == "see (https://h/a?b=2), ok"
    assert I.redacted_value({"token": "x", "n": [{"u": "https://h/?api_key=1"}]}) == {"token": "<redacted>", "n": [{"u": "https://h/"}]}
    assert I.redacted_value({"token": "x"}, by_key=False) == {"token": "x"}
    assert I.join_path("https://h/a.zarr?x=1", "/0", "1") == "https://h/a.zarr/0/1?x=1"


def test_requests_and_hashes():
    r = Request(("b", "a"), 0.5, 224)
    assert r.content_hash() == r.at(models=("a", "b"), batch=7, device="cuda").content_hash()
    assert r.grid_hash() == r.at(models=("z",), amp="fp16").grid_hash() != r.at(mpp=1.0).grid_hash()
    assert r.content_hash() != r.at(amp="fp16").content_hash()
    assert run_hash([r, r.at(mpp=1.0)]) == run_hash([r.at(mpp=1.0), r])
    for bad in ({"mpp": 0}, {"patch_px": -1}, {"models": ()}, {"threshold": 2}, {"multiplex": "c", "percentiles": (9, 1)}, {"aggregation": "concat"}, {"stain": "x"}, {"shard_index": 1}):
        with pytest.raises(ValueError):
            Request(**({"models": ("a",)} | bad))


def test_geometries():
    catalog_ = {m.name: m for m in (registry.Model("a", 8, 224, 0.5), registry.Model("b", 8, 256), registry.Model("c", 8, 224, 0.5))}
    go = lambda *args, **k: [(g.mpp, g.patch_px, g.models, g.source) for g in registry.geometries(*args, catalog=catalog_, **k)]
    assert go(["a", "b", "c", "a"]) == [(0.5, 224, ("a", "c"), "recommended"), (1.0, 256, ("b",), "default")]
    assert go(["a", "b"], 0.25) == [(0.25, 224, ("a",), "explicit"), (0.25, 256, ("b",), "explicit")]
    assert go(["a", "b"], 0.25, 96) == [(0.25, 96, ("a", "b"), "explicit")]
    assert go(["a", "c"], None, 96) == [(0.5, 96, ("a", "c"), "explicit")]
    assert go([], plan=[{"model": "a"}, {"model": "a", "mpp": 1.0}]) == [(0.5, 224, ("a",), "config"), (1.0, 224, ("a",), "config")]
    with pytest.raises(ValueError):
        go(["x"])


# --- pooling, multiplex, quality -----------------------------------------------------------------------------------


def test_pools_against_numpy(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(50, 6)).astype(np.float32)
    rows = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "slide_id string, patch_idx int, vec array<float>").repartition(4)
    w = {"w": draw.normal(size=(5, 6)), "wb": draw.normal(size=5), "a": draw.normal(size=(4, 5)), "ab": draw.normal(size=4), "b": draw.normal(size=(4, 5)), "bb": draw.normal(size=4), "c": draw.normal(size=(1, 4)), "cb": draw.normal(size=1)}
    h = np.maximum(x @ w["w"].T + w["wb"], 0)
    s = ((np.tanh(h @ w["a"].T + w["ab"]) / (1 + np.exp(-(h @ w["b"].T + w["bb"])))) @ w["c"].T + w["cb"]).ravel()
    p = np.exp(s - s.max())
    assert np.allclose(pooling.gated_attention_pool(rows, ["slide_id"], w).first()["vec"], (p / p.sum()) @ x, atol=1e-5)
    assert np.allclose(pooling.meanmax_pool(rows, ["slide_id"]).first()["vec"], np.concatenate([x.mean(0), x.max(0)]), atol=1e-6)
    m, heads, out = draw.normal(size=(6, 8)), draw.normal(size=(2, 4)), draw.normal(size=(8, 3))
    embed = lambda v: np.tanh(v @ m).reshape(len(v), 4, 2)
    e = embed(x.astype(float))
    total = np.zeros((4, 2))
    for k in range(2):
        a = np.exp(e[:, :, k] @ heads[k])
        total[:, k] = (a / a.sum()) @ e[:, :, k]
    found = pooling.multihead_pool(rows, ["slide_id"], embed, [lambda v, k=k: v @ heads[k] for k in range(2)], lambda v: v @ out).first()["vec"]
    assert np.allclose(found, total.ravel() @ out, atol=1e-5)


def test_positions_beyond_the_grid_are_an_error(spark):
    rows = spark.createDataFrame([(448, 224, 224), (0, 224_000, 224)], "x int, y int, level0_patch int")
    assert pooling.position_cells(rows.where("x > 0")).first()["cell"] == 2 * 1000 + 1 + 1
    with pytest.raises(Exception, match="beyond"):
        pooling.position_cells(rows).collect()


def test_position_cells_query_on_a_table_beyond_the_grid(spark, tmp_path):
    rows = [(v, [1.0, 2.0], label) for v, label in [(0, 1), (24_999, 1), (25_000, 1), (1_000_000, 2), (-7, 1), (60, None), (None, 2)]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"SELECT slide_id, patch_idx, cell FROM ({catalog.oracle_sql()['position_cells']})").fetchall()
    found = catalog.queries()["position_cells"](spark, str(tmp_path))
    assert len(want) == 4
    assert sorted(map(tuple, found.select("slide_id", "patch_idx", "cell").collect()), key=repr) == sorted(want, key=repr)


def test_multiplex_errors(spark):
    panel = spark.createDataFrame([("s", 0, "DAPI"), ("s", 1, "CD3"), ("s", 2, "cd3 ")], "slide_id string, source_index int, source_name string")
    assert multiplex.selected(panel, ["dapi"]).first()["source_index"] == 0
    with pytest.raises(Exception, match="missing or ambiguous"):
        multiplex.selected(panel, ["CD3"]).collect()
    mixed = spark.createDataFrame([("s", 0, "DAPI"), ("s", 1, "Hoechst")], "slide_id string, source_index int, source_name string")
    with pytest.raises(Exception, match="one stain family"):
        multiplex.nuclear_channels(mixed).collect()
    flat = spark.createDataFrame([("m", 1.0), ("m", 1.0)], "marker string, v double")
    with pytest.raises(Exception, match="degenerate"):
        multiplex.require_bounds(multiplex.percentile_bounds(flat, ["marker"], "v")).collect()


def test_names_merge():
    assert merged_names(["DAPI", ""], ["DAPI", "CD3"]) == ["DAPI", "CD3"]
    with pytest.raises(ValueError):
        merged_names(["DAPI"], ["CD3"])


def test_above_median_and_ranks(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "k string, v double")
    assert sorted(r.k for r in quality.above_median(rows, "v").collect()) == ["b", "c"]
    assert [r.k for r in quality.ranked(rows, "v", "k", 2).collect()] == ["b", "c"]


# --- runs ----------------------------------------------------------------------------------------------------------


class Broken(E.MeanEmbedder):
    def embed(self, batch):
        raise RuntimeError("no")


def listed(spark, *paths):
    return spark.createDataFrame([(p, None) for p in paths], "path string, source_mpp double")


def statuses(frame):
    return {r.slide_id: r.status for r in frame.collect()}


REQUEST = Request(("mean",), 1.0, 64)
MEAN = [(REQUEST, [E.MeanEmbedder("mean")])]


def test_run_resumes_and_conforms(spark, slide, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert statuses(pipeline.run(spark, store, listed(spark, slide), MEAN, {"mean": "mean"})) == {"a": "complete"}
    n = store.table("patches").count()
    assert n > 0 and store.features().count() == n and store.table("slide_vectors").count() == 1
    assert statuses(pipeline.run(spark, store, listed(spark, slide), [(REQUEST, [Broken("mean")])])) == {"a": "skipped"}
    two = [(REQUEST.at(models=("mean", "histogram")), [E.MeanEmbedder("mean"), E.HistogramEmbedder("histogram", 24)])]
    pipeline.run(spark, store, listed(spark, slide), two)
    assert store.features().count() == 2 * n and store.raw("patches").count() == n
    assert store.grid() == "mpp1_px64" and store.grid_of("histogram") == "mpp1_px64"
    check = lambda f: conformance.violations(store.table("grids"), store.table("patches"), f, store.table("outputs"), store.table("cells"), store.table("slide_vectors")).collect()
    assert check(store.features()) == []
    assert len(check(store.features().where("not (model = 'mean' and patch_idx = 0)"))) == 1


def test_forced_runs_replace(spark, slide, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    pipeline.run(spark, store, listed(spark, slide), MEAN, {"mean": "mean"})
    n = store.table("patches").count()
    for _ in range(2):
        assert statuses(pipeline.run(spark, store, listed(spark, slide), [(REQUEST, [E.MeanEmbedder("mean", bias=1.0)])], {"mean": "mean"}, force=True)) == {"a": "complete"}
    assert store.raw("features").count() == 3 * n
    assert store.features().count() == store.table("patches").count() == n
    assert pipeline.whole_models(store).count() == 1 and store.table("slide_vectors").count() == 1
    low = store.features().agg(F.min(F.get("vec", F.lit(0)))).first()[0]
    assert low > 0.2  # the last one's bias


def test_a_run_that_stopped_leaves_nothing_that_shows(spark, slide, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    append = store.append

    def stop(table, rows):
        if table == "outputs":
            raise KeyboardInterrupt
        append(table, rows)

    monkeypatch.setattr(store, "append", stop)
    with pytest.raises(KeyboardInterrupt):
        pipeline.run(spark, store, listed(spark, slide), MEAN)
    assert store.raw("features").count() > 0 and store.features().count() == 0
    monkeypatch.setattr(store, "append", append)
    pipeline.run(spark, store, listed(spark, slide), MEAN)
    assert store.features().count() == store.table("patches").count() == store.raw("patches").count()
    assert pipeline.whole_models(store).count() == 1


def test_slides_of_several_chunk_shapes_and_a_broken_one(spark, tmp_path):
    draw = np.random.default_rng(12)
    image = draw.integers(0, 256, (3, 256, 256)).astype(np.uint8)
    paths = [write_image(str(tmp_path / f"c{c}.zarr"), [image, image[:, ::2, ::2]], 0.5, c) for c in (48, 128)]
    bad = write_image(str(tmp_path / "bad.zarr"), [image], 0.5, 128)
    os.remove(f"{bad}/0/.zarray")
    plain = write_image(str(tmp_path / "plain.zarr"), [image], None, 128)
    torn = write_image(str(tmp_path / "torn.zarr"), [image], 0.5, 64)
    with open(f"{torn}/0/0.0.0.0.0", "wb") as f:
        f.write(b"short")
    store = Store(spark, str(tmp_path / "store"))
    request = [(Request(("mean",), 0.5, 32, no_segmentation=True, read_block=1), [E.MeanEmbedder("mean", 4, 32)])]
    found = pipeline.run(spark, store, listed(spark, *paths, bad, plain, torn), request).collect()
    assert {r.slide_id: r.status for r in found} == {"c48": "complete", "c128": "complete", "bad": "failed", "plain": "failed", "torn": "failed"}
    assert all((r.error is None) == (r.status == "complete") for r in found)
    assert "scale" in {r.slide_id: r.error for r in found}["plain"]
    f = store.features()
    assert all(r.ok for r in conformance.compared(f.where("slide_id = 'c48'").drop("slide_id"), f.where("slide_id = 'c128'").drop("slide_id"), ["patch_idx"]).collect())
    want = (image[:, :32, :32].astype(np.float64) / 255).mean() * 2 - 1
    assert f.where("patch_idx = 0 and slide_id = 'c48'").first().vec[0] == pytest.approx(want, abs=2e-3)
    receipts = {r.slide_id: r for r in store.raw("receipts").collect()}
    assert receipts["torn"].error and receipts["c48"].n_patches == 64 and receipts["c48"].model_dims == {"mean": 4}
    assert statuses(pipeline.run(spark, store, listed(spark, *paths), request)) == {"c48": "skipped", "c128": "skipped"}


def test_geometries_and_segmenters_of_one_run(spark, slide, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    make = lambda **c: (REQUEST.at(**c), [E.MeanEmbedder("mean")])
    requests = [make(), make(patch_px=32, segmenter="canny"), make(segmenter="canny")]
    assert statuses(pipeline.run(spark, store, listed(spark, slide), requests)) == {"a": "complete"}
    grids = {r.grid_key: r for r in store.table("grids").collect()}
    assert len(grids) == 3 and {r.segmenter for r in grids.values()} == {"otsu", "canny"}
    assert sorted(k for k in grids if k.startswith("mpp1_px64")) == ["mpp1_px64", f"mpp1_px64_{requests[2][0].grid_hash()[:8]}"]
    assert statuses(pipeline.run(spark, store, listed(spark, slide), requests)) == {"a": "skipped"}
    assert statuses(pipeline.run(spark, store, listed(spark, slide), requests[:2])) == {"a": "complete"}
    assert store.primary().first().grid_key == "mpp1_px64"


def test_stain_corrected_runs_and_thumbnails(spark, slide, tmp_path):
    for method in ("macenko", "reinhard"):
        store = Store(spark, str(tmp_path / method))
        assert statuses(pipeline.run(spark, store, listed(spark, slide), [(REQUEST.at(stain=method), [E.MeanEmbedder("mean")])])) == {"a": "complete"}
    slides = pipeline.slides_of(spark, listed(spark, slide))
    r = pipeline.thumbnail(slides, store.table("patches").withColumn("level0_patch", F.lit(128)), segmenter="otsu", max_px=100).first()
    assert r.error is None and r.png[:4] == b"\x89PNG"


def test_multiplex_runs(spark, tmp_path):
    draw = np.random.default_rng(13)
    y, x = np.mgrid[:256, :256]
    inside = ((y - 128) ** 2 + (x - 128) ** 2 < 90**2)
    image = np.stack([np.where(inside, 9000, 300), draw.integers(0, 4000, (256, 256)), np.arange(65536).reshape(256, 256)]).astype(np.uint16)
    path = write_image(str(tmp_path / "m.zarr"), [image, image[:, ::2, ::2]], 4.0, 100, ["DAPI", "CD3", "CD8"])
    blank = write_image(str(tmp_path / "n.zarr"), [image], 4.0, 128, ["a", "CD3", "CD8"])
    store = Store(spark, str(tmp_path / "store"))
    request = Request(("mean",), 4.0, 32, multiplex="channelwise", markers=("cd8", "CD3"), aggregation="concat", percentiles=(0.0, 100.0), half=False)
    found = {r.slide_id: r for r in pipeline.run(spark, store, listed(spark, path, blank), [(request, [E.MeanEmbedder("mean", 2, 32)])]).collect()}
    assert found["m"].status == "complete" and found["n"].status == "failed" and "nuclear" in found["n"].error
    assert store.table("grids").first().segmenter == "nuclear"
    f = store.features().join(store.table("patches"), ["slide_id", "patch_idx"]).collect()
    assert 10 < len(f) < 64 and all(len(r.vec) == 4 for r in f)
    r = f[0]
    own = image[2, r.y : r.y + 32, r.x : r.x + 32] / 65535
    assert r.vec[0] == pytest.approx((np.rint(own * 255) / 255).mean() * 2 - 1, abs=1e-3)
    assert statuses(pipeline.run(spark, store, listed(spark, path), [(request, [Broken("mean", 2, 32)])])) == {"m": "skipped"}


def test_shared_transforms_and_half_precision(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counting(E.MeanEmbedder):
        def prepare(self, patch):
            calls.add(1)
            return super().prepare(patch)

    patch = np.random.default_rng(7).integers(0, 256, (64, 64, 3)).astype(np.uint8)
    rows = spark.createDataFrame([("s", i, 64, 64, 3, "uint8", bytearray(patch.tobytes())) for i in range(4)], "slide_id string, patch_idx long, height int, width int, channels int, dtype string, pixels binary").coalesce(1)
    found = E.embed(rows, [Counting("a"), Counting("b", bias=1.0)]).collect()
    assert calls.value == 4 and len(found) == 8
    assert all(np.float16(v) == np.float32(v) for r in found for v in r.vec)


def test_cohort(spark):
    rows = spark.createDataFrame([("/a/x.zarr", None), ("/b/x.zarr", None), ("/c/y.zarr", 0.5)], "path string, source_mpp double")
    named = cohort.identified(rows)
    with pytest.raises(ValueError, match="share an output id"):
        cohort.require_unique(named)
    parts = [cohort.strided(named, k, 2).count() for k in range(2)]
    assert sum(parts) == 3


def test_manifest_stream(spark, tmp_path):
    from tissuelake.streaming.cohort import watch_manifests

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("path,source_mpp\nx.zarr,0.5\nx.zarr,0.5\n")
    seen = []
    go = lambda: watch_manifests(spark, str(folder), lambda df: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    go()
    (folder / "b.csv").write_text("path,source_mpp\ny.zarr,\n")
    go()
    assert seen == ["x.zarr", "y.zarr"]


def test_cli(tmp_path, capsys):
    from tissuelake import cli

    path = str(tmp_path / "s.zarr")
    assert cli.main(["sample", path, "--size", "256"]) == 0 and os.path.exists(path)
    assert cli.main(["info", path]) == 0 and "256 x 256" in capsys.readouterr().out
    assert cli.main(["models"]) == 0


def test_quality_and_stored_pooling(spark, slide, tmp_path):
    from tissuelake.plans.resume import complete_tools

    store = Store(spark, str(tmp_path / "q"))
    pipeline.run(spark, store, listed(spark, slide), MEAN)
    for _ in range(2):
        assert pipeline.score_quality(spark, store, pipeline.slides_of(spark, listed(spark, slide)), tile=50).count() == 0
    qc = store.table("qc")
    assert qc.count() == store.table("patches").count() == store.raw("qc").count()
    assert complete_tools(qc, store.table("patches"), store.table("qc_status")).count() == 1
    assert all(0 <= v <= 1 for r in qc.collect() for v in r.scores.values())
    for _ in range(2):
        pipeline.pool_stored(store, store.grid(), "max", "max")
    assert store.raw("slide_vectors").count() == 1


def test_large_levels_are_averaged(slide):
    image = Image(slide)
    whole, half = (regions.read_level(image, 0, most)[0].astype(float) for most in (512, 256))
    assert whole.shape == (512, 512, 3) and half.shape == (256, 256, 3)
    assert np.abs(half - whole.reshape(256, 2, 256, 2, 3).mean(axis=(1, 3))).max() <= 1
    assert regions.read_level(image, 0, 200)[1] == 3


def test_levels_by_side(spark):
    levels = "array(named_struct('width', 4000, 'height', 900), named_struct('width', 2000, 'height', 450), named_struct('width', 1000, 'height', 225))"
    row = spark.range(1).select(F.expr(levels).alias("l"))
    pick = lambda f, px: row.select(f(F.col("l"), px)).first()[0]
    assert [pick(G.coarsest_level_over, px) for px in (5000, 4000, 1500, 1000, 10)] == [0, 0, 1, 2, 2]
    assert [pick(G.first_level_under, px) for px in (4000, 2048, 1000, 999)] == [0, 1, 2, None]


def test_marker_embedding(spark):
    draw = np.random.default_rng(9)
    image = draw.integers(0, 1000, (64, 64, 2)).astype(np.uint16)
    patches = spark.createDataFrame([("s", 3, 64, 64, 2, "uint16", bytearray(image.tobytes()))], "slide_id string, patch_idx long, height int, width int, channels int, dtype string, pixels binary")
    markers = spark.createDataFrame([("s", 0, 1, 0.0, 999.0), ("s", 1, 0, 0.0, 999.0)], "slide_id string, position int, source_index int, low double, high double")
    joined = multiplex.embed_markers(patches, markers, [E.MeanEmbedder("m")], "concat").first()
    assert joined.patch_idx == 3 and len(joined.vec) == 16
    want = (np.rint(image[..., 1] / 999 * 255) / 255).mean() * 2 - 1
    assert joined.vec[0] == pytest.approx(want, abs=2e-3)
    assert multiplex.embed_markers(patches, markers, [E.MeanEmbedder("m")]).first().vec[0] == pytest.approx((joined.vec[0] + joined.vec[8]) / 2, abs=1e-6)
    assert multiplex.effective_key("m", "mean", {"a": 1}) != multiplex.effective_key("m", "mean", {"a": 2})


def test_channel_names_fill_blanks(spark):
    panel = spark.createDataFrame([("s", 0, "DAPI"), ("s", 1, "")], "slide_id string, source_index int, source_name string")
    assert [r.source_name for r in multiplex.named_channels(panel, ["dapi", "CD3"]).orderBy("source_index").collect()] == ["DAPI", "CD3"]
    for bad in (["CD8", "CD3"], ["DAPI"], ["DAPI", "CD3", "CD4"]):
        with pytest.raises(Exception, match="channel names"):
            multiplex.named_channels(panel, bad).collect()


def test_plugins_and_provenance():
    from tissuelake.plans import plugins, provenance

    plugins.register("embedders", "own")(dict)
    assert plugins.get("embedders", "own") is dict and "otsu" in plugins.available("segmenters")
    with pytest.raises(KeyError):
        plugins.get("embedders", "none")
    assert provenance.safe_arguments(["embed", "https://u:p@h/a", "--hf-token", "x", "--api-key=y"]) == ["embed", "https://h/a", "--hf-token", "<redacted>", "--api-key=<redacted>"]
    assert provenance.sidecar("s", "geojson", "g", "g") == "s.geojson" and provenance.sidecar("s", "geojson", "h", "g") == "s.h.geojson"
