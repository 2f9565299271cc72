"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tissuelake.llm.common import written

#: Tables, probed axes of a query in each, signed axes that a hash joins, and rows of a bucket in one task.
TABLES, PROBES, AXES, BLOCK = 12, 8, 1, 2048
ROUNDS, SEED = 3, 20_240_602
#: Buckets of all tables up to which their sizes are broadcast; their number follows from the parameters alone.
BROADCAST_BUCKETS = 1_000_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, part: int, seed: int = SEED) -> np.ndarray:
    """A pseudo-random rotation: random signs and a Hadamard transform, three times."""
    signs = np.random.default_rng([seed, table, part]).choice(np.array([-1.0, 1.0]), (ROUNDS, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def codes(x: np.ndarray, table: int, axes: int) -> np.ndarray:
    """The nearest signed axis of each unit vector, of each of the table's rotations, as one number."""
    out = np.zeros(len(x), np.int64)
    for part in range(axes):
        r = rotated(x, table, part)
        at = np.abs(r).argmax(1)
        out = out * 2 * x.shape[1] + 2 * at + (r[np.arange(len(r)), at] < 0)
    return out


def probes(x: np.ndarray, table: int, axes: int, n: int) -> np.ndarray:
    """The n codes of each vector whose axes are nearest to it, best first: (vectors, n)."""
    d = x.shape[1]
    best, score = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for part in range(axes):
        r = rotated(x, table, part)
        signed = np.stack([r, -r], axis=2).reshape(len(x), 2 * d)
        near = np.argsort(-signed, axis=1, kind="stable")[:, : min(n, 2 * d)]
        # What a probe loses against the nearest axis adds up over the parts.
        lost = signed.max(1, keepdims=True) - np.take_along_axis(signed, near, 1)
        total = (score[:, :, None] + lost[:, None, :]).reshape(len(x), -1)
        code = (best[:, :, None] * 2 * d + near[:, None, :]).reshape(len(x), -1)
        order = np.argsort(total, axis=1, kind="stable")[:, :n]
        best, score = np.take_along_axis(code, order, 1), np.take_along_axis(total, order, 1)
    return best


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    sizes = np.diff(vectors.offsets.to_numpy())
    rows = np.repeat(np.arange(len(vectors)), sizes)
    columns = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, columns] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    biggest = np.abs(x).max(1, keepdims=True)
    x = x / biggest  # no overflow of squares
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of q with the rows of x in double precision, equal for equal rows wherever they stand."""
    q, x = q / np.abs(q).max(), x / np.abs(x).max(1, keepdims=True)
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def _nearest(queries: pd.DataFrame, rows: pd.DataFrame, k: int, kind: str) -> pd.DataFrame:
    out: list[tuple[int, int, float]] = []
    if len(queries) and len(rows):
        ids = rows["vec_id"].to_numpy()
        x = np.stack([np.frombuffer(b, kind) for b in rows["vec"]]).astype(np.float64)
        unit = _unit(x)
        for at in range(0, len(queries), 256):
            some = queries.iloc[at : at + 256]
            q = np.stack([np.frombuffer(b, kind) for b in some["vec"]]).astype(np.float64)
            near = _unit(q) @ unit.T
            for query, vector, s in zip(some["vec_id"].tolist(), q, near, strict=True):
                other = ids != query
                n = min(k, int(other.sum()))
                if n:
                    edge = np.partition(s[other], -n)[-n] - 1e-9
                    take = np.nonzero(other & (s >= edge))[0]
                    exact = cosines(vector, x[take])
                    order = np.lexsort((ids[take], -exact))
                    seen: dict[int, float] = {}
                    for i in order.tolist():
                        seen.setdefault(int(ids[take[i]]), float(exact[i]))
                        if len(seen) == n:
                            break
                    out.extend((query, v, c) for v, c in seen.items())
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def search(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, tables: int = TABLES, n_probes: int = PROBES, axes: int = AXES, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query row its k nearest found rows: query_id, rank, vec_id, score (the cosine), nearest first.

    Vectors that are null, zero, or hold null or non-finite components take no part; shorter ones count as padded
    with zeros. Null ids take no part. Rows of the query's own id are no candidates; rows that repeat an id count once,
    with their best score. Ties go to the smaller id. A query with fewer found than there are candidates, up to k, is
    searched exhaustively. Other columns don't matter. An empty table gives an empty result.

    Each table turns unit vectors by its own fast pseudo-rotation and files them under the nearest signed axis; a
    query looks under its n_probes nearest axes. Buckets are dealt in blocks of a bounded number of rows, the queries
    of a bucket to each of its blocks, and a block returns k rows for each query at most, reranked by exact cosines.
    With axes=1, meant for up to some million vectors, tables hold 2 x dimension buckets, so that a query's work grows
    with the table; axes=2 squares the buckets' number for larger tables, with more probes.
    """
    spark = vectors.sparkSession
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) & F.exists(v, lambda x: x != 0)
    rows = rows.where(sound)
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], schema)

    def file(batches: Iterator[pa.RecordBatch], probing: bool, all_axes: bool = False) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = _matrix(batch["v"], dim)
                unit = _unit(x)
                vec = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                for t in range(1 if all_axes else tables):
                    code = np.tile(np.arange((2 * unit.shape[1]) ** axes), (len(x), 1)) if all_axes else probes(unit, t, axes, n_probes) if probing else codes(unit, t, axes)[:, None]
                    row = np.repeat(np.arange(len(x)), code.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, np.int32)), pa.array(code.ravel()), batch["vec_id"].take(pa.array(row)), vec.take(pa.array(row))], names=["t", "code", "vec_id", "vec"])

    filed_schema = "t int, code long, vec_id long, vec binary"
    filed = rows.mapInArrow(lambda b: file(b, False), filed_schema)
    blocks = filed.groupBy("t", "code").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    few = tables * (2 * (1 << max(0, dim - 1).bit_length())) ** axes <= BROADCAST_BUCKETS
    # Beside broadcast sizes, filed vectors are shuffled once, to their blocks.
    blocks = F.broadcast(blocks) if few else blocks
    dealt = filed.join(blocks, ["t", "code"])
    data = dealt.select("t", "code", F.pmod(F.xxhash64("vec_id"), dealt["blocks"]).cast("int").alias("block"), "vec_id", "vec")
    keys = ["t", "code", "block"]
    queries = rows.where(F.expr(is_query.replace("vec_id", "`vec_id`")))

    def found(asked: DataFrame, all_axes: bool = False) -> DataFrame:
        there = blocks.select(F.col("t").alias("t_"), F.col("code").alias("code_"), F.sequence(F.lit(0), F.col("blocks") - 1).alias("all_"))
        there = F.broadcast(there) if few else there
        probing = asked.mapInArrow(lambda b: file(b, True, all_axes), filed_schema).join(there, F.expr("t = t_ and code = code_")).select("t", "code", F.explode("all_").alias("block"), "vec_id", "vec")
        here = data.where("t = 0") if all_axes else data
        return here.groupBy(*keys).cogroup(probing.groupBy(*keys)).applyInPandas(lambda x, q: _nearest(q, x, k, kind), "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(hits: DataFrame) -> DataFrame:
        once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    result = written(ranked(found(queries)), "neighbours")
    have = min(k, rows.select("vec_id").distinct().limit(k + 1).count() - 1)
    short = queries.select("vec_id").distinct().join(result.groupBy(F.col("query_id").alias("vec_id")).count(), "vec_id", "left").where(F.coalesce("count", F.lit(0)) < have).select("vec_id")
    if short.limit(1).count():
        rest = ranked(found(queries.join(short, "vec_id", "left_semi"), all_axes=True))
        result = result.join(short.withColumnRenamed("vec_id", "query_id"), "query_id", "left_anti").unionByName(rest)
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
