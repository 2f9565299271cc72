"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuelake.llm.common import SPACES, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix has this many times the words of the input; no source and no document exceeds MOST times its own.
SHARE, MOST = 1.5, 2.0
#: Documents that a block has on average, output shards, and the seed of all draws.
BLOCK_DOCS, SHARDS, SEED = 4096, 16, 20_240_601


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words of each source, in order: shares by weight, with what exceeds most times a source's size shared anew."""
    limits = [most * x for x in sizes]
    out = [0.0] * len(sizes)
    open_ = [k for k, x in enumerate(sizes) if x > 0]
    rest = share * sum(sizes)
    while open_:
        total = sum(weights[k % len(weights)] for k in open_)
        shares = {k: rest * weights[k % len(weights)] / total for k in open_}
        over = [k for k in open_ if shares[k] > limits[k]]
        if not over:
            for k in open_:
                out[k] = shares[k]
            break
        for k in over:
            out[k] = limits[k]
            rest -= limits[k]
        open_ = [k for k in open_ if k not in over]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Block draws of each source (columns) for each output shard (rows), exact in both sums up to the tree's halves.

    A node of the tree splits its quotas between its two halves of the shards: the left half gets its share of all
    the node's draws, and which source they come from is a multivariate-hypergeometric draw. A node's draw is
    seeded by its place in the tree, so that any part of the tree can be drawn anew alone.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1:
            out[first] = have
            return
        middle = (first + last) // 2
        total = int(have.sum())
        draw = np.random.default_rng([seed, first, last])
        left = draw.multivariate_hypergeometric(have, total * (middle - first) // (last - first), method="marginals") if total else have * 0
        split(first, middle, left)
        split(middle, last, have - left)

    if len(quotas):
        split(0, shards, np.asarray(quotas, np.int64))
    return out


def block_queue(sizes: list[int], target: float, most: float, draw: np.random.Generator) -> list[tuple[int, float | None]]:
    """The draws of one source's blocks that make up its target: (block, None), or (block, words) for a part of one.

    The blocks come in one drawn order, again and again while the target has room for all of them. Of the last pass
    those are drawn that still fit; of the first that doesn't, a part is drawn, as large as what the others leave.
    """
    order = draw.permutation(len(sizes)).tolist()
    total = sum(sizes)
    if not total:
        return []
    passes = min(int(target // total), int(most))
    queue: list[tuple[int, float | None]] = [(b, None) for _ in range(passes) for b in order]
    room, crossing = target - passes * total, None
    if passes < most:
        for b in order:
            if sizes[b] <= room:
                queue.append((b, None))
                room -= sizes[b]
            elif crossing is None:
                crossing = b
        if crossing is not None:
            queue.append((crossing, room))
    return queue


def _greedy(rest: pd.DataFrame) -> pd.DataFrame:
    """Of a block that is drawn in part, the documents that the part has: in their drawn order while they fit."""
    rest = rest.sort_values(["draw", "doc"], kind="stable")
    room, gets = float(rest["room"].iloc[0]), []
    smallest_miss = None
    for k, size in enumerate(rest["size"].tolist()):
        fits = size <= room
        gets.append(int(fits))
        room -= size if fits else 0
        if not fits and (smallest_miss is None or size < smallest_miss[0]):
            smallest_miss = (size, k)
    if smallest_miss and smallest_miss[0] - room < room:  # nearer to the target with it than without
        gets[smallest_miss[1]] = 1
    return pd.DataFrame({"row": rest["row"], "more": gets})


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_blocks: int = 1 << 20) -> DataFrame:
    """For each row of docs: doc_id, size, source_size, target, taken, passes, shards and position.

    size counts words (null text: none). Sources go by code point, null last; weights 5, 2, 1 repeat over them.
    Documents are taken whole, so that taken is size times passes, and passes is at most 2; shards has an output shard
    for each pass. Rows that repeat an id are rows of their own; ties of the draw go by id. A source without words has
    target 0. Empty tables give empty results.

    A source's documents are dealt by a hash into blocks (of block_docs at most on average, until most_blocks). Its
    quota is the number of block draws that make up its target (block_queue). The splitting tree deals the quotas of
    all sources to output shards; a shard takes the next draws of each source's queue, as many as the tree gave it, so
    that no two shards share one. What a document is taken is the number of its block's draws; of the one block that is
    drawn in part, the documents are chosen in their drawn order. A shard's documents come in the order of position, a
    hash, which shuffles them locally. The driver gets sizes of sources and blocks only.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    rows = written(rows.withColumn("draw", F.xxhash64("doc", "source", "size", F.lit(seed))).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    sources.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    blocks_of = [max(1, min(4 * shards, r["docs"] // 8), min(r["docs"] // block_docs, most_blocks // len(sources))) for r in sources]
    wanted = targets([r["size"] for r in sources])
    planned = spark.createDataFrame([(r["source"], k, blocks_of[k], r["size"], float(wanted[k])) for k, r in enumerate(sources)], "source string, source_no int, n_blocks int, source_size long, target double")
    # The plan has a row for each source; Spark broadcasts it only below its own size limit.
    dealt = rows.join(planned, rows["source"].eqNullSafe(planned["source"])).drop("source").withColumn("block", F.pmod(F.shiftright("draw", 8), F.col("n_blocks")).cast("int"))
    have = {(r["source_no"], r["block"]): r["size"] for r in dealt.groupBy("source_no", "block").agg(F.sum("size").alias("size")).collect()}
    queues = [block_queue([have.get((k, b), 0) for b in range(blocks_of[k])], wanted[k], MOST, np.random.default_rng([seed, k])) for k in range(len(sources))]
    deal = np.cumsum(split_quotas(np.array([len(q) for q in queues], np.int64), shards, seed), axis=0)
    drawn: dict[tuple[int, int], tuple[list[int], float | None, int | None]] = {}
    for k, queue in enumerate(queues):
        shard_of = np.searchsorted(deal[:, k], np.arange(len(queue)), side="right").tolist()
        for (block, part), shard in zip(queue, shard_of, strict=True):
            whole, room, partly = drawn.get((k, block), ([], None, None))
            drawn[k, block] = (whole, part, shard) if part is not None else ([*whole, shard], room, partly)
    blocks = spark.createDataFrame([(k, b, whole, room, partly) for (k, b), (whole, room, partly) in drawn.items()], "source_no int, block int, whole array<int>, room double, partly int")
    chosen = dealt.join(blocks, ["source_no", "block"], "left")
    crossing = chosen.where("room is not null").select("row", "doc", "draw", "size", "room", "source_no").groupBy("source_no").applyInPandas(_greedy, "row long, more int")
    final = chosen.join(crossing, "row", "left").withColumn("shards", F.concat(F.coalesce("whole", F.array().cast("array<int>")), F.when(F.col("more") > 0, F.array("partly")).otherwise(F.array().cast("array<int>"))))
    return final.select(
        F.col("doc").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("shards")).alias("taken"),
        F.size("shards").alias("passes"),
        "shards",
        F.xxhash64("draw", F.lit(seed + 1)).alias("position"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """docs as the mix has them: each document as often as it is taken; the columns stay, whatever their names.

    Rows that share an id are taken as often as the most taken of them. Null texts and ids, ties, very long texts and
    empty tables are as mix() has them; documents without words can be taken, too.
    """
    decided = mix(docs, id_col=id_col, **options).groupBy("doc_id").agg(F.max("passes").alias("passes")).where("passes > 0").select(F.struct("doc_id", "passes").alias("m"))
    # Structs keep the names apart from any that docs has.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    repeated = own.join(decided, F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("m.doc_id"))).select("d", F.explode(F.sequence(F.lit(1), F.col("m.passes"))).alias("copy"))
    return repeated.select("d.*")
