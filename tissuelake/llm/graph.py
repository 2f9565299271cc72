"""Connected components over distributed links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuelake.llm.common import trimmed, written

#: Links that one local contraction holds.
LOCAL_LINKS = 1 << 20
#: A node of more links is a hub, or of more than make this many hubs possible: these are broadcast.
HUB_LINKS, HUBS = 1000, 200_000


@trimmed
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the links seen: each node but a root with its tree's smallest node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def stars() -> Iterator[pa.RecordBatch]:
        if up:
            a = np.fromiter(up, np.int64, len(up))
            b = np.fromiter((root(x) for x in list(up)), np.int64, len(up))
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    for batch in batches:
        for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > LOCAL_LINKS:
            yield from stars()
            up.clear()
    yield from stars()


def _beside_least(links: DataFrame, n_links: int, least: Column) -> DataFrame:
    """links(a, b) with m, the least of all b of a by the given aggregate.

    Least ones are found by sums in the tasks before the shuffle. Links of a hub stay in their tasks, beside a broadcast
    of the hubs, of which n_links allow HUBS at most; all others meet their m in a join whose keys have few links.
    """
    own = links.groupBy("a").agg(least.alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > max(HUB_LINKS, n_links // HUBS)
    hubs = F.broadcast(own.where(hub).select("a", "m"))
    others = links.join(hubs.select("a"), "a", "left_anti").join(own.where(~hub).select("a", "m"), "a")
    return links.join(hubs, "a").unionByName(others)


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of each node of links(a, b) that is not a component's smallest.

    Each task first contracts its own links to a forest. Then large stars and small stars alternate until every link
    leads to a component's smallest node, each star written to the shared folder. No task needs a hub's links together.
    """
    edges = written(links.select("a", "b").mapInArrow(_contract, "a long, b long"), "links")
    before = None
    while True:
        size = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == before or not size[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = size
        # Large star: every larger neighbour of a node goes to the node's smallest.
        both = edges.union(edges.select("b", "a"))
        starred = _beside_least(both, 2 * size[0], F.least(F.min("b"), F.col("a"))).where("b > a")
        large = written(starred.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        # Small star: a node and its smaller neighbours go to the smallest of these.
        small = _beside_least(large, large.count(), F.min("b")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("x"))
        edges = written(small.select("x.a", F.col("x.m").alias("b")).where("a <> b").distinct(), "links")
