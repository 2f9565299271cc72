"""Exact deduplication with Patricia tries that own partitions of the length and content-hash space."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuelake.llm.common import SPACES, forget, trimmed, written

#: Text bytes that a trie holds before it spills subtrees, and the share of them that it keeps.
TRIE_BYTES, KEPT = 24 << 20, 0.5

_TERMINALS = "n_bytes long, sha binary, norm binary, keep_id long, members long"
_OWNERS = "sha binary, keep_id long, members long"


class PatriciaTrie:
    """A compressed radix trie over byte strings; a terminal holds the smallest identifier and a count."""

    __slots__ = ("held", "root")

    def __init__(self) -> None:
        # A node: [children by first byte, smallest id, rows, payload]; a child: (edge label, node).
        self.root: list = [{}, None, 0, None]
        self.held = 0

    def insert(self, key: bytes, smallest: int | None, rows: int, payload: object = None) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[0].get(key[at])
            if child is None:
                leaf = [{}, None, 0, None]
                node[0][key[at]] = (key[at:], leaf)
                self.held += len(key) - at
                node, at = leaf, len(key)
                break
            label, below = child
            if key.startswith(label, at):
                node, at = below, at + len(label)
                continue
            n = _shared(label, key, at)
            middle = [{label[n]: (label[n:], below)}, None, 0, None]
            node[0][key[at]] = (label[:n], middle)
            node, at = middle, at + n
        if not node[2]:
            node[3] = payload
        node[2] += rows
        if smallest is not None and (node[1] is None or smallest < node[1]):
            node[1] = smallest

    def terminals(self, node: list | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[bytes, int | None, int, object]]:
        """Each string of a subtree (of all) with its smallest identifier, rows and payload."""
        stack: list[tuple[list, tuple[bytes, ...]]] = [(self.root if node is None else node, path)]
        while stack:
            node, path = stack.pop()
            if node[2]:
                yield b"".join(path), node[1], node[2], node[3]
            stack.extend((below, (*path, label)) for label, below in node[0].values())

    def spill(self, most: int) -> Iterator[tuple[bytes, int | None, int, object]]:
        """Take subtrees out, the largest first, until labels of `most` bytes are left; their terminals."""
        # Sizes bottom-up: a node's subtree counts the labels below it.
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(below for _, below in node[0].values())
        size: dict[int, int] = {}
        for node in reversed(order):
            size[id(node)] = sum(len(label) + size[id(below)] for label, below in node[0].values())
        node, path = self.root, ()
        while self.held > most and node[0]:
            byte, (label, below) = max(node[0].items(), key=lambda item: len(item[1][0]) + size[id(item[1][1])])
            whole = len(label) + size[id(below)]
            if self.held - whole < most // 2 and len(below[0]) > 1:
                node, path = below, (*path, label)  # too much to spill at once: a part of it
                continue
            del node[0][byte]
            self.held -= whole
            yield from self.terminals(below, (*path, label))


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of label and key[at:], by bisection over comparisons of slices."""
    low, high = 1, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[:middle] == key[at : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def combined(batches: Iterator[pa.RecordBatch], most: int = TRIE_BYTES) -> Iterator[pa.RecordBatch]:
    """Copies within one input partition meet in a trie, so that a group sends a row for each spill at most."""
    forget()
    trie = PatriciaTrie()
    for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
        for doc, norm, sha in zip(batch["doc"].to_pylist(), batch["norm"].to_pylist(), batch["sha"].to_pylist(), strict=True):
            trie.insert(norm, doc, 1, sha)
            if trie.held > most:
                yield from _terminal_rows(trie.spill(int(KEPT * most)))
    yield from _terminal_rows(trie.terminals())


def _terminal_rows(terminals: Iterator[tuple], step: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for norm, smallest, members, sha in terminals:
        rows.append((len(norm), sha, norm, smallest, members))
        size += len(norm) + 100
        if size > step:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["n_bytes", "sha", "norm", "keep_id", "members"])


def owned(batches: Iterator[pa.RecordBatch], most: int = TRIE_BYTES) -> Iterator[pa.RecordBatch]:
    """The owner of a partition of lengths and hashes: equal strings meet in its trie, or else as rows of its spills."""
    trie = PatriciaTrie()
    for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
        for sha, norm, smallest, members in zip(*(batch[c].to_pylist() for c in ("sha", "norm", "keep_id", "members")), strict=True):
            trie.insert(norm, smallest, members, sha)
            if trie.held > most:
                yield from _owner_rows(trie.spill(int(KEPT * most)))
    yield from _owner_rows(trie.terminals())


def _owner_rows(terminals: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    found = [(sha, smallest, members) for _, smallest, members, sha in terminals]
    if len({x[0] for x in found}) < len(found):
        raise ValueError("two different texts share a SHA-256")
    if found:
        sha, smallest, members = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(smallest, pa.int64()), pa.array(members, pa.int64())], names=["sha", "keep_id", "members"])


_combine, _own = trimmed(combined), trimmed(owned)


def _normal(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space is one space; null counts as empty. Of equal
    texts the row with the smallest id stays. Of rows that repeat both id and text one stays. Null ids are never the
    smallest; a group of null ids only keeps one row, with a null keep_id. Other columns of docs don't matter. An
    empty table gives an empty result.

    Each input partition runs its rows through a Patricia trie, whose terminals (a text, its smallest id, its number
    of rows) are dealt by length and hash to owner partitions. However large a group is, it sends a row for each
    spill of those tries at most. An owner inserts the full byte strings into its trie. A trie over TRIE_BYTES spills
    its largest subtrees as rows and goes on; a text that came again after its subtree was spilled has several rows,
    which add up by hash where they lie. Which of rows that repeat id and text stays is settled by a row number, of
    which each group keeps the least, map-side.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc"), _normal(text_col).alias("norm")).select("doc", "norm", _digest(F.col("norm")).alias("sha"))
    terminals = keyed.select("doc", F.col("norm").cast("binary").alias("norm"), "sha").mapInArrow(_combine, _TERMINALS)
    found = terminals.repartition("n_bytes", "sha").mapInArrow(_own, _OWNERS)
    owners = found.groupBy("sha").agg(F.min("keep_id").alias("keep_id"), F.sum("members").alias("group_size"))
    rows = written(keyed.select("doc", "sha").withColumn("row", F.monotonically_increasing_id()), "digests")
    first = rows.groupBy("sha").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "row"))["row"].alias("keep_row"))
    return rows.join(owners, "sha").join(first, "sha").select(
        F.col("doc").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups() drops; the columns stay, whatever their names.

    Null texts are empty ones. Of rows that repeat both id and text one stays; null ids never win over others. Very
    long texts are compared whole, and an empty table stays empty.
    """
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.struct(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha")).alias("k"))
    # Structs keep the names apart from any that docs has.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.struct(F.col(id_col).cast("long").alias("id"), _digest(_normal(text_col)).alias("sha")).alias("k"))
    stay = own.join(kept, own["k.id"].eqNullSafe(kept["k.id"]) & (own["k.sha"] == kept["k.sha"]), "left_semi")
    repeated = own.groupBy("k").count().where("count > 1").limit(1).count()
    return (stay.dropDuplicates(["k"]) if repeated else stay).select("d.*")
