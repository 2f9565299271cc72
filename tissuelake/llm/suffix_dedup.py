"""Removal of repeated substrings: prefix doubling over sampled suffixes, by sorted pairs of ranks at growing offsets."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuelake.llm.common import Blocks, bucketed, mix, ranges, string_bytes, trimmed, written
from tissuelake.llm.lm import leading, squeeze, unsqueeze

#: Bytes of a unit of whole documents, of units in one bucket of their table, and suffixes in one ranking partition.
UNIT_BYTES, BUCKET_BYTES, PARTITION_SUFFIXES = 4 << 20, 16 << 20, 1_000_000
#: Bytes hashed at a time, few enough for the arrays to stay in a core's cache.
CHUNK = 1 << 15
#: Bits of a first rank that are sorted; too few only let more suffixes go on to the next round.
FIRST_BITS = 44
_NEVER = np.iinfo(np.int64).max

_UNITS = "docs array<long>, sizes array<long>, data binary"
_ASKED = "part long, unit long, base long, keys binary, more binary, a binary, b binary"


def _pack(keys: np.ndarray, bits: int) -> bytes:
    return squeeze(np.diff(keys >> np.uint64(64 - bits), prepend=np.uint64(0)))


def _flags(mask: np.ndarray) -> bytes:
    return len(mask).to_bytes(8, "little") + pa.compress(np.packbits(mask).tobytes() or b"\0", "zstd", asbytes=True)


def _unflags(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.unpackbits(np.frombuffer(pa.decompress(b[8:], max(1, (n + 7) // 8), "zstd", asbytes=True), np.uint8), count=n).astype(bool)


def _by_key(keys: np.ndarray, *columns: tuple[np.ufunc, np.ndarray], more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray | None]:
    """The different keys in order, each row's place among them, the columns reduced by key, and the keys' second words."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    if more is not None and len(s):
        m = more[order]
        if ((s[1:] == s[:-1]) & (m[1:] != m[:-1])).any():  # the first words alone don't tell them apart
            order = np.lexsort((more, keys))
            s, m = keys[order], more[order]
        apart = (s[1:] != s[:-1]) | (m[1:] != m[:-1])
    else:
        m, apart = more, s[1:] != s[:-1]
    first = np.flatnonzero(np.concatenate([[True], apart])) if len(s) else np.empty(0, np.int64)
    at = np.empty(len(keys), np.int64)
    at[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(s)))
    return s[first], at, [op.reduceat(values[order], first) if len(s) else values[:0] for op, values in columns], None if m is None else m[first]


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The rank of a pair of ranks, named by mixing both."""
    return mix(mix(left + np.uint64(0xA0761D6478BD642F)) * np.uint64(0x9FB21C651E98DF25) + right)


class Unit:
    """Some documents' bytes and their sampled suffixes.

    Of the starts in a window of `length` bytes at which `gram` bytes fit, the one whose bytes hash least is sampled
    (ties: the first). A window's sampled suffix depends on its bytes alone, so that equal windows anywhere have
    equal ones. low and high are the first and last start of the windows that sample a suffix.
    """

    def __init__(self, docs: list[int | None], sizes: list[int], data: np.ndarray, length: int):
        self.docs = np.array([_NEVER if d is None else d for d in docs], np.int64)
        self.raw, self.data, self.length = docs, data, length
        sizes = np.asarray(sizes, np.int64)
        self.ends = np.cumsum(sizes)
        gram = length // 2
        starts, picks, ranks = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        last = -1
        for at in range(0, len(data) - length + 1, CHUNK):
            new, pick, grams = self._picked(data[at : at + CHUNK + length - 1], gram, last - at)
            starts.append(new + at)
            picks.append(pick[new] + at)
            ranks.append(grams[pick[new]])
            last = int(pick[-1]) + at
        starts, picks, ranks = (np.concatenate(x) for x in (starts, picks, ranks))
        # A document's windows start from its first byte to its end less the length; runs are cut there.
        whole = np.flatnonzero(sizes >= length)
        first, final = (self.ends - sizes)[whole], self.ends[whole] - length
        k = np.searchsorted(starts, first, side="right") - 1  # the run that a document's first window is in
        inside = np.searchsorted(first, starts, side="right") - 1
        keep = (inside >= 0) & (starts <= final[np.maximum(inside, 0)]) & (starts != first[np.maximum(inside, 0)]) if len(whole) else np.zeros(len(starts), bool)
        low = np.concatenate([first, starts[keep]])
        order = np.argsort(low, kind="stable")
        self.low = low[order]
        self.at = np.concatenate([picks[k], picks[keep]])[order]
        firsts = np.concatenate([ranks[k], ranks[keep]])[order]
        end = final[np.searchsorted(first, self.low, side="right") - 1] if len(whole) else self.low
        self.high = np.minimum(np.append(self.low[1:], _NEVER)[: len(self.low)] - 1, end)
        self.doc = self.docs[np.searchsorted(self.ends, self.low, side="right")]
        #: Rank of the sampled suffix's first bytes.
        self.first = mix(firsts + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(64 - FIRST_BITS) << np.uint64(64 - FIRST_BITS)

    @staticmethod
    def _picked(data: np.ndarray, gram: int, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of a part whose sampled start is another than the window's before; all sampled starts; hashes."""
        grams = Blocks(data).all(gram)
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        # A part has span - 1 starts more than windows.
        width, span = 1, gram + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: -(span - width)], least[span - width :])
        pick = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return np.flatnonzero(np.concatenate([[pick[0] != before], pick[1:] != pick[:-1]])), pick, grams

    def ranks(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the windows at sorted places, in two words: pairs of the ranks of a window's halves.

        The halves' ranks are hashes, the second word's by another seed; a pair stands at the offset that is left of
        the window behind a half.
        """
        half = -(-self.length // 2)
        words = np.empty((2, len(starts)), np.uint64)
        for at in range(0, len(self.data), CHUNK):
            i, j = np.searchsorted(starts, [at, at + CHUNK]).tolist()
            if j > i:
                part, places = self.data[at : at + CHUNK + self.length], starts[i:j] - at
                for seed in (0, 1):
                    blocks = Blocks(part, seed)
                    words[seed, i:j] = _named(blocks.of(places, half), blocks.of(places + (self.length - half), half))
        return words[0], words[1]

    def whole(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all bytes of the windows that sample these suffixes: pairs of the first and the last window's.

        The pair's offset is at most the sampled part's length, so that the two windows cover all bytes between.
        """
        low, high = self.low[suffixes], self.high[suffixes]
        # Both places in order, each once, as ranks() reads the bytes from front to back.
        places, at = np.unique(np.concatenate([low, high]), return_inverse=True)
        ranks = self.ranks(places)
        shape = ((high - low) << 32 | (self.at[suffixes] - low)).astype(np.uint64)
        n = len(low)
        return tuple(_named(r[at[:n]] + shape, r[at[n:]]) for r in ranks)

    @classmethod
    def read(cls, batch: pa.RecordBatch, row: int, length: int) -> Unit:
        sizes = batch["sizes"][row].as_py()
        data = np.frombuffer(pa.decompress(batch["data"][row].as_py(), max(1, sum(sizes)), "zstd", asbytes=True), np.uint8)[: sum(sizes)]
        return cls(batch["docs"][row].as_py(), sizes, data, length)

    def windows(self, suffixes: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Starts, ranks and documents of all windows that sample these suffixes."""
        n = self.high[suffixes] - self.low[suffixes] + 1
        starts = ranges(self.low[suffixes], n)
        return starts, self.ranks(starts), np.repeat(self.doc[suffixes], n)


def units(docs: DataFrame, id_col: str, text_col: str, unit_bytes: int, bucket_bytes: int) -> DataFrame:
    """Whole documents gathered to units, in a table bucketed by unit, so that joins by unit don't move the texts."""

    @trimmed
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        sizes: list[int] = []
        parts: list[bytes] = []
        total = 0

        def unit() -> pa.RecordBatch:
            data = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([pa.compress(data or b"\0", "zstd", asbytes=True)], pa.binary())], names=["docs", "sizes", "data"])

        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                data, offsets = string_bytes(batch["text"])
                ids += batch["doc"].to_pylist()
                sizes += np.diff(offsets).tolist()
                parts.append(data.tobytes())
                total += len(data)
                if total >= unit_bytes:
                    yield unit()
                    ids, sizes, parts, total = [], [], [], 0
        if ids:
            yield unit()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    gathered = rows.mapInArrow(gather, _UNITS).select(F.monotonically_increasing_id().alias("unit"), "*")
    return bucketed(gathered, f"suffix_units_{uuid.uuid4().hex}", "unit", max(1, min(50_000, -(-size // bucket_bytes)))), size


class Stream(NamedTuple):
    """Sorted keys of a round with key bits, second words (none for a first round's) and two values each."""

    keys: np.ndarray
    bits: int
    more: np.ndarray | None
    a: np.ndarray
    b: np.ndarray | None = None


def _asking(unit: int, base: int, bits: int, streams: list[Stream]) -> Iterator[tuple]:
    """Rows that ask the partitions of some streams' keys by the keys' leading bits."""
    for k, s in enumerate(streams):
        own = leading(s.keys, bits)
        parts = np.unique(own)
        low, high = np.searchsorted(own, parts).tolist(), np.searchsorted(own, parts, side="right").tolist()
        for part, i, j in zip(parts.tolist(), low, high, strict=True):
            least = np.uint64(part << (64 - bits)) if bits else np.uint64(0)
            yield (k << 32) | part, unit, base, _pack(s.keys[i:j] - least, s.bits), squeeze(s.more[i:j]) if s.more is not None else b"", squeeze(s.a[i:j]), squeeze(s.b[i:j]) if s.b is not None else b""


def _answers(asked: DataFrame, kinds: tuple[str, ...], name: str) -> DataFrame:
    """unit_ and a column `name` of (part, flags): Spark brings equal ranks together, which get their answer.

    shared: whether rows of different documents have the rank (a: this unit's do). many: whether suffixes of the
    rank go on differently (a, b: least rank of the whole and what the greatest exceeds it by). least: whether a
    smaller document has the rank elsewhere (a: this unit's smallest less base); its keys have two words.
    """

    def answer(table: pa.Table) -> pa.Table:
        kind = kinds[table["part"][0].as_py() >> 32]
        keys = [np.cumsum(unsqueeze(b), dtype=np.uint64) for b in table["keys"].to_pylist()]
        values = lambda c: np.concatenate([unsqueeze(b) for b in table[c].to_pylist()])
        a = values("a")
        ends = np.cumsum(list(map(len, keys)))
        joined = np.concatenate(keys)
        if kind == "shared":
            _, at, (n, flag), _ = _by_key(joined, (np.add, np.ones(len(joined), np.int64)), (np.maximum, a))
            out = ((n > 1) | (flag > 0))[at]
        elif kind == "many":
            _, at, (low, high), _ = _by_key(joined, (np.minimum, a), (np.maximum, a + values("b")))
            out = (low != high)[at]
        else:
            doc = a.astype(np.int64) + np.repeat(np.array(table["base"].to_pylist(), np.int64), list(map(len, keys)))
            _, at, (least,), _ = _by_key(joined, (np.minimum, doc), more=values("more"))
            out = least[at] < doc
        return pa.table([table["part"], table["unit"], pa.array([_flags(out[e - len(k) : e]) for k, e in zip(keys, ends.tolist(), strict=True)], pa.binary())], names=["part", "unit", "flags"])

    rows = written(asked.groupBy("part").applyInArrow(answer, "part long, unit long, flags binary"), "suffix-ranks")
    return rows.groupBy(F.col("unit").alias("unit_")).agg(F.array_sort(F.collect_list(F.struct("part", "flags"))).alias(name))


def _answered(batch: pa.RecordBatch, row: int, name: str, stream: int) -> np.ndarray:
    parts = [_unflags(x["flags"]) for x in batch[name][row].as_py() or () if x["part"] >> 32 == stream]
    return np.concatenate(parts) if parts else np.empty(0, bool)


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT_BYTES, bucket_bytes: int = BUCKET_BYTES, partition_suffixes: int = PARTITION_SUFFIXES) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    Texts are UTF-8 bytes (null: empty), read whole. Each byte is removed that a string of `length` bytes covers which
    also starts in a document of smaller id; strings are judged on the input. A null id is larger than any other;
    rows of equal ids don't remove each other's strings. Other columns don't matter. An empty table gives an empty
    result.

    Suffixes are sampled by content (see Unit), so that each string of the given length has one, equal for equal
    strings. In each round, units send the ranks of the suffixes still undecided, Spark sorts them together, and
    suffixes that are unique leave. The first rank is of half the length. It doubles to the whole length by pairs of
    ranks half a length apart, and to all bytes that the windows of a suffix cover (up to one and a half lengths) by
    pairs of those, at which most copies are decided at once: all but those of the smallest document go. Where
    suffixes of one first rank go on differently, the last round has the pair of each of their windows. Ranks are
    named by hashes instead of numbered, of 128 bits where they decide. A unit sends each rank once, so that frequent
    passages meet in one row for each unit.
    """
    spark = docs.sparkSession
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    table, size = units(docs, id_col, text_col, unit_bytes, bucket_bytes)
    bits = min(24, max(0, int(np.ceil(np.log2(max(1, size / (length // 4) / partition_suffixes))))))
    asked = [pa.field("part", pa.int64()), pa.field("unit", pa.int64()), pa.field("base", pa.int64()), pa.field("keys", pa.binary()), pa.field("more", pa.binary()), pa.field("a", pa.binary()), pa.field("b", pa.binary())]

    def asker(streams):
        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    u = Unit.read(batch, row, length)
                    base = int(u.docs.min()) if len(u.docs) else 0
                    found = list(_asking(batch["unit"][row].as_py(), base, bits, streams(u, batch, row, base)))
                    for at in range(0, len(found), 256):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[at : at + 256], strict=True), asked, strict=True)], schema=pa.schema(asked))

        return run

    def less(doc: np.ndarray, base: int) -> np.ndarray:
        return (doc - base).astype(np.uint64)

    def first_ranks(u: Unit, batch: pa.RecordBatch, row: int, base: int):
        keys, _, (low, high), _ = _by_key(u.first, (np.minimum, u.doc), (np.maximum, u.doc))
        return [Stream(keys, FIRST_BITS, None, (low != high).astype(np.uint64))]

    def undecided(u: Unit, batch: pa.RecordBatch, row: int) -> np.ndarray:
        """Suffixes whose first rank another document has."""
        _, at, _, _ = _by_key(u.first)
        return np.flatnonzero(_answered(batch, row, "r1", 0)[at]) if len(at) else at

    def whole_ranks(u: Unit, batch: pa.RecordBatch, row: int, base: int):
        some = undecided(u, batch, row)
        rank, second = u.whole(some)
        wholes, _, (least,), more = _by_key(rank, (np.minimum, u.doc[some]), more=second)
        firsts, _, (low, high), _ = _by_key(u.first[some], (np.minimum, rank), (np.maximum, rank))
        return [Stream(wholes, 64, more, less(least, base)), Stream(firsts, FIRST_BITS, None, low, high - low)]

    def decided(u: Unit, batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes whose windows all go, and suffixes whose windows are ranked one by one."""
        some = undecided(u, batch, row)
        if not len(some):
            return some, some
        rank, second = u.whole(some)
        _, at, (least,), _ = _by_key(rank, (np.minimum, u.doc[some]), more=second)
        copy = _answered(batch, row, "r2", 0)[at] | (u.doc[some] > least[at])
        _, at, _, _ = _by_key(u.first[some])
        many = _answered(batch, row, "r2", 1)[at]
        return some[copy], some[~copy & many]

    def window_ranks(u: Unit, batch: pa.RecordBatch, row: int, base: int):
        _, rest = decided(u, batch, row)
        _, (rank, second), doc = u.windows(rest)
        keys, _, (least,), more = _by_key(rank, (np.minimum, doc), more=second)
        return [Stream(keys, 64, more, less(least, base))]

    @trimmed
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                u = Unit.read(batch, row, length)
                gone, rest = decided(u, batch, row)
                starts, (rank, second), doc = u.windows(rest)
                _, at, (least,), _ = _by_key(rank, (np.minimum, doc), more=second)
                copy = (_answered(batch, row, "r3", 0)[at] | (doc > least[at])) if len(at) else np.empty(0, bool)
                cover = np.zeros(len(u.data) + 1, np.int32)
                np.add.at(cover, np.concatenate([u.low[gone], starts[copy]]), 1)
                np.add.at(cover, np.concatenate([u.high[gone] + length, starts[copy] + length]), -1)
                removed = np.cumsum(cover[:-1]) > 0
                rows, begin = [], 0
                for d, end in zip(u.raw, u.ends.tolist(), strict=True):
                    mask = removed[begin:end]
                    spans = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(len(mask) > 0 and bool(mask[0]))
                    rows.append((d, end - begin, int(np.count_nonzero(mask)), spans, hashlib.sha256(u.data[begin:end][~mask].tobytes()).hexdigest()))
                    begin = end
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def joined(frame: DataFrame, answers: DataFrame) -> DataFrame:
        return frame.join(answers, F.expr("unit = unit_"), "left").drop("unit_")

    r1 = _answers(table.mapInArrow(asker(first_ranks), _ASKED), ("shared",), "r1")
    r2 = _answers(joined(table, r1).mapInArrow(asker(whole_ranks), _ASKED), ("least", "many"), "r2")
    both = joined(joined(table, r1), r2)
    r3 = _answers(both.mapInArrow(asker(window_ranks), _ASKED), ("least",), "r3")
    return joined(both, r3).mapInArrow(finish, schema)
