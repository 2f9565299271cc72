"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuelake.llm.common import forget, mix, string_bytes, trimmed, word_hashes, written

#: Tokens of a unit (documents counted together; a longer document is a unit of its own), and of all that one
#: counting partition gets.
UNIT_TOKENS, PARTITION_TOKENS = 800_000, 2_000_000
#: Rounds of expectation-maximisation.
ROUNDS = 40
#: Steps of a natural-log ratio by which held-out tokens are summed up.
STEP = 0.25

_END, _BEGIN = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543211)
_SPACE = bytes(32 if c in b" \t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_TABLE = np.frombuffer(_SPACE, np.uint8)

_UNITS = "unit long, docs array<long>, held array<boolean>, sizes array<long>, tokens binary, words binary"
_REQUESTS = "part int, unit long, word_keys binary, word_counts binary, pair_keys binary, pair_counts binary"
_ANSWERS = "part int, unit long, word_counts binary, pair_counts binary, n_tokens long, n_types long"


def squeeze(a: np.ndarray) -> bytes:
    """Unsigned integers as byte planes under Zstandard; unsqueeze() gives them back as 64-bit ones."""
    a = np.ascontiguousarray(a, "<u8")
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + len(a).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unsqueeze(b: bytes) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(b[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


def _deltas(sorted_keys: np.ndarray) -> bytes:
    return squeeze(np.diff(sorted_keys, prepend=np.uint64(0)))


def _sums(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(b), dtype=np.uint64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of some texts (words, then one end), one after the other; how many each text has."""
    words, n = word_hashes(_TABLE[data], offsets)
    sizes = n + 1
    out = np.full(len(words) + len(sizes), _END)
    last = np.zeros(len(out), bool)
    last[np.cumsum(sizes) - 1] = True
    out[~last] = words
    return out, sizes


class Unit:
    """Some documents' tokens as numbers into the unit's sorted words, and its pairs of words."""

    def __init__(self, docs: list, held: list, sizes: np.ndarray, ids: np.ndarray, words: np.ndarray):
        self.docs, self.held, self.sizes, self.ids, self.words = docs, np.asarray(held, bool), sizes, ids, words
        before = np.empty(len(ids), np.uint64)
        before[1:] = words[ids[:-1]]
        before[np.cumsum(sizes) - sizes] = _BEGIN
        with np.errstate(over="ignore"):
            keys = mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + words[ids])
        self.pairs, self.pair_ids = np.unique(keys, return_inverse=True)
        self.train = np.repeat(~self.held, sizes)

    @classmethod
    def of(cls, docs: list, held: list, sizes: np.ndarray, hashes: np.ndarray) -> Unit:
        words, ids = np.unique(hashes, return_inverse=True)
        return cls(docs, held, sizes, ids, words)

    @classmethod
    def read(cls, batch: pa.RecordBatch, row: int) -> Unit:
        at = lambda c: batch[c][row].as_py()
        return cls(at("docs"), at("held"), np.array(at("sizes"), np.int64), unsqueeze(at("tokens")).astype(np.int64), _sums(at("words")))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often training documents have each word and each pair."""
        return np.bincount(self.ids[self.train], minlength=len(self.words)), np.bincount(self.pair_ids[self.train], minlength=len(self.pairs))


def units(docs: DataFrame, id_col: str, text_col: str, unit_tokens: int = UNIT_TOKENS) -> DataFrame:
    """Whole documents gathered to units. A unit is numbered when it is written and the same ever after."""

    @trimmed
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list = []
        sizes: list[np.ndarray] = []
        hashes: list[np.ndarray] = []

        def unit() -> pa.RecordBatch:
            u = Unit.of(ids, held, np.concatenate(sizes), np.concatenate(hashes))
            columns = ([ids], [held], [u.sizes.tolist()], [squeeze(u.ids)], [_deltas(u.words)])
            kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["docs", "held", "sizes", "tokens", "words"])

        total = 0
        forget()
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                h, n = tokens(*string_bytes(batch["text"]))
                ids += batch["doc"].to_pylist()
                held += batch["held"].to_pylist()
                sizes.append(n)
                hashes.append(h)
                total += len(h)
                if total >= unit_tokens:
                    yield unit()
                    ids, held, sizes, hashes, total = [], [], [], [], 0
        if total:
            yield unit()

    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    gathered = rows.mapInArrow(gather, _UNITS.partition(", ")[2]).select(F.monotonically_increasing_id().alias("unit"), "*")
    return written(gathered, "lm-units")


def leading(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def counted(all_units: DataFrame, bits: int) -> DataFrame:
    """Training counts of each unit's words and pairs, summed over all units: rows of part and unit.

    A unit asks the partition of a key's leading bits once for each different word and pair, with its own count;
    keys are sorted, so that a partition's are one run, sent as packed differences. Partitions are even however
    frequent a word is, and as many as the input needs for each to stay small.
    """

    @trimmed
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                u = Unit.read(batch, row)
                word_counts, pair_counts = u.counts()
                w, p = (leading(keys, bits) for keys in (u.words, u.pairs))
                parts = np.unique(np.concatenate([w, p]))
                bounds = (np.searchsorted(x, parts, side=side).tolist() for x in (w, p) for side in ("left", "right"))
                rows = []
                for part, a, b, c, d in zip(parts.tolist(), *bounds, strict=True):
                    least = np.uint64(part << (64 - bits)) if bits else np.uint64(0)
                    rows.append((part, batch["unit"][row].as_py(), _deltas(u.words[a:b] - least), squeeze(word_counts[a:b]), _deltas(u.pairs[c:d] - least), squeeze(pair_counts[c:d])))
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "unit", "word_keys", "word_counts", "pair_keys", "pair_counts"])

    def answer(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        out: list[list[bytes]] = []
        totals = (0, 0)
        for kind in ("word", "pair"):
            keys = [_sums(b) for b in rows[f"{kind}_keys"].to_pylist()]
            own = np.concatenate([unsqueeze(b) for b in rows[f"{kind}_counts"].to_pylist()])
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(at, own.astype(float), len(found)).astype(np.uint64)
            if kind == "word":
                totals = (int(own.sum()), int((sums > 0).sum()))
            ends = np.cumsum(list(map(len, keys)))
            out.append([squeeze(sums[at[e - len(k) : e]]) for k, e in zip(keys, ends.tolist(), strict=True)])
        n = rows.num_rows
        first = [1] + [0] * (n - 1)
        return pa.table([rows["part"], rows["unit"], pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array([totals[0] * x for x in first], pa.int64()), pa.array([totals[1] * x for x in first], pa.int64())], names=["part", "unit", "word_counts", "pair_counts", "n_tokens", "n_types"])

    return written(all_units.mapInArrow(ask, _REQUESTS).groupBy("part").applyInArrow(answer, _ANSWERS), "lm-counts")


def _with_counts(some_units: DataFrame, answers: DataFrame) -> DataFrame:
    by_unit = answers.groupBy(F.col("unit").alias("unit_")).agg(F.array_sort(F.collect_list(F.struct("part", "word_counts", "pair_counts"))).alias("answers"))
    return some_units.join(by_unit, F.expr("unit = unit_")).drop("unit_")


def _counts(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    parts = batch["answers"][row].as_py()
    return tuple(np.concatenate([unsqueeze(p[c]) for p in parts]).astype(np.float64) for c in ("word_counts", "pair_counts"))


def _estimates(u: Unit, words: np.ndarray, pairs: np.ndarray, n: float, starts: float, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its context's count, and the maximum-likelihood bigram and unigram estimates.

    own: each document's counts are taken off first, so that it is held out of the counts that predict it.
    """
    doc = np.repeat(np.arange(len(u.sizes)), u.sizes)
    c, pair = words[u.ids], pairs[u.pair_ids]
    context = np.empty(len(c))
    context[1:] = c[:-1]
    context[np.cumsum(u.sizes) - u.sizes] = starts
    if own:
        def within(ids: np.ndarray, n_ids: int) -> np.ndarray:
            _, at, k = np.unique(doc * n_ids + ids, return_inverse=True, return_counts=True)
            return k[at]

        off = within(u.ids, len(u.words))
        before = np.empty(len(c))
        before[1:] = off[:-1]
        before[np.cumsum(u.sizes) - u.sizes] = 1
        pair, c, context = pair - within(u.pair_ids, len(u.pairs)), c - off, context - before
        n = n - u.sizes[doc]
    with np.errstate(divide="ignore", invalid="ignore"):
        return context, np.where(context > 0, pair / np.maximum(context, 1), 0.0), np.where(np.asarray(n) > 0, c / np.maximum(n, 1), 0.0)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Context frequencies by powers of two; 0 for contexts that training documents don't have."""
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def held_out_sums(rows: DataFrame, n: float, v: float, starts: float) -> list[tuple[int, int, int, int]]:
    """(bucket, bigram ratio, unigram ratio, tokens) of held-out tokens; ratios to the uniform estimate in log steps."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                u = Unit.read(batch, row)
                context, p2, p1 = (x[u.train] for x in _estimates(u, *_counts(batch, row), n, starts, True))
                step = lambda p: np.where(p > 0, np.rint(np.log(np.maximum(p, 1e-300) * (v + 1)) / STEP), -1000).astype(np.int64)
                key = (bucket_of(context) * 2048 + step(p2) + 1024) * 2048 + step(p1) + 1024
                keys, k = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(k)], names=["key", "n"])

    sums = rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return [(r["key"] >> 22, (r["key"] >> 11 & 2047) - 1024, (r["key"] & 2047) - 1024, r["n"]) for r in sums]


def learn_weights(sums: list[tuple[int, int, int, int]], rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each of 64 buckets by expectation-maximisation."""
    weights = np.tile([0.4, 0.5, 0.1], (64, 1))
    by: dict[int, list[tuple[int, int, int]]] = {}
    for b, r2, r1, k in sums:
        by.setdefault(min(b, 63), []).append((r2, r1, k))
    for b, rows in by.items():
        r2, r1, k = np.array(rows, float).T
        p = np.stack([np.where(r2 <= -1000, 0, np.exp(r2 * STEP)), np.where(r1 <= -1000, 0, np.exp(r1 * STEP)), np.ones(len(k))], axis=1)
        for _ in range(rounds):
            share = p * weights[b]
            share *= (k / share.sum(1))[:, None]
            new = share.sum(0) + np.array([0.1, 0.5, 0.4])
            weights[b] = new / new.sum()
    unseen = sorted(set(range(64)) - set(by))
    for b in unseen:
        if near := [x for x in by if x < b] or [x for x in by if x > b]:
            weights[b] = weights[max(near) if near[0] < b else min(near)]
    weights[0] = [0.0, *(weights[0, 1:] + weights[0, 0] * weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_tokens: int = UNIT_TOKENS, partition_tokens: int = PARTITION_TOKENS) -> DataFrame:
    """For each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    A null text is empty: its one token is the end. Documents whose CRC-32 of the id as text (a null id: of the empty
    text) leaves 1 by 5 are held out; all others are counted, all their words and pairs. base_score is the add-half
    unigram sum of the contract. score is the log10 probability of the text: each token's is the mixture of its
    maximum-likelihood bigram estimate c(vw)/c(v), unigram estimate c(w)/N and the uniform one 1/(V+1), with weights
    by the frequency c(v) of the word before. A document's first token has a begin mark before it. The weights are
    learned by expectation-maximisation on all training documents, each predicted from counts without its own. Rows that repeat an id are documents of their own. Texts are read
    whole. Other columns don't matter. An empty table gives an empty result; without training documents all tokens
    are unknown.
    """
    spark = docs.sparkSession
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    all_units = units(docs, id_col, text_col, unit_tokens)
    size = all_units.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum(F.size(F.filter("held", lambda h: ~h)))).first()
    if size[0] is None:
        return spark.createDataFrame([], schema)
    bits = min(24, max(0, int(np.ceil(np.log2(max(1, size[0] / partition_tokens))))))
    answers = counted(all_units, bits)
    total = answers.agg(F.sum("n_tokens"), F.sum("n_types")).first()
    n, v, starts = float(total[0]), float(total[1]), float(size[1])
    weights = learn_weights(held_out_sums(_with_counts(all_units, answers), n, v, starts))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                u = Unit.read(batch, row)
                words, pairs = _counts(batch, row)
                context, p2, p1 = _estimates(u, words, pairs, n, starts, False)
                w = weights[np.minimum(bucket_of(context), 63)]
                p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1)
                c = words[u.ids]
                first = np.cumsum(u.sizes) - u.sizes
                add = lambda x: np.add.reduceat(x, first)
                base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
                columns = (pa.array(u.docs, pa.int64()), pa.array(u.held), pa.array(u.sizes), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(u.sizes), int(n))), pa.array(add(base)), pa.array(add(np.log10(p))))
                yield pa.RecordBatch.from_arrays(list(columns), names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _with_counts(all_units, answers).mapInArrow(run, schema)
