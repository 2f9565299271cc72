"""Best-fit packing of tokenised documents by bin completion with branch and bound."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissuelake.llm.common import no_threads, ranges, remembered, trimmed, written

#: Pieces of the last bins that are searched together where a plan needs more than the least number of bins, and the
#: nodes of such a search. It only ever improves a whole plan, which stands when the nodes are used up.
TAIL, NODES = 60, 20_000
#: Pieces of one length that are numbered together, at most on average.
PART_PIECES = 1_000_000
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 600_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECES}, sequence_id long, offset long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of whole texts from ids of their words.

    The tokenizer lower-cases, normalises and splits without looking across an ASCII white-space character, so that a
    text's ids are its words' ids in order; nor does it look across the place between a letter and punctuation that
    ends the word, so that "word," has the ids of "word" and of ",". Words met before come from a bounded memory.
    Texts that hold the content of an added token, in any case, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        no_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 20, np.uint32), 0
        self.at, self.size = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)

    def add(self, words: list[str], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        n, total = len(self.known), self.used + len(flat)
        while total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while n + len(words) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.size))
        self.pool[self.used : total] = flat
        self.at[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(words)] = sizes
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.used = total

    def numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places in the memory of each word without punctuation that ends it, and of that punctuation."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        known = self.known
        stems, tails = [], []
        for w in words:
            if w not in known:
                stem = w.rstrip(".,;:!?%*#&$")
                if stem and len(stem) < len(w) and stem[-1].isalpha():
                    stems.append(stem)
                    tails.append(w[len(stem) :])
                    continue
            stems.append(w)
            tails.append("")
        wanted = [w for w in dict.fromkeys(chain(stems, tails)) if w not in known]
        for k in range(0, len(wanted), 20_000):
            some = wanted[k : k + 20_000]
            self.add(some, [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)])
        return tuple(np.fromiter(map(known.__getitem__, x), np.int64, len(x)) for x in (stems, tails))

    def texts(self, texts: pa.Array, step: int = 250) -> Iterator[np.ndarray]:
        """The ids of each text; words are looked up for all texts at once, ids gathered for some at a time."""
        lower = pc.ascii_lower(pc.fill_null(texts, ""))
        whole: dict[int, np.ndarray] = {}
        for content in self.added:
            for k in pc.indices_nonzero(pc.match_substring(lower, content)).to_pylist():
                if k not in whole:
                    whole[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
        if whole:
            some = np.zeros(len(texts), bool)
            some[list(whole)] = True
            lower = pc.if_else(pa.array(some), pa.scalar("", lower.type), lower)
        words = pc.ascii_split_whitespace(lower)
        flat = words.flatten().dictionary_encode()
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        stems, tails = self.numbers(flat.dictionary.to_pylist())
        size = self.size[stems] + self.size[tails]
        indices = flat.indices.to_numpy(zero_copy_only=False)
        for first in range(0, len(texts), step):
            own = ends[first : first + step]
            begin = ends[first - 1] if first else 0
            at = indices[begin : own[-1]]
            both = np.stack([stems[at], tails[at]], axis=1).ravel()
            ids = self.pool[ranges(self.at[both], self.size[both])]
            stops = np.concatenate([[0], np.cumsum(size[at])])[own - begin].tolist()
            for k, (start, stop) in enumerate(zip([0, *stops], stops, strict=False), first):
                yield whole.get(k, ids[start:stop])


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, whose memory serves all its tasks."""
    return remembered(("tokenizer", path), lambda: WordTokenizer(path))


def token_pieces(docs: DataFrame, capacity: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of at most capacity tokens; id 0 ends a document."""
    path = path or vocabulary_path()

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 3000):
                batch = whole.slice(at, 3000)
                rows: list[tuple] = []
                for doc, ids in zip(batch["doc"].to_pylist(), tokenizer.texts(batch["text"]), strict=True):
                    own, n = np.append(ids, np.uint32(0)).astype("<u4"), len(ids)
                    rows.extend((doc, k, s, min(capacity, n + 1 - s), zlib.crc32(own[s : s + capacity].tobytes())) for k, s in enumerate(range(0, n + 1, capacity)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(cut, _PIECES)


def reachable(room: int, lengths: list[int], left: dict[int, int]) -> list[int]:
    """For each k the sums up to room that pieces of the first k lengths can make, as the bits of a number."""
    found, bits, mask = [1], 1, (2 << room) - 1
    for x in lengths:
        n, step = min(left[x], room // x), 1
        while n:
            bits |= bits << x * min(step, n) & mask
            n -= min(step, n)
            step *= 2
        found.append(bits)
    return found


def best_filling(room: int, lengths: list[int], left: dict[int, int]) -> list[int]:
    """The lengths that fill room with least waste, largest first.

    A depth-first search over fillings in descending order, which meets dominating ones (a larger piece in place of
    smaller ones) first. Its bound is exact: the sums that smaller pieces can still make. A branch that can't reach the
    least waste is never entered, so that the search neither backtracks nor needs a limit.
    """
    upto = bisect_right(lengths, room)
    sums = reachable(room, lengths[:upto], left)
    want, taken = sums[-1].bit_length() - 1, []
    for k in range(upto - 1, -1, -1):
        x = lengths[k]
        n = min(left[x], want // x)
        while not sums[k] >> (want - n * x) & 1:
            n -= 1
        taken += [x] * n
        want -= n * x
        if not want:
            break
    return taken


def fillings(room: int, lengths: list[int], left: dict[int, int], waste: int) -> Iterator[list[int]]:
    """All undominated fillings of room that waste that much at most, the least waste first.

    One is dominated, and left out, if a piece that it leaves could take the place of a smaller one of its own.
    """
    upto = bisect_right(lengths, room)
    sums = reachable(room, lengths[:upto], left)

    def descend(k: int, want: int, taken: list[int]) -> Iterator[list[int]]:
        if not want:
            yield taken
            return
        x = lengths[k]
        for n in range(min(left[x], want // x), -1, -1):
            if sums[k] >> (want - n * x) & 1:
                yield from descend(k - 1, want - n * x, taken + [x] * n)

    for lost in range(min(waste, room) + 1):
        if sums[-1] >> (room - lost) & 1:
            for taken in descend(upto - 1, room - lost, []):
                used = Counter(taken)
                spare = [y for y in lengths[:upto] if left[y] > used[y]]
                if not any(0 < y - x <= lost for x in used for y in spare):
                    yield taken


def search_bins(counts: dict[int, int], capacity: int, bins: int, nodes: int = NODES) -> list[list[int]] | None:
    """Fillings of that many bins for all pieces, or None: bin completion, branching over undominated fillings.

    Each bin is completed around the largest piece left. The waste that the goal allows is shared by all bins, which
    prunes fillings and whole branches; states that failed before aren't tried again.
    """
    failed: set[tuple] = set()
    budget = nodes

    def complete(left: dict[int, int], rest: int, spare: int) -> list[list[int]] | None:
        nonlocal budget
        lengths = sorted(x for x, n in left.items() if n)
        if not lengths:
            return []
        key = tuple((x, left[x]) for x in lengths)
        if not rest or (key, rest) in failed:
            return None
        largest = lengths[-1]
        others = left | {largest: left[largest] - 1}
        for own in fillings(capacity - largest, [x for x in lengths if others[x]], others, spare):
            budget -= 1
            if budget < 0:
                return None
            after = dict(others)
            for x in own:
                after[x] -= 1
            found = complete(after, rest - 1, spare - (capacity - largest - sum(own)))
            if found is not None:
                return [[largest, *own], *found]
        if budget >= 0:
            failed.add((key, rest))
        return None

    spare = bins * capacity - sum(x * n for x, n in counts.items())
    return complete(dict(counts), bins, spare) if spare >= 0 else None


Runs = dict[int, list[tuple[int, int, int, int]]]


def best_fit(room: int, lengths: list[int], left: dict[int, int]) -> list[int]:
    """The largest length that fits, again and again."""
    filling: list[int] = []
    k = bisect_right(lengths, room) - 1
    while k >= 0:
        x = lengths[k]
        n = min(left[x], room // x)
        filling += [x] * n
        room -= n * x
        k = min(k - 1, bisect_right(lengths, room) - 1)
    return filling


Steps = list[tuple[list[int], int]]


def _planned(counts: dict[int, int], capacity: int, fill: Callable[[int, list[int], dict[int, int]], list[int]]) -> Steps:
    """Fillings and how often each is made: around the largest length left, as often as the counts allow."""
    left = {x: n for x, n in counts.items() if n}
    lengths, steps = sorted(left), []
    while lengths:
        largest = lengths[-1]
        left[largest] -= 1
        filling = [largest, *fill(capacity - largest, lengths if left[largest] else lengths[:-1], left)]
        left[largest] += 1
        need = Counter(filling)
        times = min(left[x] // n for x, n in need.items())
        steps.append((filling, times))
        for x, n in need.items():
            left[x] -= times * n
            if not left[x]:
                lengths.pop(bisect_right(lengths, x) - 1)
    return steps


def _bins(steps: Steps) -> int:
    return sum(times for _, times in steps)


def _improved(steps: Steps, capacity: int, least: int) -> Steps:
    """The plan with its last bins searched for a way to need fewer."""
    while _bins(steps) > least:
        tail, pieces, at = [], 0, len(steps)
        while at and pieces + len(steps[at - 1][0]) * steps[at - 1][1] <= TAIL:
            at -= 1
            tail.append(steps[at])
            pieces += len(steps[at][0]) * steps[at][1]
        counts: Counter[int] = Counter()
        for filling, times in tail:
            for x in filling:
                counts[x] += times
        found = search_bins(counts, capacity, _bins(tail) - 1) if tail else None
        if found is None:
            return steps
        steps = steps[:at] + [(own, 1) for own in found]
    return steps


def plan(counts: dict[int, int], capacity: int) -> tuple[Runs, int]:
    """Runs (first rank, how many, first sequence, offset) for each length, and the number of sequences.

    The plan works on counts of lengths alone, of which there are at most capacity. Best fit is the incumbent of the
    whole plan: it stands unless bin completion needs fewer sequences. A plan that needs more than the sum of lengths
    does is searched again in its last bins.
    """
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    steps = _planned(counts, capacity, best_filling)
    if _bins(steps) > least:
        incumbent = _planned(counts, capacity, best_fit)
        steps = min(_improved(steps, capacity, least), _improved(incumbent, capacity, least), key=_bins)
    runs: Runs = {x: [] for x, n in counts.items() if n}
    used, sequence = dict.fromkeys(runs, 0), 0
    for filling, times in steps:
        offset = 0
        for x in filling:
            runs[x].append((used[x], times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return runs, sequence


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty; an empty document is its end id alone. Rows that repeat an id are packed each. Ties (pieces
    of one length) are dealt by id. Other columns don't matter. An empty table gives an empty result.

    Texts are tokenised once into a written table of pieces without their ids. What the driver gets are the numbers
    of pieces by length (at most capacity) and by part, of which a length has one for each PART_PIECES. Pieces take
    their place by their rank within their length, which parts keep from meeting in one task.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, capacity, path, id_col, text_col), "pieces")
    by_length = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    many = {x: -(-n // PART_PIECES) for x, n in by_length.items() if n > PART_PIECES}
    parts = F.lit(1)
    for x, n in sorted(many.items()):
        parts = F.when(F.col("length") == x, n).otherwise(parts)
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), parts.cast("long")).cast("int"))
    sizes = sorted((r["length"], r["part"], r["count"]) for r in parted.groupBy("length", "part").count().collect())
    stride = max(many.values(), default=1)
    counts: dict[int, int] = {}
    before: list[tuple[int, int, int]] = []
    for length, k, n in sizes:
        before.append((length, k, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    runs, _ = plan(counts, capacity)
    table = np.array(sorted((x, *run) for x, own in runs.items() for run in own), np.int64).reshape(-1, 5)
    offsets = np.array(before, np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast((table, offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, offsets = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch["length"].to_numpy()
            start = offsets[np.searchsorted(offsets[:, 0] * stride + offsets[:, 1], length * stride + batch["part"].to_numpy()), 2]
            rank = start + batch["nth"].to_numpy()
            row = table[np.searchsorted(table[:, 0] << 40 | table[:, 1], length << 40 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    return parted.withColumn("nth", F.row_number().over(within).cast("long") - 1).mapInArrow(place, _PLACED)
