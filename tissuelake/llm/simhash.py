"""SimHash near-duplicates with a generalised-pigeonhole search in Hamming space."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuelake.llm.common import forget, mix, string_bytes, trimmed, word_hashes, written
from tissuelake.llm.graph import components

BITS = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The same for arrays of bytes, with one space for all white space.
_FOLD = np.frombuffer(bytes(32 if c in b" \t\n\x0b\x0c\r" else _LOWER[c] for c in range(256)), np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Cost of dealing one probe, in units of verifying one candidate.
PROBE_COST = 60.0
#: Points that the probes of near copies are chosen for at least, so that a point's probes don't depend on smaller tables'
#: sizes. Beyond it the choice weighs probes against the candidates of a table of that size.
DESIGN_POINTS = 1 << 20
#: Counters of how many texts have a shingle, by bits of its hash, and how many of them make up a part.
COUNTERS, COUNTER_PART = 1 << 20, 1 << 10
#: Longs of a set's bitmap, whose bits are the parities of how many shingles fall on them.
BITMAP = 8
#: Points of candidate pairs up to which they are broadcast to find their texts.
BROADCAST_POINTS = 1 << 20
#: Points of one group with one token from which they are heavy: others look them up by their group.
HEAVY = 64


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle of a text, repeats included; of the whole text if it has fewer words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    return np.array([xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if set in over half of the hashes; none give zero. As a signed long."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc and fp of each row."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [fingerprint(shingle_hashes(t.as_py(), k)) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(found, pa.int64())], names=["doc", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc long, fp long")


def bit_counts(points: DataFrame) -> tuple[int, np.ndarray]:
    """How many points there are, and how many have both bits i and j, from sums over all points."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            n += len(bits)
            both += bits.T @ bits
        flat = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "n"])

    rows = points.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of the bits, correlated ones together: each part grows by the bit most correlated with it."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    rho = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    free, parts = set(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, parts))) // (m - k)
        rest = sorted(free)
        part = [max(rest, key=lambda b: (rho[b, rest].sum(), -b))]
        free.discard(part[0])
        while len(part) < size:
            b = max(sorted(free), key=lambda b: (rho[b, part].sum(), -b))
            part.append(b)
            free.discard(b)
        parts.append(sorted(part))
    return parts


def nearness(n: int, both: np.ndarray, part: list[int], radius: int) -> np.ndarray:
    """Estimated chance that two points differ in at most t bits of a part, for t up to radius.

    Mean and variance of the distance follow from how often pairs of bits are set together among all points; a
    beta-binomial distribution with these gives the chances.
    """
    q = both[np.ix_(part, part)] / n
    p = np.diag(q)
    one = 2 * p * (1 - p)
    p10 = p[:, None] - q
    p01 = p[None, :] - q
    p00 = 1 - q - p10 - p01
    joint = 2 * (q * p00 + p10 * p01)
    np.fill_diagonal(joint, one)
    w, mean = len(part), max(float(one.sum()), 1e-6)
    var = max(float(joint.sum()) - mean * mean, 1e-6)
    mu = min(mean / w, 1 - 1e-9)
    over = (var / (w * mu * (1 - mu)) - 1) / max(w - 1, 1)
    over = min(max(over, 1e-4), 0.99)
    a, b = mu * (1 / over - 1), (1 - mu) * (1 / over - 1)
    from math import exp, lgamma

    beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    mass = [comb(w, t) * exp(beta(t + a, w - t + b) - beta(a, b)) for t in range(min(radius, w) + 1)]
    return np.minimum(1, np.cumsum(mass))


def allocate(n: int, both: np.ndarray, radius: int, most_parts: int = 8, design: int = 0) -> list[tuple[list[int], int]]:
    """Parts of the bits and a threshold for each, of least estimated cost for n points, or for design if they are fewer.

    Generalised pigeonhole: if two points differ in at most radius bits and the thresholds t (-1 or more) sum to
    radius - m + 1, some part differs in at most its t bits. For each number of parts m, dynamic programming spreads
    the sum of t + 1, which is radius + 1, over the parts. A part at t costs its probes and estimated candidates.
    """
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(2, most_parts + 1):
        parts = correlated_parts(n, both, m)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            near = nearness(n, both, part, radius)
            cost = [0.0]
            for t in range(min(radius, len(part)) + 1):
                probes = sum(comb(len(part), d) for d in range(t + 1))
                cost.append(probes * PROBE_COST + max(near[t], probes / 2.0 ** len(part)) * max(n, design))
            grown: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in table.items():
                for extra in range(min(len(cost), radius + 2 - used)):
                    new = (c + cost[extra], [*ts, extra - 1])
                    if used + extra not in grown or new[0] < grown[used + extra][0]:
                        grown[used + extra] = new
            table = grown
        if radius + 1 in table and (best is None or table[radius + 1][0] < best[0]):
            best = (table[radius + 1][0], list(zip(parts, table[radius + 1][1], strict=True)))
    return best[1]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def near_pairs(points: DataFrame, radius: int, carried: tuple[str, ...] = (), agree: Callable[[Column, Column], Column] | None = None, beyond: int = 0, design: int = 0) -> DataFrame:
    """All pairs a < b of distinct points(fp) that differ in more than beyond and at most radius bits, each once.

    With agree, only pairs for which it holds of the structs of their carried columns. Points meet where their bits of
    a part, some of them flipped on one side, are equal; the join's own condition verifies the distance and takes a
    pair in the first part only that finds it, so that no candidates leave the join.
    """
    n, both = bit_counts(points)
    if n < 2:
        return points.sparkSession.createDataFrame([], "a long, b long")
    parts = [(sum(1 << b for b in part), part, t) for part, t in allocate(n, both, radius, design=design) if t >= 0]
    flips = [[_signed(sum(1 << b for b in some)) for d in range(t + 1) for some in combinations(part, d)] for _, part, t in parts]
    long_of = lambda x: F.lit(x).cast("long")
    own = F.struct(*carried) if carried else F.lit(None).cast("boolean")
    table = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    # Numbers of parts and probes are exploded for each point, and looked up behind that.
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.when(F.col("fp").isNotNull(), n - 1)))
    at = lambda values, k: F.get(table(values), F.col(k))
    masks = [_signed(mask) for mask, _, _ in parts]
    probe_part = [k for k, f in enumerate(flips) for _ in f]
    index = points.select(upto(len(parts)).alias("part"), F.col("fp").alias("b"), own.alias("own_b")).select("part", F.col("b").bitwiseAND(at(masks, "part")).alias("key"), "b", "own_b")
    probes = points.select(upto(len(probe_part)).alias("probe"), F.col("fp").alias("a"), own.alias("own_a")).select(at(probe_part, "probe").cast("int").alias("part"), F.col("a").bitwiseAND(at([masks[k] for k in probe_part], "probe")).bitwiseXOR(at([x for f in flips for x in f], "probe")).alias("key"), "a", "own_a")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.lit(True)
    for k in range(1, len(parts)):
        missed = F.lit(True)
        for mask, _, t in parts[:k]:
            missed = missed & (F.bit_count(apart.bitwiseAND(long_of(_signed(mask)))) > t)
        earlier = earlier & ((F.col("p.part") != k) | missed)
    condition = (F.col("p.part") == F.col("i.part")) & (F.col("p.key") == F.col("i.key")) & (F.col("a") < F.col("b")) & F.bit_count(apart).between(beyond + 1, radius) & earlier
    if agree is not None:
        condition = condition & agree(F.col("own_a"), F.col("own_b"))
    return probes.alias("p").join(index.alias("i"), condition).select("a", "b")


def near_groups(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, fingerprint (16 hex digits) and component_id.

    Words are runs outside ASCII white space of the text with A-Z lower-cased; shingles have k words, repeats
    included; a text of fewer words is one shingle, and one without words (or a null text) has fingerprint zero.
    Fingerprints link at radius or fewer differing bits, equal ones among them; component_id is the smallest
    doc_id reachable, itself included. Null ids link but are never the smallest. Rows that repeat an id are rows of
    their own. Other columns don't matter. An empty table gives an empty result.

    Only distinct fingerprints are searched and linked, so that copies, however many, cost one row.
    """
    prints = written(fingerprints(docs, k, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc").alias("least"))
    linked = components(near_pairs(distinct.select("fp"), radius))
    joined = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("top"))
    tops = joined.groupBy("top").agg(F.min("least").alias("component_id"))
    of = joined.select("fp", "top").join(tops, "top").select("fp", "component_id")
    return prints.join(of, "fp").select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Hashes of the k-word shingles of each text, repeats included, from those of its words: the same for the same words.

    A text of fewer words has one shingle, one without words none.
    """
    data, offsets = string_bytes(texts)
    words, n = word_hashes(_FOLD[data], offsets)
    whole = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        whole = mix(whole * _ODD + words[i : i + len(whole)])
    ends = np.cumsum(n)
    for start, end in zip((ends - n).tolist(), ends.tolist(), strict=True):
        if end - start >= k:
            yield whole[start : end - k + 1]
            continue
        h = np.zeros(min(1, end - start), np.uint64)
        for w in words[start:end]:
            h = mix(h * _ODD + w)
        yield h


def bitmap(shingles: np.ndarray) -> list[int]:
    """A set's bitmap: two sets differ in as many elements at least as their bitmaps in bits."""
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) & (64 * BITMAP - 1), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").tolist()


def can_be_similar(na: Column, nb: Column, a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of these sizes and bitmaps can have the similarity: their sizes and differing bits bound it."""
    differing = sum(F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITMAP))
    return (F.least(na, nb) >= similarity * F.greatest(na, nb) - 1e-9) & (differing <= na + nb - 2 * least_common(na, nb, similarity))


def least_common(na: Column, nb: Column, similarity: float) -> Column:
    """How many elements sets of these sizes have in common at least, if they have the similarity."""
    return F.ceil((na + nb) * (similarity / (1 + similarity)) - 1e-9)


def texts_of(docs: DataFrame, text_col: str) -> DataFrame:
    """point (a hash of the text, null texts as empty ones) and text of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("point"), text.alias("text"))


def described(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc, point (a hash of its text), fp, n (different shingles) and their bitmap of each row.

    Rows with a part hold, behind those of each task, how many of its rows have shingles of each counter of the part.
    """
    names = ["doc", "point", "fp", "n", "bits", "part", "counts"]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts = np.zeros(COUNTERS, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                prints, sets = [], []
                for h in shingle_sets(batch["text"], k):
                    prints.append(fingerprint(h))
                    sets.append(np.unique(h))
                counts += np.bincount(_counter(np.concatenate(sets)), minlength=COUNTERS)
                yield pa.RecordBatch.from_arrays([batch["doc"], batch["point"], pa.array(prints, pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(bitmap, sets)), pa.list_(pa.int64())), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=names)
        held = [(i, np.minimum(part, 2**31 - 1).astype(np.int32).tobytes()) for i, part in enumerate(counts.reshape(-1, COUNTER_PART)) if part.any()]
        if held:
            empty = [pa.nulls(len(held), kind) for kind in (*[pa.int64()] * 3, pa.int32(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([i for i, _ in held], pa.int32()), pa.array([b for _, b in held], pa.binary())], names=names)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("point"), text.alias("text")).mapInArrow(run, "doc long, point long, fp long, n int, bits array<long>, part int, counts binary")


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) & (COUNTERS - 1)


def summed_counts(parts: DataFrame) -> np.ndarray:
    """The counters of all tasks together, from rows of part and counts."""

    def add(frame: object) -> object:
        import pandas as pd

        total = np.zeros(COUNTER_PART, np.int64)
        for b in frame["counts"]:
            total += np.frombuffer(b, np.int32)
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    counts = np.zeros(COUNTERS, np.int32)
    for r in parts.groupBy("part").applyInPandas(add, "part int, counts binary").collect():
        counts[r["part"] * COUNTER_PART : (r["part"] + 1) * COUNTER_PART] = np.frombuffer(r["counts"], np.int32)
    return counts


def prefix_length(n: int, similarity: float) -> int:
    """How many of n ordered shingles are sure to hold one of any similar set's own such first shingles."""
    return n - ceil(similarity * n - 1e-9) + 1


def prefixes(texts: DataFrame, counts: np.ndarray, k: int, similarity: float) -> DataFrame:
    """token, at (its place), point and n (all shingles): the first shingles of each text, rare ones first.

    The order is the same for all texts (by counter, then hash), so that texts of the similarity share one of theirs
    whatever the counters say; these only keep common shingles out. Texts without words have token zero.
    """
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            tokens, points, ns, held = [], [], [], 0
            for point, h in zip(batch["point"].to_pylist(), map(np.unique, shingle_sets(batch["text"], k)), strict=True):
                first = h[np.lexsort((h, shared.value[_counter(h)]))][: prefix_length(len(h), similarity)] if len(h) else np.zeros(1, np.uint64)
                tokens.append(first.view(np.int64))
                points.append(point)
                ns.append(len(h))
                held += len(first)
                if held >= 1 << 17:
                    yield rows(tokens, points, ns)
                    tokens, points, ns, held = [], [], [], 0
            if tokens:
                yield rows(tokens, points, ns)

    def rows(tokens: list[np.ndarray], points: list[int], ns: list[int]) -> pa.RecordBatch:
        lengths = np.array([len(x) for x in tokens])
        at = np.concatenate([np.arange(len(x), dtype=np.int32) for x in tokens])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(at), pa.array(np.repeat(np.array(points, np.int64), lengths)), pa.array(np.repeat(np.array(ns, np.int32), lengths))], names=["token", "at", "point", "n"])

    return texts.select("point", "text").mapInArrow(run, "token long, at int, point long, n int")


def shared_prefixes(texts: DataFrame, counts: np.ndarray, k: int, similarity: float) -> DataFrame:
    """The prefixes' rows whose token several points have."""
    found = written(prefixes(texts, counts, k, similarity), "prefixes")
    several = found.groupBy("token").agg(F.min("point").alias("x"), F.max("point").alias("y")).where("x < y").select("token")
    return written(found.join(several, "token", "left_semi").distinct(), "shared")


def prefix_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """All pairs a < b of points of different tops that can have the similarity, each once.

    shared: shared_prefixes with top and bits, as a written table. A pair shares a token of its prefixes; the numbers of
    shingles, the token's places and the bitmaps bound how many they can have in common. All bounds hold within the
    joins. Points of one top aren't held against each other but for HEAVY of them at a token: where it has more there,
    points of other tops are joined with the top first, and then with its points.
    """
    sides = [shared.select(*(F.col(c).alias(f"{c}_{x}") for c in ("token", "at", "point", "n", "top", "bits"))) for x in "ab"]
    na, nb = F.col("n_a"), F.col("n_b")
    most = F.least("at_a", "at_b") + F.least(na - F.col("at_a"), nb - F.col("at_b"))
    can = (most >= least_common(na, nb, similarity)) & can_be_similar(na, nb, F.col("bits_a"), F.col("bits_b"), similarity)
    heavy = written(shared.groupBy("token", "top").agg(F.count("*").alias("size")).where(F.col("size") > HEAVY).select(F.col("token").alias("token_h"), F.col("top").alias("top_h")), "heavy")
    if not heavy.limit(1).count():
        a, b = sides
        return a.join(b, F.expr("token_a = token_b AND point_a < point_b AND top_a <> top_b") & can).select(F.col("point_a").alias("a"), F.col("point_b").alias("b")).distinct()
    a, b = (side.join(heavy, F.expr(f"token_{x} = token_h AND top_{x} = top_h"), "left_anti") for side, x in zip(sides, "ab", strict=True))
    light = a.join(b, F.expr("token_a = token_b AND point_a < point_b AND top_a <> top_b") & can)
    asked = sides[0].join(heavy, F.expr("token_a = token_h AND top_a <> top_h"))
    held = sides[1].join(heavy, F.expr("token_b = token_h AND top_b = top_h"), "left_semi")
    found = asked.join(held, F.expr("token_a = token_b AND top_h = top_b") & can)
    pair = (F.least("point_a", "point_b").alias("a"), F.greatest("point_a", "point_b").alias("b"))
    return light.select(*pair).unionByName(found.select(*pair)).distinct()


def first_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """Of each token the pairs of its smallest point with one of each other top, if they can be similar: few, and enough
    for most groups to meet."""
    each = shared.groupBy("token", "top").agg(F.min(F.struct("point", "n", "bits")).alias("own"))
    least = each.groupBy(F.col("token").alias("token_")).agg(F.min(F.struct("own", "top")).alias("s"))
    can = can_be_similar(F.col("s.own.n"), F.col("own.n"), F.col("s.own.bits"), F.col("own.bits"), similarity)
    return each.join(least, (F.col("token") == F.col("token_")) & (F.col("top") != F.col("s.top")) & can).select(F.col("s.own.point").alias("a"), F.col("own.point").alias("b")).distinct()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets, as sorted arrays without repeats; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _similar(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs of points whose whole sets of k-word shingles are similar enough."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            sets = zip(*(map(np.unique, shingle_sets(batch[c], k)) for c in ("ta", "tb")), strict=True)
            keep = [jaccard(x, y) >= similarity for x, y in sets]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(pairs, "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("point")).distinct()
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_POINTS else needed
    some = texts.join(needed, "point", "left_semi").groupBy("point").agg(F.first("text").alias("text"))
    left = some.select(F.col("point").alias("a"), F.col("text").alias("ta"))
    right = some.select(F.col("point").alias("b"), F.col("text").alias("tb"))
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "similar")


def similar_groups(docs: DataFrame, k: int = 5, radii: tuple[int, ...] = (4, 6), similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc and component_id (its smallest id) of each row: groups linked by similar sets of k-word shingles.

    Candidates link if the whole shingle sets of their texts have the similarity. The first ones are pairs of
    fingerprints that differ in at most radii[-1] bits, in growing radii, and of texts of one fingerprint with the
    smallest of them. The last ones miss none: all pairs that share one of their first shingles, rare ones first, of
    which a set has enough to meet every similar set. Only pairs that join different groups are looked at, so that
    close groups, which the first rounds link, cost few.
    """
    texts = texts_of(docs, text_col)
    rows = written(described(docs, k, id_col, text_col), "prints")
    prints, counts = rows.where("part IS NULL"), summed_counts(rows.where("part IS NOT NULL"))
    points = written(prints.groupBy("point").agg(F.min("doc").alias("least"), *(F.first(c).alias(c) for c in ("fp", "n", "bits"))), "points")
    # Of each fingerprint, one point stands for the others in the first rounds.
    first = written(points.groupBy("fp").agg(F.min(F.struct("point", "n")).alias("s")).select("fp", "s.*"), "first")
    alike = points.select("fp", F.col("point").alias("b")).join(first.select("fp", F.col("point").alias("a")), "fp").where("a <> b").select("a", "b")
    linked = None

    def agree(a: Column, b: Column) -> Column:
        return (a["top"] != b["top"]) & (F.least(a["n"], b["n"]) >= similarity * F.greatest(a["n"], b["n"]) - 1e-9)

    def topped(rows: DataFrame) -> DataFrame:
        if linked is None:
            return rows.withColumn("top", F.col("point"))
        return rows.join(linked, rows["point"] == linked["node"], "left").drop("node").withColumn("top", F.coalesce("component", "point")).drop("component")

    def joined(candidates: DataFrame) -> DataFrame:
        found = _similar(candidates, texts, k, similarity)
        return components(found if linked is None else found.unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    for beyond, radius in zip((0, *radii), radii):  # nearer pairs were looked at before
        grouped = written(topped(first), "grouped")
        near = near_pairs(grouped, radius, ("n", "top"), agree, beyond, DESIGN_POINTS).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
        near = near.join(first.select(F.col("fp").alias("fa"), F.col("point").alias("a")), "fa").join(first.select(F.col("fp").alias("fb"), F.col("point").alias("b")), "fb").select("a", "b")
        linked = joined(near if linked is not None else near.unionByName(alike))
    shared = shared_prefixes(texts, counts, k, similarity)

    def grouped_prefixes() -> DataFrame:
        return written(shared.join(topped(points.select("point", "bits")), "point"), "topped")

    linked = joined(first_pairs(grouped_prefixes(), similarity))
    linked = joined(prefix_pairs(grouped_prefixes(), similarity))
    grouped = written(topped(points.select("point", "least")), "grouped")
    tops = grouped.groupBy("top").agg(F.min("least").alias("component_id"))
    of = grouped.select("point", "top").join(tops, "top").select("point", "component_id")
    return prints.select("doc", "point").join(of, "point").select("doc", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """docs with the row of smallest id of each group of near copies; the columns stay, whatever their names.

    Null texts are empty ones; texts without words are alike. Rows that share an id stay or go together; null ids are
    never the smallest, and a group of null ids only stays. Texts are compared whole, however long; an empty table stays empty.
    """
    groups = similar_groups(docs, id_col=id_col, text_col=text_col, **options)
    kept = groups.where(F.col("doc").eqNullSafe(F.col("component_id"))).select(F.struct(F.col("doc").alias("id")).alias("k")).distinct()
    # A struct keeps the id apart from any column that docs has.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    return own.join(kept, F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("k.id")), "left_semi").select("d.*")
