"""The operators on documents against brute-force versions, over a small table with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tissuelake.llm import exact_dedup, langid, license_scan, lm, mixing, packing, simhash, suffix_dedup

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, fp string, size string, unit int, row int, part int, score string"
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def odd_rows() -> list[tuple]:
    long_text = " ".join(f"word{i % 977} the and" for i in range(9000))
    texts = [None, "", " \t\n ", "the", "the", "The  the\tthe", "a\x1cb\x85c d", "ünïcödé wörds hier und da, ñandú ça", long_text, long_text + " x", "x" * 60_000, "!!! 123 ###", "all rights reserved cc by cc by general public license", "<|endoftext|> 's 't don't", "hello <|endoftext|> world", "a<|ENDOFTEXT|>b <|StartOfText|>c<|startoftext|>d", "<|endoftext|>" * 3, "same text of five words here", "same text of five words here"]
    rows = [(9000 + i, t, "en" if i % 2 else None, None if i % 3 else "", None) for i, t in enumerate(texts)]
    rows += [(9014, "same text of five words here", "en", "src1", 1)] * 2  # repeats id and text
    rows += [(None, "the", None, None, None), (None, "only null ids say this sentence here today", "de", "z", 3), (9030, "KK İ ß Σ", "xx", "\U0001f600", 1)]
    return [(*r, 7, "clash", "clash", 1, 2, 3, "clash") for r in rows]


@pytest.fixture(scope="module")
def docs(spark, data):
    some = spark.read.parquet(f"{data}/documents.parquet").limit(120).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 7, "clash", "clash", 1, 2, 3, "clash") for r in some] + odd_rows()
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ident(d):
    return math.inf if d is None else d


def test_empty_tables(empty, spark):
    for found in (exact_dedup.exact_groups(empty), langid.identify(empty), license_scan.scan(empty), lm.score(empty), mixing.mix(empty), packing.pack(empty), simhash.near_groups(empty), suffix_dedup.remove_repeats(empty)):
        assert found.collect() == []
    for found in (exact_dedup.drop_exact_copies(empty), langid.identified_documents(empty), simhash.drop_near_copies(empty), mixing.mixed_documents(empty)):
        assert found.collect() == [] and found.columns == empty.columns


def test_exact_groups(docs, rows):
    norm = lambda t: re.sub(SPACE, " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    want = Counter()
    for t, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = min(real) if real else None
        for k, i in enumerate(ids):
            kept = i == keep and ids[:k].count(i) == 0
            want[(i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest())] += 1
    found = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect())
    assert found == want


def test_drop_exact_copies_keeps_one_of_each(docs, rows):
    left = exact_dedup.drop_exact_copies(docs).collect()
    texts = [re.sub(SPACE, " ", r.text or "") for r in left]
    assert set(texts) >= {re.sub(SPACE, " ", r.text or "") for r in rows if r.doc_id is not None}
    assert len(set(texts)) == len(texts)


def test_patricia_trie_matches_a_dictionary():
    draw = np.random.default_rng(3)
    trie, want = exact_dedup.PatriciaTrie(), {}
    for i in range(3000):
        key = bytes(draw.integers(97, 100, draw.integers(0, 9)).astype(np.uint8))
        trie.insert(key, i, 1)
        low, n = want.get(key, (i, 0))
        want[key] = (min(low, i), n + 1)
    assert {k: (a, n) for k, a, n, _ in trie.terminals()} == want


def test_tries_spill_by_subtree():
    draw = np.random.default_rng(4)
    trie, want, out = exact_dedup.PatriciaTrie(), Counter(), []
    for i in range(4000):
        key = bytes(draw.integers(97, 100, draw.integers(0, 12)).astype(np.uint8))
        trie.insert(key, i, 1)
        want[key] += 1
        if trie.held > 3000:
            out += trie.spill(1500)
            assert 0 < trie.held <= 1500
    left = list(trie.terminals())
    assert sum(len(label) for node in [trie.root] for label in labels(node)) == trie.held
    found = Counter()
    for key, _, n, _ in out + left:
        found[key] += n
    assert out and left and found == want


def labels(node):
    for label, below in node[0].values():
        yield label
        yield from labels(below)


def test_spilled_groups_add_up(docs, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "_combine", lambda batches: exact_dedup.combined(batches, 2000))
    monkeypatch.setattr(exact_dedup, "_own", lambda batches: exact_dedup.owned(batches, 2000))
    assert sorted(map(str, exact_dedup.exact_groups(docs).collect())) == want


def brute_fingerprint(text, k=4):
    words = (text or "").translate(LOWER).encode().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(points, near):
    up = {p: p for p in points}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if near(a, b):
                up[root(a)] = root(b)
    return {p: root(p) for p in points}


def test_near_groups(docs, rows):
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
    tops = linked(sorted({p for _, p in prints}), lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(lambda: math.inf)
    for d, p in prints:
        least[tops[p]] = min(least[tops[p]], ident(d))
    want = Counter((d, f"{p:016x}", None if least[tops[p]] == math.inf else least[tops[p]]) for d, p in prints)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()) == want


@pytest.mark.parametrize("radius", [2, 4, 8, 10])
def test_near_pairs_finds_all(spark, radius):
    draw = np.random.default_rng(radius)
    base = draw.integers(-(2**63), 2**63, 60)
    points = set(base.tolist())
    for b in base.tolist():
        for _ in range(6):
            flips = draw.choice(64, draw.integers(1, 14), replace=False)
            points.add(int(np.int64(np.uint64(b & (2**64 - 1)) ^ np.uint64(sum(1 << int(f) for f in flips)))))
    frame = spark.createDataFrame([(p,) for p in points], "fp long")
    found = [(r.a, r.b) for r in simhash.near_pairs(frame, radius).collect()]
    order = sorted(points)
    want = {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    assert len(found) == len(set(found)) and set(found) == want


def test_drop_near_copies(spark):
    draw = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    rows, groups = [], []
    for g in range(12):
        text = list(draw.choice(words, 300))
        groups.append([])
        for k in range(3):
            copy = list(text)
            for at in draw.choice(300, 2 * k, replace=False):  # up to 4 of 300 words: similarity over 0.87
                copy[at] = "changed"
            groups[-1].append(len(rows))
            rows.append((len(rows), " ".join(copy)))
    left = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {g[0] for g in groups}


def test_bounds_never_reject_similar_sets(spark):
    draw = np.random.default_rng(14)
    rows, want = [], []
    for n in (1, 5, 40, 300, 2000):
        for _ in range(12):
            a = draw.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[int(n * draw.uniform(0, 0.2)) :], draw.integers(0, 2**63, int(n * draw.uniform(0, 0.2))).astype(np.uint64)])
            rows.append((len(a), len(b), simhash.bitmap(a), simhash.bitmap(b)))
            want.append(simhash.jaccard(np.sort(a), np.sort(b)))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, na int, nb int, a array<long>, b array<long>")
    can = frame.select("i", simhash.can_be_similar(F.col("na"), F.col("nb"), F.col("a"), F.col("b"), 0.8).alias("can")).collect()
    assert all(r.can for r in can if want[r.i] >= 0.8)
    far = [simhash.bitmap(draw.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(2)]
    assert not spark.createDataFrame([(300, 300, *far)], "na int, nb int, a array<long>, b array<long>").select(simhash.can_be_similar(F.col("na"), F.col("nb"), F.col("a"), F.col("b"), 0.8)).first()[0]


@pytest.mark.parametrize("heavy", [0, 3, 1000])
def test_prefix_pairs_of_heavy_groups(spark, heavy, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    draw = np.random.default_rng(5)
    rows = []
    for point in range(60):
        own = np.unique(draw.integers(0, 2**63, int(draw.integers(8, 12))).astype(np.uint64))
        top = 1 if point < 25 else 2 if point < 32 else point
        rows += [(int(t), int(draw.integers(0, 3)), point, len(own), top, simhash.bitmap(own[: point % 2])) for t in draw.permutation(6)[:3]]
    found = simhash.prefix_pairs(spark.createDataFrame(rows, "token long, at int, point long, n int, top long, bits array<long>"), 0.8)

    def can(x, y):
        least = math.ceil((x[3] + y[3]) * 0.8 / 1.8 - 1e-9)
        apart = sum((i ^ j).bit_count() if i ^ j >= 0 else ((i ^ j) + 2**64).bit_count() for i, j in zip(x[5], y[5], strict=True))
        return min(x[1], y[1]) + min(x[3] - x[1], y[3] - y[1]) >= least and min(x[3], y[3]) >= 0.8 * max(x[3], y[3]) - 1e-9 and apart <= x[3] + y[3] - 2 * least

    wanted = {(x[2], y[2]) for x in rows for y in rows if x[0] == y[0] and x[2] < y[2] and x[4] != y[4] and can(x, y)}
    got = list(map(tuple, found.select("a", "b").collect()))
    assert 100 < len(wanted) < 60 * 59 // 2
    assert sorted(got) == sorted(wanted)


def test_near_copies_against_all_pairs(spark, docs, rows):
    """Of the whole table, odd rows and all: every link at 0.8 or more by definition, and nothing else."""
    def shingles(t):
        w = (t or "").translate(LOWER).encode().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    texts = sorted({r.text or "" for r in rows})
    sets = {t: shingles(t) for t in texts}
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] or sets[b] else 1.0
    tops = linked(texts, lambda a, b: sim(a, b) >= 0.8)
    least = defaultdict(lambda: math.inf)
    for r in rows:
        least[tops[r.text or ""]] = min(least[tops[r.text or ""]], ident(r.doc_id))
    want = Counter((r.doc_id, None if (x := least[tops[r.text or ""]]) == math.inf else x) for r in rows)
    assert Counter((r.doc, r.component_id) for r in simhash.similar_groups(docs).collect()) == want


def partly_changed(words, at, k):
    """A text with k words changed far from each other: each changes five shingles."""
    copy = list(words)
    for j in range(k):
        copy[10 + 12 * j] = f"changed{at}x{j}"
    return " ".join(copy)


def test_similarity_is_exact_for_long_texts(spark):
    draw = np.random.default_rng(8)
    rows, want = [], set()
    for g in range(40):
        words = [f"g{g}w{i}" for i in draw.permutation(1204)]
        # 1,200 shingles; k changed words leave (1200 - 5k) / (1200 + 5k): 26 give 0.805 and 27 give 0.798
        k = 26 + g % 2
        rows += [(2 * g, " ".join(words)), (2 * g + 1, partly_changed(words, g, k))]
        want |= {(2 * g, 2 * g + 1)} if k == 26 else set()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = simhash.texts_of(frame, "text")
    point = {r.text: r.point for r in texts.collect()}
    ids = {point[t]: d for d, t in rows}
    pairs = spark.createDataFrame([(point[rows[2 * g][1]], point[rows[2 * g + 1][1]]) for g in range(40)], "a long, b long")
    assert {(ids[r.a], ids[r.b]) for r in simhash._similar(pairs, texts, 5, 0.8).collect()} == want


def test_near_copies_at_the_threshold(spark):
    draw = np.random.default_rng(9)
    rows, want = [], set()
    for g in range(60):
        words = [f"g{g}w{i}" for i in draw.permutation(304)]
        # 300 shingles; 6 changed words leave 0.818, 7 leave 0.791
        rows += [(2 * g, " ".join(words)), (2 * g + 1, partly_changed(words, g, 6 + g % 2))]
        want |= {2 * g} if g % 2 == 0 else {2 * g, 2 * g + 1}
    left = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == want


def test_texts_of_one_fingerprint_are_compared(spark):
    rows = [(g, "again " * 400 + " ".join(f"g{g}w{i}" for i in range(200))) for g in range(3)]
    assert len({simhash.fingerprint(simhash.shingle_hashes(t, 5)) for _, t in rows}) == 1
    assert simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3


def test_mix(docs, rows):
    found = mixing.mix(docs, shards=4).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(re.findall(WORD, r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order]), strict=True))
    ids = Counter(r.doc_id for r in rows)
    by_doc = {r.doc_id: r.source for r in rows if ids[r.doc_id] == 1}
    taken, seen = Counter(), {}
    for r in found:
        assert r.taken <= 2 * r.size and r.taken == r.size * r.passes
        if r.doc_id in by_doc:
            seen[by_doc[r.doc_id]] = (r.source_size, r.target)
        taken[r.source_size, r.target] += r.taken
    for s, (size, target) in seen.items():
        assert size == sizes[s] and target == pytest.approx(want[s])
    for (size, target), n in taken.items():
        docs_of = [len(re.findall(WORD, r.text or "")) for r in rows]
        assert abs(n - target) <= max(docs_of)
    assert all(len(r.shards) == r.passes and all(0 <= x < 4 for x in r.shards) for r in found)
    key = lambda r: (ident(r.doc_id), r.size, r.taken, r.shards, r.position)
    assert sorted(map(key, found)) == sorted(map(key, mixing.mix(docs.repartition(5), shards=4).collect()))


def test_targets_stop_at_twice_a_source():
    found = mixing.targets([10, 1000, 500, 0])
    assert found[0] == 20 and found[3] == 0
    assert sum(found) == pytest.approx(1.5 * 1510)
    assert all(t <= 2 * s + 1e-9 for t, s in zip(found, [10, 1000, 500, 0], strict=True))


def test_splitting_tree_is_exact():
    quotas = np.array([7, 100, 0, 33])
    deal = mixing.split_quotas(quotas, 5)
    assert (deal.sum(0) == quotas).all() and (deal >= 0).all()
    assert deal.sum(1).max() - deal.sum(1).min() <= 3
    assert (deal == mixing.split_quotas(quotas, 5)).all()


def test_block_queues_make_up_the_target():
    draw = np.random.default_rng(3)
    for _ in range(200):
        sizes = draw.integers(0, 50, draw.integers(1, 30)).tolist()
        target = float(draw.uniform(0, 2 * sum(sizes)))
        queue = mixing.block_queue(sizes, target, 2.0, draw)
        assert max(Counter(b for b, _ in queue).values(), default=0) <= 2
        whole = sum(sizes[b] for b, part in queue if part is None)
        parts = [(b, part) for b, part in queue if part is not None]
        assert whole <= target + 1e-9 and len(parts) <= 1
        if parts:
            assert parts[0][1] == pytest.approx(target - whole) and sizes[parts[0][0]] > parts[0][1]
        else:
            assert whole == pytest.approx(target) or not sum(sizes) or whole == 2 * sum(sizes)


def test_mixed_documents_repeat_what_is_taken(docs):
    passes = Counter(r.passes for r in mixing.mix(docs).collect())
    assert mixing.mixed_documents(docs).count() >= passes[1]


def test_pack(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[(r.doc_id, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    found = packing.pack(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in found) // 2048) + 1


def test_plan_uses_every_piece_once():
    draw = np.random.default_rng(1)
    for _ in range(20):
        counts = {int(x): int(n) for x, n in zip(draw.choice(100, 12, replace=False) + 1, draw.integers(1, 40, 12), strict=True)}
        runs, bins = packing.plan(counts, 100)
        fill = Counter()
        for x, own in runs.items():
            assert sum(r[1] for r in own) == counts[x]
            for _, times, sequence, _ in own:
                for s in range(sequence, sequence + times):
                    fill[s] += x
        assert max(fill.values()) <= 100 and len(fill) == bins
        rooms: list[int] = []  # best fit decreasing
        for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
            fit = min((r, i) for i, r in enumerate([*rooms, 100]) if r >= x)[1]
            rooms[fit:] = [*(rooms[fit : fit + 1] or [100]), *rooms[fit + 1 :]]
            rooms[fit] -= x
        assert bins <= len(rooms)


def test_thousands_of_tiny_pieces_complete_bins():
    assert packing.best_filling(2047, [1], {1: 5000}) == [1] * 2047
    assert packing.plan({1: 5000, 1500: 3}, 2048)[1] == 5
    assert packing.plan({1: 100_000, 2: 1}, 2048)[1] == 49


def test_plans_reach_the_optimum_of_small_tables():
    from functools import lru_cache

    assert packing.plan(Counter([1042, 969, 927, 927, 913, 698, 678, 596, 375, 357, 243, 223]), 2048)[1] == 4
    draw = np.random.default_rng(6)
    for _ in range(40):
        pieces = tuple(sorted(draw.integers(3, 50, 10).tolist(), reverse=True))

        @lru_cache(maxsize=None)
        def least(left, room):
            if not left:
                return 0
            best = 1 + least(left[1:], 60 - left[0])
            for k, x in enumerate(left):
                if x <= room:
                    best = min(best, least(left[:k] + left[k + 1 :], room - x))
            return best

        assert packing.plan(Counter(pieces), 60)[1] == least(pieces, 0)


def test_best_filling_is_best():
    from itertools import combinations

    draw = np.random.default_rng(2)
    for _ in range(60):
        pieces = sorted(draw.integers(1, 50, 9).tolist())
        left = Counter(pieces)
        best = max(sum(c) for n in range(10) for c in combinations(pieces, n) if sum(c) <= 90)
        found = packing.best_filling(90, sorted(left), dict(left))
        assert sum(found) == best and not Counter(found) - left


def test_identify(docs, rows):
    found = langid.identify(docs, sample_docs=50).collect()
    assert len(found) == len(rows)
    text = {r.doc_id: r for r in rows if r.doc_id is not None}
    good = total = 0
    for r in found:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.doc_id is None:
            continue
        own = text[r.doc_id]
        letters = any(c.isalpha() for c in own.text or "")
        assert (r.lang_pred == "und") == (not letters)
        if r.doc_id < 9000 and r.held_out:
            total += 1
            good += r.lang_pred == own.lang
    assert good / total >= 0.9
    kept = langid.identified_documents(docs, sample_docs=50).collect()
    assert len(kept) == sum(r.lang_pred != "und" for r in found)


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "a", "b", "ab", "▁ab", "ba", "▁"]
    known = langid.Pieces(pieces)
    p = np.random.default_rng(0).uniform(0.1, 1, (known.n, 2))
    table = langid._with_zero(p)

    def brute(word, k):
        if not word:
            return 1.0
        return sum(p[pieces.index(word[:n]), k] * brute(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in pieces) + (p[known.n - 1, k] * brute(word[1:], k) if word[0] not in pieces else 0)

    for at, n, found in known.spans(["abab", "baba", "ac", "b"]):
        a = langid.forward(n, len(at), found, table)
        for row, w in enumerate(at):
            for k in range(2):
                assert a[n][row, k] == pytest.approx(brute("▁" + ["abab", "baba", "ac", "b"][w], k))


def test_long_words_are_scored_whole():
    pieces = ["▁a", "a", "b", "ab", "▁ab", "ba", "bab"]
    known = langid.Pieces(pieces)
    p = np.random.default_rng(1).uniform(0.1, 0.3, (known.n, 3))
    table = langid._with_zero(p)
    for word in ("abab", "abbabaabab", "cabab"):
        ((at, n, found),) = known.spans([word])
        a, logs = langid.scaled_forward(known.of_long(word), table)
        assert np.allclose(np.log(a[-1]) + logs[-1], np.log(langid.forward(n, 1, found, table)[n][0]))
    one = langid._with_zero(p[:, :1])
    ((at, n, found),) = known.spans(["abbabab"])
    f = langid.forward(n, 1, found, one)
    b = np.zeros_like(f)
    b[n] = 1
    for i, j, piece in reversed(found):
        b[i] += b[j] * one[piece]
    want = np.zeros(known.n + 1)
    for i, j, piece in found:
        if piece[0] >= 0:
            want[piece[0]] += (f[i] * one[piece] * b[j] / f[n])[0, 0]
    assert np.allclose(langid.expected_of_long(known.of_long("abbabab"), one, known.n + 1), want)
    scorer = langid.Scorer(pieces, p)
    x, y = scorer.of(["ab" * 5000, "ab"])
    assert np.isfinite(x).all() and (x < 2000 * y).all()
    langs, probabilities = langid.fit({"a": {"ab" * 40: 2, "ab": 1}, "b": {"b" * 50: 1}}, known)
    assert langs == ["a", "b"] and np.allclose(probabilities.sum(0), 1)


def test_identify_against_a_direct_model(spark):
    """The whole query: sample, fit and posterior against sums over all segmentations, word by word."""
    draw = np.random.default_rng(7)
    words = {"en": "the house was blue and old".split(), "de": "das haus war blau und alt".split()}
    rows = [(i, " ".join(draw.choice(words[lang], 12)), lang) for i in range(40) for lang in [("en", "de")[i % 2]]]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    pieces = langid.read_pieces()
    number = {w: k for k, w in enumerate(pieces)}
    learned = {lang: Counter(w for i, t, x in rows if x == lang and zlib.crc32(str(i).encode()) % 5 for w in t.split()) for lang in words}

    def cuts(w):
        if not w:
            return [[]]
        ends = [k for k in range(1, len(w) + 1) if w[:k] in number]
        own = [[number[w[:k]], *rest] for k in ends for rest in cuts(w[k:])]
        return own + ([[len(pieces), *rest] for rest in cuts(w[1:])] if w[0] not in number else [])

    prob = {}
    for lang, counts in learned.items():
        p = np.full(len(pieces) + 1, 1 / (len(pieces) + 1))
        for _ in range(langid.ROUNDS):
            expected = np.full(len(p), langid.ADDED)
            for w, c in counts.items():
                ways = [(np.prod(p[way]), way) for way in cuts("▁" + w)]
                for x, way in ways:
                    for k in way:
                        expected[k] += c * x / sum(v for v, _ in ways)
            p = expected / expected.sum()
        prob[lang] = {w: math.log(sum(np.prod(p[way]) for way in cuts("▁" + w))) for w in {*words["en"], *words["de"]}}
    for i, t, _ in rows:
        total = {lang: sum(prob[lang][w] for w in t.split()) for lang in prob}
        best = max(sorted(total), key=total.get)
        assert found[i].lang_pred == best
        assert found[i].score == pytest.approx(1 / sum(math.exp(v - total[best]) for v in total.values()), abs=1e-4)


def test_license_base(docs, rows):
    want = Counter()
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOWER))
        places = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        want[(r.doc_id, len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places})))] += 1
    found = license_scan.scan(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in found)


def test_license_templates(spark):
    mit = next(t for label, t in license_scan.TEMPLATES if label == "mit" and len(t) > 100)
    broken = mit.split()
    broken[10:12] = ["quite", "different", "words", "here"]
    rows = [(1, "Some notes. " + mit + " The end."), (2, "x " * 500 + " ".join(broken)), (3, "permission is hereby granted to nobody"), (4, "Licensed under the Apache License, Version 2.0."), (5, "Licensed under CC BY-NC 4.0.")]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].labels == "mit" and found[1].score == 1
    assert found[2].labels == "mit" and 0.9 < found[2].score < 1
    assert found[3].labels == "" and found[3].score == 0
    assert found[4].labels == "apache-2.0"
    assert found[5].labels == "cc-by,cc-by-nc-4.0" and found[5].base_labels == "cc-by"


def test_remove_repeats(docs, rows):
    length = 50
    by_doc = [(ident(r.doc_id), r.doc_id, (r.text or "").encode()) for r in rows]
    first = {}
    for d, _, b in by_doc:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, math.inf), d)
    want = Counter()
    for d, raw, b in by_doc:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < d:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[(raw, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())] += 1
    for options in ({}, {"unit_bytes": 30_000, "bucket_bytes": 60_000, "partition_suffixes": 3000}):
        found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, **options).collect())
        assert found == want


def test_lm_base(docs, rows):
    tokens = lambda t: [*re.findall(WORD, (t or "").translate(LOWER)), "\0end"]
    left = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = Counter()
    for r in rows:
        if not left(r.doc_id):
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        own = tokens(r.text)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        want[(r.doc_id, left(r.doc_id), len(own), sum(counts[t] > 0 for t in own), n, round(base, 4))] += 1
    for options in ({}, {"unit_tokens": 3000, "partition_tokens": 4000}):
        found = lm.score(docs, **options).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def thue_morse(n, flip=False):
    """Of two such words every polynomial hash modulo a power of two is the same."""
    return "".join("ab"[(k.bit_count() + flip) % 2] for k in range(n))


def test_words_that_polynomials_confuse(spark):
    a, b = thue_morse(2048), thue_morse(2048, True)
    free = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = spark.createDataFrame([(free, a), (held, b)], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in lm.score(rows).collect()} == {free: 2, held: 1}
    scanned = license_scan.scan(rows, base=((a, "x"),)).collect()
    assert {r.doc_id: r.n_base for r in scanned} == {free: 1, held: 0}
    removed = suffix_dedup.remove_repeats(spark.createDataFrame([(1, a + "c" * 60), (2, b + "d" * 60)], "doc_id long, text string"), length=2048).collect()
    assert [r.n_removed for r in removed] == [0, 0]


def test_many_license_lines_in_one_text(spark):
    rows = [(1, "Licensed under CC BY-NC 4.0. Some words between here and there. " * 20_000)]
    r = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert r.labels == "cc-by,cc-by-nc-4.0" and r.spans.count("cc-by-nc-4.0") == 20_000


def test_lm_against_a_direct_model(spark):
    draw = np.random.default_rng(4)
    rows = [(i, " ".join(f"t{x}" for x in draw.zipf(1.5, 80) % 40)) for i in range(60)]
    found = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    train = [t.split() + ["</s>"] for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for t in train:
        uni.update(t)
        pairs = list(zip(["<s>", *t[:-1]], t, strict=True))
        bi.update(pairs)
        ctx.update(v for v, _ in pairs)
    n, v = sum(uni.values()), len(uni)
    sums = Counter()
    bucket = lambda c: int(math.log2(c)) + 1 if c > 0 else 0
    step = lambda p: round(math.log(p * (v + 1)) / lm.STEP) if p > 0 else -1000
    for t in train:
        pairs = list(zip(["<s>", *t[:-1]], t, strict=True))
        du, db, dc = Counter(t), Counter(pairs), Counter(a for a, _ in pairs)
        for a, b in pairs:
            c = ctx[a] - dc[a]
            sums[bucket(c), step((bi[a, b] - db[a, b]) / c if c else 0), step((uni[b] - du[b]) / (n - len(t)))] += 1
    w = lm.learn_weights([(*k, x) for k, x in sums.items()])
    for i, t in rows:
        own = t.split() + ["</s>"]
        s = 0.0
        for a, b in zip(["<s>", *own[:-1]], own, strict=True):
            c = ctx[a]
            k = w[min(bucket(c), 63)]
            s += math.log10(k[0] * (bi[a, b] / c if c else 0) + k[1] * uni[b] / n + k[2] / (v + 1))
        assert found[i] == pytest.approx(s, abs=1e-6)


def test_pipeline_against_brute_force(spark, docs, rows, tmp_path):
    """Every stage on its predecessor's rows, odd rows and clashing columns too, against its definition."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    frame, outs = docs.select("*", F.lit(1).alias("_keep"), F.lit(1).alias("_own_id"), F.lit(1).alias("_id"), F.lit(1).alias("_copy"), F.lit(1).alias("passes"), F.lit(1).alias("k"), F.lit(1).alias("d")), []
    columns = frame.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, "")
        assert k == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        frame = spark.read.parquet(str(tmp_path / str(k)))
        outs.append(frame.collect())
    named = lambda found: Counter((r.doc_id, r.text) for r in found)
    assert named(outs[0]) == Counter((r.doc_id, r.text) for r in rows if any(c.isalpha() for c in r.text or ""))
    kept: dict = {}
    for r in outs[0]:
        t = re.sub(SPACE, " ", r.text)
        kept[t] = r if t not in kept or ident(r.doc_id) < ident(kept[t].doc_id) else kept[t]
    assert Counter((r.doc_id, re.sub(SPACE, " ", r.text)) for r in outs[1]) == Counter((r.doc_id, t) for t, r in kept.items())

    def shingles(t):
        w = t.translate(LOWER).encode().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    texts = sorted({r.text for r in outs[1]})
    sets = {t: shingles(t) for t in texts}
    tops = linked(texts, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    least = defaultdict(lambda: math.inf)
    for r in outs[1]:
        least[tops[r.text]] = min(least[tops[r.text]], ident(r.doc_id))
    assert named(outs[2]) == Counter((r.doc_id, r.text) for r in outs[1] if ident(r.doc_id) == least[tops[r.text]])
    size = lambda t: len(re.findall(WORD, t))
    have, taken, most = Counter(), Counter(), Counter()
    for r in outs[2]:
        have[r.source] += size(r.text)
        most[r.source] = max(most[r.source], size(r.text))
    for r in outs[3]:
        taken[r.source] += size(r.text)
    order = sorted(have, key=lambda x: (x is None, (x or "").encode()))
    for source, target in zip(order, mixing.targets([have[x] for x in order]), strict=True):
        assert abs(taken[source] - target) <= most[source]
    assert max(named(outs[3]).values()) <= 2 and set(named(outs[3])) <= set(named(outs[2]))
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for r in outs[3]:
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[(r.doc_id, k, s, zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in outs[4]) == want
    fill = defaultdict(list)
    for r in outs[4]:
        fill[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in own) <= 2048 and [o for o, _ in sorted(own)] == [sum(n for o2, n in own if o2 < o) for o, _ in sorted(own)] for own in fill.values())
    assert len(fill) <= -(-sum(r.length for r in outs[4]) // 2048) + 1


def test_probes_of_near_copies_do_not_depend_on_the_size_of_tables_below_the_design(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    counted, chosen = simhash.bit_counts, simhash.allocate
    found = {}
    for size in (47_000, 236_000):

        def scaled(points, size=size):
            n, both = counted(points)
            return size, both * (size / n)

        def kept(*args, size=size, **options):
            parts = chosen(*args, **options)
            found.setdefault(size, []).append([(part, t) for part, t in parts if t >= 0])
            return parts

        monkeypatch.setattr(simhash, "bit_counts", scaled)
        monkeypatch.setattr(simhash, "allocate", kept)
        simhash.similar_groups(docs)
    assert len(found[47_000]) == 2 and found[47_000] == found[236_000]
