"""Language identification by unigram pieces, marginalised over all segmentations of a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissuelake.llm.common import no_threads, remembered, trimmed, written

#: The classifier is fitted on this many labelled documents of each language at most, those of smallest id hash.
SAMPLE_DOCS = 1000
#: Rounds of expectation-maximisation, and what is added to each piece's expected count.
ROUNDS, ADDED = 4, 0.1
#: Longer words go through the scaled recursion, whose sums don't underflow; both give the same.
SHORT_LETTERS = 32
#: Words whose scores a Python worker remembers.
CACHE_WORDS = 400_000
UNDETERMINED = "und"
#: Ids of the sample, and languages, up to which they are broadcast.
BROADCAST_IDS, BROADCAST_LANGS = 1_000_000, 100_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str | None = None) -> list[str]:
    """The vocabulary's ordinary pieces of letters in id order; a leading U+2581 marks the start of a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path())
    pieces = (model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    return list(dict.fromkeys(p.lower() for p in pieces if p.lstrip("▁").isalpha() and p.rfind("▁") <= 0))


def words_of(texts: pa.Array) -> pa.Array:
    """Lists of each text's words: runs of letters of the lower-cased text."""
    cleaned = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
    cleaned = pc.utf8_trim(cleaned, " ")
    # Splitting an empty string gives one empty word; a null gives none.
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(cleaned, ""), pa.scalar(None, cleaned.type), cleaned))


class Pieces:
    """The fixed vocabulary as sorted hashes; which piece stands at each place of each word."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces) + 1  # the last stands for any single letter that no piece covers
        self.longest = max(map(len, pieces), default=1)
        hashes = np.zeros(len(pieces), np.uint64)
        for k, p in enumerate(pieces):
            h = np.uint64(0)
            for c in p:
                h = self._next(h, np.uint64(ord(c)))
            hashes[k] = h
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)

    @staticmethod
    def _next(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h ^ (c + np.uint64(1))) * _STEP
            return h ^ (h >> np.uint64(29))

    def spans(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, list[tuple[int, int, np.ndarray]]]]:
        """By length: places of the words in the list, their length, and (start, end, piece or -1) arrays."""
        marked = ["▁" + w for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        for n in np.unique(sizes).tolist():
            at = np.nonzero(sizes == n)[0]
            letters = np.frombuffer("".join([marked[k] for k in at.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.uint64)
            found = []
            for i in range(n):
                h = np.zeros(len(at), np.uint64)
                for j in range(i, min(n, i + self.longest)):
                    h = self._next(h, letters[:, j])
                    k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                    piece = np.where(self.hashes[k] == h, self.ids[k], -1) if len(self.hashes) else np.full(len(at), -1)
                    if j == i:
                        piece = np.where(piece < 0, self.n - 1, piece)
                    if j == i or (piece >= 0).any():
                        found.append((i, j + 1, piece))
            yield at, n, found


    def of_long(self, word: str) -> np.ndarray:
        """(letters, longest): the piece that starts at a place and has a length, -1 where there is none."""
        letters = np.frombuffer(("▁" + word).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n = len(letters)
        out, h = np.full((n, self.longest), -1, np.int32), np.zeros(n, np.uint64)
        for j in range(min(self.longest, n)):
            h = self._next(h[: n - j], letters[j:])
            k = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
            found = np.where(self.hashes[k] == h, self.ids[k], -1) if len(self.hashes) else np.full(n - j, -1)
            out[: n - j, j] = np.where(found < 0, self.n - 1, found) if not j else found
        return out


def scaled_forward(pieces: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums of one word as (letters + 1, languages) numbers and their common log scales, one a place."""
    n, longest = pieces.shape
    a, logs = np.zeros((n + 1, table.shape[1])), np.zeros(n + 1)
    a[0] = 1
    for j in range(1, n + 1):
        i = np.arange(max(0, j - longest), j)
        sums = (a[i] * np.exp(logs[i] - logs[j - 1])[:, None] * table[pieces[i, j - 1 - i]]).sum(0)  # piece -1 takes the last row, of zeros
        top = sums.max()
        a[j], logs[j] = sums / top, logs[j - 1] + np.log(top)
    return a, logs


def expected_of_long(pieces: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """Expected counts of pieces in one word, of a table of one language."""
    n, longest = pieces.shape
    a, up = scaled_forward(pieces, table)
    p, b, down = table[:, 0], np.zeros(n + 1), np.zeros(n + 1)
    b[n] = 1
    for i in range(n - 1, -1, -1):
        j = np.arange(i + 1, min(n, i + longest) + 1)
        total = (p[pieces[i, j - 1 - i]] * b[j] * np.exp(down[j] - down[i + 1])).sum()
        b[i], down[i] = 1.0, down[i + 1] + np.log(total)
    i, length = np.nonzero(pieces >= 0)
    j = i + length + 1
    share = a[i, 0] * p[pieces[i, length]] * b[j] * np.exp(up[i] + down[j] - up[n]) / a[n, 0]
    return np.bincount(pieces[i, length], share, size)


def forward(n: int, rows: int, found: list[tuple[int, int, np.ndarray]], table: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each prefix, by language: (n + 1, rows, languages). table: (pieces + 1, languages)."""
    a = np.zeros((n + 1, rows, table.shape[1]))
    a[0] = 1
    for i, j, piece in found:  # ordered by start: all that ends at i is there before it is used
        a[j] += a[i] * table[piece]  # piece -1 takes the table's last row, of zeros
    return a


def _with_zero(p: np.ndarray) -> np.ndarray:
    return np.vstack([p, np.zeros((1, p.shape[1]))])


def fit(counts: dict[str, dict[str, int]], pieces: Pieces, rounds: int = ROUNDS, added: float = ADDED) -> tuple[list[str], np.ndarray]:
    """Languages in order, and (pieces, languages) probabilities, from counts of words by language."""
    langs = sorted(counts)
    p = np.zeros((pieces.n, len(langs)))
    for k, lang in enumerate(langs):
        words = sorted(w for w in counts[lang] if len(w) <= SHORT_LETTERS)
        weight = np.array([counts[lang][w] for w in words], float)
        groups = list(pieces.spans(words))
        longer = [(pieces.of_long(w), c) for w, c in sorted(counts[lang].items()) if len(w) > SHORT_LETTERS]
        own = np.full((pieces.n, 1), 1.0 / pieces.n)
        for _ in range(rounds):
            table, expected = _with_zero(own), np.zeros(pieces.n + 1)
            for at, n, found in groups:
                a = forward(n, len(at), found, table)
                b = np.zeros_like(a)
                b[n] = 1
                for i, j, piece in reversed(found):
                    b[i] += b[j] * table[piece]
                share = weight[at] / a[n][:, 0]
                for i, j, piece in found:
                    expected += np.bincount(np.where(piece < 0, pieces.n, piece), a[i][:, 0] * table[piece][:, 0] * b[j][:, 0] * share, pieces.n + 1)
            for own_pieces, c in longer:
                expected += c * expected_of_long(own_pieces, table, pieces.n + 1)
            c = expected[:-1] + added
            own = (c / c.sum())[:, None]
        p[:, k] = own[:, 0]
    return langs, p


class Scorer:
    """Log probabilities of words by language, remembered from batch to batch."""

    def __init__(self, pieces: list[str], p: np.ndarray):
        self.pieces, self.table = Pieces(pieces), _with_zero(p)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.logs = np.empty((1 << 16, self.table.shape[1]), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.forget()
        new = [w for w in words if w not in self.known]
        if new:
            first = len(self.known)
            while first + len(new) > len(self.logs):
                self.logs = np.concatenate([self.logs, np.empty_like(self.logs)])
            for k in (k for k, w in enumerate(new) if len(w) > SHORT_LETTERS):
                a, logs = scaled_forward(self.pieces.of_long(new[k]), self.table)
                with np.errstate(divide="ignore"):
                    self.logs[first + k] = np.log(a[-1]) + logs[-1]
            short = np.array([k for k, w in enumerate(new) if len(w) <= SHORT_LETTERS], np.int64)
            for own, n, found in self.pieces.spans([new[k] for k in short.tolist()]):
                at = short[own]
                for k in range(0, len(at), 20_000):
                    some = slice(k, k + 20_000)
                    a = forward(n, len(at[some]), [(i, j, piece[some]) for i, j, piece in found], self.table)
                    self.logs[first + at[some]] = np.log(a[n])
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
        return self.logs[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]


def learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int) -> dict[str, dict[str, int]]:
    """Counts of words by language of the sample: labelled documents that aren't held out."""
    labelled = docs.where(F.col(lang_col).isNotNull() & ~_held_out(id_col)).select(F.col(id_col).cast("long").alias("doc"), F.col(lang_col).cast("string").alias("lang"))
    # Only ids whose hash may be among a language's smallest are ranked, so that no task ranks all of a language. The
    # hash that an id must stay under follows from the language's number of documents, of which the driver gets one row
    # a language.
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    under = docs.sparkSession.createDataFrame([(r["lang"], (2 * sample_docs << 40) // r["n"]) for r in sizes], "lang_ string, under long")
    under = F.broadcast(under) if len(sizes) <= BROADCAST_LANGS else under
    hashed = labelled.withColumn("u", F.pmod(F.xxhash64("doc"), F.lit(1 << 40))).join(under, F.col("lang") == F.col("lang_")).where(F.col("u") < F.col("under"))
    order = Window.partitionBy("lang").orderBy("u", "doc")
    ids = hashed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample_docs).select("doc").distinct()
    ids = written(ids, "language-sample")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null").join(ids, "doc", "left_semi").select("lang", "text")

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_threads()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                words = words_of(batch["text"])
                langs = batch["lang"].take(pc.list_parent_indices(words))
                found = pa.table({"lang": langs, "word": words.flatten()}).group_by(["lang", "word"]).aggregate([([], "count_all")])
                yield from found.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).combine_chunks().to_batches()

    out: dict[str, dict[str, int]] = {}
    for r in rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        out.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return out


def _held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, path: str | None = None) -> DataFrame:
    """For each row of docs: doc_id, held_out, lang_pred and score.

    held_out: CRC-32 of the id as text (a null id: of the empty text) leaves 0 by 5. Of the others, sample_docs of
    each language teach one unigram distribution over the pieces of a fixed public vocabulary for each value of
    lang, by expectation-maximisation over all segmentations of their words. A text's log probability in a language
    is the sum over its words (repeats counted) of the log of the forward sum over all segmentations. lang_pred is the
    likeliest language (ties: the smallest name), score its posterior under equal priors. A null text, one without
    letters, and every text when nothing was learned, is `und` with score 0. Texts and runs of letters are read whole,
    however long. Rows that repeat an id are rows of their own; other columns don't
    matter. An empty table gives an empty result.
    """
    predict = _predictor(docs, id_col, text_col, lang_col, sample_docs, path)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lang, score = predict(batch["text"])
                yield pa.RecordBatch.from_arrays([batch["doc"], batch["held_out"], pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), _held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def _predictor(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, path: str | None):
    """A function for executors, from texts to their languages and scores, fitted on docs."""
    pieces = read_pieces(path)
    langs, p = fit(learned(docs, id_col, text_col, lang_col, sample_docs), Pieces(pieces))
    # Its size is bounded by the vocabulary and the number of languages.
    shared = docs.sparkSession.sparkContext.broadcast((langs, pieces, p))
    token = hash((tuple(langs), p.tobytes()))

    def predict(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        no_threads()
        langs, pieces, p = shared.value
        scorer = remembered(("scorer", token), lambda: Scorer(pieces, p))
        n, words = len(texts), words_of(texts)
        flat = words.flatten().dictionary_encode()
        best, score = np.full(n, len(langs)), np.zeros(n)
        if langs and len(flat):
            logs = scorer.of(flat.dictionary.to_pylist())[flat.indices.to_numpy(zero_copy_only=False)]
            doc = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
            total = np.stack([np.bincount(doc, logs[:, k].astype(float), n) for k in range(len(langs))], axis=1)
            some = np.bincount(doc, minlength=n) > 0
            best[some] = total.argmax(1)[some]
            score[some] = (1 / np.exp(total - total.max(1, keepdims=True)).sum(1))[some]
        return np.array([*langs, UNDETERMINED], object)[best], score

    return predict


def identified_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, path: str | None = None) -> DataFrame:
    """docs without the rows whose language is undetermined; the columns stay, whatever their names.

    Null texts and texts without letters go, and all texts where nothing was learned. Every other row stays, rows that
    repeat an id or text among them; very long texts are read whole. An empty table stays empty.
    """
    predict = _predictor(docs, id_col, text_col, lang_col, sample_docs, path)
    place = docs.columns.index(text_col)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lang, _ = predict(batch.column(place))
                yield batch.filter(pa.array(lang != UNDETERMINED))

    return docs.mapInArrow(run, docs.schema)
