"""Helpers shared by the training-data operators: scratch tables and vectorised byte work."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np

from tissuelake.scratch import bucketed, drop_scratch, scratch_dir, written

__all__ = ["SPACES", "bucketed", "drop_scratch", "forget", "mix", "no_threads", "ranges", "remembered", "scratch_dir", "string_bytes", "trim", "trimmed", "word_hashes", "written", "Blocks"]

#: ASCII white space as the contracts spell it, for Java's and Python's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"


def no_threads() -> None:
    """Libraries with thread pools of their own keep to the one core of a Spark task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    import pyarrow as pa

    pa.set_cpu_count(1)


_remembered: dict[object, object] = {}


def remembered(key: object, build: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: of one operator at a time, so that memories don't add up."""
    if key not in _remembered:
        forget()
        _remembered[key] = build()
    return _remembered[key]


def forget() -> None:
    """Give back what earlier operators left in this worker's memory."""
    if _remembered:
        _remembered.clear()
        trim()


def trim() -> None:
    """Hand freed memory back to the system, which else stays with a worker while it waits for its next task."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A function of batches that trims once its task is over."""

    @functools.wraps(run)
    def go(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return go


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start+1, ... start+length-1 of every pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, lengths)


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary array as its bytes and the n+1 offsets into them; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and len(column) else np.empty(0, np.uint8)
    return whole, at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (the finaliser of SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all words of some texts, one after the other, and the number of words of each text.

    folded: the texts' bytes with a space for all that parts words. Each different word is hashed once.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from xxhash import xxh64_intdigest

    n = len(offsets) - 1
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(folded))])
    words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    lists = words.flatten().dictionary_encode()
    parents = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
    different = lists.dictionary.cast(pa.large_binary()).to_pylist()
    own = np.fromiter((xxh64_intdigest(w) for w in different), np.uint64, len(different))
    at = lists.indices.to_numpy(zero_copy_only=False)
    # Splitting leaves empty strings at the ends of texts; they aren't words.
    real = np.fromiter(map(len, different), np.int64, len(different))[at] > 0
    return own[at[real]], np.bincount(parents[real], minlength=n)


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Blocks:
    """Hashes of substrings of one byte array by doubling: a string's from those of its two halves.

    Each doubling multiplies and folds bits down, so that no sum of powers is ever compared: strings that are alike by
    the rules of a polynomial aren't here. Another seed gives an independent hash.
    """

    def __init__(self, data: np.ndarray, seed: int = 0):
        values = np.arange(256, dtype=np.uint64) * _ODD[0] + np.uint64(seed) * _ODD[1] + _ODD[2]
        self.levels = [mix(values)[data]]

    def _pair(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        h = (a ^ (b >> np.uint64(29))) * _ODD[k & 7] + (b ^ (a >> np.uint64(31))) * _ODD[(k + 3) & 7]
        return h ^ (h >> np.uint64(32))

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            half, n = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(self._pair(half[: len(half) - n], half[n:], len(self.levels)) if len(half) > n else half[:0])
        return self.levels[k]

    def all(self, length: int) -> np.ndarray:
        """Of the substrings of one length, at each place where one starts: two overlapping powers of two cover it."""
        k = length.bit_length() - 1
        whole, rest = self._level(k), length - (1 << k)
        n = len(self.levels[0]) - length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix(whole[:n] + _ODD[1]) if not rest else mix(self._pair(whole[:n], whole[rest : rest + n], length & 7) + np.uint64(length))

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Of the substrings of one length at some places."""
        k = length.bit_length() - 1
        whole, rest = self._level(k), length - (1 << k)
        if not len(starts):
            return np.empty(0, np.uint64)
        return mix(whole[starts] + _ODD[1]) if not rest else mix(self._pair(whole[starts], whole[starts + rest], length & 7) + np.uint64(length))
