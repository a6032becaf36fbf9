"""Words and word hashes of whole Arrow string columns, with numpy and without a loop over rows.

A word is a run of bytes other than space and 0x09 to 0x0D. All separators are ASCII, so UTF-8 text can be cut on
bytes. A word's hash is a polynomial over its bytes modulo 2**64, taken from one prefix sum over a block of text and
mixed afterwards. Two independent hashes together identify a word or a sequence of words (128 bits).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK_BYTES = 1 << 20
_MASK = (1 << 64) - 1

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


@lru_cache(None)
def _byte_codes(seed: int, fold: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0x632BE59BD9B4E019 & _MASK))
    if fold:
        codes[ord("A"):ord("Z") + 1] = codes[ord("a"):ord("z") + 1]
    return codes


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest array asked for is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(BLOCK_BYTES + 1, n)
        factors = np.full(size, base, U)
        factors[0] = 1
        have = _POWERS[base] = np.cumprod(factors, dtype=U)
    return have[:n]


def _base(seed: int) -> int:
    return (0x9E3779B97F4A7C15 * (2 * seed + 3) | 1) & _MASK


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Words:
    """The words of a block of texts: byte range and text number of each, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        gap = SEPARATOR[data]
        edge = np.empty(len(data) + 1, bool)
        edge[:-1] = ~gap
        edge[-1] = False
        starts = edge[:-1].copy()
        starts[1:] &= gap[:-1]
        ends = edge[:-1].copy()
        ends[:-1] &= gap[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        starts[inner] = ~gap[inner]
        ends[inner - 1] = ~gap[inner - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self._hashes: dict[tuple[int, bool], np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.start)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 0, fold: bool = False) -> np.ndarray:
        """One mixed 64-bit hash for each word; ``fold`` lower-cases A-Z."""
        if (seed, fold) not in self._hashes:
            base = _base(seed)
            prefix = np.zeros(len(self.data) + 1, U)
            np.cumsum(_byte_codes(seed, fold)[self.data] * _powers(base, len(self.data)), out=prefix[1:])
            h = prefix[self.end] - prefix[self.start]
            h *= _powers(_inverse(base), len(self.data) + 1)[self.start]
            h += (self.end - self.start).astype(U) * U(0xD6E8FEB86659FD93)
            self._hashes[seed, fold] = mix(h)
        return self._hashes[seed, fold]

    def windows(self, size: int) -> np.ndarray:
        """Numbers of the words that start a run of ``size`` words of one text."""
        if len(self) < size:
            return np.empty(0, np.int64)
        text = self.text
        return np.flatnonzero(text[: len(text) - size + 1] == text[size - 1:])

    def slice_bytes(self, word_from: int, word_to: int) -> bytes:
        return self.data[self.start[word_from]:self.end[word_to - 1]].tobytes()


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Mixed hashes of all runs of ``size`` word hashes; entry i covers words i to i+size-1."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U)
    base = U(_base(seed + 101))
    out = words[:n].copy()
    for k in range(1, size):
        out *= base
        out += words[k:k + n]
    return mix(out)


def blocks(texts: pa.Array | pa.ChunkedArray, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for runs of rows of about ``block_bytes``; nulls count as empty texts.

    Texts are never cut: one that is longer than a block makes up a block of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, offsets = string_bytes(texts)
    row, rows = 0, len(texts)
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop, Words(data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row])
        row = stop


def by_bytes(batches: Iterator[pa.RecordBatch], column: int | str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some ``limit`` bytes of a text column (a longer text is one of its own).

    What a task makes of a batch is then as small as that, however many rows the engine sends at once. After the last
    one, memory that is free in this process goes back to the system, as the process is kept for later tasks.
    """
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        texts = batch.column(batch.schema.get_field_index(column) if isinstance(column, str) else column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        row = done = 0
        while row < batch.num_rows:
            stop = min(batch.num_rows, max(row + 1, int(np.searchsorted(ends, done + limit, "right"))))
            yield batch.slice(row, stop - row)
            row, done = stop, int(ends[stop - 1])
    give_back()


def give_back() -> None:
    """Memory that is free in this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offset of each row (one more than rows)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
