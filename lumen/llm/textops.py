"""Vectorised text helpers used inside tasks: Arrow string columns as byte
arrays, words, 64-bit word and shingle hashes.

All functions work on one bounded chunk of whole documents (or on a piece of a
very long one, cut at white space), so a task's memory does not grow with the
length of a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Bytes of whole documents held at once where a task has several numbers for each byte.
SCAN_BYTES = 1 << 18

U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, giving the memory it freed back to the system at its end: Python
    workers stay for later tasks, and what they hold counts in the executor's memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and odd multipliers)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = True
    return t


SPACE = _space_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(data: np.ndarray, offsets: np.ndarray, max_bytes: int = CHUNK_BYTES,
           overlap: int = 0, piece: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks ``(first document, bytes, offsets)`` of up to ``max_bytes``.

    A longer document comes alone, in pieces (of ``piece`` bytes, or as many) cut after white space (a single
    word is never cut); with ``overlap``, pieces are cut anywhere and each
    repeats the last ``overlap`` bytes of the one before.
    """
    n, i, piece = len(offsets) - 1, 0, piece or max_bytes
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        if j > i:
            lo = int(offsets[i])
            yield i, data[lo:int(offsets[j])], offsets[i:j + 1] - lo
            i = j
            continue
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        while lo < hi:
            cut = hi
            if hi - lo > piece:
                cut = lo + max(piece, 2 * overlap)
                while not overlap and cut < hi and not SPACE[data[cut - 1]]:
                    step = SPACE[data[cut:min(hi, cut + piece)]]
                    at = int(step.argmax()) if step.any() else -1
                    cut = cut + at + 1 if at >= 0 else min(hi, cut + piece)
                cut = min(cut, hi)
            yield i, data[lo:cut], np.array([0, cut - lo], np.int64)
            lo = cut if cut == hi else cut - overlap
        i += 1


class Hasher:
    """Polynomial prefix hashes over bytes: the hash of every word of a chunk in
    a few array passes. Two words differ in hash unless 64 random bits agree."""

    def __init__(self, size: int = CHUNK_BYTES) -> None:
        self.size = size                       # of the usual chunk; longer ones let the tables grow
        rng = np.random.default_rng(20_240_607)
        self.table = rng.integers(1, _MASK, 256, dtype=np.uint64)
        self.power = np.ones(1, U)
        self.inverse = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power), self.size + 1024)
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.concatenate(([U(1)], np.full(n - 1, _BASE, U))))
                self.inverse = np.cumprod(np.concatenate(([U(1)], np.full(n - 1, _BASE_INV, U))))

    def words(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash, word offset of each document) of the chunk's words."""
        n = len(data)
        self._grow(n + 1)
        inside = ~SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        table = self.table[LOWER] if lower else self.table
        total = np.zeros(n + 1, U)
        np.cumsum(table[data] * self.power[:n], out=total[1:])
        h = (total[end] - total[start]) * self.inverse[start] + (end - start).astype(U)
        return start, end, mix(h), np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each document and their offsets; a document
    of fewer words has one shingle, its whole sequence, and none if it has no word."""
    count = np.diff(bounds)
    if not len(words):
        return np.zeros(0, U), np.zeros(len(count) + 1, np.int64)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - bounds[:-1], size)
    length = np.repeat(np.minimum(count, n), size)
    h = np.zeros(len(at), U)
    for k in range(n):
        use = length > k
        w = words[np.minimum(at + k, len(words) - 1)]
        h = np.where(use, mix(h * U(0xC2B2AE3D27D4EB4F) + w + U(k + 1)), h)
    return mix(h + length.astype(U)), out
