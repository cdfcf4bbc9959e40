"""Vectorised word splitting and hashing over Arrow string arrays.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; all of those are ASCII, so the
split is the same on UTF-8 bytes as on code points.  Everything here works on a bounded slice of
documents (`slices`), so a worker's memory follows the slice and the longest single document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_RNG = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
BYTE_AGAIN = np.random.Generator(np.random.PCG64(20240502)).integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)  # a second, independent hash
_BASE = int(_RNG.integers(2**62, 2**63, dtype=np.uint64)) | 1
_COEF = _RNG.integers(1, 2**64 - 1, (4, 64), dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = np.ones(1, dtype=np.uint64)


def give_back() -> None:
    """Returns freed memory to the system; an idle worker would hold it while other stages run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(f: Callable) -> Callable:
    """A function on batches that gives its memory back at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run


def rests(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], int], most: int) -> Iterator[pa.RecordBatch]:
    """The batches; memory is given back each time ``most`` of what ``size`` counts has passed.

    Arrays that grow in steps leave holes, which the allocator keeps.  Who takes a batch should drop
    it (``del``) before it asks for the next.
    """
    passed = 0
    for batch in batches:
        passed += size(batch)
        yield batch
        del batch
        if passed >= most:
            give_back()
            passed = 0


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        step = np.uint64(pow(_BASE, len(_POWERS), 2**64))
        _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS


@dataclass
class Words:
    """Words of a slice of documents: byte spans, 64-bit hashes and the row each belongs to."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hash: np.ndarray | None

    @property
    def n_rows(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows).astype(np.int64)

    def row_starts(self) -> np.ndarray:
        """Index of each row's first word, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.counts())])


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an array; null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def split(texts: pa.Array, lower: bool = False, hashes: bool = True) -> Words:
    """Words of every text; ``lower`` maps A-Z to a-z first."""
    data, off = raw(texts)
    if lower:
        data = LOWER[data]
    none = np.zeros(0, np.int64)
    if not len(data):
        return Words(data, off, none, none, none, np.zeros(0, np.uint64))
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    row = np.searchsorted(off, starts, side="right") - 1
    return Words(data, off, starts, ends, row, hash_spans(data, starts, ends) if hashes else None)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE, step: int = 1 << 15) -> np.ndarray:
    """Polynomial (Rabin-Karp) hash of each word's bytes modulo 2**64, in blocks of words; no word is empty."""
    out = np.empty(len(starts), dtype=np.uint64)
    for i in range(0, len(starts), step):
        s, e = starts[i : i + step], ends[i : i + step]
        size = e - s
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        inside = np.arange(int(size.sum())) - np.repeat(first, size)
        byte = data[inside + np.repeat(s, size)]
        out[i : i + step] = np.add.reduceat(table[byte] * _powers(int(size.max()))[inside], first)
    return mix(out)


def windows(words: Words, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of every ``width``-word window that lies in one row."""
    n = len(words.row) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.row[:n] == words.row[width - 1 :])
    h = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        h += words.hash[j : j + n] * _COEF[salt, j]
    return at, mix(h[at])


def slices(batch: pa.RecordBatch | pa.Table, column: str, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch | pa.Table]:
    """Consecutive parts of a batch with at most ``most_bytes`` of text each, or one row."""
    if batch.num_rows == 0:
        return
    col = batch.column(column)
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False) if not isinstance(col, pa.ChunkedArray) else pc.fill_null(pc.binary_length(col), 0).to_numpy(), dtype=np.int64)
    begin, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > begin and held + n > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    yield batch.slice(begin)
    if sum(size.tolist()) > most_bytes:
        give_back()
