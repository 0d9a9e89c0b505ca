"""Array kernels over batches of texts, shared by the corpus operators.

A batch of texts is one flat ``uint8`` buffer with row offsets.  Hashes of
arbitrary ranges come from prefix sums of a polynomial modulo 2**64: with
``P[i] = sum(v[j] * B**j for j < i)`` the hash of ``[s, e)`` is
``(P[e] - P[s]) * B**-s``, finished with a bit mixer, so every window of a
batch costs a few vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about this many bytes (one longer text is a slice of its own).
SLICE_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that ``column`` holds about ``limit`` bytes in each piece."""
    for rb in batches:
        if rb.num_rows == 0:
            continue
        col = rb.column(rb.schema.get_field_index(column))
        size = np.frombuffer(pc.binary_length(col).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), dtype=np.int64)
        total = np.cumsum(size)
        at = 0
        while at < rb.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield rb.slice(at, end - at)
            at = end
        del rb, col
        pa.default_memory_pool().release_unused()  # workers are reused: what a batch took goes back


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary column; null counts as empty."""
    col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finishes a 64-bit hash (all output bits depend on all input bits)."""
    t = h >> np.uint64(30)
    h = np.bitwise_xor(h, t, out=t)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    t = h >> np.uint64(27)
    h ^= t
    h *= np.uint64(0x94D049BB133111EB)
    np.right_shift(h, np.uint64(31), out=t)
    h ^= t
    return h


def _power(kind: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            p = np.full(size, np.uint64(_BASE if kind > 0 else _BASE_INV), dtype=np.uint64)
            p[0] = 1
            have = np.multiply.accumulate(p)
        if size <= 1 << 23:
            _powers[kind] = have
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``ranges`` reads hashes; ``values`` are uint64."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    if len(values):
        np.cumsum(values * _power(1, len(values)), out=out[1:])
    return out


def ranges(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ``[start, end)``; equal sequences hash alike wherever they stand."""
    return mix((pre[end] - pre[start]) * _power(-1, len(pre))[start])


def every(pre: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``[i, i + width)`` for every i, without gathering."""
    n = len(pre) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = pre[width:] - pre[:n]
    h *= _power(-1, n)
    return mix(h)


#: A random value for each byte, so that sums of neighbouring byte values say nothing.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of a batch: maximal runs of bytes that are no separators, never across rows.

    ``start``/``end`` are positions in the flat buffer, ``first`` (rows + 1)
    the number of words before each row.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
        word = ~separator[raw]
        before = np.empty(len(raw) + 1, dtype=bool)
        before[1:] = word
        before[0] = False
        inner = offsets[(offsets > 0) & (offsets < len(raw))]
        opens = word & ~before[:-1] if len(raw) else word
        opens[inner] = word[inner]
        closes = word.copy()
        if len(raw):
            closes[:-1] &= ~word[1:]
            closes[inner - 1] = word[inner - 1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n = np.diff(self.first)
        self.offsets, self.raw = offsets, raw

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        raw = self.raw if fold is None else fold[self.raw]
        return ranges(prefix(BYTE_VALUE[raw]), self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)

    def windows(self, word_hash: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(index of the first word, hash)`` of each run of ``k`` words within a row."""
        per = np.maximum(self.n - k + 1, 0)
        at = spread(self.first[:-1], per)
        return at, ranges(prefix(word_hash), at, at + k) if len(at) else np.zeros(0, np.uint64)


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...`` (``count[i]`` of them) for each i, joined."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(count)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - count), count)
