"""Array kernels over UTF-8 text, shared by the operators that run in Arrow batches.

Texts are handled as one byte buffer with offsets, in blocks of bounded size, so that a worker's
memory does not depend on how many rows an Arrow batch holds. A single text is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Bytes of text worked on at once; a longer text makes a block of its own.
BLOCK = 1 << 19

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not every C library has it
    _trim = None

if TaskContext.get() is not None:
    # in a worker, Arrow's own pools would keep their peak; what comes from the system is given back to it
    pa.set_memory_pool(pa.system_memory_pool())

_U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _seeded(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit words, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits each depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _seeded(256, 11) | _U(1)
_BASE = _U(0xD1342543DE82EF95)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + BLOCK // 4)
        for k, b in enumerate((_BASE, _INVERSE)):
            t = np.full(size, b, _U)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def give_back() -> None:
    """Returns freed memory to the machine: workers live on between tasks, and beside the JVM every one's peak would stay."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for consecutive blocks; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    give_back()


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs where inside holds, cut at texts' borders, and for each text the place of its first run (one more at the end)."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the words ``[^\\x20\\x09-\\x0D]+``."""
    return spans(~WHITE[data], offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one prefix sum over the whole block."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ (ends - starts).astype(_U))


def window_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k units that stay inside one text, and for each text the place of its first window.

    h holds the units' hashes, first the place of each text's first unit."""
    sizes = np.maximum(np.diff(first) - (k - 1), 0)
    if len(h) < k or not sizes.any():
        return np.zeros(0, _U), np.zeros(len(first), np.int64)
    acc = np.zeros(len(h) - k + 1, _U)
    for j in range(k):
        acc *= _BASE
        acc += h[j : len(h) - k + 1 + j]
    ptr = np.zeros(len(first), np.int64)
    np.cumsum(sizes, out=ptr[1:])
    return mix(acc[ragged(first[:-1], sizes)] + _U(k)), ptr


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (sizes[0] places), starts[1], ..."""
    total = int(sizes.sum())
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return out


def group_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values[ptr[i]:ptr[i+1]], with 0 for empty groups."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]


class HashIndex:
    """Sorted distinct 64-bit keys with a table over their leading bits; find() gives places, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, _U(0xFFFFFFFFFFFFFFFF))
        bits = max(1, min(20, int(len(keys)).bit_length()))
        self.shift = _U(64 - bits)
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=_U) << self.shift).astype(np.int32)
        self.last = len(keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self.start[(h >> self.shift).astype(np.int64)]
        got = self.keys[at]
        todo = np.flatnonzero(got < h)
        while len(todo):
            at[todo] += 1
            got[todo] = now = self.keys[at[todo]]
            todo = todo[(now < h[todo]) & (at[todo] < self.last)]
        return np.where((got == h) & (at < self.last), at, -1)
