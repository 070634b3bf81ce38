"""Vectorised text kernels over Arrow buffers: words, hashes and shingles without a Python loop per word.

A batch of texts is one byte array with document offsets. Word hashes are polynomial
hashes modulo 2**64 over random byte values, read off one running sum, so that the cost is
a few array operations per byte whatever the number of words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
#: Texts are handled in slices of about so many bytes, which bounds the temporary arrays.
SLICE_BYTES = 1 << 19


def _lut(chars: bytes) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(chars)] = False
    return out


#: Bytes of the words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
PLAIN = _lut(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM = _lut(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_VALUES_LOWER = _VALUES[_LOWER]
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = max(n, 1 << 16)
        base = _R if kind == "up" else _R_INV
        have = np.full(size, U64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:  # a very long text gets its own, which is not kept
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=len(column) + 1, offset=column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def release() -> None:
    """Give freed memory back at a task's end, or when the driver has fitted a model: Python workers live on beside the next task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about `most` bytes; a longer text stands alone."""
    data, offs = raw(column)
    at, n = 0, len(offs) - 1
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end
    release()


class Words:
    """Words of a slice: starts, ends (byte positions), bounds (first word of each document, and the end)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray):
        inside = kind[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offs] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.bounds = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.bounds)
        self._data = data

    def hashes(self, lower: bool = True) -> np.ndarray:
        values = (_VALUES_LOWER if lower else _VALUES)[self._data]
        values *= _power("up", len(values))
        total = np.zeros(len(values) + 1, U64)
        np.cumsum(values, out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * _power("down", len(values) + 1)[self.starts])

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


_STEPS = np.array([pow(_R, 7 * (j + 1), 1 << 64) for j in range(64)], dtype=U64)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of `width` words; a shorter, non-empty document is one run."""
    n, counts = len(hashes), np.diff(bounds)
    document = np.repeat(np.arange(len(counts)), counts)
    out, doc = np.zeros(0, U64), np.zeros(0, np.int64)
    if n >= width:
        out = hashes[: n - width + 1] * _STEPS[0]
        for j in range(1, width):
            out = out + hashes[j : n - width + 1 + j] * _STEPS[j]
        whole = document[: n - width + 1] == document[width - 1 :]
        out, doc = mix(out[whole] + U64(width)), document[: n - width + 1][whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        one = np.array([sum(int(h) * int(s) for h, s in zip(hashes[bounds[d] : bounds[d + 1]], _STEPS, strict=False)) + int(counts[d]) & (1 << 64) - 1 for d in short], dtype=U64)
        out, doc = np.concatenate([out, mix(one)]), np.concatenate([doc, short])
    return out, doc
