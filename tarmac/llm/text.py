"""Words of Arrow text columns as numpy arrays of 64-bit hashes.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z in lower case. All bytes of a
chunk are hashed together: prefix sums of byte codes times powers of an odd base give the hash of
any slice, and a final mixing step spreads it over 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
IS_NO_LETTER = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b > 127) for b in range(256)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)[FOLD] | U(1)
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, as far as needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, CHUNK_BYTES + 1)
            inverse = U(pow(int(BASE), -1, 1 << 64))
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate(([U(1)], np.full(n - 1, b)))) for b in (BASE, inverse))
        return cls.up[:n], cls.down


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if col.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; `apart` marks the bytes between words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~apart[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    head = word.copy()
    head[1:] &= ~word[:-1] | edge[1:n]
    tail = word.copy()
    tail[:-1] &= ~word[1:] | edge[1:n]
    start = np.flatnonzero(head)
    return start, np.flatnonzero(tail) + 1, np.searchsorted(offsets, start, "right") - 1


def running(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which sliced() hashes any slice of `data`."""
    up, _ = _Powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * up[: len(data)], out=sums[1:])
    return sums


def sliced(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each slice start:end, letters in lower case."""
    _, down = _Powers.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return sliced(running(data), start, end)


def hashed(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, word hashes, and number of words of each row, chunk by chunk."""
    data, offsets = string_buffers(col)
    for a, b in spans(offsets, limit):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, row = words(part, at)
        yield a, b, slice_hashes(part, start, end), np.bincount(row, minlength=b - a)
