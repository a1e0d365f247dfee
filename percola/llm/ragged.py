"""Texts as one byte buffer and offsets: words, their 64-bit hashes and windows of them, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

_bytes = np.arange(256)
#: Maps of a byte to its value plus 1; 0 separates words.
SPACED = np.where(np.isin(_bytes, [9, 10, 11, 12, 13, 32]), 0, _bytes + 1).astype(np.uint16)
SPACED_LOWER = SPACED.copy()
SPACED_LOWER[65:91] += 32
ALNUM_LOWER = np.where((_bytes >= 128) | ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122)), _bytes + 1, 0).astype(np.uint16)
ALNUM_LOWER[65:91] = _bytes[97:123] + 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i <= n, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for key, base in (("up", _P), ("down", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of h reaches every bit of the result."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n+1 offsets into them; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or column.type != pa.large_string() else column
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or not len(off) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def fixed(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    """Rows of a binary column whose values, none null, are all `width` bytes."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if len(column) else np.zeros(0, np.uint8)
    return flat.reshape(-1, width).view(dtype)


def binary(rows: np.ndarray) -> pa.Array:
    """The inverse of fixed()."""
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.Array.from_buffers(pa.binary(flat.shape[1]), len(rows), [None, pa.py_buffer(flat.reshape(-1))]).cast(pa.binary())


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` text bytes; one longer text makes a run of its own."""
    if not batch.num_rows:
        return
    _, off = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The mapped bytes; each word's begin and end; for each text (and the end) its first word's index."""
    mapped = table[buf]
    inside = mapped != 0
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return mapped, begin, end, np.searchsorted(begin, off)


def word_hashes(mapped: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span."""
    up, down = powers(len(mapped))
    total = np.zeros(len(mapped) + 1, np.uint64)
    np.cumsum(mapped * up[: len(mapped)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, at the index of the first; runs across texts are for the caller to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _P + hashes[j : n + j]
    return mix(out)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def grouped_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
