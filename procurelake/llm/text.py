"""Arrow text columns as numpy arrays, and the hashes that the operators share.

Texts stay UTF-8 bytes in Arrow's own buffer; nothing here makes a Python string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass holds; a longer document is a pass of its own.
BLOCK = 1 << 20
_U = np.uint64

#: The white space that separates words, bytes 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose low and high bits both depend on all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers modulo 2**64, and their inverses."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, BLOCK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        p, q = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
        p[0] = q[0] = 1
        _powers = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is an empty text; offsets begin at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, where, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most `limit` bytes of text, or one row: (rows, bytes, offsets)."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, documents) of all words; none crosses from one document to the next."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~SPACE[data]
    begin = inside[:-1].copy()
    begin[1:] &= ~inside[:-2]
    edge = offsets[1:-1][offsets[1:-1] < len(data)]
    begin[edge] = inside[edge]
    starts = np.flatnonzero(begin)
    stop = ~inside[1:] & inside[:-1]
    stop[edge[edge > 0] - 1] |= inside[edge[edge > 0] - 1]
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: a polynomial modulo 2**64, mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lowered, its document)."""
    low = LOWER[data]
    starts, ends, doc = words(low, offsets)
    return span_hashes(low, starts, ends), doc


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after the other."""
    counts = np.asarray(counts, np.int64)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
