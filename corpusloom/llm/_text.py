"""Flat numpy views of Arrow text columns: words, spans and their 64-bit hashes, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def coefficients(n: int, seed: int) -> np.ndarray:
    """``n`` odd pseudo-random 64-bit factors."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed * 0xD1342543DE82EF95 % 2**64)
    return mix(x) | U(1)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    column = pc.fill_null(column, b"" if kind == pa.large_binary() else "") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The rows again, in pieces of about ``limit`` bytes of text (one row at least), so that memory follows the
    limit and the longest text, not Arrow's row count."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than ASCII white space), and where each row's words begin."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ink = ~SPACE[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edge = offs[:-1][offs[:-1] < n]
    first[edge] = ink[edge]
    edge = offs[1:][offs[1:] > 0] - 1
    last[edge] = ink[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each of the ordered, disjoint spans."""
    out = np.empty(len(starts), np.uint64)
    length = ends - starts
    factor = coefficients(int(length.max(initial=0)) + 1, seed)
    # Blocks of about a million bytes bound the memory of what is computed for each byte.
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 20), "right")))
        base, stop = starts[i], ends[j - 1]
        n = length[i:j]
        size = np.diff(np.append(starts[i:j], stop))
        at = np.arange(stop - base) - np.repeat(starts[i:j] - base, size)
        reach = np.repeat(n, size)
        value = factor[np.minimum(at, reach)]
        value *= data[base:stop].astype(np.uint64) + U(1)
        if (size != n).any():
            value[at >= reach] = 0
        out[i:j] = np.add.reduceat(value, starts[i:j] - base)
        i = j
    return mix(out ^ (length.astype(np.uint64) * U(0x9E3779B97F4A7C15)))


def rolling(h: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """The hash of each ``k`` consecutive hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = coefficients(k, seed)
    out = h[:n] * c[0]
    for i in range(1, k):
        out += h[i : i + n] * c[i]
    return mix(out)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, fill: int | None = None) -> np.ndarray:
    """The bytes (or values) of the given spans, one after the other; with ``fill``, also beyond the end of the data."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return data[:0]
    at = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
    if fill is not None:
        return np.where(at < len(data), data[np.minimum(at, len(data) - 1)], data.dtype.type(fill))
    return data[at]


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def unique_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ordered, disjoint spans the number of its distinct content, and the first span of each content."""
    import pandas as pd

    codes, values = pd.factorize(span_hash(data, starts, ends))
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    length = ends - starts
    like = first[codes]
    same = bool((length == length[like]).all())
    step = max(1, (1 << 20) * len(starts) // max(1, int(length.sum())))
    for i in range(0, len(starts) if same else 0, step):
        n, a, b = length[i : i + step], starts[i : i + step], starts[like[i : i + step]]
        same = same and bool((gather(data, a, n) == gather(data, b, n)).all())
    return (codes, first) if same else (np.arange(len(starts)), np.arange(len(starts)))
