"""Batches of texts as numpy arrays: words, word hashes, n-grams and sliding minima.

A batch is one byte array with document offsets, so that every step below is a few
array operations for thousands of documents. All hashes are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
BATCH_BYTES = 2 << 20

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(0, 2**64, (64, 256), dtype=np.uint64)
_ONE, _TWO, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of `column` (or one longer row)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def byte_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each row begins (one more entry than rows)."""
    column = pc.fill_null(column, b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0]:offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word `[^\\x20\\x09-\\x0D]+`, and each row's first word (one more entry than rows)."""
    inside = ~BLANKS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _ONE
    x = (x ^ (x >> np.uint64(27))) * _TWO
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a sum of random numbers for each byte at its place in the word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    value = _TABLE[place & 63, data[place + np.repeat(starts, lengths)]]
    if lengths.max() > 64:
        value = value * ((place >> 6) * 2 + 1).astype(np.uint64)
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def byte_hashes(data: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each byte."""
    return _TABLE[0][data]


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order."""
    return mix(a * _ODD + b)


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of every `k` consecutive units, by doubling; entry i starts at unit i."""
    result, done, power, size = None, 0, units, 1
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while k:
        if k & 1:
            part = power[done:done + n]
            result = part if result is None else joined(result, part)
            done += size
        k >>= 1
        if k:
            power, size = joined(power[:-size], power[size:]), size * 2
    return result


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` consecutive entries."""
    n, size = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[:n], x[width - size:width - size + n])


def whole(first: np.ndarray, width: int) -> np.ndarray:
    """Mask over the `width`-windows of the concatenation: inside one row. `first`: each row's first unit."""
    n = int(first[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + width <= ends[:n]


def anchored_runs(units: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut all windows into runs whose smallest k-gram is the same occurrence.

    Returns each run's k-gram hash, first window and number of windows. Equal windows have
    the same hash, wherever they stand, and two equal windows are never in one run.
    """
    valid = whole(first, window)
    if not valid.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = grams(units, k)
    least = sliding_min(gram, window - k + 1)[:len(valid)]
    begins = np.ones(len(valid), bool)
    begins[1:] = (least[1:] != least[:-1]) | (gram[:len(valid) - 1] == least[:-1]) | ~valid[:-1]
    begins &= valid
    starts = np.flatnonzero(begins)
    stops = np.append(starts[1:], len(valid))
    counts = np.concatenate([[0], np.cumsum(valid)])
    return least[starts], starts, counts[stops] - counts[starts]
