"""Hashes and counts of a chunk as short binary cells, dealt out by ranges of hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ZSTD = pa.Codec("zstd")


def range_starts(ranges: int) -> np.ndarray:
    """First hash of each of so many equal ranges of 64-bit hashes."""
    return np.array([-(-(i << 64) // ranges) for i in range(ranges)], np.uint64)


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers by byte plane, compressed."""
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T).tobytes()
    return len(values).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(_ZSTD.decompress(data[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind)[:, 0] if n else np.zeros(0, kind)


def rising(values: np.ndarray) -> bytes:
    """Ascending hashes as differences."""
    return packed(np.diff(values, prepend=np.uint64(0)))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)
