"""Compact bytes for arrays of numbers that travel in one shuffled row."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(numbers: np.ndarray) -> bytes:
    """Variable-length bytes, seven bits each, of non-negative numbers."""
    n = np.asarray(numbers).astype(np.uint64)
    if not len(n):
        return b""
    top = int(n.max())
    width = np.ones(len(n), dtype=np.int64)
    for k in range(7, max(top.bit_length(), 1), 7):
        width += n >= np.uint64(1 << k)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]), dtype=np.uint8)
    start = ends - width
    for k in range(int(width.max())):
        has = width > k
        low = (n[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[start[has] + k] = low.astype(np.uint8) | ((width[has] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The numbers of ``pack``, as int64."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.empty(0, dtype=np.int64)
    last = np.flatnonzero(b < 128)
    start = np.concatenate([[0], last[:-1] + 1])
    out = np.zeros(len(last), dtype=np.uint64)
    for k in range(int((last - start).max()) + 1):
        has = start + k <= last
        out[has] |= (b[start[has] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return out.view(np.int64)


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)
