"""Golomb-Rice codes of sorted integers and bitmaps, as numpy operations."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<IB")


def encode(values: np.ndarray) -> bytes:
    """Sorted, distinct, non-negative integers as one block.

    Gaps are cut into a unary quotient and ``k`` low bits; the two streams lie one
    after the other, so that both ends work without a loop over values.
    """
    n = len(values)
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(-1)) - 1
    mean = int(gaps.sum()) // max(n, 1)
    k = max(mean, 1).bit_length() - 1
    quotients, rest = gaps >> k, gaps & ((1 << k) - 1)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n else 0, dtype=np.uint8)
    unary[ends] = 1
    low = (rest[:, None] >> np.arange(k, dtype=np.int64)) & 1
    bits = np.concatenate([unary, low.astype(np.uint8).ravel()])
    return _HEAD.pack(n, k) + np.packbits(bits).tobytes()


def decode(block: bytes) -> np.ndarray:
    n, k = _HEAD.unpack_from(block)
    bits = np.unpackbits(np.frombuffer(block, dtype=np.uint8, offset=_HEAD.size))
    if not n:
        return np.empty(0, dtype=np.int64)
    ends = np.flatnonzero(bits)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    start = int(ends[-1]) + 1
    low = bits[start:start + n * k].reshape(n, k).astype(np.int64)
    rest = (low << np.arange(k, dtype=np.int64)).sum(axis=1)
    return np.cumsum((quotients.astype(np.int64) << k) + rest + 1) - 1
