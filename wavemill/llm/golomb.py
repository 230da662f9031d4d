"""Golomb-Rice coding of sorted 64-bit numbers, in numpy.

Gaps are divided by 2**k, with k from their mean; the quotients are coded in unary and the remainders in k bits, in two
streams, so that both coding and decoding work on whole arrays.
"""

from __future__ import annotations

import math

import numpy as np


def encode(numbers: np.ndarray) -> bytes:
    """Sorted distinct unsigned numbers, as bytes: count u32, k u8, first u64, unary bits, remainder bits."""
    n = len(numbers)
    if not n:
        return (0).to_bytes(4, "little")
    gaps = np.diff(numbers)
    mean = float(numbers[-1] - numbers[0]) / max(1, n - 1)
    k = max(0, min(63, math.floor(math.log2(max(1.0, mean * math.log(2))))))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    low = np.zeros((len(gaps), k), np.uint8)
    for bit in range(k):
        low[:, bit] = (gaps >> np.uint64(bit)) & np.uint64(1)
    head = n.to_bytes(4, "little") + bytes([k]) + int(numbers[0]).to_bytes(8, "little") + len(unary).to_bytes(8, "little")
    return head + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def decode(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    if not n:
        return np.zeros(0, np.uint64)
    k, first, size = raw[4], int.from_bytes(raw[5:13], "little"), int.from_bytes(raw[13:21], "little")
    unary = np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), 21), count=size)
    ones = np.flatnonzero(unary)
    gaps = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    low = np.unpackbits(np.frombuffer(raw, np.uint8, offset=21 + -(-size // 8)), count=(n - 1) * k).reshape(n - 1, k)
    for bit in range(k):
        gaps |= low[:, bit].astype(np.uint64) << np.uint64(bit)
    return np.cumsum(np.concatenate([[np.uint64(first)], gaps]), dtype=np.uint64)
