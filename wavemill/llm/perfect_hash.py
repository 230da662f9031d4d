"""A minimal perfect hash over distinct 64-bit keys, in numpy: levels of bit arrays, and ranks.

On each level the keys that are left are hashed to GAMMA slots a key; slots that one key alone reaches are marked and settle
it, the others go on to the next level. A key's number is the count of marked slots before its own, over all levels: each of n
keys gets one of 0..n-1, in about three bits a key and in constant time. What few keys are left after LEVELS are listed.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
LEVELS = 24
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """16 bits that tell a key apart from a stranger; independent of the levels' hashes."""
    return (mix(keys, 99) >> np.uint64(48)).astype("<u2")


class PerfectHash:
    """``levels`` is a list of packed bit arrays and their sizes; ``rest`` holds the keys that no level settled, in order."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray], rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.before, total = [], 0
        for packed in bits:  # ones before each byte, over all levels
            ones = np.bitwise_count(packed).astype(np.int64)
            self.before.append(total + np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else np.zeros(0, np.int64))
            total += int(ones.sum())
        self.settled = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys, sizes, bits = keys.astype(np.uint64), [], []
        while len(keys) and len(sizes) < LEVELS:
            size = max(64, int(len(keys) * GAMMA))
            slot = (mix(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little"))
            keys = keys[~alone[slot]]
        return cls(sizes, bits, np.sort(keys))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that was not built in, some number or -1."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, packed, before) in enumerate(zip(self.sizes, self.bits, self.before, strict=True)):
            if not len(left):
                return out
            slot = (mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            byte, bit = slot >> 3, (slot & 7).astype(np.uint8)
            hit = (packed[byte] >> bit) & 1 == 1
            below = np.bitwise_count(packed[byte] & ((np.uint8(1) << bit) - np.uint8(1)))
            out[left[hit]] = (before[byte] + below)[hit]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            same = self.rest[at] == keys[left]
            out[left[same]] = self.settled + at[same]
        return out
