"""A minimal perfect hash of 64-bit keys: levels of bit arrays, each key placed where it is alone.

A key that shares its bit with another goes on to the next level; its slot is the number of set bits before its own.
About 3 bits a key, looked up in a constant expected number of steps. Keys that no level takes, which twice the keys'
number of bits makes vanishingly rare, are kept as they are.
"""

from __future__ import annotations

import numpy as np

from .flat import mix

LEVELS = 48


def _at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return mix(keys.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(bits)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """words: the bit arrays of all levels, 64 bits a word; before: set bits before each word; sizes: words of each level."""

    def __init__(self, words: np.ndarray, before: np.ndarray, sizes: np.ndarray, rest: np.ndarray):
        self.words, self.before, self.sizes, self.rest = words, before, sizes, rest

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct int64."""
        levels, left = [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            words = max(1, -(-2 * len(left) // 64))
            at = _at(left, level, 64 * words)
            alone = np.bincount(at.astype(np.int64), minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at.astype(np.int64)]]
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(words, (np.cumsum(counts) - counts).astype(np.uint32), np.array([len(x) for x in levels], np.int64), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that wasn't built in gets -1 or any slot, which its fingerprint tells."""
        slot = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _at(keys[open_], level, 64 * size)
            word = self.words[base + (at >> np.uint64(6)).astype(np.int64)]
            bit = at & np.uint64(63)
            hit = (word >> bit) & np.uint64(1) == 1
            inside = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[open_[hit]] = (self.before[base + (at >> np.uint64(6)).astype(np.int64)] + inside)[hit]
            open_, base = open_[~hit], base + size
        if len(self.rest) and len(open_):
            place = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[place] == keys[open_]
            slot[open_[found]] = int(np.bitwise_count(self.words).sum()) + place[found]
        return slot
