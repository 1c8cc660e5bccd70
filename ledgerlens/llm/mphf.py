"""Minimal perfect hashes of sets of 64-bit keys, by levels of bits.

Each level hashes the keys that are left to somewhat more bits than there are keys
and sets the bits that one key alone meets; the others go on to the next level. A
key's number is how many bits are set before its own: no two keys share one, and
none is left out. Numbers say nothing of keys outside the set, so whoever looks a
key up compares the key that is kept at its number.
"""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that meets it.
ROOM = 1.5


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Keys as evenly spread unsigned 64-bit numbers, others for each seed."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def built(keys: np.ndarray) -> list[int | bytes]:
    """The levels of distinct ``keys``: sizes in bits, and the bits."""
    sizes, words = [], []
    left = keys
    while len(left):
        size = -(-int(ROOM * len(left) + 1) // 64) * 64
        at = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~alone[at]]
    return sizes, np.concatenate(words) if words else np.zeros(0, dtype="<u8")


class Hash:
    """Numbers of keys: ``sizes`` and ``words`` as ``built`` gives them."""

    def __init__(self, sizes, words: np.ndarray):
        self.sizes, self.words = [int(s) for s in sizes], np.asarray(words, dtype="<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.n = int(ones.sum())

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where no bit is met (such a key isn't in the set)."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left, base = np.arange(len(keys)), 0
        for seed, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (mixed(keys[left], seed) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.before[at[hit] >> 6] + below
            left, base = left[~hit], base + size
        return out
