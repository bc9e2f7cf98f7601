"""Minimal perfect hashing of distinct 64-bit keys: n keys, the places 0 to n - 1.

A level is a row of bits, about twice as many as keys. A key that no other key
meets on it sets its bit; the others go on to the next level. A key's place is
the number of bits set before its own, over all levels. What is left after the
last level is told apart by order.
"""

from __future__ import annotations

import numpy as np

LEVELS = 32
_WORD = 64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key; another seed gives other bits."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Places of known keys. Any other key may be given a place too: compare the key that has it."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest
        ahead, self.ahead = 0, []
        for words in levels:
            below = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.ahead.append(ahead + np.r_[0, below[:-1]])
            ahead += int(below[-1])
        self.of_rest, self.size = ahead, ahead + len(rest)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """A hash of ``keys``, which are distinct."""
        levels, left = [], keys.astype(np.int64)
        while len(left) and len(levels) < LEVELS:
            n_words = max(1, -(-2 * len(left) // _WORD))
            at = mixed(left, len(levels)) % np.uint64(n_words * _WORD)
            met = np.bincount(at.astype(np.int64), minlength=n_words * _WORD)
            bits = np.packbits(met == 1, bitorder="little")
            levels.append(bits.view("<u8").astype(np.uint64))
            left = left[met[at.astype(np.int64)] > 1]
        return cls(levels, np.sort(left))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for one that is certainly unknown."""
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            if not len(open_):
                return found
            at = mixed(keys[open_], level) % np.uint64(len(words) * _WORD)
            word, bit = (at // np.uint64(_WORD)).astype(np.int64), at % np.uint64(_WORD)
            here = words[word] >> bit
            hit = (here & np.uint64(1)).astype(bool)
            before = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            found[open_[hit]] = (self.ahead[level][word] + np.bitwise_count(before))[hit]
            open_ = open_[~hit]
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            known = self.rest[at] == keys[open_]
            found[open_[known]] = self.of_rest + at[known]
        return found

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels), len(self.rest)], "<i8")
        return b"".join([head.tobytes(), *(w.astype("<u8").tobytes() for w in self.levels), self.rest.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n + 1, 8).tolist()
        at, levels = 8 * (n + 2), []
        for size in sizes[:-1]:
            levels.append(np.frombuffer(data, "<u8", size, at).astype(np.uint64))
            at += 8 * size
        return cls(levels, np.frombuffer(data, "<i8", sizes[-1], at).astype(np.int64))


class CountTable:
    """Counts of keys, held in a dense vector at the keys' places; keys are compared when looked up."""

    def __init__(self, hash_: PerfectHash, keys: np.ndarray, counts: np.ndarray) -> None:
        self.hash, self.keys, self.counts = hash_, keys, counts

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's count and whether the key is in the table; 0 if not."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = self.hash.places(keys)
        known = (at >= 0) & (self.keys[at] == keys)
        return np.where(known, self.counts[at], 0), known


def in_places(hash_: PerfectHash, keys: np.ndarray) -> np.ndarray:
    """The keys in the order of their places."""
    ordered = np.empty(len(keys), np.int64)
    ordered[hash_.places(keys)] = keys
    return ordered
