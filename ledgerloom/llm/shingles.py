"""Word shingles as 64-bit fingerprints, and minwise signatures of their sets."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words per shingle.
WORDS = 5

_MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.uint64(31)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit over all the others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> _SHIFT)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case.

    ``bytes.lower`` and ``bytes.split`` know ASCII only: exactly the letters and
    the six white space characters that are meant.
    """
    return (text or "").encode().lower().split()


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """The sorted fingerprints of the distinct shingles of ``width`` words.

    A text with fewer words counts as one shingle, a text without words as none.
    """
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - width + 1
    total = hashes[:count].copy()
    for i in range(1, width):
        total *= _MULTIPLIERS[i]
        total += hashes[i : i + count]
    return np.unique(_mix(total))


def multipliers(size: int, seed: int) -> np.ndarray:
    """Odd 64-bit factors, one per coordinate of a signature."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, size=size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(shingles: np.ndarray, factors: np.ndarray, block: int = 2048) -> np.ndarray:
    """For each factor the smallest image of the set, of which the high 32 bits are kept.

    Two sets agree in a coordinate with a probability equal to their Jaccard
    similarity. Works through a long set in blocks.
    """
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), block):
        images = factors[:, None] * shingles[None, i : i + block]
        np.minimum(best, images.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, hundredths: int) -> bool:
    """Whether 100 * |a and b| >= hundredths * |a or b|, on sorted distinct values."""
    if 100 * min(len(a), len(b)) < hundredths * max(len(a), len(b)) or not len(a):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= hundredths * (len(a) + len(b) - both)
