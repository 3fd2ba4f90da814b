"""Hashes of all words and word windows of many texts at once.

A word is a run of bytes other than space and the five ASCII line and tab characters. Words are hashed by XXH3, which
is not linear in their bytes; a window's hash is a polynomial in its words' hashes, taken from prefix sums modulo 2**64, so
windows cost the same whatever their length. Windows are far too short (under 2**10 words) for the sequences that
collide under every such polynomial; where equality must not rest on that, the bytes themselves are digested.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

WORD_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every input bit spread over all output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n at least."""
    return _powers(base, 1 << max(12, (n - 1).bit_length()))


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i; length len(values) + 1."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(base, len(values) + 1)[: len(values)])])


def ranges(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[start:end], equal wherever the values are."""
    inverse = pow(base, -1, 1 << 64)
    return mixed((prefix[ends] - prefix[starts]) * powers(inverse, len(prefix))[starts])


class Words:
    """Words of a batch of UTF-8 texts: 64-bit hashes, and per text the range of its words."""

    def __init__(self, texts: list[bytes]):
        found = [t.split() for t in texts]  # at just the six characters that end a word
        self.counts = np.array([len(x) for x in found], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.words = [w for x in found for w in x]
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of ``size`` words that lie in one text."""
        each = np.maximum(self.counts - size + 1, 0)
        return np.repeat(self.bounds[:-1] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for each i that has so many."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
