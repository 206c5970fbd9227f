"""Texts as arrays of 64-bit word hashes, inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
#: What each of the first 256 characters is when words are split at blanks: itself in a word, else a blank.
_PLAIN = bytes(c if WORD.match(chr(c)) else 32 for c in range(256))
#: Words that a worker remembers before it starts anew.
MEMORY = 200_000


class Memory(dict):
    """word -> make(word), filled as words come up."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, word):
        if len(self) >= MEMORY:
            self.clear()
        out = self[word] = self._make(word)
        return out


HASHES = Memory(xxhash.xxh3_64_intdigest)
#: Odd multipliers from one generator: place j of a window, and function i of a family.
ODD = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[str]:
    """The lower-cased text's matches of WORD, in order; texts of the first 256 characters go without the slower expression."""
    text = (text or "").lower()
    try:
        return text.encode("latin-1").translate(_PLAIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(text)


def hashes(text: str | None) -> np.ndarray:
    """One hash for each word of the lower-cased text."""
    found = words_of(text)
    return np.fromiter(map(HASHES.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def windows(words: np.ndarray, offsets: list[int] | range) -> np.ndarray:
    """A hash for each place of the words at the given offsets from it; none if there are too few words."""
    n = len(words) - max(offsets)
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, o in enumerate(offsets):
        total += words[o : o + n] * ODD[j]
    return mixed(total)
