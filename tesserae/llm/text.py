"""Words, 64-bit word hashes and shingles over whole texts, with NumPy.

Words follow the pattern ``[^\\x20\\x09-\\x0D]+``: ``bytes.split()`` without an
argument splits at exactly those six ASCII characters, and ``bytes.lower()``
maps only A-Z.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)

#: ASCII letters in lower case, digits and all bytes of longer characters stay; the rest parts tokens.
TOKEN_BYTES = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class WordHasher(dict):
    """64-bit hash of each word; the memory of past words is bounded."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def tokens(text: str) -> list[bytes]:
    """Lower-cased runs of letters and digits."""
    return text.lower().encode().translate(TOKEN_BYTES).split()


def rolling(w: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbours."""
    h = w[: len(w) - size + 1].copy()
    for k in range(1, size):
        h = h * _ODD + w[k : len(w) - size + 1 + k]
    return mix(h)


def shingles(w: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle of all its words."""
    if not len(w):
        return w
    if len(w) < size:
        h = np.array([len(w)], np.uint64)
        for x in w:
            h = h * _ODD + x
        return mix(h + _M2)
    return np.unique(rolling(w, size))


SPACES = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """The number of words of a text; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"[{SPACES}]+", -1))).cast("long")
