"""Codebooks of bipolar vectors.

`packed` derives a vector from SHA-256 digests of a label, so any SQL engine gets the same one; a set bit
is -1, and 32 coordinates share a word. Binding two bipolar vectors is the exclusive or of their words.
`Twister` draws the vectors of the published studies, word for word, from a Mersenne Twister.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 32
DIGEST_BITS = 256


def packed(label: Column, dimension: int) -> Column:
    """Words of the vector that a label names."""
    digests = F.concat(*(F.sha2(F.concat_ws("|", label, F.lit(str(b))), 256) for b in range(dimension // DIGEST_BITS)))
    words = F.sequence(F.lit(0), F.lit(dimension // WORD_BITS - 1))
    return F.transform(words, lambda k: F.conv(F.substr(digests, k * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def bound(a: Column, b: Column) -> Column:
    """Packed bind."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def unpacked(words: np.ndarray) -> np.ndarray:
    """Coordinates (+1, -1) of packed vectors, one row each."""
    bits = np.unpackbits(words.astype(">u4").view(np.uint8).reshape(len(words), -1), axis=1)
    return (1 - 2 * bits.astype(np.int8)).astype(np.int8)


class Twister:
    """The draws of the published studies (their generator's 32-bit words, in order)."""

    def __init__(self, seed: int):
        self._words = np.random.RandomState(seed)

    def words(self, n: int) -> np.ndarray:
        return self._words.randint(0, 1 << 32, n, dtype=np.uint32) if n else np.zeros(0, np.uint32)

    def categories(self, n: int, cardinality: int) -> np.ndarray:
        return (self.words(n) % cardinality).astype(np.int64)

    def bipolar(self, n: int, dimension: int) -> np.ndarray:
        """n vectors; a coordinate takes two words and the sign of bit 20 of the first."""
        first = self.words(2 * n * dimension)[::2]
        return np.where(first & (1 << 20), 1, -1).astype(np.int8).reshape(n, dimension)

    def levels(self, n: int, dimension: int) -> np.ndarray:
        """n ordered levels between two random endpoints."""
        ends = self.bipolar(2, dimension)
        cut = (self.words(dimension) & 0xFFFFFF) * 2.0**-24
        return np.stack([np.where(cut < 1 - i / (n - 1), ends[0], ends[1]) for i in range(n)])
