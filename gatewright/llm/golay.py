"""The perfect binary Golay code (23, 12, 7) as lookup tables, and fuzzy keys made from it.

Every 23-bit word lies within distance 3 of exactly one codeword. `keys` gives a word the
index of that codeword and, when it lies at distance 3, of the five codewords at distance 4.
Two words that differ in one bit share a key: either they decode alike, or both lie at
distance 3 and the codeword of each lies at distance 4 from the other.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed values of the code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, word length, check bits.
GENERATOR, LENGTH, CHECK = 0b110001110101, 23, 11


def remainder(word: int) -> int:
    """`word` modulo the generator: its 11-bit syndrome."""
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of single bits, error by syndrome, key differences by syndrome: 2048 x 6, -1 for none)."""
    single = np.array([remainder(1 << b) for b in range(LENGTH)], dtype=np.int32)
    error = np.zeros(1 << CHECK, dtype=np.int32)
    weight = np.zeros(1 << CHECK, dtype=np.int8)
    triples = {}
    for size in range(4):
        for bits in combinations(range(LENGTH), size):
            syndrome = 0
            for b in bits:
                syndrome ^= int(single[b])
            error[syndrome], weight[syndrome] = sum(1 << b for b in bits), size
            if size == 3:
                triples[syndrome] = bits
    through: dict[tuple[int, ...], list[int]] = {}
    for message in range(1 << (LENGTH - CHECK)):
        word = message << CHECK
        word |= remainder(word)
        if word.bit_count() == 7:
            for bits in combinations([b for b in range(LENGTH) if word >> b & 1], 3):
                through.setdefault(bits, []).append(message)
    other = np.full((1 << CHECK, 6), -1, dtype=np.int32)
    other[:, 0] = 0
    for syndrome, bits in triples.items():
        other[syndrome, 1:] = through[bits]
    return single, error, other


def keys(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word up to six 12-bit codeword indices; -1 fills unused places."""
    single, error, other = tables()
    syndrome = np.zeros(len(words), dtype=np.int32)
    for b in range(LENGTH):
        syndrome ^= np.where(words >> b & 1, single[b], 0).astype(np.int32)
    base = (words ^ error[syndrome]) >> CHECK
    more = other[syndrome]
    return np.where(more >= 0, base[:, None] ^ more, -1)
