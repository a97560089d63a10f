"""Fuzzy keys from the binary Golay code (23, 12): words at most two bits apart share a key.

Every 23-bit word lies within three bits of exactly one codeword. The keys of a word are the codewords of the word and
of its 23 neighbours (one or six different ones): two words at most two bits apart have a neighbour in common.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECKS = 23, 11


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of each syndrome."""
    bit = []
    for i in range(LENGTH):
        rest = 1 << i
        while rest >> CHECKS:
            rest ^= GENERATOR << (rest.bit_length() - 1 - CHECKS)
        bit.append(rest)

    def syndromes(first: int, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, np.int32)
        for i in range(bits):
            out[1 << i : 2 << i] = out[: 1 << i] ^ bit[first + i]
        return out

    errors = np.zeros(1 << CHECKS, np.int32)
    for weight in (1, 2, 3):
        for places in combinations(range(LENGTH), weight):
            syndrome = 0
            for i in places:
                syndrome ^= bit[i]
            errors[syndrome] = sum(1 << i for i in places)
    return syndromes(0, 12), syndromes(12, 11), errors


def index(words: np.ndarray) -> np.ndarray:
    """12-bit number of the codeword nearest to each 23-bit word."""
    low, high, errors = _tables()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> CHECKS


def keys(words: np.ndarray) -> np.ndarray:
    """Array (n, 6): the keys of each word, padded with -1."""
    words = np.asarray(words, np.int32)
    around = np.concatenate([[0], 1 << np.arange(LENGTH)]).astype(np.int32)
    found = np.sort(index(words[:, None] ^ around), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    out = np.full((len(words), 6), -1, np.int64)
    row, column = np.nonzero(new)
    out[row, (np.cumsum(new, axis=1) - 1)[row, column]] = found[row, column]
    return out
