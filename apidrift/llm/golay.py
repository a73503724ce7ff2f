"""The binary Golay code of length 23: nearest codewords, and the further ones that close words share."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, CHECK_BITS, RADIUS = 23, 11, 3
#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011
#: Codewords at distance 4 from a word that is 3 away from its nearest one.
FURTHER = 5


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and high halves of a word; per syndrome its error patterns, lightest first, -1 where none."""

    def syndrome(word: int) -> int:
        for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
            if word >> bit & 1:
                word ^= GENERATOR << bit - CHECK_BITS
        return word

    low = np.array([syndrome(x) for x in range(1 << CHECK_BITS)])
    high = np.array([syndrome(x << CHECK_BITS) for x in range(1 << LENGTH - CHECK_BITS)])
    single = [syndrome(1 << bit) for bit in range(LENGTH)]
    errors = np.full((1 << CHECK_BITS, 1 + FURTHER), -1, np.int64)
    filled = np.zeros(1 << CHECK_BITS, np.int64)
    light = np.zeros(1 << CHECK_BITS, bool)
    for weight in range(RADIUS + 2):
        for bits in combinations(range(LENGTH), weight):
            at = 0
            for bit in bits:
                at ^= single[bit]
            if weight > RADIUS and light[at]:
                continue  # a nearest codeword at distance 2 or less is shared by every neighbour
            light[at] |= weight < RADIUS
            errors[at, filled[at]] = sum(1 << bit for bit in bits)
            filled[at] += 1
    return low, high, errors


def nearby(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords near each 23-bit word: one column per codeword, -1 where none.

    The nearest lies at distance 3 at most. A word at distance 3 also gets the five at distance 4. Two words that
    differ in one bit at most so share an index: if the nearest codeword of one is too far from the other (4), it
    is among the other's five.
    """
    low, high, errors = tables()
    syndrome = low[words & (1 << CHECK_BITS) - 1] ^ high[words >> CHECK_BITS]
    error = errors[syndrome]
    return np.where(error < 0, -1, (words[:, None] ^ error) >> CHECK_BITS)
