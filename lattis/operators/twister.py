"""The legacy stream of random words from any place on, so that tasks can share it.

Words of the Mersenne twister obey a linear recurrence over bits, so those
``e`` on are a combination of the first ones: the one that the remainder of
t**e by the recurrence's polynomial tells.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

DEGREE, HELD = 19_937, 624


def _state(words: np.ndarray) -> tuple:
    """The generator that goes on after these 624 words of the recurrence."""
    return ("MT19937", words, HELD, 0, 0.0)


@lru_cache(maxsize=4)
def _first(seed: int) -> np.ndarray:
    """The recurrence's first words after the seeding, as they are before tempering."""
    rng, out = np.random.RandomState(seed), []
    for _ in range(-(-2 * (DEGREE + HELD) // HELD)):
        rng.randint(0, 1 << 32, size=HELD, dtype=np.uint32)
        out.append(rng.get_state()[1].copy())
    return np.concatenate(out)


@lru_cache(maxsize=1)
def _polynomial() -> int:
    """The recurrence's polynomial, from the lowest bits of its words (Berlekamp and Massey)."""
    c, b, size, m, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate((_first(1)[: 2 * DEGREE] & 1).tolist()):
        seen = (seen << 1 | bit) & ((1 << (DEGREE + 1)) - 1)
        if (c & seen).bit_count() & 1:
            if 2 * size <= n:
                c, b, size, m = c ^ (b << m), c, n + 1 - size, 1
                continue
            c ^= b << m
        m += 1
    return int(bin(c)[2:].zfill(size + 1)[::-1], 2)


def _power(e: int) -> int:
    """The remainder of t**e."""
    p, x = _polynomial(), 1
    places = [k for k in range(DEGREE) if p >> k & 1]

    def rest(x: int) -> int:
        while (high := x >> DEGREE):
            x &= (1 << DEGREE) - 1
            for k in places:
                x ^= high << k
        return x

    for digit in bin(e)[2:]:
        x = rest(int("0".join(bin(x)[2:]), 2) << int(digit))
    return x


def stream_from(seed: int, place: int) -> np.random.RandomState:
    """The legacy generator of ``seed`` after ``place`` words of 32 bits."""
    rng = np.random.RandomState(seed)
    if place < HELD:
        rng.randint(0, 1 << 32, size=place, dtype=np.uint32)
        return rng
    first, x = _first(seed), _power(place - HELD)
    words = np.zeros(HELD, dtype=np.uint32)
    for k in np.flatnonzero(np.frombuffer(bin(x)[:1:-1].encode(), dtype=np.uint8) == ord("1")).tolist():
        words ^= first[k : k + HELD]
    rng.set_state(_state(words))
    return rng
