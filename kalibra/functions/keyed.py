"""Keyed hashes of whole numbers that numpy, Spark and any other SQL engine work out alike."""

from __future__ import annotations

import numpy as np

#: Hashes are numbers below this prime, and values should be, too.
PRIME = 2_147_483_647
#: Added before each power, so that small keys and values don't give small hashes.
SHIFT = 1_013_904_223


def mixed_sql(h: str, x: str) -> str:
    """SQL of a number below PRIME from one and the next value, a bijection of the value: fifth powers permute the field."""
    y = f"((({h}) + ({x}) + {SHIFT}) % {PRIME})"
    return f"(({y} * {y} % {PRIME}) * ({y} * {y} % {PRIME}) % {PRIME} * {y} % {PRIME})"


def mixed(h, x):
    """The same of integers or arrays."""
    y = (h + x + SHIFT) % PRIME
    square = y * y % PRIME
    return square * square % PRIME * y % PRIME


def folded(y: np.ndarray) -> np.ndarray:
    """Whole numbers below 2**62 modulo PRIME, which is 2**31 - 1, but for PRIME and PRIME + 1 as they are."""
    y = (y & PRIME) + (y >> 31)
    return (y & PRIME) + (y >> 31)


def fifths(y: np.ndarray) -> np.ndarray:
    """Fifth powers modulo PRIME of unsigned 64-bit numbers up to twice PRIME, in place and without divisions."""
    t = np.empty_like(y)

    def fold() -> None:
        np.right_shift(y, 31, out=t)
        np.bitwise_and(y, PRIME, out=y)
        np.add(y, t, out=y)

    fold()
    x = y.copy()
    np.multiply(y, y, out=y)
    fold()  # below 2**32
    np.multiply(y, y, out=y)
    fold()
    fold()
    np.multiply(y, x, out=y)
    fold()
    fold()  # below PRIME + 3
    np.subtract(y, PRIME, out=t)
    return np.minimum(y, t, out=y)


def mixed_places(h: int, size: int) -> np.ndarray:
    """mixed(h, 0), mixed(h, 1), ... up to size, without divisions and by pieces that fit the caches."""
    out = np.empty(size, np.int64)
    for a in range(0, size, 1 << 15):
        y = folded(np.arange(a, min(a + (1 << 15), size)) + (h + SHIFT))
        square = folded(y * y)
        y = folded(folded(square * square) * y)
        out[a : a + len(y)] = np.where(y >= PRIME, y - PRIME, y)
    return out


def chained_sql(*parts: str) -> str:
    """SQL of the hash of several values, the first one being the seed."""
    out = parts[0]
    for x in parts[1:]:
        out = mixed_sql(out, x)
    return out


def chained(*parts):
    out = parts[0]
    for x in parts[1:]:
        out = mixed(out, x)
    return out
