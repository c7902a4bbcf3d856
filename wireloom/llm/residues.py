"""Exact integer matrix products by residues.

Numbers are split into residues modulo small primes, symmetric around zero. Matrices of residues are multiplied as float32:
with at most ``DEPTH`` terms of at most ``HALF`` squared every partial sum is an integer below 2**24, which float32 holds
exactly, in whatever order the library adds. The residues of a product are put together by Chinese remaindering in mixed
radix; with symmetric digits the result comes out signed.
"""

from __future__ import annotations

import numpy as np

#: Terms of one float32 product; longer rows are multiplied in lots.
DEPTH = 64
#: The largest residue whose square ``DEPTH`` times stays below 2**24.
HALF = int((2**24 / DEPTH) ** 0.5) - 1
#: Products must fit a long.
LARGEST = 2**62


def primes_for(bound: int) -> list[int]:
    """The largest primes up to 2 * HALF + 1 whose product exceeds 2 * bound + 1, largest first."""
    if bound > LARGEST:
        raise ValueError("products may exceed 2**62")
    found, product = [], 1
    for n in range(2 * HALF + 1, 2, -2):
        if all(n % f for f in range(3, int(n**0.5) + 1, 2)):
            found.append(n)
            product *= n
            if product > 2 * bound + 1:
                return found
    raise ValueError("not enough primes")  # their product is far beyond 2**63


def reduced(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p in place, between -p/2 and p/2; x holds integers of float32 below 2**24.

    The first quotient may be off by one through rounding; on what it leaves the second is exact.
    """
    factor = np.float32(1 / p)
    for _ in range(2):
        quotient = np.rint(x * factor)
        quotient *= np.float32(p)
        x -= quotient
    return x


class Residues:
    """The rows of a matrix of longs modulo each prime."""

    def __init__(self, rows: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = []
        for p in primes:
            r = np.remainder(rows, p)
            self.parts.append((r - p * (r > p // 2)).astype(np.float32))

    def __getitem__(self, rows: slice) -> Residues:
        out = Residues.__new__(Residues)
        out.primes, out.parts = self.primes, [p[rows] for p in self.parts]
        return out


def products(a: Residues, b: Residues) -> np.ndarray:
    """a @ b.T as longs; every product must be within the bound that the primes were chosen for."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(a.primes):
        left, right = a.parts[k], b.parts[k]
        r = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, left.shape[1], DEPTH):
            lot = left[:, at : at + DEPTH] @ right[:, at : at + DEPTH].T
            r = reduced(r + reduced(lot, p) if at else lot, p)
        for q, digit in zip(a.primes, digits):
            # what lies above this digit: (r - digit) / q modulo p, of factors of at most p and p / 2
            inverse = pow(q, -1, p)
            r -= digit
            reduced(r, p)
            r *= np.float32(inverse - p if inverse > p // 2 else inverse)
            reduced(r, p)
        digits.append(r)
    out = digits[-1].astype(np.int64)
    for p, digit in zip(a.primes[-2::-1], digits[-2::-1]):
        out *= p
        out += digit.astype(np.int64)
    return out
