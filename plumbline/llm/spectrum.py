"""Eigenvalues and eigenvectors of an exact integer scatter matrix.

The characteristic polynomial is computed exactly: the matrix is reduced to Hessenberg form modulo many primes at once, the polynomials
are read off by recurrence and their coefficients joined by the Chinese remainder theorem. All roots are real, so the sign changes in the coefficients
of the polynomial shifted by a count the roots above a, multiplicities included; bisection by that count isolates the roots,
and bisection by sign refines them. Vectors come from the null space of M - root by inverse iteration in long decimals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb

import numpy as np

Matrix = Sequence[Sequence[int]]
#: Bits to which roots are known relative to the trace, and digits of the inverse iteration.
BITS, DIGITS = 192, 90


def primes(bits: int) -> list[int]:
    """The primes below 2**31 from the largest down, until their product has more than ``bits`` bits."""
    out, product, p = [], 1, 2**31 - 1
    while product.bit_length() <= bits:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def _is_prime(p: int) -> bool:
    """Miller's test; the four bases decide every number below 3.2 x 10**9."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x in (1, p - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def coefficient_bits(m: Matrix) -> int:
    """Bits that hold twice any coefficient of the characteristic polynomial of a matrix without negative eigenvalues: the k-th
    symmetric function of d numbers is largest where all are alike."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    return max(((comb(d, k) * trace**k) // d**k + 1).bit_length() for k in range(d + 1)) + 2


def residues(m: Matrix, moduli: Sequence[int]) -> np.ndarray:
    """(primes x d + 1) coefficients of the characteristic polynomial modulo each prime, the constant first."""
    d = len(m)
    p = np.array(moduli, dtype=np.int64)
    a = np.array([[[x % q for x in row] for row in m] for q in moduli], dtype=np.int64)
    each, col, flat = np.arange(p.size), p[:, None], p[:, None, None]
    for k in range(1, d - 1):
        # A row with an entry below the diagonal comes to place k, row and column alike; where there is none the factors are zero.
        pivot = k + (a[:, k:, k - 1] != 0).argmax(axis=1)
        a[each, k], a[each, pivot] = a[each, pivot].copy(), a[each, k].copy()
        a[each, :, k], a[each, :, pivot] = a[each, :, pivot].copy(), a[each, :, k].copy()
        inverse = np.array([pow(int(x), int(q) - 2, int(q)) for x, q in zip(a[:, k, k - 1], p, strict=True)])
        u = a[:, k + 1 :, k - 1] * inverse[:, None] % col
        a[:, k + 1 :, :] = (a[:, k + 1 :, :] - u[:, :, None] * a[:, k, None, :] % flat) % flat
        a[:, :, k] = (a[:, :, k] + (a[:, :, k + 1 :] * u[:, None, :] % flat).sum(axis=2)) % col
    poly = np.zeros((d + 1, p.size, d + 1), dtype=np.int64)
    poly[0, :, 0] = 1
    for k in range(1, d + 1):
        new = np.roll(poly[k - 1], 1, axis=1) - a[:, k - 1, k - 1, None] * poly[k - 1] % col
        below = np.ones(p.size, dtype=np.int64)
        for i in range(k - 1, 0, -1):
            below = below * a[:, i, i - 1] % p
            new -= (a[:, i - 1, k - 1] * below % p)[:, None] * poly[i - 1] % col
        poly[k] = new % col
    return poly[d]


def combine(rows: np.ndarray, moduli: Sequence[int]) -> list[int]:
    """Coefficients from their residues, each between minus and plus half the product of the primes."""
    whole = 1
    for q in moduli:
        whole *= q
    parts = [(whole // q) * pow(whole // q, -1, q) for q in moduli]
    out = [sum(int(r) * part for r, part in zip(column, parts, strict=True)) % whole for column in rows.T]
    return [c - whole if c > whole // 2 else c for c in out]


@dataclass(frozen=True)
class Root:
    """``multiplicity`` roots between low and high, in units of 2**-scale; they differ by less than BITS bits can tell."""

    low: int
    high: int
    scale: int
    multiplicity: int

    def value(self) -> Decimal:
        return Decimal(self.low + self.high) / 2 / (Decimal(2) ** self.scale)


def roots_above(poly: Sequence[int], a: int) -> int:
    """How many roots of a polynomial with real roots only lie above ``a``: sign changes of the coefficients shifted by a."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(poly: Sequence[int], a: int) -> int:
    value = 0
    for c in reversed(poly):
        value = value * a + c
    return (value > 0) - (value < 0)


def largest_roots(poly: Sequence[int], trace: int, count: int) -> list[Root]:
    """The ``count`` largest positive roots (more if the last is multiple), from the largest down. All roots are real and not negative."""
    if trace <= 0:
        return []
    scale = max(0, BITS - trace.bit_length())
    d = len(poly) - 1
    scaled = [c << (scale * (d - k)) for k, c in enumerate(poly)]
    top = trace << scale
    out: list[Root] = []
    stack = [(0, top, roots_above(scaled, 0), 0)]  # low, high, roots above low, roots above high
    while stack and sum(r.multiplicity for r in out) < count:
        low, high, n_low, n_high = stack.pop()
        if n_low == n_high:
            continue
        if n_low - n_high == 1 or high - low == 1:
            while n_low - n_high == 1 and high - low > 1:
                mid = (low + high) // 2
                s = _sign(scaled, mid)
                if s == 0:
                    low = high = mid
                elif (s < 0) == (n_low % 2 == 1):  # as many roots lie above as above low
                    low = mid
                else:
                    high = mid
            out.append(Root(low, high, scale, n_low - n_high))
            continue
        mid = (low + high) // 2
        n_mid = roots_above(scaled, mid)
        stack += [(low, mid, n_low, n_mid), (mid, high, n_mid, n_high)]
    return out


def null_vectors(m: Matrix, root: Root) -> list[list[float]]:
    """Orthonormal vectors for one root, as many as its multiplicity; the largest entry of each (the first of several) is positive."""
    d = len(m)
    with localcontext() as ctx:
        ctx.prec = DIGITS + max(len(str(abs(x))) for row in m for x in row)
        at = root.value()
        tiny = Decimal(10) ** (Decimal(sum(m[i][i] for i in range(d))).adjusted() - DIGITS)
        a = [[Decimal(x) - (at if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(m)]
        order = list(range(d))
        for k in range(d):
            pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[pivot], order[k], order[pivot] = a[pivot], a[k], order[pivot], order[k]
            if not a[k][k]:
                a[k][k] = tiny
            own, top = a[k], a[k][k]
            for i in range(k + 1, d):
                row = a[i]
                if row[k]:
                    f = row[k] = row[k] / top
                    for j in range(k + 1, d):
                        row[j] -= f * own[j]

        def solve(b: list[Decimal]) -> list[Decimal]:
            y = [b[i] for i in order]
            for i in range(d):
                y[i] -= sum(a[i][j] * y[j] for j in range(i))
            for i in reversed(range(d)):
                y[i] = (y[i] - sum(a[i][j] * y[j] for j in range(i + 1, d))) / a[i][i]
            return y

        def free(y: list[Decimal], others: list[list[Decimal]]) -> list[Decimal]:
            """Length one, without the part along the others."""
            for _ in range(2):
                for o in others:
                    dot = sum(p * q for p, q in zip(y, o, strict=True))
                    y = [p - dot * q for p, q in zip(y, o, strict=True)]
                norm = sum(p * p for p in y).sqrt()
                y = [p / norm for p in y]
            return y

        found: list[list[Decimal]] = []
        rng = np.random.default_rng(7)
        for _ in range(root.multiplicity):
            y = free([Decimal(int(x)) for x in rng.integers(1, 10**9, d)], found)
            for _ in range(3):
                y = free(solve(y), found)
            big = max(range(d), key=lambda i: (abs(y[i]), -i))
            found.append([-p for p in y] if y[big] < 0 else y)
        return [[float(p) for p in y] for y in found]


