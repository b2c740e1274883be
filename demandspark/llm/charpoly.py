"""Exact characteristic polynomials of integer symmetric matrices, their real roots, and null spaces.

The polynomial is reduced to Hessenberg form modulo primes below 2^31, one prime at a time, and put together by Chinese
remaindering; the primes are enough for the known bound of its coefficients. All roots are real, so Descartes' rule of
signs is exact: the sign changes after a shift count the roots above it, with multiplicity. Bisection on that count
separates the roots, and on the sign of the polynomial narrows them, both in integers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal, localcontext
from math import comb

import numpy as np

PRECISION_BITS = 160
DIGITS = 90


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 3.2e9."""
    if n < 2 or any(n % q == 0 for q in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(product: int) -> list[int]:
    """Primes from 2^31 downwards whose product exceeds ``product``."""
    found, total, n = [], 1, 2**31 - 1
    while total <= product:
        if _is_prime(n):
            found.append(n)
            total *= n
        n -= 2
    return found


def coefficient_bound(trace: int, size: int) -> int:
    """Bound of the coefficients for a matrix without negative eigenvalues: the k-th is at most C(d,k) (trace/d)^k."""
    mean = -(-trace // size) if size else 0
    return max((comb(size, k) * mean**k for k in range(size + 1)), default=1)


def hessenberg_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo ``p`` with zeros below the first subdiagonal."""
    m = matrix.copy()
    size = len(m)
    for k in range(1, size - 1):
        pivots = np.flatnonzero(m[k:, k - 1])
        if not len(pivots):
            continue
        at = k + int(pivots[0])
        if at != k:
            m[[k, at]] = m[[at, k]]
            m[:, [k, at]] = m[:, [at, k]]
        factor = m[k + 1 :, k - 1] * pow(int(m[k, k - 1]), -1, p) % p
        m[k + 1 :] = (m[k + 1 :] - factor[:, None] * m[k] % p) % p
        m[:, k] = (m[:, k] + (m[:, k + 1 :] * factor % p).sum(axis=1)) % p
    return m


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(tI - matrix) modulo ``p``, the constant first."""
    h = hessenberg_mod(matrix, p)
    size = len(h)
    polys = [np.array([1], np.int64)]
    for k in range(size):
        new = np.zeros(k + 2, np.int64)
        new[1:] = polys[k]
        new[:-1] = (new[:-1] - polys[k] * h[k, k] % p) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            weight = int(h[i, k]) * chain % p
            new[: i + 1] = (new[: i + 1] - polys[i] * weight % p) % p
        polys.append(new)
    return polys[size]


def remaindered(residues: Iterator[tuple[int, Sequence[int]]]) -> list[int]:
    """Integers of least size with the given residues: pairs of a prime and its list of residues."""
    modulus, values = 1, None
    for p, residue in residues:
        if values is None:
            values = [0] * len(residue)
        inverse = pow(modulus, -1, p) if modulus > 1 else 1
        values = [v + modulus * ((int(r) - v) * inverse % p) for v, r in zip(values, residue, strict=True)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in values or []]


def _above(poly: list[int], at: int) -> int:
    """Roots greater than ``at``: sign changes of the coefficients of poly(t + at)."""
    c = poly[:]
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], at: int) -> int:
    value = 0
    for c in reversed(poly):
        value = value * at + c
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], bound: int, count: int) -> list[tuple[int, int, int]]:
    """The ``count`` largest positive roots, falling: (numerator, bits, multiplicity), a root being numerator / 2^bits.

    ``bound`` is not below any root. Each root is known to ``PRECISION_BITS`` bits of the bound; roots closer than that
    count as one with their joint multiplicity, which may pass ``count``.
    """
    bits = max(0, PRECISION_BITS - bound.bit_length())
    degree = len(poly) - 1
    scaled = [c << bits * (degree - k) for k, c in enumerate(poly)]
    low, high = 0, bound << bits
    todo, roots, found = [(low, high, _above(scaled, low), 0)], [], 0
    while todo:
        low, high, above_low, above_high = todo.pop()
        inside = above_low - above_high
        if not inside or above_high >= count:
            continue
        ends = (_sign(scaled, low), _sign(scaled, high)) if inside == 1 else (0, 0)
        if ends[0] * ends[1] < 0:
            while high - low > 1:
                mid = (low + high) // 2
                if _sign(scaled, mid) == ends[0]:
                    low = mid
                else:
                    high = mid
        if high - low == 1:
            roots.append((high, bits, inside))
            found += inside
            continue
        mid = (low + high) // 2
        above_mid = _above(scaled, mid)
        todo += [(low, mid, above_low, above_mid), (mid, high, above_mid, above_high)]
    return roots


def null_space(matrix: list[list[int]], root: int, bits: int, multiplicity: int) -> np.ndarray:
    """Unit vectors that span the eigenvectors of ``matrix`` at root / 2^bits, as rows; two steps of inverse iteration.

    The shifted matrix is factored with ``DIGITS`` decimal digits. The largest entry of each vector is positive.
    """
    size = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        shift = Decimal(root) / Decimal(2**bits)
        scale = max((abs(x) for row in matrix for x in row), default=1) or 1
        lu = np.array([[Decimal(x) for x in row] for row in matrix], dtype=object)
        lu[range(size), range(size)] -= shift
        tiny = Decimal(scale).scaleb(-DIGITS + 5)
        order = list(range(size))
        for k in range(size):
            at = k + max(range(size - k), key=lambda i: abs(lu[k + i, k]))
            if at != k:
                lu[[k, at]] = lu[[at, k]]
                order[k], order[at] = order[at], order[k]
            if abs(lu[k, k]) < tiny:
                lu[k, k] = tiny
            lu[k + 1 :, k] /= lu[k, k]
            lu[k + 1 :, k + 1 :] -= lu[k + 1 :, k, None] * lu[k, None, k + 1 :]
        rows: list[np.ndarray] = []
        for number in range(multiplicity):
            # A start without structure: the vector must not be orthogonal to the space.
            x = np.array([Decimal((i + 1) * (2 * number + 3) * 7919 % 10007 - 5003) for i in range(size)], dtype=object)
            for _ in range(2):
                x = x[order]
                for k in range(size):
                    x[k + 1 :] -= lu[k + 1 :, k] * x[k]
                for k in range(size - 1, -1, -1):
                    x[k] /= lu[k, k]
                    x[:k] -= lu[:k, k] * x[k]
                for _ in range(2):
                    for row in rows:
                        x = x - row * (row * x).sum()
                x = x / (x * x).sum().sqrt()
            rows.append(x)
        vectors = np.array([[float(v) for v in row] for row in rows]).reshape(len(rows), size)
    for v in vectors:
        if v[np.argmax(np.abs(v) > np.abs(v).max() * (1 - 1e-9))] < 0:
            v *= -1
    return vectors
