"""Leading eigenpairs of one symmetric matrix: Householder tridiagonalisation, Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues nearer than this share of the matrix's norm are a cluster.
CLUSTER = 1e-3
ROUNDS = 5


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit vectors of the reflections that lead to them."""
    a = matrix.copy()
    n = len(a)
    off, mirrors = np.zeros(max(n - 1, 0)), []
    for k in range(n - 2):
        column = a[k + 1 :, k]
        length = np.sqrt((column * column).sum())
        mirror = column.copy()
        target = -np.copysign(length, column[0])
        mirror[0] -= target
        size = np.sqrt((mirror * mirror).sum())
        if size == 0:
            mirrors.append(np.zeros(len(mirror)))
            continue
        mirror /= size
        rest = a[k + 1 :, k + 1 :]
        p = rest @ mirror
        p -= (mirror @ p) * mirror
        rest -= 2 * (np.outer(mirror, p) + np.outer(p, mirror))
        off[k] = target
        mirrors.append(mirror)
    if n > 1:
        off[-1] = a[-1, -2]
    return np.diag(a).copy(), off, mirrors


def counts_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: negative terms of the Sturm sequence."""
    least = EPS * (np.abs(diagonal).max() + np.abs(off).max(initial=0)) * EPS + np.finfo(float).tiny
    q = diagonal[0] - at
    below = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off):
        q = np.where(np.abs(q) < least, -least, q)
        q = d - at - e * e / q
        below += q < 0
    return below


def largest(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection as far as doubles go."""
    n = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    slack = 2 * EPS * (np.abs(diagonal) + reach).max()
    low = np.full(k, (diagonal - reach).min() - slack)
    high = np.full(k, (diagonal + reach).max() + slack)
    wanted = n - 1 - np.arange(k)  # its place from below
    for _ in range(2100):
        middle = low + (high - low) / 2
        close = high - low <= EPS * np.maximum(np.maximum(np.abs(low), np.abs(high)), EPS * reach.max())
        if ((middle <= low) | (middle >= high) | close).all():
            break
        above = counts_below(diagonal, off, middle) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return low + (high - low) / 2


def solve(diagonal: np.ndarray, off: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Solve a tridiagonal system by elimination with row exchanges; vanishing pivots become ``least``."""
    n = len(diagonal)
    d, r = diagonal.tolist(), right.tolist()
    up, second, lower = [*off.tolist(), 0.0], [0.0] * n, off.tolist()
    for i in range(n - 1):
        if abs(lower[i]) > abs(d[i]):
            d[i], lower[i] = lower[i], d[i]
            up[i], d[i + 1] = d[i + 1], up[i]
            second[i], up[i + 1] = up[i + 1], 0.0
            r[i], r[i + 1] = r[i + 1], r[i]
        if abs(d[i]) < least:
            d[i] = least
        share = lower[i] / d[i]
        d[i + 1] -= share * up[i]
        up[i + 1] -= share * second[i]
        r[i + 1] -= share * r[i]
    if abs(d[-1]) < least:
        d[-1] = least
    x = [0.0] * n
    for i in range(n - 1, -1, -1):
        rest = r[i]
        if i + 1 < n:
            rest -= up[i] * x[i + 1]
        if i + 2 < n:
            rest -= second[i] * x[i + 2]
        x[i] = rest / d[i]
    return np.array(x)


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector of the tridiagonal matrix in each column, orthogonal to those of its cluster before it."""
    n = len(diagonal)
    norm = (np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))).max() or 1.0
    random = np.random.default_rng(11)
    out = np.zeros((n, len(values)))
    begin = 0
    shift = values[0] if len(values) else 0.0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            begin = j
        # equal values are told apart by a few units of rounding, so that their solutions differ
        shift = value if j == begin else min(value, shift - 10 * EPS * norm)
        x = random.normal(size=n)
        for _ in range(ROUNDS):
            x -= out[:, begin:j] @ (out[:, begin:j].T @ x)
            x /= np.abs(x).max()
            x = solve(diagonal - shift, off, x, EPS * norm)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, begin:j] @ (out[:, begin:j].T @ x)
            x /= np.sqrt((x * x).sum())
        out[:, j] = x
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Of the two signs the one that makes the entry of largest size positive.
    """
    k = min(k, len(matrix))
    scale = np.abs(matrix).max(initial=0)
    if not k or scale == 0:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = largest(diagonal, off, k)
    vectors = vectors_of(diagonal, off, values)
    for at in range(len(mirrors) - 1, -1, -1):
        part = vectors[at + 1 :]
        part -= 2 * np.outer(mirrors[at], mirrors[at] @ part)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values * scale, vectors
