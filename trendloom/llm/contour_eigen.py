"""Leading eigenpairs of a symmetric positive semidefinite matrix by contour integration (FEAST, Polizzi 2009).

The spectrum is cut into intervals by inertia counts: by Sylvester's law the signs in a factorisation of V - s tell how
many eigenvalues lie below s; they are taken from V's tridiagonal form. For each interval, Gauss-Legendre quadrature of complex
shifted solves over the circle through its ends projects a random block on the interval's eigenspace; Rayleigh-Ritz extracts
eigenpairs, and what is projected next is what was found, until the residuals are at rounding. An interval is done only
with as many eigenpairs as its inertia count demands, so none is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Quadrature nodes on the upper half of the circle.
NODES = 8
#: Eigenvalues that an interval should hold at most.
PER_INTERVAL = 6
MAX_ITERATIONS = 60
EPS = np.finfo(np.float64).eps


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and next diagonal of a matrix with the same eigenvalues, by Householder reflections."""
    a = v.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.linalg.norm(x)
        a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def inertia(v: np.ndarray) -> Callable[[float], int]:
    """A function that counts the eigenvalues below a number."""
    main, beside = tridiagonal(v)
    squares, least = np.concatenate(([0.0], beside**2)), EPS * EPS * max(np.abs(main).max(), 1e-300)

    def below(s: float) -> int:
        count, pivot = 0, 1.0
        for d, b in zip(main.tolist(), squares.tolist(), strict=True):
            pivot = d - s - b / pivot
            if abs(pivot) < least:
                pivot = -least
            count += pivot < 0
        return count

    return below


def lower_end(below: Callable[[float], int], n: int, top: float, m: int, least: float) -> float:
    """A number with m eigenvalues above it, or a few more if the m-th is repeated."""
    low, high = least, top
    while high - low > 4 * EPS * top:
        middle = (low + high) / 2
        above = n - below(middle)
        if above == m:
            return middle
        low, high = (middle, high) if above > m else (low, middle)
    return low


def intervals(below: Callable[[float], int], low: float, high: float, narrow: float) -> Iterator[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues) that hold all eigenvalues from low to high, cut where none is near."""
    inside = below(high) - below(low)
    if not inside:
        return
    if inside > PER_INTERVAL and high - low > narrow:
        for part in (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8):
            cut = low + part * (high - low)
            if below(cut - 1e-4 * (high - low)) == below(cut + 1e-4 * (high - low)):
                yield from intervals(below, cut, high, narrow)
                yield from intervals(below, low, cut, narrow)
                return
    yield low, high, inside


def in_interval(v: np.ndarray, low: float, high: float, inside: int, size: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of an interval, of which there are `inside`, and their unit vectors."""
    n = len(v)
    x, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (1 + x))
    centre, radius = (low + high) / 2, (high - low) / 2
    block = rng.standard_normal((n, min(n, 2 * inside + 6)))
    best, worst = None, np.inf
    for _ in range(MAX_ITERATIONS):
        projected = sum(
            (w / 2) * np.real(radius * t * np.linalg.solve((centre + radius * t) * np.eye(n) - v, block.astype(complex))) for t, w in zip(turn, weights, strict=True))
        basis, _ = np.linalg.qr(projected)
        values, turned = np.linalg.eigh(basis.T @ v @ basis)
        block = basis @ turned
        residual = np.linalg.norm(v @ block - block * values, axis=0)
        own = np.flatnonzero((values >= low - 8 * EPS * size) & (values <= high + 8 * EPS * size))
        if len(own) > inside:  # spurious ones have large residuals
            own = np.sort(own[np.argsort(residual[own], kind="stable")[:inside]])
        if len(own) == inside:
            now = residual[own].max()
            if best is not None and worst <= 1e-12 * size and now > worst / 2:  # at rounding
                break
            if now < worst:
                best, worst = (values[own], block[:, own]), now
    if best is None or worst > 1e-10 * size:
        raise RuntimeError(f"{inside} eigenvalues from {low} to {high} were not all found")
    return best


def leading(v: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues (falling, `limit` at most, none that rounding can't tell from zero) and unit eigenvectors as columns."""
    n, trace = len(v), float(np.trace(v))
    if not n or not trace > 0:
        return np.zeros(0), np.zeros((n, 0))
    below, top = inertia(v), trace * (1 + 1e-9)
    least = 16 * n * EPS * float(np.linalg.norm(v))
    m = min(limit, n - below(least))
    if not m:
        return np.zeros(0), np.zeros((n, 0))
    low, rng = lower_end(below, n, top, m, least), np.random.default_rng(5)
    found = [in_interval(v, *interval, float(np.linalg.norm(v)), rng) for interval in intervals(below, low, top, 1e-10 * top)]
    if sum(len(values) for values, _ in found) != n - below(low):
        raise RuntimeError("the inertia counts name more eigenvalues than were found")
    basis, _ = np.linalg.qr(np.concatenate([vectors for _, vectors in found], axis=1))  # vectors of different intervals at right angles
    values, turned = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-values, kind="stable")[:m]
    return values[order], basis @ turned[:, order]
