"""Eigenpairs of a symmetric matrix by contour integration (FEAST).

The number of eigenvalues above a shift is the inertia of the shifted matrix:
the signs of the pivots of its LDL' factors, taken from the tridiagonal form to
which the matrix is congruent by reflections. Bisection on these counts cuts
the wanted end of the spectrum into intervals that end in gaps. For every
interval a quadrature over a half circle of complex shifts z of the solves
(zI - V)^-1 Y filters a block Y onto the interval's eigenvectors, Rayleigh-Ritz
extracts the pairs, and the filter is repeated on them until the residuals
stand at rounding. An interval whose pairs do not match its inertia count is
filtered again with a wider block.
"""

from __future__ import annotations

import numpy as np

NODES = 8  # Gauss-Legendre nodes on the half circle
ROUNDS = 24
GROUP = 12  # eigenvalues per interval, where gaps allow it


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the tridiagonal form, by Householder reflections."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        sub = a[k + 1:, k + 1:]
        p = sub @ x
        q = p - (x @ p) * x
        sub -= 2 * (np.outer(x, q) + np.outer(q, x))
        a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, a[k + 1, k])
        a[k + 2:, k] = a[k, k + 2:] = 0
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(tri: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Eigenvalues greater than a shift: positive pivots of the shifted matrix."""
    a, b = tri
    tiny = np.finfo(float).tiny ** 0.5
    count, p = 0, 1.0
    for k, x in enumerate((a - shift).tolist()):
        p = x - (b[k - 1] ** 2 / p if k else 0.0)
        if abs(p) < tiny:
            p = -tiny
        count += p > 0
    return count


def _value(tri, k: int, low: float, high: float) -> float:
    """The k-th largest eigenvalue (from 1), by bisection on the counts."""
    for _ in range(60):
        mid = (low + high) / 2
        if above(tri, mid) >= k:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def intervals(tri, wanted: int, low: float, high: float, gap: float) -> list[tuple[float, float, int]]:
    """``(low, high, count)`` from the top down, holding at least the ``wanted`` largest
    eigenvalues; edges lie in gaps wider than ``gap``."""
    d = len(tri[0])
    out, edge, inside, have = [], high, 0, 0
    at = _value(tri, 1, low, high) if d else 0.0
    for k in range(1, d + 1):
        inside, have = inside + 1, k
        below = _value(tri, k + 1, low, high) if k < d else low
        wide = at - below > gap
        if (wide or k == d) and (k >= wanted or inside >= GROUP):
            cut = (at + below) / 2 if k < d else low
            out.append((cut, edge, inside))
            edge, inside = cut, 0
            if have >= wanted:
                break
        at = below
    return out


def contour(v: np.ndarray, low: float, high: float, count: int, rng, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of v between two shifts."""
    d = len(v)
    mid, radius = (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(nodes)
    theta = np.pi / 2 * (1 - x)
    turn = radius * np.exp(1j * theta)
    width = min(d, count + max(8, count // 2))
    for _ in range(4):
        y = rng.standard_normal((d, width))
        best = np.inf
        for _ in range(ROUNDS):
            q = np.zeros_like(y)
            for t, wt in zip(turn, w):
                solved = np.linalg.solve((mid + t) * np.eye(d) - v, y.astype(complex))
                q += wt / 2 * (t * solved).real
            q, _ = np.linalg.qr(q)
            e, u = np.linalg.eigh(q.T @ v @ q)  # Rayleigh-Ritz on the filtered block
            y = q @ u
            inside = (e > low) & (e < high)
            if inside.sum() != count:
                continue
            residual = np.linalg.norm(v @ y[:, inside] - y[:, inside] * e[inside], axis=0).max()
            if residual <= 5e-16 * np.abs(v).max() or residual >= best / 2:
                break
            best = residual
        if inside.sum() == count and min(residual, best) <= 1e-11 * max(np.abs(v).max(), 1e-300) * d:
            return e[inside], y[:, inside]
        width = min(d, 2 * width)
    raise RuntimeError(f"contour integration found {inside.sum()} of {count} eigenvalues between {low} and {high}")


def largest(v: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a positive semidefinite matrix, falling, and their unit vectors as columns.

    Values of at most 1e-12 of the largest count as zero and are left out, so
    fewer than k pairs may come back (none of a zero or empty matrix).
    """
    d = len(v)
    scale = np.abs(np.diag(v)).max() if d else 0.0
    if not scale > 0:
        return np.zeros(0), np.zeros((d, 0))
    a = (v + v.T) / (2 * scale)
    tri = tridiagonal(a)
    top = np.abs(a).sum(axis=1).max() * 1.01  # no eigenvalue is larger
    first = _value(tri, 1, -top, top)
    rank = above(tri, 1e-12 * first)
    rng = np.random.default_rng(seed)
    found = [contour(a, lo, hi, n, rng) for lo, hi, n in intervals(tri, min(k, rank), -top, top, 1e-9 * first)]
    e = np.concatenate([f[0] for f in found])
    y = np.concatenate([f[1] for f in found], axis=1)
    order = np.argsort(-e, kind="stable")[:min(k, rank)]
    return e[order] * scale, y[:, order]
