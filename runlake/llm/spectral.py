"""Eigenvectors of a symmetric matrix by spectral divide and conquer over QDWH polar decompositions.

The polar factor of A - sI is the matrix sign of it, and (sign + I) / 2 projects on the eigenvectors of
eigenvalues above s. An orthonormal basis of each side splits A into two smaller matrices, and so on down
to single components.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix by dynamically weighted Halley iterations.

    They start from the least lower bound of the singular values, relative to the largest, that doubles know; so a
    matrix needs six of them. Singular values below it do not reach 1, which `split` finds out.
    """
    x, low, eye = a / np.linalg.norm(a, 2), EPS, np.eye(len(a))
    while abs(low - 1) > 10 * EPS:
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:  # ill-conditioned still: by QR
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[: len(a)] @ q[len(a) :].T)
        else:
            lower = np.linalg.cholesky(eye + wc * (x.T @ x))
            x = wb / wc * x + (wa - wb / wc) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
    return x


def split(a: np.ndarray, shift: float, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces of eigenvalues above and below the shift, or None if it lies too near to one."""
    n = len(a)
    sign = polar_factor(a - shift * np.eye(n))
    projector = (sign + sign.T) / 4 + np.eye(n) / 2
    rank = round(np.trace(projector))
    if not 0 < rank < n or np.linalg.norm(projector @ projector - projector) > 1e-6:
        return None
    tried = np.random.default_rng(n).standard_normal((n, rank))
    tried = np.linalg.qr(projector @ tried)[0]
    q = np.linalg.qr(projector @ tried, mode="complete")[0]
    above, below = q[:, :rank], q[:, rank:]
    return (above, below) if np.linalg.norm(below.T @ a @ above) <= 20 * n * EPS * scale else None


def top_components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows.

    Eigenvalues that rounding cannot tell from zero have no component; equal ones share an arbitrary basis.
    """
    v = (v + v.T) / 2
    scale, found = np.linalg.norm(v), []
    stack = [(v, np.eye(len(v)))]  # the part with the largest eigenvalues on top
    while stack and len(found) < most:
        a, basis = stack.pop()
        n, mean = len(a), np.trace(a) / len(a)
        spread = np.linalg.norm(a - mean * np.eye(n))
        if n == 1 or spread <= 4 * n * EPS * scale:
            found.extend(basis.T)
            continue
        # the mean parts unequal eigenvalues for sure, unless it is one of them
        shifts = [mean, float(np.median(np.diag(a))), *(mean + spread * np.sqrt(2) * k / (4.1 * n) for m in range(1, 2 * n + 2) for k in (m, -m))]
        above, below = next(x for s in shifts if (x := split(a, s, scale)) is not None)
        stack += [(b.T @ a @ b, basis @ b) for b in (below, above)]
    vectors = np.array(found).reshape(-1, len(v))
    values = np.einsum("ij,jk,ik->i", vectors, v, vectors)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > 8 * len(v) * EPS * scale]
    return values[order], vectors[order]
