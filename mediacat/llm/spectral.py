"""Leading eigenvectors of a symmetric matrix by spectral divide and conquer.

The polar factor of a shifted matrix has the eigenvalues 1 and -1: half of it plus the
identity projects on the space of the eigenvalues above the shift. Two orthonormal bases,
of that space and of the rest, split the matrix into two smaller ones, and so on down to
single vectors. Only halves that hold wanted components are split further. The polar factor
comes from the QR-based dynamically weighted Halley iteration.
"""

from __future__ import annotations

import math

import numpy as np

_EPS = np.finfo(np.float64).eps
#: Where to cut, as multiples of the spread around the mean, if a cut meets an eigenvalue.
_CUTS = (0.0, 0.11, -0.13, 0.29, -0.31, 0.53, -0.57)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix."""
    d = len(a)
    x = a / np.linalg.norm(a)
    low = _EPS
    while 1 - low > 4 * _EPS:
        square = low * low
        root = np.cbrt(4 * (1 - square) / (square * square))
        weight = math.sqrt(1 + root)
        weight += math.sqrt(8 - 4 * root + 8 * (2 - square) / (square * math.sqrt(1 + root))) / 2
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q = np.linalg.qr(np.vstack([math.sqrt(c) * x, np.eye(d)]))[0]
        x = b / c * x + (weight - b / c) / math.sqrt(c) * (q[:d] @ q[d:].T)
        x = (x + x.T) / 2
        low = min(1.0, low * (weight + b * square) / (1 + c * square))
    return x @ (1.5 * np.eye(d) - 0.5 * (x @ x))


def _split(a: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the space above a cut and of that below; None where all eigenvalues agree."""
    d = len(a)
    mean = np.trace(a) / d
    spread = np.linalg.norm(a - mean * np.eye(d)) / math.sqrt(d)
    if spread <= 8 * _EPS * norm:
        return None
    start = np.random.default_rng(d).standard_normal((d, d))
    for cut in _CUTS:
        projector = (polar(a - (mean + cut * spread) * np.eye(d)) + np.eye(d)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < d or np.linalg.norm(projector @ projector - projector) > 1e-9:
            continue
        basis = np.linalg.qr(projector @ start[:, :rank], mode="complete")[0]
        basis = np.linalg.qr(projector @ basis[:, :rank], mode="complete")[0]
        return basis[:, :rank], basis[:, rank:]
    return None


def _leading(a: np.ndarray, wanted: int, norm: float) -> np.ndarray:
    """Columns that span the spaces of the ``wanted`` largest eigenvalues, largest first."""
    if len(a) == 1 or (bases := _split(a, norm)) is None:
        return np.eye(len(a))[:, :wanted]
    found = []
    for basis in bases:
        if wanted > 0:
            part = basis.T @ a @ basis
            found.append(basis @ _leading((part + part.T) / 2, min(wanted, basis.shape[1]), norm))
            wanted -= found[-1].shape[1]
    return np.hstack(found)


def leading_components(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the largest eigenvalues, falling; the largest entry is positive.

    A matrix of zeros has any basis.
    """
    a = (a + a.T) / 2
    wanted = min(wanted, len(a))
    norm = float(np.linalg.norm(a))
    if norm == 0 or wanted == 0:
        return np.zeros(wanted), np.eye(len(a))[:, :wanted]
    vectors = np.linalg.qr(_leading(a / norm, wanted, 1.0))[0]
    values = np.einsum("ik,ij,jk->k", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    most = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[most, range(wanted)] < 0, -1.0, 1.0)
