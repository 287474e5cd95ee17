"""Dense symmetric matrices on the driver: K x K at most, as they come out of aggregations."""

from __future__ import annotations

import numpy as np


def is_symmetric(m: np.ndarray, tol: float = 1e-8) -> bool:
    return bool(np.isrealobj(m) and m.ndim == 2 and m.shape[0] == m.shape[1] and np.allclose(m, m.T, atol=tol, rtol=tol))


def mirror_upper(m: np.ndarray) -> np.ndarray:
    """Symmetric matrix of the upper triangle."""
    upper = np.triu(m)
    return upper + np.triu(m, 1).T


def fractional_power(m: np.ndarray, power: float, tol: float = 0.0) -> np.ndarray:
    """(m + tol I)^power by eigenvalues; the absolute ones, so a slightly negative one does no harm."""
    if not is_symmetric(m, 1e-6):
        raise ValueError("not symmetric")
    values, vectors = np.linalg.eigh((m + m.T) / 2 + tol * np.eye(len(m)))
    sizes = np.abs(values)
    if power < 0 and not (sizes.min(initial=1.0) > 0 and np.isfinite(sizes.min(initial=1.0) ** power)):
        raise ValueError("singular: raise the tolerance")
    out = (vectors * sizes**power) @ vectors.T
    return (out + out.T) / 2


def inverse_sqrt(m: np.ndarray, tol: float = 1e-15) -> np.ndarray:
    return fractional_power(m, -0.5, tol)


def canonical_signs(rows: np.ndarray) -> np.ndarray:
    """Each row's largest element by size is made positive."""
    if not rows.size:
        return rows
    at = np.abs(rows).argmax(axis=1)
    signs = np.sign(rows[np.arange(len(rows)), at])
    return rows * np.where(signs == 0, 1, signs)[:, None]


def smallest_eigenvectors(m: np.ndarray, n: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as rows) of the n eigenvalues that follow the first ``skip`` by size."""
    if n + skip > len(m):
        raise ValueError("fewer eigenvectors than asked for")
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    order = np.argsort(np.abs(values), kind="stable")[skip : skip + n]
    return np.abs(values[order]), canonical_signs(vectors[:, order].T)
