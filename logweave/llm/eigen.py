"""Leading eigenpairs of a symmetric matrix that fits on the driver: Householder reflections to
tridiagonal form, bisection on Sturm counts, inverse iteration with reorthogonalisation inside clusters.
The matrix is dimensions squared, whatever the number of rows it was summed from."""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
#: Eigenvalues closer than this share of the norm are a cluster: their vectors are made orthogonal.
CLUSTER = 1e-3


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the unit vectors of the reflections (of rows j + 1 and on for j)."""
    a = np.array(matrix, float)
    n = len(a)
    mirrors = []
    for j in range(n - 2):
        x = a[j + 1 :, j].copy()
        norm = np.linalg.norm(x)
        v = x
        if np.linalg.norm(x[1:]) == 0:
            mirrors.append(np.zeros_like(x))
            continue
        v[0] += np.copysign(norm, x[0])
        v /= np.linalg.norm(v)
        rest = a[j + 1 :, j + 1 :]
        p = 2 * (rest @ v)
        w = p - (v @ p) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        a[j + 1 :, j] = a[j, j + 1 :] = a[j + 1 :, j] - 2 * v * (v @ a[j + 1 :, j])
        mirrors.append(v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), mirrors


def counts_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each number of `at`: sign changes of the Sturm sequence."""
    least = _EPS * max(np.abs(off).max(initial=0), np.abs(diagonal).max(initial=0), np.finfo(float).tiny) ** 2 + np.finfo(float).tiny
    square = np.concatenate(([0.0], off**2))
    out = np.zeros(len(at), np.int64)
    q = np.ones(len(at))
    for d, s in zip(diagonal, square):
        q = d - at - s / q
        q = np.where(np.abs(q) < least, -least, q)
        out += q < 0
    return out


def bisected(diagonal: np.ndarray, off: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The eigenvalues of the given places in rising order, all halved down side by side."""
    reach = np.concatenate(([0.0], np.abs(off))) + np.concatenate((np.abs(off), [0.0]))
    low = np.full(len(wanted), (diagonal - reach).min())
    high = np.full(len(wanted), (diagonal + reach).max())
    norm = max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))
    low, high = low - 2 * _EPS * norm, high + 2 * _EPS * norm
    for _ in range(200):
        middle = (low + high) / 2
        if np.all(high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high)) + _EPS**2 * norm) or np.all((middle <= low) | (middle >= high)):
            break
        above = counts_below(diagonal, off, middle) > wanted
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    return (low + high) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """A tridiagonal system by elimination with row exchanges; pivots that vanish count as `least`."""
    n = len(diagonal)
    d, u = diagonal.tolist(), [*off.tolist(), 0.0]
    second, below, y = [0.0] * n, [*off.tolist(), 0.0], right.tolist()
    for i in range(n - 1):
        if abs(below[i]) > abs(d[i]):
            d[i], below[i] = below[i], d[i]
            u[i], d[i + 1] = d[i + 1], u[i]
            second[i], u[i + 1] = u[i + 1], 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(d[i]) < least:
            d[i] = least
        m = below[i] / d[i]
        d[i + 1] -= m * u[i]
        u[i + 1] -= m * second[i]
        y[i + 1] -= m * y[i]
    if abs(d[-1]) < least:
        d[-1] = least
    out = [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        out[i] = (y[i] - u[i] * out[i + 1] - second[i] * out[i + 2]) / d[i]
    return np.array(out[:n])


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns. The largest entry of
    each is positive. Fewer if the matrix is smaller."""
    n = len(matrix)
    k = min(k, n)
    scale = float(np.abs(matrix).max(initial=0))
    if scale == 0:
        return np.zeros(k), np.eye(n, k)
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = bisected(diagonal, off, np.arange(n - 1, n - 1 - k, -1))
    norm = max(np.abs(diagonal).max(initial=0) + 2 * np.abs(off).max(initial=0), np.finfo(float).tiny)
    rng = np.random.default_rng(12)
    vectors = np.zeros((n, k))
    shifted = np.inf
    for i, value in enumerate(values):
        # Equal eigenvalues are told apart, so that the systems differ.
        shifted = min(value, shifted - 10 * _EPS * norm)
        near = [j for j in range(i) if values[j] - value <= CLUSTER * norm]
        z = rng.standard_normal(n)
        for _ in range(6):
            z = _solved(diagonal - shifted, off, z / np.linalg.norm(z), _EPS * norm)
            for _ in range(2):
                z /= np.linalg.norm(z)
                z -= vectors[:, near] @ (vectors[:, near].T @ z)
        vectors[:, i] = z / np.linalg.norm(z)
    for j in range(len(mirrors) - 1, -1, -1):
        v = mirrors[j]
        vectors[j + 1 :] -= 2 * np.outer(v, v @ vectors[j + 1 :])
    top = np.abs(vectors).argmax(axis=0)
    return values * scale, vectors * np.where(vectors[top, np.arange(k)] < 0, -1.0, 1.0)
