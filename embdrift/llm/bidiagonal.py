"""Singular values and right singular vectors of a small triangular matrix by the qd route.

Householder reflections make the matrix bidiagonal; dqds transforms (differential quotient-difference
with shifts) find the squared singular values to high relative accuracy; a twisted factorisation of
B'B - value gives each vector without iteration. Matrices are dimension x dimension, whatever the data.
"""

from __future__ import annotations

import math

import numpy as np

_EPS = np.finfo(float).eps
_DEFLATE = (100 * _EPS) ** 2
_RESIDUAL = 16 * _EPS
_CLUSTER = 1e-3  # values closer than this, relatively, have their vectors made orthogonal


def _reflector(x: np.ndarray) -> np.ndarray:
    """Unit v with (I - 2 v v') x a multiple of the first unit vector; zero if x is there already."""
    v = x / max(np.abs(x).max(initial=0), np.finfo(float).tiny)
    if not np.abs(v[1:]).any():
        return np.zeros_like(v)
    v[0] += math.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def bidiagonalise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and orthogonal w with u' m w = bidiagonal for some orthogonal u."""
    m, n = m.astype(float), len(m)
    w = np.eye(n)
    for k in range(n):
        v = _reflector(m[k:, k])
        m[k:, k:] -= 2 * np.outer(v, v @ m[k:, k:])
        if k + 2 < n:
            v = _reflector(m[k, k + 1:])
            m[k:, k + 1:] -= 2 * np.outer(m[k:, k + 1:] @ v, v)
            w[:, k + 1:] -= 2 * np.outer(w[:, k + 1:] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), w


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds sweep; None if the shift lies above the smallest value."""
    d, new_q, new_e = q[0] - shift, [], []
    for k, x in enumerate(e):
        s = d + x
        if not (d >= 0 and s >= 0):
            return None
        ratio = q[k + 1] / s if s else 0.0
        new_q.append(s)
        new_e.append(x * ratio)
        d = d * ratio - shift if s else q[k + 1] - shift
    return (new_q + [d], new_e) if d >= 0 else None


def _limits(q: list[float], e: list[float]) -> tuple[float, float]:
    """Bounds of the smallest value: the d of an unshifted sweep are the reciprocals of the diagonal of
    the inverse, whose largest entry and trace bound its largest eigenvalue."""
    d = least = q[0]
    if d <= 0:
        return 0.0, 0.0
    inverse = 1 / d
    for k, x in enumerate(e):
        d *= q[k + 1] / (d + x)
        if d < 1e-300:
            return 0.0, max(d, 0.0)
        inverse += 1 / d
        least = min(least, d)
    return 1 / inverse, least


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling."""
    scale = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0))
    if not scale:
        return np.zeros(len(diagonal))
    blocks = [([float(x) for x in (diagonal / scale) ** 2], [float(x) for x in (upper / scale) ** 2], 0.0)]
    out: list[float] = []
    while blocks:
        q, e, moved = blocks.pop()
        for _ in range(200 * len(q) + 200):
            while e and e[-1] <= _DEFLATE * (moved + q[-1]):
                out.append(moved + q.pop())
                e.pop()
            if not e:
                break
            cut = [k for k, x in enumerate(e) if x <= _DEFLATE * (moved + min(q[k], q[k + 1]))]
            if cut:
                k = cut[-1]
                blocks.append((q[: k + 1], e[:k], moved))
                q, e = q[k + 1:], e[k + 1:]
                continue
            low, high = _limits(q, e)
            best, shift = _transform(q, e, 0.0), 0.0
            for _ in range(8):  # the sign of a sweep tells on which side a trial shift lies
                trial = low if shift < low else (low + high) / 2
                got = _transform(q, e, trial * (1 - 4 * _EPS))
                if got is None:
                    high = trial
                    if trial <= low:
                        break
                else:
                    best, shift, low = got, trial * (1 - 4 * _EPS), max(low, trial)
                if high - low <= 1e-3 * high:
                    break
            (q, e), moved = best, moved + shift
        else:
            raise RuntimeError("dqds did not settle")
        out += [moved + x for x in q]
    return np.sort(out)[::-1] * scale ** 2


def twisted_vector(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for ``value``: B'B = L D L' is factored from the top and from the bottom;
    where the two meet with the least remainder, both give the vector by substitution."""
    n = len(diagonal)
    tiny = np.finfo(float).tiny ** 0.5
    a = np.where(np.abs(diagonal) < tiny, tiny, diagonal)
    d, low = a * a, (upper / a[:-1] if n > 1 else upper)
    down, up = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for k in range(n - 1):
        x = d[k] + s[k]
        x = x if abs(x) > tiny else math.copysign(tiny, x)
        down[k] = d[k] * low[k] / x
        s[k + 1] = down[k] * low[k] * s[k] - value
    p[-1] = d[-1] - value
    for k in range(n - 2, -1, -1):
        x = d[k] * low[k] * low[k] + p[k + 1]
        x = x if abs(x) > tiny else math.copysign(tiny, x)
        up[k] = low[k] * d[k] / x
        p[k] = p[k + 1] * d[k] / x - value
    r = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def right_singular(m: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of the square matrix ``m``, falling, and the right singular vectors (rows) of the
    first ``most``, the largest entry of each positive."""
    a, b, w = bidiagonalise(m)
    scale = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    b[np.abs(b) <= _EPS * scale] = 0.0
    edges = [0, *(np.flatnonzero(b == 0) + 1).tolist(), len(a)]
    found = []  # (value, block start, block end)
    for lo, hi in zip(edges, edges[1:]):
        found += [(x, lo, hi) for x in dqds(a[lo:hi], b[lo:hi - 1])]
    found.sort(key=lambda f: -f[0])
    values = np.array([f[0] for f in found])
    vectors: list[np.ndarray] = []
    rng = np.random.default_rng(5)
    for k, (x, lo, hi) in enumerate(found[:most]):
        z = np.zeros(len(a))
        z[lo:hi] = twisted_vector(a[lo:hi], b[lo:hi - 1], x)
        near = [vectors[j] for j in range(k) if found[j][1] == lo and values[j] - x <= _CLUSTER * values[j]]
        block = np.diag(a[lo:hi]) + np.diag(b[lo:hi - 1], 1)
        block = block.T @ block
        most_of = values[0]
        for trial in range(20):
            for _ in range(3):
                for v in near:
                    z -= (v @ z) * v
                z /= max(np.linalg.norm(z), np.finfo(float).tiny)
            apart = max((abs(v @ z) for v in near), default=0.0)
            if z.any() and max(apart * most_of, np.linalg.norm(block @ z[lo:hi] - x * z[lo:hi])) <= _RESIDUAL * (len(a) + 10) * most_of:
                break
            # Vectors of a tight cluster coincided: inverse iteration from a new start beside those found.
            moved = block - (x + 4 * _EPS * most_of * (trial + 1)) * np.eye(hi - lo)
            z = np.zeros(len(a))
            z[lo:hi] = rng.normal(size=hi - lo)
            for _ in range(3):
                for v in near:
                    z -= (v @ z) * v
                z[lo:hi] = np.linalg.solve(moved, z[lo:hi])
                z /= np.linalg.norm(z)
        vectors.append(z)
    out = np.array(vectors).reshape(len(vectors), len(a)) @ w.T
    for v in out:
        v *= math.copysign(1.0, v[np.argmax(np.abs(v))])
    return values, out
