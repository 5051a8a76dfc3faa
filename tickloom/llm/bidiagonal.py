"""Singular values and right singular vectors of a small square matrix by qd transforms."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
TINY = float(np.finfo(float).tiny)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reflections from both sides: ``r = U B V'`` with upper bidiagonal B; returns B's two diagonals and V."""
    a = np.array(r, float)
    n = len(a)
    right = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        """v and b with (I - b v v') x = a multiple of the first unit vector."""
        scale = np.abs(x).max(initial=0.0)
        if scale == 0.0 or not (x[1:] != 0).any():
            return np.zeros(len(x)), 0.0
        v = x / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v, 2.0 / (v @ v)

    for k in range(n):
        v, b = reflector(a[k:, k].copy())
        a[k:, k:] -= b * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v, b = reflector(a[k, k + 1:].copy())
            a[k:, k + 1:] -= b * np.outer(a[k:, k + 1:] @ v, v)
            right[:, k + 1:] -= b * np.outer(right[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One differential qd transform with a shift; None when the shift is above the smallest eigenvalue."""
    n = len(q)
    q2, e2 = np.empty(n), np.empty(max(n - 1, 0))
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None
        q2[i] = d + e[i]
        if q2[i] == 0.0:
            e2[i], d = 0.0, q[i + 1] - shift
            continue
        ratio = q[i + 1] / q2[i]
        e2[i] = e[i] * ratio
        d = d * ratio - shift
    if not d >= 0:
        return None
    q2[n - 1] = d
    return q2, e2, d


def _lower_bound(q: np.ndarray, e: np.ndarray) -> float:
    """At most the smallest eigenvalue: the inverse's trace, whose terms a transform without shift passes by."""
    total, d = 0.0, q[0]
    for i in range(len(q)):
        if d <= TINY:
            return 0.0
        total += 1.0 / d
        if i < len(q) - 1:
            d *= q[i + 1] / (d + e[i])
    return (1.0 - 8 * EPS) / total


def qd_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, largest first, each to high relative accuracy.

    Works on squares with shifts below the smallest value that is left, so nothing is ever subtracted that could cancel:
    a shift is the exact lower bound, or a bolder guess that is taken back when it proves too large. Values leave at the
    bottom once their coupling is negligible; a negligible coupling further up cuts the problem in two.
    """
    found: list[float] = []
    todo = [(np.asarray(diagonal, float) ** 2, np.asarray(above, float) ** 2, 0.0)]
    while todo:
        q, e, moved = todo.pop()
        gentle = 0
        while len(q) > 1:
            if e[-1] <= EPS * EPS * (moved + q[-1]) or e[-1] <= TINY:
                found.append(moved + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            cut = np.flatnonzero((e <= EPS * EPS * (moved + np.minimum(q[:-1], q[1:]))) | (e <= TINY))
            if len(cut):
                at = int(cut[-1]) + 1
                todo.append((q[:at], e[: at - 1], moved))
                q, e = q[at:], e[at:]
                continue
            if q[0] * 4 < q[-1]:  # the flipped factor has the same values, and small ones leave sooner at the bottom
                q, e = q[::-1].copy(), e[::-1].copy()
            low = _lower_bound(q, e)
            bold = low + 0.8 * max(q[-1] - e[-1] - low, 0.0) if gentle < 60 else low
            step = _dqds(q, e, bold) if bold > low else None
            shift = bold
            if step is None:
                shift, step = low, _dqds(q, e, low)
            if step is None:
                shift, step = 0.0, _dqds(q, e, 0.0)
            q, e, _ = step
            moved += shift
            gentle += 1
        found.append(moved + q[0])
    return np.sort(np.maximum(np.asarray(found), 0.0))[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """Vector and residual of B'B - value I from its factorisations down and up, joined where they nearly meet in zero."""
    n = len(a)
    q, e, ab = a * a, b * b, a[: n - 1] * b
    guard = EPS * EPS * max(value, TINY)

    def nonzero(x: float) -> float:
        return x if abs(x) > guard else np.copysign(guard, x)

    s, lower = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = nonzero(s[i] + q[i])
        lower[i] = ab[i] / pivot
        s[i + 1] = e[i] / pivot * s[i] - value
    p, upper = np.empty(n), np.empty(n)
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = nonzero(e[i] + p[i + 1])
        upper[i] = ab[i] / pivot
        p[i] = q[i] / pivot * p[i + 1] - value
    twist = s + p + value
    r = int(np.abs(twist).argmin())
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -upper[i] * z[i]
    return z, float(twist[r])


def _solve(a: np.ndarray, b: np.ndarray, value: float, x: np.ndarray) -> np.ndarray:
    """A step of inverse iteration with B'B - value I."""
    n = len(a)
    t = np.diag(a * a + np.r_[0.0, b * b]) + np.diag(a[: n - 1] * b, 1) + np.diag(a[: n - 1] * b, -1)
    t[np.diag_indices(n)] -= value
    try:
        y = np.linalg.solve(t, x)
    except np.linalg.LinAlgError:
        t[np.diag_indices(n)] += EPS * max(abs(value), TINY)
        y = np.linalg.solve(t, x)
    return y / np.linalg.norm(y)


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors (columns) of an upper bidiagonal matrix for its given squared singular values, largest first.

    Twisted factorisations give each vector on its own. Those of values closer than a thousandth are made orthogonal;
    where equal values gave the same vector twice, inverse iteration from another start finds the next one.
    """
    a, b = np.asarray(diagonal, float), np.asarray(above, float)
    rng = np.random.default_rng(3)
    out = np.zeros((len(a), len(values)))
    for j, value in enumerate(values):
        z, residual = _twisted(a, b, value)
        for _ in range(3):
            better = value + residual / (z @ z)
            if abs(better - value) <= 4 * EPS * value:
                break
            value, (z, residual) = better, _twisted(a, b, better)
        z /= np.linalg.norm(z)
        near = out[:, [i for i in range(j) if abs(values[i] - values[j]) <= 1e-3 * values[i]]]
        for attempt in range(8):
            for _ in range(2):
                z = z - near @ (near.T @ z)
            kept = np.linalg.norm(z)
            if kept > 0.5:
                break
            z = _solve(a, b, values[j] * (1 + 4 * EPS * attempt), z / kept if kept > 1e-3 else rng.standard_normal(len(a)))
        out[:, j] = z / np.linalg.norm(z)
    return out


def leading_directions(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of a square matrix, all of them, and unit right singular vectors (columns) of its ``k`` largest.

    Signs make the entry of largest magnitude positive. Values that are rounding of zero have zero vectors.
    """
    scale = float(np.abs(r).max(initial=0.0))
    n = len(r)
    if scale == 0.0:
        return np.zeros(n), np.zeros((n, k))
    diagonal, above, right = bidiagonalise(r / scale)
    values = qd_values(diagonal, above)
    wanted = values[:k]
    real = int((wanted > (n * EPS) ** 2 * values[0]).sum())
    vectors = np.zeros((n, k))
    vectors[:, :real] = right @ right_vectors(diagonal, above, wanted[:real])
    for j in range(real):
        vectors[:, j] *= np.sign(vectors[np.abs(vectors[:, j]).argmax(), j]) / np.linalg.norm(vectors[:, j])
    return values * scale * scale, vectors
