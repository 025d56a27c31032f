"""Singular values and right singular vectors of a square matrix, in numpy.

Householder reflections make the matrix bidiagonal; differential quotient-
difference steps with shifts (dqds) find the squares of its singular values to
high relative accuracy; twisted factorisations give the vectors of the largest.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
# Squares of couplings below this share of the squares beside them are nought.
_NOUGHT = (100 * _EPS) ** 2


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """``h`` and ``c`` for which x - c h (h.x) has nothing but a first entry."""
    size = np.linalg.norm(x)
    if size == 0:
        return x, 0.0
    h = x / size
    h[0] += np.copysign(1.0, h[0])
    return h, 2.0 / (h @ h)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of B, and V, where ``r`` is U B V' with
    orthogonal U and V."""
    a, n = np.array(r, dtype=float), len(r)
    v = np.eye(n)
    for k in range(n):
        h, c = _reflector(a[k:, k])
        a[k:, k:] -= c * np.outer(h, h @ a[k:, k:])
        if k < n - 2:
            h, c = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= c * np.outer(a[k:, k + 1 :] @ h, h)
            v[:, k + 1 :] -= c * np.outer(v[:, k + 1 :] @ h, h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float):
    """One dqds step; None if the shift is above the least value."""
    d, new_q, new_e = q[0] - shift, [], []
    for i, coupling in enumerate(e):
        if d < 0:
            return None
        own = d + coupling
        ratio = q[i + 1] / own if own else 1.0
        new_q.append(own)
        new_e.append(coupling * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    return [*new_q, d], new_e


def _below(q: list[float], e: list[float]) -> float:
    """A bound from below for the least value: one Newton step from nought. The
    reciprocals of a shiftless step's d sum to the trace of the inverse."""
    d, total = q[0], 0.0
    for i, coupling in enumerate(e):
        if d <= 0:
            return 0.0
        total += 1.0 / d
        d *= q[i + 1] / (d + coupling)
    return 0.0 if d <= 0 else (1 - 4 * len(q) * _EPS) / (total + 1.0 / d)


def squared_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling."""
    top = float(max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0)))
    if top == 0:
        return np.zeros(len(diagonal))
    # An exact nought would divide; 1e-200 of the largest square is far below rounding.
    q = np.maximum((diagonal / top) ** 2, 1e-200).tolist()
    blocks = [(q, ((upper / top) ** 2).tolist(), 0.0)]
    found = []
    while blocks:
        q, e, moved = blocks.pop()
        while len(q) > 1:
            if e[-1] <= _NOUGHT * (moved + q[-1]):
                found.append(moved + q.pop())
                e.pop()
                continue
            cut = next(
                (i for i, c in enumerate(e) if c <= _NOUGHT * (moved + min(q[i], q[i + 1]))), None
            )
            if cut is not None:
                blocks.append((q[cut + 1 :], e[cut + 1 :], moved))
                q, e = q[: cut + 1], e[:cut]
                continue
            if 1.5 * q[0] < q[-1]:  # the small end last: it converges first
                q.reverse()
                e.reverse()
            shift = _below(q, e)
            new = _step(q, e, shift)
            while new is None:
                shift = shift / 4 if shift > _EPS * q[-1] else 0.0
                new = _step(q, e, shift)
            (q, e), moved = new, moved + shift
        found.append(moved + q[0])
    return np.sort(np.array(found))[::-1] * top**2


class _Twisted:
    """B'B - value as N D N' with N twisted where D is least."""

    def __init__(self, diagonal: np.ndarray, upper: np.ndarray, value: float):
        # B'B is L D L' with D = diagonal**2 and L = upper / diagonal below the diagonal.
        d, low = (diagonal**2).tolist(), (upper / diagonal[:-1]).tolist()
        n, tiny = len(d), _EPS**2 * max(value, 1e-300)
        self.down, self.l = [0.0] * n, [0.0] * (n - 1)
        self.up, self.u = [0.0] * n, [0.0] * (n - 1)
        s, p = [0.0] * n, [0.0] * n
        s[0] = -value
        for i in range(n - 1):
            self.down[i] = s[i] + d[i] or tiny
            self.l[i] = d[i] * low[i] / self.down[i]
            s[i + 1] = self.l[i] * low[i] * s[i] - value
        self.down[n - 1] = s[n - 1] + d[n - 1] or tiny
        p[n - 1] = d[n - 1] - value
        for i in range(n - 2, -1, -1):
            self.up[i + 1] = d[i] * low[i] ** 2 + p[i + 1] or tiny
            ratio = d[i] / self.up[i + 1]
            self.u[i] = low[i] * ratio
            p[i] = p[i + 1] * ratio - value
        self.up[0] = p[0] or tiny
        gamma = [a + b + value for a, b in zip(s, p)]
        self.at = min(range(n), key=lambda i: abs(gamma[i]))
        self.gamma = gamma[self.at]
        self.tiny = tiny

    def _spread(self, y: list[float]) -> np.ndarray:
        """N'^-1 y."""
        for i in range(self.at - 1, -1, -1):
            y[i] -= self.l[i] * y[i + 1]
        for i in range(self.at, len(y) - 1):
            y[i + 1] -= self.u[i] * y[i]
        return np.array(y)

    def vector(self) -> np.ndarray:
        y = [0.0] * len(self.down)
        y[self.at] = 1.0
        return self._spread(y)

    def solve(self, b: np.ndarray) -> np.ndarray:
        y, at = b.tolist(), self.at
        for i in range(at):
            y[i + 1] -= self.l[i] * y[i]
        for i in range(len(y) - 1, at, -1):
            y[i - 1] -= self.u[i - 1] * y[i]
        pivots = [*self.down[:at], self.gamma or self.tiny, *self.up[at + 1 :]]
        return self._spread([v / p for v, p in zip(y, pivots)])


def _apart(z: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in known:
            z = z - (other @ z) * other
    return z


def right_vectors(
    diagonal: np.ndarray, upper: np.ndarray, squares: np.ndarray, count: int
) -> np.ndarray:
    """Unit right singular vectors of a bidiagonal matrix for the first ``count``
    of its squared singular values, as rows."""
    if not len(squares) or squares[0] == 0:
        return np.eye(count, len(diagonal))
    top = np.sqrt(squares[0])
    a, b = diagonal / top, upper / top
    a = np.where(np.abs(a) < 1e-100, 1e-100, a)
    known: list[np.ndarray] = []
    for j in range(count):
        value = float(squares[j] / top**2)
        factors = _Twisted(a, b, value)
        z = factors.vector()
        for _ in range(3):  # Rayleigh quotients, while they still move the value
            change = factors.gamma / (z @ z)
            if not 2 * _EPS * value < abs(change) < 1e-8 * value:
                break
            value += change
            factors = _Twisted(a, b, value)
            z = factors.vector()
        z = _apart(z / np.linalg.norm(z), known)
        if np.linalg.norm(z) < 0.5:
            # Equal values: the vectors known span this one's, so start from another.
            z = np.cos(np.arange(1.0, len(a) + 1) * (j + 1))
            for _ in range(4):
                z = _apart(z / np.linalg.norm(z), known)
                z = factors.solve(z / np.linalg.norm(z))
                z = _apart(z / np.linalg.norm(z), known)
        known.append(z / np.linalg.norm(z))
    return np.array(known).reshape(count, len(diagonal))


def largest(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of a square matrix, falling, and the unit right
    singular vectors of the first ``count``, as rows."""
    diagonal, upper, v = bidiagonal(r)
    squares = squared_values(diagonal, upper)
    return squares, right_vectors(diagonal, upper, squares, min(count, len(r))) @ v.T
