"""Singular values and right singular vectors of a small square matrix, by qd transforms.

Householder reflections from both sides make the matrix upper bidiagonal. The differential qd
algorithm with shifts (dqds) finds its singular values from the squares of its entries,
without subtractions that lose digits, so the small ones are as accurate as the large ones.
Vectors come from twisted factorisations of the shifted tridiagonal ``B'B``: a factorisation from
the top and one from the bottom are joined where their pivot is smallest, and that row of the
inverse is the vector. Vectors whose values lie close together are found by inverse iteration with
the same factorisation and made orthogonal to each other.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
_TINY = float(np.finfo(np.float64).tiny)
_NEAR = 1e-3
"""Relative distance below which values form a cluster."""


def bidiagonalise(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor v of ``u' a v = b``; a is square."""
    a = np.array(a, dtype=np.float64)
    n = len(a)
    v = np.eye(n)
    for k in range(n):
        x = a[k:, k]
        if (reflector := _reflector(x)) is not None:
            a[k:, k:] -= np.outer(reflector, 2.0 * (reflector @ a[k:, k:]))
        if k + 2 < n and (reflector := _reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= np.outer(2.0 * (a[k:, k + 1 :] @ reflector), reflector)
            v[:, k + 1 :] -= np.outer(2.0 * (v[:, k + 1 :] @ reflector), reflector)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """Unit vector of the reflection that takes x to a multiple of the first axis."""
    scale = float(np.abs(x).max(initial=0.0))
    if len(x) < 2 or scale == 0.0 or not np.any(x[1:]):
        return None
    h = x / scale
    h[0] += np.copysign(np.linalg.norm(h), h[0])
    return h / np.linalg.norm(h)


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, list[float]] | None:
    """One dqds transform: the squares of a bidiagonal with the same values less the shift. None if the shift is too large."""
    d = q[0] - shift
    out_q, out_e, ds = [], [], [d]
    for k, off in enumerate(e):
        if d < 0.0:
            return None
        total = d + off
        if total <= 0.0:
            total = _TINY
        ratio = q[k + 1] / total
        out_q.append(total)
        out_e.append(off * ratio)
        d = d * ratio - shift
        ds.append(d)
    if not d >= 0.0:
        return None
    out_q.append(d)
    return out_q, out_e, min(ds), ds


def squared_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, largest first, by dqds."""
    found: list[float] = []
    todo = [((np.asarray(diagonal, dtype=np.float64) ** 2).tolist(), (np.asarray(above, dtype=np.float64) ** 2).tolist(), 0.0)]
    while todo:
        q, e, base = todo.pop()
        while q:
            if len(q) == 1:
                found.append(base + q[0])
                break
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= EPS * EPS * (base + max(q[k], q[k + 1])) or e[k] <= _TINY), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], base))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1]:  # the small ones to the end, where they converge
                q, e = q[::-1], e[::-1]
            still = _sweep(q, e, 0.0)
            q, e, _, ds = still if still else (q, e, 0.0, [0.0])
            # the reciprocals of ds are the diagonal of the inverse, so this is below the least value
            least = 1.0 / sum(1.0 / max(x, _TINY) for x in ds)
            # the smaller value of the last two rows: close to the least once it converges, but maybe above
            a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), e[-1], q[-1]
            half = 0.5 * (a + b + c)
            guess = a * c / (half + max(half * half - a * c, 0.0) ** 0.5) if half > 0 else 0.0
            for shift in (0.99 * guess, 0.99 * least, 0.0):
                if shift < 0.99 * least and shift:
                    continue
                moved = _sweep(q, e, shift)
                if moved:
                    q, e = moved[0], moved[1]
                    base += shift
                    break
    return np.array(sorted(found, reverse=True))


class _Twisted:
    """Twisted factorisation of ``l d l' - shift``, with its twist where the pivot is smallest."""

    def __init__(self, d: np.ndarray, low: np.ndarray, shift: float):
        n = len(d)
        least = EPS * max(abs(shift), _TINY)
        safe = lambda x: x if abs(x) > least * EPS else np.copysign(least * EPS, x)
        s, p = np.zeros(n), np.zeros(n)
        self.top, self.low = np.zeros(n), np.zeros(n)  # pivots and multipliers from the top
        self.bottom, self.up = np.zeros(n), np.zeros(n)  # and from the bottom
        s[0] = -shift
        for k in range(n - 1):
            self.top[k] = safe(s[k] + d[k])
            self.low[k] = d[k] * low[k] / self.top[k]
            s[k + 1] = self.low[k] * low[k] * s[k] - shift
        self.top[n - 1] = safe(s[n - 1] + d[n - 1])
        p[n - 1] = d[n - 1] - shift
        for k in range(n - 2, -1, -1):
            self.bottom[k + 1] = safe(d[k] * low[k] * low[k] + p[k + 1])
            ratio = d[k] / self.bottom[k + 1]
            self.up[k] = low[k] * ratio
            p[k] = p[k + 1] * ratio - shift
        self.bottom[0] = safe(p[0])
        gamma = s + p + shift
        self.at = int(np.argmin(np.abs(gamma)))
        self.pivot = float(gamma[self.at])

    def outward(self, z: np.ndarray) -> np.ndarray:
        for k in range(self.at - 1, -1, -1):
            z[k] -= self.low[k] * z[k + 1]
        for k in range(self.at, len(z) - 1):
            z[k + 1] -= self.up[k] * z[k]
        return z

    def vector(self) -> np.ndarray:
        z = np.zeros(len(self.top))
        z[self.at] = 1.0
        return self.outward(z)

    def solve(self, f: np.ndarray) -> np.ndarray:
        f = f.copy()
        for k in range(self.at):
            f[k + 1] -= self.low[k] * f[k]
        for k in range(len(f) - 1, self.at, -1):
            f[k - 1] -= self.up[k - 1] * f[k]
        pivots = np.concatenate((self.top[: self.at], [self.pivot or EPS * EPS], self.bottom[self.at + 1 :]))
        return self.outward(f / pivots)


def _block_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows: unit eigenvectors of ``b'b`` for its eigenvalues, of a bidiagonal that does not split."""
    n = len(diagonal)
    d, low = diagonal**2, above / diagonal[:-1]
    out = np.zeros((len(values), n))
    random = np.random.default_rng(n)
    start = 0  # of the cluster
    for i, value in enumerate(values):
        if i and values[i - 1] - value > _NEAR * values[i - 1]:
            start = i
        near_next = i + 1 < len(values) and value - values[i + 1] <= _NEAR * value
        if start == i and not near_next:
            z = np.zeros(n)
            for _ in range(3):
                twisted = _Twisted(d, low, float(value))
                z = twisted.vector()
                step = twisted.pivot / float(z @ z)  # Rayleigh quotient
                if abs(step) <= EPS * value:
                    break
                value = value + step
            out[i] = z / np.linalg.norm(z)
            continue
        twisted = _Twisted(d, low, float(value))
        z = random.standard_normal(n)
        for _ in range(5):
            z = twisted.solve(z / np.linalg.norm(z))
            z /= np.abs(z).max()
            for _ in range(2):
                z -= out[start:i].T @ (out[start:i] @ z)
            z /= np.linalg.norm(z)
        out[i] = z
    return out


def right_vectors(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of a square matrix, falling, and rows with the right singular vectors of the first ``count``.

    The entry of a vector with the largest size (the first of these) is positive.
    """
    n = len(a)
    diagonal, above, v = bidiagonalise(a)
    size = float(max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0)))
    if not size:
        return np.zeros(n), np.eye(n)[:count]
    diagonal = np.where(np.abs(diagonal) < EPS * EPS * size, EPS * EPS * size, diagonal)
    edges = [0, *(np.flatnonzero(np.abs(above) <= EPS * size * 1e-2) + 1).tolist(), n]
    blocks, total = [], []
    for a_, b_ in zip(edges[:-1], edges[1:], strict=True):
        own = squared_values(diagonal[a_:b_], above[a_ : b_ - 1])
        blocks.append((a_, b_, own))
        total += [(float(x), len(blocks) - 1) for x in own]
    total.sort(key=lambda x: (-x[0], x[1]))
    wanted = total[:count]
    rows = np.zeros((len(wanted), n))
    for k, (a_, b_, own) in enumerate(blocks):
        places = [i for i, (_, block) in enumerate(wanted) if block == k]
        if places:
            # whole clusters are not needed: what comes later is made orthogonal to what came before
            rows[places, a_:b_] = _block_vectors(diagonal[a_:b_], above[a_ : b_ - 1], own[: len(places)])
    rows = np.linalg.qr(v @ rows.T)[0].T  # orthogonal across blocks too, to the last digit
    signs = np.sign(rows[np.arange(len(rows)), np.argmax(np.abs(rows), axis=1)])
    return np.array([x for x, _ in total]), rows * signs[:, None]
