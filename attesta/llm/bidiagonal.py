"""Eigenvectors of ``R'R`` by a bidiagonal qd solver, for one matrix of the vectors' dimension.

Householder reflections make R upper bidiagonal (diagonal ``a``, beside it ``b``). The squares of its singular
values come from dqds, the differential quotient-difference algorithm with shifts, which keeps small ones
accurate to the last digits. Each eigenvector of ``B'B`` comes from a twisted factorisation: a stationary
sweep from the top and a progressive one from the bottom meet where the remaining pivot is smallest.
"""

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues closer than this share of their size: their vectors are made orthogonal to each other.
CLOSE = 1e-5


def bidiagonalise(r):
    """``a``, ``b`` and orthogonal ``v`` with ``r = u B v'`` for some orthogonal ``u``."""
    r = np.array(r, float)
    d = len(r)
    v = np.eye(d)

    def reflector(x):
        size = np.abs(x).max(initial=0.0)
        if not size or not np.abs(x[1:]).max(initial=0.0):
            return None
        w = x / size
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        w = reflector(r[k:, k])
        if w is not None:
            r[k:, k:] -= 2 * np.outer(w, w @ r[k:, k:])
        w = reflector(r[k, k + 1:])
        if w is not None:
            r[k:, k + 1:] -= 2 * np.outer(r[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(r).copy(), np.diag(r, 1).copy(), v


def _sweep(q, e, shift):
    """One dqds transform, or None if the shift was too large."""
    n = len(q)
    q2, e2, d = [0.0] * n, [0.0] * (n - 1), q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None
        q2[i] = top = d + e[i]
        if top <= 0:
            return None
        t = q[i + 1] / top
        e2[i] = e[i] * t
        d = d * t - shift
    if d < 0:
        return None
    q2[-1] = d
    return q2, e2


def dqds(a, b) -> np.ndarray:
    """The squared singular values of an upper bidiagonal matrix, falling."""
    out = []
    work = [([float(x) for x in np.square(a)], [float(x) for x in np.square(b)], 0.0)]
    while work:
        q, e, moved = work.pop()
        while True:
            if len(q) == 1:
                out.append(q[0] + moved)
                break
            small = [i for i in range(len(e)) if e[i] <= EPS * EPS * (q[i] + moved) or e[i] <= EPS * EPS * (q[i + 1] + moved)
                     or e[i] < 1e-290]
            if small:
                cuts = [0, *[i + 1 for i in small], len(q)]
                work += [(q[i:j], e[i:j - 1], moved) for i, j in zip(cuts, cuts[1:])]
                break
            # the smaller eigenvalue of the last two rows, tried a little lower each time, at last no shift
            x, y, z = q[-2], e[-1], q[-1]
            half = (x + y + z) / 2
            low = x * z / (half + np.sqrt(max(half * half - x * z, 0.0)))
            for shift in (low, low * 0.98, low / 2, low / 16, 0.0):
                swept = _sweep(q, e, shift)
                if swept is not None:
                    break
            q, e = swept
            moved += shift
            if q[0] < q[-1] / 4:      # large values first: the last ones converge soonest
                q, e = _turned(q, e)
    return np.sort(np.array(out))[::-1]


def _turned(q, e):
    """The same matrix from its other end."""
    return q[::-1], e[::-1]


def _twisted(d, l, value):
    """The pivots, and the multipliers of both sweeps, of ``L D L' - value``."""
    n = len(d)
    tiny = 1e-300
    down, up, s, p = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0)), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > tiny else EPS * EPS * (abs(d[i]) + value + tiny)
        down[i] = d[i] * l[i] / pivot
        s[i + 1] = down[i] * l[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * l[i] * l[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else EPS * EPS * (abs(d[i]) + value + tiny)
        t = d[i] / pivot
        up[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    return s + p + value, down, up


def _vector(twist, down, up):
    n = len(down) + 1
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def vectors(a, b, values) -> np.ndarray:
    """Unit eigenvectors (as columns) of ``B'B`` for the given eigenvalues of one unsplit bidiagonal block."""
    a = np.where(a == 0, EPS * EPS * max(np.abs(a).max(), np.abs(b).max(initial=0.0)), a)
    d, l = a * a, b / a[:-1]
    out = np.zeros((len(a), len(values)))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLOSE * abs(values[k - 1]):
            first = k
        pivots, down, up = _twisted(d, l, value)
        near = out[:, first:k]
        for twist in np.argsort(np.abs(pivots), kind="stable"):
            z = _vector(twist, down, up)
            for _ in range(2):
                z = z - near @ (near.T @ z)
            size = np.linalg.norm(z)
            if size > 0.3:            # else it repeats a vector of the cluster: twist elsewhere
                break
        out[:, k] = z / size
    return out


def eigen(r) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``r'r``, falling, and their unit eigenvectors as columns."""
    scale = np.abs(r).max(initial=0.0)
    if not scale:
        return np.zeros(len(r)), np.eye(len(r))
    a, b, v = bidiagonalise(r / scale)
    top = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    ends = [0, *(np.flatnonzero(np.abs(b) <= EPS * top / 8) + 1).tolist(), len(a)]
    values, columns = [], []
    for i, j in zip(ends, ends[1:]):
        found = dqds(a[i:j], b[i:j - 1])
        block = np.zeros((len(a), j - i))
        block[i:j] = vectors(a[i:j], b[i:j - 1], found)
        values.append(found)
        columns.append(block)
    values, columns = np.concatenate(values), np.concatenate(columns, 1)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale * scale, v @ columns[:, order]
