"""Eigendecompositions kept up to date by rank-one changes: secular equation, deflation, sums of spectra."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_EPS = np.finfo(float).eps


@dataclass
class Spectrum:
    """Scatter of ``n`` vectors about their ``mean``: ``vectors @ diag(values) @ vectors.T``, values ascending."""
    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(d: int) -> Spectrum:
        return Spectrum(0, np.zeros(d), np.zeros(d), np.eye(d))


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> np.ndarray:
    """``delta[i, j] = root_i - d_j`` for the roots of ``1 + rho * sum(z_j**2 / (d_j - x))``.

    ``d`` ascends strictly, no ``z`` is zero and ``rho`` is positive, so that root i lies between d_i and the next pole. Each root is
    sought from the nearer of the two, by fits of both poles' terms, kept inside a bracket by bisection."""
    k = len(d)
    z2 = rho * z * z
    if k == 1:
        return np.array([[z2[0]]])
    upper = np.append(d[1:], d[-1] + z2.sum())
    gap = upper - d
    middle = 1 + (z2 / (d - d[:, None] - gap[:, None] / 2)).sum(1)
    row = np.arange(k)
    near_upper = (middle < 0) & (row < k - 1)  # the last root has no pole above it
    origin = np.where(near_upper, upper, d)
    pole = d - origin[:, None]  # exact where it matters: near the origin
    low = np.where(near_upper, -gap / 2, 0.0)
    high = np.where(near_upper, 0.0, np.where(row < k - 1, gap / 2, gap))
    x = (low + high) / 2
    last = row == k - 1
    below = np.where(last, k - 2, row)  # the two poles of the fit
    under = row <= below[:, None]
    open_ = row
    for _ in range(200):
        p, at = pole[open_], x[open_]
        diff = p - at[:, None]
        term = z2 / diff
        f = 1 + term.sum(1)
        low[open_], high[open_] = np.where(f < 0, at, low[open_]), np.where(f < 0, high[open_], at)
        more = (np.abs(f) > 2 * _EPS * k * (1 + np.abs(term).sum(1))) & (high[open_] - low[open_] > 2 * _EPS * np.abs(at))
        if not more.any():
            break
        open_, diff, term, f = open_[more], diff[more], term[more], f[more]
        slope = term / diff
        here = np.arange(len(open_))
        d1, d2 = diff[here, below[open_]], diff[here, below[open_] + 1]
        s1 = (slope * under[open_]).sum(1)
        s2 = slope.sum(1) - s1
        # a fit with both poles, a + b1 / (d1 - t) + b2 / (d2 - t), that has the value and the slopes of either side
        a, linear, fixed = f - d1 * s1 - d2 * s2, f * (d1 + d2) - d1 * d2 * (s1 + s2), f * d1 * d2
        with np.errstate(all="ignore"):
            # of the two zeros the one between the poles, for the last root the one above both
            root = np.sqrt(np.maximum(linear * linear - 4 * a * fixed, 0)) * np.where(last[open_], -1, 1)
            step = np.where((linear > 0) != last[open_], 2 * fixed / (linear + root), (linear - root) / (2 * a))
            guess = x[open_] + step
            inside = (guess > low[open_]) & (guess < high[open_])
        x[open_] = np.where(inside, guess, (low[open_] + high[open_]) / 2)
    return x[:, None] - pole


def _solve(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Values and vectors of ``diag(d) + rho * z z^T`` with nothing to deflate. The vectors come from the z that belongs exactly to
    the computed roots, and so are orthogonal however close these lie."""
    delta = secular_roots(d, z, rho)
    k = len(d)
    if k == 1:
        return d + delta[0], np.ones((1, 1))
    between = d[:, None] - d[None, :]
    ratio = np.ones((k, k))
    # factor i of entry j: root_i - d_j over d_i - d_j for i < j, and over d_(i+1) - d_j for j <= i < k - 1
    for_low, for_high = np.triu(np.ones((k, k), bool), 1), np.tril(np.ones((k, k), bool))
    for_high[-1] = False
    ratio[for_low] = delta[for_low] / between[for_low]
    ratio[for_high] = delta[for_high] / between[np.roll(np.arange(k), -1)][for_high]
    ratio[-1] = delta[-1] / rho
    exact = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(z)
    vectors = exact[:, None] / -delta.T
    vectors /= np.linalg.norm(vectors, axis=0)
    values = d + np.diag(delta)
    return values, vectors


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``vectors diag(values) vectors^T + rho * v v^T``, values ascending, ``rho`` not negative.

    Deflation: eigenvalues that lie together are rotated by a reflection so that one of them meets all of v, and those that v
    does not meet are kept as they are."""
    z = vectors.T @ v
    size = float(z @ z)
    if rho * size <= 0:
        return values, vectors
    z, rho = z / np.sqrt(size), rho * size
    tol = 8 * _EPS * max(abs(values[0]), abs(values[-1]), rho)
    vectors = vectors.copy()
    run = np.flatnonzero(np.diff(values, prepend=-np.inf) > tol)
    for a, b in zip(run.tolist(), [*run[1:].tolist(), len(values)]):
        if b - a > 1 and (part := z[a:b].copy()).any():
            # a reflection that carries this part of z to its last entry
            length = np.linalg.norm(part)
            u = part + np.append(np.zeros(b - a - 1), np.copysign(length, part[-1]))
            u /= np.linalg.norm(u)
            vectors[:, a:b] -= 2 * np.outer(vectors[:, a:b] @ u, u)
            z[a:b] = 0
            z[b - 1] = -np.copysign(length, part[-1])
    met = np.abs(rho * z) > tol
    if not met.any():
        return values, vectors
    changed, inner = _solve(values[met], z[met], rho)
    values = values.copy()
    vectors[:, met] = vectors[:, met] @ inner
    values[met] = changed
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def add_vector(s: Spectrum, x: np.ndarray) -> Spectrum:
    """One more vector: its difference from the mean, centred, is one rank-one change of the scatter."""
    off = x - s.mean
    values, vectors = rank_one(s.values, s.vectors, off, s.n / (s.n + 1))
    return Spectrum(s.n + 1, s.mean + off / (s.n + 1), values, vectors)


def add_spectrum(s: Spectrum, t: Spectrum) -> Spectrum:
    """The scatter of both: the eigenvectors of ``t``, weighted by its values, and the difference of the means, one after the other."""
    if not s.n or not t.n:
        return s if s.n else t
    values, vectors = s.values, s.vectors
    for k in range(len(t.values)):
        values, vectors = rank_one(values, vectors, t.vectors[:, k], max(t.values[k], 0.0))
    off, n = t.mean - s.mean, s.n + t.n
    values, vectors = rank_one(values, vectors, off, s.n * t.n / n)
    return Spectrum(n, s.mean + off * (t.n / n), values, vectors)
