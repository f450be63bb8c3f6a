"""Hashed n-grams of texts, computed on whole byte buffers with numpy.

Texts are taken in parts of about a megabyte, cut at white space; no n-gram runs over such a cut.
Hashes are fixed arithmetic, so a model fitted on the driver meets the same features in tasks."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

PART = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_P = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words of letters, digits and characters over U+007F.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def parts(data: bytes, size: int = PART) -> Iterator[np.ndarray]:
    """The text as byte arrays of about ``size`` bytes."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + size)
        end = cut.start() if cut else len(data)
        yield np.frombuffer(data, np.uint8, end - at, at)
        at = end


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    """Hashes to ``bits`` bits."""
    h = (h ^ (h >> np.uint32(15))) * _MIX
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def char_grams(buf: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each byte on."""
    if len(buf) < n:
        return np.zeros(0, np.uint32)
    last = len(buf) - n + 1
    h = np.full(last, n, np.uint32)
    for k in range(n):
        h = h * _P + buf[k:k + last]
    return h


def word_bounds(buf: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words between white space, or of plain words."""
    inside = _PLAIN[buf] if plain else ~_BLANK[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each lower-cased word, from all its bytes."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    size = ends - starts
    rows = np.repeat(np.arange(len(starts)), size)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.full(int(size.max()), _P, np.uint32), dtype=np.uint32)
    value = (_LOWER[buf[starts[rows] + place]].astype(np.uint32) + np.uint32(1)) * power[place]
    return np.add.reduceat(value, np.cumsum(size) - size, dtype=np.uint32)


def word_heads(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: range) -> Iterator[np.ndarray]:
    """A hash of the first n bytes of each lower-cased word that has more, for each n of ``sizes``."""
    h = np.full(len(starts), 7, np.uint32)
    for k in range(max(sizes)):
        reach = starts + k < ends
        h = np.where(reach, h * _P + _LOWER[buf[np.minimum(starts + k, len(buf) - 1)]], h) if len(buf) else h
        if k + 1 in sizes:
            yield h[starts + k + 1 < ends] + np.uint32(k)


class Rows:
    """Sparse rows end to end: features, and values where given."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate(rows or [np.zeros(0, np.int64)])
        self.values = np.concatenate([np.zeros(0, np.float32), *values]) if values is not None else None
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _places(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.sizes[index]
        return np.repeat(self.starts[index] - (np.cumsum(size) - size), size) + np.arange(size.sum()), np.repeat(np.arange(len(index)), size)

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of some rows and the place of the row of each."""
        at, row = self._places(index)
        return self.flat[at], row

    def take_values(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, row = self._places(index)
        return self.flat[at], self.values[at], row


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Steps of stochastic gradient descent with running moments, over a dict of arrays."""

    def __init__(self, values: dict[str, np.ndarray], rate: float):
        self.values, self.rate, self.t = values, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in values.items()}
        self.v = {k: np.zeros_like(v) for k, v in values.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.values[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def platt(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through scores, by Newton's method with smoothed targets."""
    pos, neg = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * score + b)
        g = weight * (p - target)
        h = weight * p * (1 - p) + 1e-9
        grad = np.array([(g * score).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum()]])
        move = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        a, b = a - move[0], b - move[1]
        if abs(move).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)
