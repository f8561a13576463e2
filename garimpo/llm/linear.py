"""Sparse logistic regression over hashed or named features, boosted trees and isotonic calibration, in NumPy.

Models are fitted on bounded samples.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np


def fit_logistic(rows: list[list[str]], labels: np.ndarray, weights: np.ndarray | None = None, epochs: int = 12, rate: float = 0.5, l2: float = 1e-5, least: int = 2, seed: int = 0, start: float = 1.0) -> dict[str, float]:
    """Weights by feature name (``""`` is the intercept); features of fewer than ``least`` rows are left out."""
    seen = Counter(f for r in rows for f in set(r))
    number = {f: i + 1 for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    index = [np.array([0, *sorted({number[f] for f in r if f in number})]) for r in rows]
    # a large start of the squared gradients keeps rare features from learning single rows by heart
    w, g = np.zeros(len(number) + 1), np.full(len(number) + 1, start)
    y, weights = np.asarray(labels, float), np.ones(len(rows)) if weights is None else weights
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for s in range(0, len(order), 64):
            part = order[s : s + 64]
            size = np.array([len(index[i]) for i in part])
            flat = np.concatenate([index[i] for i in part])
            z = np.add.reduceat(w[flat], np.cumsum(size) - size)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weights[part]
            at, inverse = np.unique(flat, return_inverse=True)
            grad = np.bincount(inverse, np.repeat(error, size)) + l2 * len(part) * w[at]
            g[at] += grad * grad
            w[at] -= rate * grad / np.sqrt(g[at])
    out = {f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-4}
    out[""] = float(w[0])
    return out


class Hashed:
    """Logistic regression over features hashed into a table of ``2 ** bits`` weights; cell 0 is the intercept."""

    def __init__(self, bits: int = 18):
        self.size = 1 << bits
        self.weights = np.zeros(self.size, np.float32)

    def cells(self, features) -> np.ndarray:
        mask, crc = self.size - 1, zlib.crc32
        return np.unique(np.array([0, *[crc(f.encode("utf-8", "surrogatepass")) & mask or 1 for f in features]], np.int64))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 14, rate: float = 0.5, l2: float = 3e-4, least: int = 5, seed: int = 0, enough: float = 2e-3) -> Hashed:
        """Adagrad in batches of 64 until an epoch moves the mean loss by less than ``enough`` of it; cells of fewer than ``least`` rows keep weight 0, and so do all without rows."""
        if not rows:
            return self
        known = np.bincount(np.concatenate(rows), minlength=self.size) >= least
        known[0] = True
        index = [r[known[r]] for r in rows]
        w, g, y = np.zeros(self.size), np.ones(self.size), np.asarray(labels, float)
        random, before = np.random.default_rng(seed), np.inf
        for _ in range(epochs):
            order, loss = random.permutation(len(rows)), 0.0
            for s in range(0, len(order), 64):
                part = order[s : s + 64]
                size = np.fromiter((len(index[i]) for i in part), np.int64, len(part))
                flat = np.concatenate([index[i] for i in part])
                p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[flat], np.cumsum(size) - size), -30, 30)))
                loss -= float(np.log(np.maximum(np.where(y[part] > 0, p, 1 - p), 1e-9)).sum())
                at, inverse = np.unique(flat, return_inverse=True)
                grad = np.bincount(inverse, np.repeat(p - y[part], size)) + l2 * len(part) * w[at]
                g[at] += grad * grad
                w[at] -= rate * grad / np.sqrt(g[at])
            if before - loss < enough * before:
                break
            before = loss
        self.weights = w.astype(np.float32)
        return self

    def probability(self, features) -> float:
        return self.of_cells(self.cells(features))

    def of_cells(self, cells: np.ndarray) -> float:
        return probability(float(self.weights[cells].sum()))


def score(model: dict[str, float], features) -> float:
    get = model.get
    return model[""] + sum([get(f, 0.0) for f in set(features)])


def probability(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def best_threshold(p: np.ndarray, y: np.ndarray, low: float = 0.3, high: float = 0.9) -> float:
    """The threshold of highest F1 on held-out rows; the middle of the best stretch."""
    grid = np.linspace(low, high, 61)
    f1 = np.array([2 * ((p >= t) & y).sum() / max(1, (p >= t).sum() + y.sum()) for t in grid])
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    return float(grid[best[len(best) // 2]])


def isotonic(p: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (scores, calibrated probabilities) to interpolate between."""
    order = np.argsort(p, kind="stable")
    w = np.ones(len(p)) if w is None else w
    blocks: list[list[float]] = []
    for x, v, k in zip(p[order], np.asarray(y, float)[order], w[order]):
        blocks.append([x, x, v * k, k])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]
    x = np.array([v for b in blocks for v in (b[0], b[1])])
    return x, np.array([v for b in blocks for v in (b[2] / b[3],) * 2])


class Trees:
    """Gradient-boosted trees for the logistic loss on binned dense features."""

    def __init__(self, count: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 5.0):
        self.count, self.depth, self.rate, self.bins, self.least = count, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = np.log(mean / (1 - mean))
        z = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-z))
            tree, leaf = self.grow(b, y - p, p * (1 - p))
            z += tree[2][leaf]
            self.trees.append(tree)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], axis=1).astype(np.int16)

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A complete tree: feature and bin of each inner node (-1: none), value of each leaf."""
        node = np.zeros(len(b), np.int64)
        feature, split = np.full(2**self.depth, -1), np.zeros(2**self.depth, np.int64)
        width = self.bins + 1
        for level in range(self.depth):
            n = 2**level
            best = np.full(n, 1e-6)
            for f in range(b.shape[1]):
                cell = node * width + b[:, f]
                sg = np.cumsum(np.bincount(cell, g, n * width).reshape(n, width), axis=1)
                sh = np.cumsum(np.bincount(cell, h, n * width).reshape(n, width), axis=1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                gain[(sh < self.least / 4) | (th - sh < self.least / 4)] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(n), at] > best
                best[better] = gain[np.arange(n), at][better]
                feature[n - 1 + np.flatnonzero(better)], split[n - 1 + np.flatnonzero(better)] = f, at[better]
            f = feature[n - 1 + node]
            right = (f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > split[n - 1 + node])
            node = 2 * node + right
        n = 2**self.depth
        value = self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + 1)
        return (feature, split, value), node

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        z = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, split, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                n = 2**level
                f = feature[n - 1 + node]
                node = 2 * node + ((f >= 0) & (b[rows, np.maximum(f, 0)] > split[n - 1 + node]))
            z += value[node]
        return z
