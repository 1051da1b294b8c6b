"""Gradient-boosted trees in numpy: softmax loss, histogram splits, trees of fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    edges: list[np.ndarray]  # bin borders of each feature
    feature: np.ndarray  # rounds, classes, inner nodes
    cut: np.ndarray  # the same: bins above go right
    leaf: np.ndarray  # rounds, classes, leaves
    base: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Logits of each class."""
        b = self.bins(x)
        rows = np.arange(len(b))
        out = np.repeat(self.base[None], len(b), 0)
        rounds, classes, inner = self.feature.shape
        depth = (inner + 1).bit_length() - 1
        for r in range(rounds):
            for k in range(classes):
                at = np.zeros(len(b), np.int64)
                for _ in range(depth):
                    at = 2 * at + 1 + (b[rows, self.feature[r, k, at]] > self.cut[r, k, at])
                out[:, k] += self.leaf[r, k, at - inner]
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x)
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 48, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0, least: int = 6, share: float = 0.35, seed: int = 1) -> Boosted:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    n, f = x.shape
    inner = (1 << depth) - 1
    model = Boosted(edges, np.zeros((rounds, classes, inner), np.int64), np.full((rounds, classes, inner), 255, np.int64), np.zeros((rounds, classes, 1 << depth)), np.log((np.bincount(y, minlength=classes) + 1.0) / (n + classes)))
    b = model.bins(x)
    flat = b.astype(np.int64) + np.arange(f) * bins
    logit = np.repeat(model.base[None], n, 0)
    target = np.eye(classes)[y]
    whole, everything, rng = b, flat, np.random.default_rng(seed)
    for r in range(rounds):
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for k in range(classes):
            pick = np.flatnonzero(rng.random(len(whole)) < share)  # each tree sees a share of the rows
            b, flat, n = whole[pick], everything[pick], len(pick)
            q = p[pick, k]
            g, h = target[pick, k] - q, np.maximum(q * (1 - q), 1e-6)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                first, width = (1 << level) - 1, 1 << level
                cell = ((at - first)[:, None] * (f * bins) + flat).ravel()
                shape = (width, f, bins)
                hist = [np.bincount(cell, np.repeat(v, f), width * f * bins).reshape(shape).cumsum(2) for v in (g, h)]
                count = np.bincount(cell, minlength=width * f * bins).reshape(shape).cumsum(2)
                (gl, hl), (gt, ht) = hist, (hist[0][:, :, -1:], hist[1][:, :, -1:])
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(count < least) | (count[:, :, -1:] - count < least)] = 0
                best = gain.reshape(width, -1).argmax(1)
                good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
                model.feature[r, k, first : first + width] = np.where(good, best // bins, 0)
                model.cut[r, k, first : first + width] = np.where(good, best % bins, 255)
                at = 2 * at + 1 + (b[np.arange(n), model.feature[r, k, at]] > model.cut[r, k, at])
            own = at - inner
            value = rate * np.bincount(own, g, 1 << depth) / (np.bincount(own, h, 1 << depth) + ridge)
            model.leaf[r, k] = value
            at = np.zeros(len(whole), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (whole[np.arange(len(whole)), model.feature[r, k, at]] > model.cut[r, k, at])
            logit[:, k] += value[at - inner]
    return model
