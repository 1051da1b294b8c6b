"""Maximum likelihood in a task: a bounded quasi-Newton search, and filters whose gradient runs along with them."""

from __future__ import annotations

from collections.abc import Callable
from math import log

import numpy as np

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def minimise(f: Objective, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200, memory: int = 10, tolerance: float = 1e-7, rest: float = 1e-12) -> tuple[np.ndarray, float, bool]:
    """Least point of f within bounds: point, value, and whether the search came to rest.

    f gives a value and its gradient; the search ends where the slope is below `tolerance` or a step gains less than
    `rest`, both relative to the value. Steps follow a limited-memory inverse Hessian of the coordinates that no bound
    holds, and are cut back at the bounds.
    """
    x = np.clip(start, low, high)
    value, slope = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(np.clip(x - slope, low, high) - x).max() < tolerance * max(1.0, abs(value)):
            return x, value, True
        free = ~(((x <= low) & (slope > 0)) | ((x >= high) & (slope < 0)))
        way, passed = np.where(free, slope, 0.0), []
        for s, y in reversed(steps):
            a = (s @ way) / (s @ y)
            way = way - a * y
            passed.append((a, s, y))
        if steps:
            s, y = steps[-1]
            way = way * (s @ y) / (y @ y)
        else:
            way = way / max(1.0, np.abs(way).max())
        for a, s, y in reversed(passed):
            way = way + s * (a - (y @ way) / (s @ y))
        way = np.where(free, -way, 0.0)
        if way @ slope >= 0:
            way, steps = np.where(free, -slope, 0.0) / max(1.0, np.abs(slope).max()), []
        size, found = 1.0, None
        for _ in range(40):
            there = np.clip(x + size * way, low, high)
            at, down = f(there)
            if np.isfinite(at) and at <= value + 1e-4 * (slope @ (there - x)):
                found = (there, at, down)
                break
            size /= 2
        if found is None:
            if not steps:
                return x, value, True
            steps = []
            continue
        there, at, down = found
        s, y = there - x, down - slope
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            steps = [*steps[-(memory - 1) :], (s, y)]
        still = abs(value - at) <= rest * max(1.0, abs(value))
        x, value, slope = there, at, down
        if still:
            return x, value, True
    return x, value, False


def decayed(u: np.ndarray, rate: float, block: int = 64) -> np.ndarray:
    """y_t = rate y_(t-1) + u_t for each column of u, in blocks of rows instead of a row at a time."""
    n, rest = len(u), -len(u) % block
    x = np.concatenate([u, np.zeros((rest, u.shape[1]))]).reshape(-1, block, u.shape[1])
    power = rate ** np.arange(block + 1)
    k = np.arange(block)
    inside = np.where(k[:, None] >= k[None, :], power[np.abs(k[:, None] - k[None, :])], 0.0)
    y = inside @ x
    carry = np.zeros(u.shape[1])
    for i in range(len(y)):
        y[i] += power[1:, None] * carry
        carry = y[i, -1]
    return y.reshape(-1, u.shape[1])[:n]


class TwoStateFilter:
    """y = level + deviation + noise; the level moves by b'x, the deviation decays by phi.

    `loss` is the recency-weighted negative log likelihood with penalties; the derivatives of state and covariance
    are carried along the rows. Parameters: phi by tanh, b, and log excess of the three variances over their floors.
    """

    def __init__(self, y: np.ndarray, x: np.ndarray, phi_most: float = 0.98, phi_least: float = 0.25, phi_penalty: float = 3.0, q_floor: float = 1e-5, r_floor: float = 5e-3, deviation_floor: float = 3.0, recency: float = 0.1, ratio_target: float = 80.0, ratio_penalty: float = 5.0, curvature: float = 0.5, phi_start: float = 0.6) -> None:
        self.y, self.x, self.k = y, x, x.shape[1]
        self.phi_most, self.phi_least, self.phi_penalty = phi_most, min(max(phi_least, 0.0), phi_most - 1e-3), max(phi_penalty, 0.0)
        self.ratio_target, self.ratio_penalty, self.curvature = ratio_target, ratio_penalty, curvature
        spread, moved = float(np.var(y)), observation_variance(y)
        r = max(moved, spread * r_floor, 1e-4)
        q, q_dev = r / max(ratio_target, 1.0), r / 15
        self.r_floor = max(moved, spread * r_floor, r / 2, 1e-6)
        self.q_floor = max(self.r_floor / max(ratio_target, 1.0), spread * q_floor, q / 4, 1e-8)
        self.dev_floor = max(self.r_floor / 25, spread * q_floor / 2, q_dev / 4, 1e-8) * max(deviation_floor, 1.0)
        t = np.arange(len(y)) / max(len(y) - 1, 1)
        w = np.exp(recency * (t - 1))
        self.weights = w / w.mean()
        first = np.clip(phi_start, max(0.0, self.phi_least) + 1e-3 if self.phi_least > 0 else 1e-3 - phi_most, phi_most - 1e-3)
        self.start = np.concatenate([[np.arctanh(first / phi_most)], np.zeros(self.k), np.log([q, q_dev, r])])

    def parameters(self, theta: np.ndarray) -> dict:
        q, d, r = np.exp(theta[1 + self.k :])
        return {"phi": self.phi_most * np.tanh(theta[0]), "b": theta[1 : 1 + self.k], "q": self.q_floor + q, "q_dev": self.dev_floor + d, "r": self.r_floor + r}

    def loss(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        p, k, size = self.parameters(theta), self.k, len(theta)
        phi, q, q_dev, r = p["phi"], p["q"], p["q_dev"], p["r"]
        unit = np.eye(size)
        d_phi = unit[0] * self.phi_most * (1 - np.tanh(theta[0]) ** 2)
        d_q, d_dev, d_r = (unit[1 + k + i] * np.exp(theta[1 + k + i]) for i in range(3))
        pulls = (self.x @ p["b"]).tolist()
        f = d = c = 0.0
        a = e = 1.0  # variances of level and deviation; c: their covariance
        # derivatives of level, deviation, a, c, e and r; an update is linear in them
        held = np.zeros((6, size))
        held[5] = d_r
        total, slope, bend, d_bend = 0.0, np.zeros(size), 0.0, np.zeros(size)
        for i, (y, w, pull, row) in enumerate(zip(self.y.tolist(), self.weights.tolist(), pulls, self.x, strict=True)):
            before, d_before = f, held[0].copy()
            held[0, 1 : 1 + k] += row
            held[2] += d_q
            held[4] *= phi * phi
            held[4] += d_dev
            held[1] *= phi
            held[3] *= phi
            held[[1, 3, 4], 0] += np.array((d, c, 2 * phi * e)) * d_phi[0]
            f, d, a, c, e = f + pull, phi * d, a + q, phi * c, phi * phi * e + q_dev
            s = a + 2 * c + e + r
            g, h, miss = (a + c) / s, (c + e) / s, y - f - d
            total += 0.5 * w * (log(s) + miss * miss / s)
            t, u, z = 0.5 * w * (1 - miss * miss / s) / s, -w * miss / s, miss / s
            turn = np.array((
                (1 - g, -g, (1 - g) * z, (1 - 2 * g) * z, -g * z, -g * z),
                (-h, 1 - h, -h * z, (1 - 2 * h) * z, (1 - h) * z, -h * z),
                (0, 0, (1 - g) ** 2, -2 * g * (1 - g), g * g, g * g),
                (0, 0, -(1 - g) * h, 1 - g - h + 2 * g * h, -g * (1 - h), g * h),
                (0, 0, h * h, -2 * h * (1 - h), (1 - h) ** 2, h * h),
                (u, u, t, 2 * t, t, t),
            ))
            made = turn @ held
            slope += made[5]
            made[5] = d_r
            held = made
            a, c, e = a - g * g * s, c - g * h * s, e - h * h * s
            f, d = f + g * miss, d + h * miss
            if i:
                bend += (f - before) ** 2
                d_bend += 2 * (f - before) * (held[0] - d_before)
        short = max(0.0, np.log(self.ratio_target) - np.log(r) + np.log(q))
        total += self.ratio_penalty * short * short
        slope = slope + 2 * self.ratio_penalty * short * (d_q / q - d_r / r)
        low = max(0.0, self.phi_least - phi)
        if self.phi_least > 0:
            total += self.phi_penalty * low * low
            slope = slope - 2 * self.phi_penalty * low * d_phi
        if self.curvature > 0 and len(self.y) > 1:
            total += self.curvature * bend / (len(self.y) - 1)
            slope = slope + self.curvature * d_bend / (len(self.y) - 1)
        return float(total), slope

    def fit(self, rounds: int = 100) -> dict:
        free = np.full(len(self.start), np.inf)
        theta, value, done = minimise(self.loss, self.start, -free, free, rounds, tolerance=1e-6, rest=2e-9)
        return self.parameters(theta) | {"loss": value, "converged": done}


def observation_variance(y: np.ndarray) -> float:
    """Variance of log returns of positive values, else of the values."""
    if len(y) < 2:
        return 1e-4
    v = float(np.var(y if (y <= 0).any() else np.diff(np.log(y))))
    return v if np.isfinite(v) and v > 0 else 1e-4


def two_state(y: np.ndarray, x: np.ndarray, p: dict, state: tuple | None = None) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Filtered level and deviation, and the state after the last row (to go on from)."""
    f, d, a, c, e = state or (0.0, 0.0, 1.0, 0.0, 1.0)
    phi, pulls, level, deviation = p["phi"], x @ np.asarray(p["b"], float), np.empty(len(y)), np.empty(len(y))
    for i, v in enumerate(y.tolist()):
        f, d, a, c, e = f + pulls[i], phi * d, a + p["q"], phi * c, phi * phi * e + p["q_dev"]
        ka, ke = a + c, c + e
        s = ka + ke + p["r"]
        miss = v - f - d
        f, d = f + ka / s * miss, d + ke / s * miss
        a, c, e = a - ka / s * ka, c - ka / s * ke, e - ke / s * ke
        level[i], deviation[i] = f, d
    return level, deviation, (f, d, a, c, e)
