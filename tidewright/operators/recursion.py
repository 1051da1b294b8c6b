"""Recursions along time: exponential and Wilder means, seeded means, filters.

They are sequential for a key by nature, so each key is one group of a grouped
Arrow kernel, and all recursions asked for run in one pass over it. A key's
history is its daily rows, which bounds the group.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from math import tanh

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ewm(x: np.ndarray, alpha: float, least: int = 0) -> np.ndarray:
    """y = a x + (1 - a) y; a gap lets the old weight decay; null until `least` values."""
    out, y, w, seen = np.full(len(x), np.nan), np.nan, 1.0, 0
    for i, v in enumerate(x):
        if v == v:
            seen += 1
            if y != y:
                y = v
            else:
                w *= 1 - alpha
                y = (w * y + alpha * v) / (w + alpha)
            w = 1.0
        elif y == y:
            w *= 1 - alpha
        if y == y and seen >= least:
            out[i] = y
    return out


def ema(x: np.ndarray, span: int, strict: bool = False) -> np.ndarray:
    return ewm(x, 2 / (span + 1), span if strict else 0)


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Seed: mean of what is there in the first n rows; a later gap stays for good."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    head = x[:n]
    y = np.nan if np.isnan(head).all() else np.nanmean(head)
    out[n - 1] = y
    for i in range(n, len(x)):
        y = y + (x[i] - y) / n
        out[i] = y
    return out


def smoothed(x: np.ndarray, n: int) -> np.ndarray:
    """Seed: simple mean of n rows; rows without a value are skipped."""
    out, y = np.full(len(x), np.nan), np.nan
    means = pd.Series(x).rolling(n, min_periods=n).mean().to_numpy()
    for i, v in enumerate(x):
        if v == v:
            y = means[i] if y != y else (y * (n - 1) + v) / n
            out[i] = y
    return out


def high_pass(x: np.ndarray, period: float) -> np.ndarray:
    """Two-pole high-pass filter; the first two rows are 0."""
    a = np.exp(-1.414 * np.pi / period)
    c2, c3 = 2 * a * np.cos(1.414 * np.pi / period), -a * a
    c1 = (1 + c2 - c3) / 4
    out = np.zeros(len(x))
    for i in range(2, len(x)):
        out[i] = c1 * (x[i] - 2 * x[i - 1] + x[i - 2]) + c2 * out[i - 1] + c3 * out[i - 2]
    return out


def integrate(x: np.ndarray, rho: float, bound: float = 0.0) -> np.ndarray:
    """Mean-reverting sum y = rho y + x; a gap adds nothing; with a bound it is squashed to stay within."""
    out, y = np.zeros(len(x)), 0.0
    for i, v in enumerate(x):
        y = rho * y + (v if v == v else 0.0)
        if bound:
            y = float(np.tanh(y / bound) * bound)
        out[i] = y
    return out


def local_level(x: np.ndarray, q: float, r: float) -> np.ndarray:
    """One-state Kalman filter of a level; gaps only predict."""
    out, m, p = np.full(len(x), np.nan), np.nan, 1.0
    for i, v in enumerate(x):
        if m != m:
            m = v
        else:
            p += q
            if v == v:
                k = p / (p + r)
                m, p = m + k * (v - m), (1 - k) * p
        out[i] = m
    return out


def local_trend(x: np.ndarray, q_level: float, q_trend: float, r: float, phi: float = 1.0) -> np.ndarray:
    """Two-state Kalman filter (level, damped trend): the filtered level."""
    out = np.full(len(x), np.nan)
    m, p = np.array([np.nan, 0.0]), np.eye(2)
    step, noise = np.array([[1.0, 1.0], [0.0, phi]]), np.diag([q_level, q_trend])
    for i, v in enumerate(x):
        if m[0] != m[0]:
            m[0] = v
        else:
            m, p = step @ m, step @ p @ step.T + noise
            if v == v:
                k = p[:, 0] / (p[0, 0] + r)
                m, p = m + k * (v - m[0]), p - np.outer(k, p[0])
        out[i] = m[0]
    return out


def spaced(days: np.ndarray, gap: int) -> np.ndarray:
    """1 for rows at least `gap` days after the last row that was taken."""
    out, last = np.zeros(len(days)), None
    for i, d in enumerate(days):
        if last is None or d >= last + gap:
            out[i], last = 1, d
    return out


def running_quantiles(x: np.ndarray, levels: tuple[float, ...], window: int | None, least: int) -> np.ndarray:
    """Quantiles of the values up to each row (of its last `window` rows), with linear interpolation.

    The values are kept in order, so a row costs one insertion instead of a sort of its frame.
    """
    out = np.full((len(x), len(levels)), np.nan)
    held: list[float] = []
    for i, v in enumerate(x.tolist()):
        if v == v:
            insort(held, v)
        if window is not None and i >= window and x[i - window] == x[i - window]:
            del held[bisect_left(held, x[i - window])]
        n = len(held)
        if n >= least:
            for j, q in enumerate(levels):
                at = q * (n - 1)
                k = int(at)
                out[i, j] = held[k] + (held[min(k + 1, n - 1)] - held[k]) * (at - k)
    return out


def running_quantile(x: np.ndarray, level: float, window: int | None, least: int, shift: int = 0) -> np.ndarray:
    """One running quantile, known `shift` rows before."""
    out = running_quantiles(x, (level,), window, least)[:, 0]
    return out if not shift else np.concatenate([np.full(shift, np.nan), out[:-shift]])[: len(x)]


def percentile_of_last(x: np.ndarray, window: int, least: int) -> np.ndarray:
    """Place of each value among those of the `window` rows before it: -1 below all, 1 not below any."""
    out, held = np.full(len(x), np.nan), []
    for i, v in enumerate(x.tolist()):
        if len(held) >= least and v == v:
            out[i] = 2 * bisect_right(held, v) / len(held) - 1
        if v == v:
            insort(held, v)
        if i >= window and x[i - window] == x[i - window]:
            del held[bisect_left(held, x[i - window])]
    return out


def clamp(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


class Trailing:
    """The last n values, in order of time and of size."""

    def __init__(self, n: int = 365, least: int = 60) -> None:
        self.n, self.least, self.queue, self.held = n, least, deque(), []

    def __len__(self) -> int:
        return len(self.held)

    def add(self, v: float) -> None:
        if v != v:
            return
        self.queue.append(v)
        insort(self.held, v)
        if len(self.queue) > self.n:
            del self.held[bisect_left(self.held, self.queue.popleft())]

    def quantile(self, q: float) -> float:
        at = q * (len(self.held) - 1)
        k = int(at)
        return self.held[k] + (self.held[min(k + 1, len(self.held) - 1)] - self.held[k]) * (at - k)

    def share(self, v: float) -> float:
        """v in percent of the 90th percentile; unknown with too little history, 0 for v up to 0."""
        if v != v:
            return float("nan")
        if v <= 0:
            return 0.0
        if len(self) < self.least:
            return float("nan")
        high = self.quantile(0.9)
        return clamp(100 * v / high, 0, 100) if high > 0 else 0.0

    def robust(self, v: float) -> float:
        """100 tanh(z / 2) against median and scaled median deviation, else the deviation; z within 4."""
        if v != v or len(self) < self.least:
            return float("nan")
        past = np.array(self.queue)
        middle = np.median(past)
        scale = 1.4826 * float(np.median(np.abs(past - middle)))
        if scale <= 1e-12:
            scale = float(past.std())
        return 100 * tanh(clamp((v - middle) / scale, -4, 4) / 2) if scale > 1e-12 else 0.0


def robust_scores(x: np.ndarray, window: int, least: int) -> np.ndarray:
    """Each value's robust score against the values before it."""
    past, out = Trailing(window, least), np.full(len(x), np.nan)
    for i, v in enumerate(x.tolist()):
        out[i] = past.robust(v)
        past.add(v)
    return out


def robust_z(x: np.ndarray, window: int, least: int) -> np.ndarray:
    """(x - m) / 1.4826 d of the last rows: m their median, d the median of the rows' own |x - m|; NaN without spread."""
    m = running_quantiles(x, (0.5,), window, least)[:, 0]
    spread = 1.4826 * running_quantiles(np.abs(x - m), (0.5,), window, least)[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(spread != 0, (x - m) / spread, np.nan)


def share_of_high(x: np.ndarray, history: np.ndarray, window: int, least: int) -> np.ndarray:
    """x in percent of the 90th percentile of history's rows before, within 0 and 100; 0 for x up to 0."""
    high = np.concatenate([[np.nan], running_quantiles(history, (0.9,), window, least)[:-1, 0]])[: len(x)]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(high > 0, np.clip(100 * x / high, 0, 100), np.where(high <= 0, 0.0, np.nan))
    return np.where(x <= 0, 0.0, np.where(np.isnan(x), np.nan, share))


def share_of_amounts(x: np.ndarray, window: int, least: int) -> np.ndarray:
    """The same against the last positive values themselves."""
    out, at = np.where(x <= 0, 0.0, np.nan), np.flatnonzero(x > 0)
    out[at] = share_of_high(x[at], x[at], window, least)
    return out


def rolling_correlation(x: np.ndarray, y: np.ndarray, window: int, least: int) -> np.ndarray:
    """Correlation over the last rows in which both are known, from running sums; NaN without spread."""
    both = ~(np.isnan(x) | np.isnan(y))
    if not both.any():
        return np.full(len(x), np.nan)
    x, y = (np.where(both, v - v[both].mean(), 0.0) for v in (x, y))
    sums = np.cumsum(np.stack([both.astype(float), x, y, x * x, y * y, x * y]), axis=1)
    sums[:, window:] = sums[:, window:] - sums[:, :-window]
    with np.errstate(divide="ignore", invalid="ignore"):
        n, sx, sy, xx, yy, xy = sums
        spread = np.sqrt(np.maximum(xx / n - (sx / n) ** 2, 0) * np.maximum(yy / n - (sy / n) ** 2, 0))
        return np.where((n >= least) & (spread > 1e-14), (xy / n - sx * sy / n**2) / spread, np.nan)


@dataclass(frozen=True)
class Recursion:
    """`name` = f(values of `source`)."""

    name: str
    source: str
    f: Callable[[np.ndarray], np.ndarray]


def fold(df: DataFrame, recursions: list[Recursion], keys: tuple[str, ...] = ("symbol",), time: str = "day") -> DataFrame:
    """df with a column for each recursion; a recursion may read an earlier one's column."""
    schema = df.schema
    extra = ", ".join(f"`{r.name}` double" for r in recursions)

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(time).reset_index(drop=True)
        for r in recursions:
            frame[r.name] = r.f(frame[r.source].to_numpy(float, na_value=np.nan))
        return frame

    made = df.groupBy(*keys).applyInPandas(f, f"{_ddl(schema)}, {extra}")
    # NaN is no value anywhere else
    return made.replace(float("nan"), None, subset=[r.name for r in recursions])


def _ddl(schema) -> str:
    return ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in schema)


def fold_rows(df: DataFrame, f: Callable[[pd.DataFrame], dict[str, np.ndarray]], names: list[str], keys: tuple[str, ...] = ("symbol",), time: str = "day") -> DataFrame:
    """df with double columns `names` that f makes of all of a key's rows in time order, in one pass."""
    extra = ", ".join(f"`{n}` double" for n in names)

    def g(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(time).reset_index(drop=True)
        return frame.assign(**f(frame))

    return df.groupBy(*keys).applyInPandas(g, f"{_ddl(df.schema)}, {extra}").replace(float("nan"), None, subset=names)
