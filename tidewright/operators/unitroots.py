"""Rolling unit-root and stationarity statistics of each symbol's closes.

Windows overlap, so their normal equations are differences of running sums of
outer products: a row costs one product more and one less, whatever the
window. One Cholesky factor of a window gives the squared residuals of all
nested lag lengths at once, and a break in the mean enters a window's
regression as one more column by its Schur complement, for all break days at
once. A window with a gap, or one without movement, has no statistic.
"""

from __future__ import annotations

from math import ceil
from statistics import NormalDist

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from tidewright.operators.recursion import fold_rows

# MacKinnon's response surface of the p value for one series with a constant.
TAU_LEAST, TAU_TURN, TAU_MOST = -18.83, -1.61, 2.74
TAU_LOW = (2.1659, 1.4412, 0.038269)
TAU_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)


def most_lags(n: int) -> int:
    return ceil(12 * (n / 100) ** 0.25)


def p_value(stat: float) -> float:
    if stat != stat:
        return stat
    if stat > TAU_MOST or stat < TAU_LEAST:
        return float(stat > TAU_MOST)
    surface = TAU_LOW if stat <= TAU_TURN else TAU_HIGH
    return NormalDist().cdf(sum(c * stat**k for k, c in enumerate(surface)))


def sliding_gram(z: np.ndarray, n: int) -> np.ndarray:
    """Z'Z of the n rows up to each row; the first n - 1 rows have none."""
    running = np.cumsum((z[:, :, None] * z[:, None, :]).astype(np.longdouble), axis=0)
    running[n:] = running[n:] - running[:-n]
    return running[n - 1 :].astype(float)


def designs(x: np.ndarray, lags: int) -> np.ndarray:
    """Rows (1, level before, differences 1 to `lags` rows before, difference) for each row but the first lags + 1."""
    d = np.diff(x)
    rows = len(d) - lags
    return np.column_stack([np.ones(rows), x[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)], d[lags:]])


def moving(x: np.ndarray, n: int) -> np.ndarray:
    """Whether the n values up to each row are known and not all on one line."""
    out = np.zeros(len(x), bool)
    if len(x) >= n:
        w = sliding_window_view(x, n)
        known = np.isfinite(w).all(1)
        step = np.diff(w, axis=1)
        out[n - 1 :] = known & (np.ptp(np.where(known[:, None], step, 0), axis=1) > 0)
    return out


def lag_lengths(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Number of lagged differences with the least information criterion, for the windows of n values that end at rows `at`."""
    most = most_lags(n)
    most = max(min(most, n // 2 - 2), 0)
    rows = n - 1 - most
    gram = sliding_gram(designs(x, most), rows)[at - (n - 1)]
    # the last column's part in each step of the factor is what that column explains
    factor = np.linalg.cholesky(gram)
    left = gram[:, -1:, -1] - np.cumsum(factor[:, -1, :-1] ** 2, axis=1)
    columns = np.arange(2, most + 3)
    return (rows * np.log(left[:, 1:] / rows) + 2 * columns).argmin(1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """x in the unit of its deviations; the statistics don't depend on it."""
    known = x[np.isfinite(x)]
    spread = known.std() if len(known) else 0
    return np.nan_to_num((x - known.mean()) / spread) if spread else np.zeros(len(x))


def dickey_fuller(x: np.ndarray, n: int) -> np.ndarray:
    """Augmented Dickey-Fuller statistic with a constant and lags by the information criterion."""
    out, at = np.full(len(x), np.nan), np.flatnonzero(moving(x, n))
    if not len(at):
        return out
    x = _scaled(x)
    lags = lag_lengths(x, at, n)
    for k in np.unique(lags):
        own, rows = at[lags == k], n - 1 - k
        gram = sliding_gram(designs(x, k), rows)[own - (n - 1)]
        inverse = np.linalg.inv(gram[:, :-1, :-1])
        slope = np.einsum("wij,wj->wi", inverse, gram[:, :-1, -1])
        left = gram[:, -1, -1] - np.einsum("wi,wi->w", slope, gram[:, :-1, -1])
        out[own] = slope[:, 1] / np.sqrt(left / (rows - k - 2) * inverse[:, 1, 1])
    return out


def autoproducts(r: np.ndarray, k: int) -> np.ndarray:
    """Sum of products of each row's values k apart."""
    return (r[:, k:] * r[:, : r.shape[1] - k]).sum(1)


def kpss(x: np.ndarray, n: int) -> np.ndarray:
    """Stationarity statistic around a mean, with a data-driven number of kernel lags."""
    out, at = np.full(len(x), np.nan), np.flatnonzero(moving(x, n))
    if not len(at):
        return out
    w = sliding_window_view(x, n)[at - (n - 1)]
    r = w - w.mean(1, keepdims=True)
    square = (r * r).sum(1)
    products = np.stack([autoproducts(r, k) for k in range(1, n)], axis=1)
    few = int(n ** (2 / 9))
    zero = square / n + products[:, :few].sum(1) / (n / 2)
    first = (products[:, :few] * np.arange(1, few + 1)).sum(1) / (n / 2)
    lags = np.minimum((1.1447 * ((first / zero) ** 2) ** (1 / 3) * n ** (1 / 3)).astype(np.int64), n - 1)
    k = np.arange(1, n)
    weight = np.where(k <= lags[:, None], 1 - k / (lags[:, None] + 1), 0)
    long_run = (square + 2 * (weight * products).sum(1)) / n
    out[at] = (np.cumsum(r, axis=1) ** 2).sum(1) / n**2 / long_run
    return out


def phillips_perron(x: np.ndarray, n: int) -> np.ndarray:
    """t statistic of a unit root, with the residuals' long-run variance by kernel weights; from the (n + 1)-th row on."""
    ok = moving(x, n)
    ok[: min(n, len(ok))] = False
    out, at = np.full(len(x), np.nan), np.flatnonzero(ok)
    if not len(at):
        return out
    w = sliding_window_view(x, n)[at - (n - 1)]
    y, z, rows = w[:, 1:], w[:, :-1], n - 1
    zc = z - z.mean(1, keepdims=True)
    spread = (zc * zc).sum(1)
    rho = (zc * y).sum(1) / spread
    u = y - y.mean(1, keepdims=True) - rho[:, None] * zc
    square, lags = (u * u).sum(1), most_lags(n)
    long_run = (square + 2 * sum((1 - k / (lags + 1)) * autoproducts(u, k) for k in range(1, lags + 1))) / rows
    plain, s2 = square / rows, square / (rows - 2)
    error = np.sqrt(s2 / spread)
    out[at] = np.sqrt(plain / long_run) * (rho - 1) / error - 0.5 * (long_run - plain) / np.sqrt(long_run) * (rows * error / np.sqrt(s2))
    return out


def break_statistic(x: np.ndarray, lags: int, trim: float = 0.15) -> float:
    """Least t statistic of a unit root over all days at which the mean may break, with a trend."""
    n, cut = len(x), int(len(x) * trim)
    z = designs(x, lags)
    y, base = z[:, -1], np.column_stack([z[:, :-1], np.arange(len(z)) / len(z)])
    inverse = np.linalg.inv(base.T @ base)
    slope = inverse @ (base.T @ y)
    left, level = y @ y - slope @ (base.T @ y), 1
    at = np.arange(cut + 1, n - cut + 1) - (lags + 1)
    # sums from each break day on are the break column's products with all others
    after = np.cumsum(z[::-1], axis=0)[::-1][at]
    time = np.cumsum(base[::-1, -1])[::-1][at]
    cross, own = np.column_stack([after[:, :-1], time]), (len(z) - at).astype(float)
    to_base = cross @ inverse
    rest = own - (to_base * cross).sum(1)
    step = (after[:, -1] - cross @ slope) / rest
    freedom = len(y) - base.shape[1] - 1
    variance = (left - step**2 * rest) / freedom * (inverse[level, level] + to_base[:, level] ** 2 / rest)
    return float(((slope[level] - step * to_base[:, level]) / np.sqrt(variance)).min())


def zivot_andrews(x: np.ndarray, n: int) -> np.ndarray:
    """Unit-root statistic with one break in the mean at an unknown day; from the (n + 1)-th row on."""
    ok = moving(x, n)
    ok[: min(n, len(ok))] = False
    out, at = np.full(len(x), np.nan), np.flatnonzero(ok)
    if not len(at):
        return out
    x = _scaled(x)
    for t, k in zip(at.tolist(), lag_lengths(x, at, n).tolist(), strict=True):
        w = x[t - n + 1 : t + 1]
        out[t] = break_statistic(w - w.mean(), k)
    return out


NAMES = ["adf_p", "kpss", "zivot_andrews", "phillips_perron"]


def unit_root_statistics(bars: DataFrame, adf: int = 90, stationary: int = 40, other: int = 100) -> DataFrame:
    """adf_p, kpss, zivot_andrews and phillips_perron of each symbol and day."""

    def f(frame: pd.DataFrame) -> dict[str, np.ndarray]:
        close = frame["close"].to_numpy(float)
        found = [np.array([p_value(s) for s in dickey_fuller(close, adf).tolist()]), kpss(close, stationary), zivot_andrews(close, other), phillips_perron(close, other)]
        return dict(zip(NAMES, found, strict=True))

    return fold_rows(bars.select("symbol", "day", "close"), f, NAMES).drop("close")


def stationarity_statistics(bars: DataFrame, stationary: int = 40, other: int = 100) -> DataFrame:
    """kpss and phillips_perron alone."""

    def f(frame: pd.DataFrame) -> dict[str, np.ndarray]:
        close = frame["close"].to_numpy(float)
        return {"kpss": kpss(close, stationary), "phillips_perron": phillips_perron(close, other)}

    return fold_rows(bars.select("symbol", "day", "close"), f, ["kpss", "phillips_perron"]).drop("close")
