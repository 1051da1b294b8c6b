"""Quantile cones from fitted volatility models, refitted on a schedule.

Every refit day of a symbol is a group of its own: the returns that it may
know are dealt to it by row numbers, at most HISTORY of them, so refits run in
parallel and no symbol's fits wait for one another. Days take the last refit's
cone by an equi-join.
"""

from __future__ import annotations

from math import exp, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.forecasts import LEVELS, NAMES
from tidewright.operators.frames import Ordered
from tidewright.operators.likelihood import decayed, minimise

O = Ordered()  # noqa: E741
HISTORY = 2500
MEAN_ABS = sqrt(2 / np.pi)
#: Greatest constant of a variance, in units of the mean square.
MOST_CONSTANT = 10.0


def before_first(e: np.ndarray) -> float:
    """Variance that stands for the time before the first return: its first values with falling weights."""
    w = 0.94 ** np.arange(min(75, len(e)))
    return float((e[: len(w)] ** 2 * w).sum() / w.sum())


def garch_variance(e: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    back = before_first(e)
    square = np.concatenate([[back], e[:-1] ** 2])
    u = omega + alpha * square
    u[0] += beta * back
    return decayed(u[:, None], beta)[:, 0]


def fit_garch(e: np.ndarray) -> tuple[float, float, float]:
    """omega, alpha and beta of the greatest likelihood, with alpha + beta below 1."""
    back, square = before_first(e), np.concatenate([[before_first(e)], e[:-1] ** 2])
    mean = float((e * e).mean())

    def f(t: np.ndarray) -> tuple[float, np.ndarray]:
        # t: omega in units of the mean square, alpha + beta, and alpha's share of it
        omega, alpha, beta = t[0] * mean, t[1] * t[2], t[1] * (1 - t[2])
        v = garch_variance(e, omega, alpha, beta)
        u = np.column_stack([np.ones(len(e)), square, np.concatenate([[back], v[:-1]])])
        d = decayed(u, beta)
        slope = 0.5 * ((1 - e * e / v) / v) @ d
        return 0.5 * float((np.log(v) + e * e / v).sum()), np.array([slope[0] * mean, slope[1] * t[2] + slope[2] * (1 - t[2]), (slope[1] - slope[2]) * t[1]])

    low, high = np.array([1e-6, 1e-4, 1e-4]), np.array([MOST_CONSTANT, 0.9999, 0.9999])
    starts = [np.array([1 - p, p, s]) for p, s in ((0.98, 0.05), (0.9, 0.15), (0.5, 0.3))]
    best = min(starts, key=lambda t: f(t)[0])
    t, _, _ = minimise(f, best, low, high)
    return t[0] * mean, t[1] * t[2], t[1] * (1 - t[2])


def egarch_path(e: np.ndarray, t: np.ndarray, slopes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Log variances and, a row each, their derivatives by omega, alpha, gamma and beta."""
    omega, alpha, gamma, beta = t.tolist()
    back = float(np.log(before_first(e)))
    h, out = omega + beta * back, np.empty(len(e))
    d0, d1, d2, d3 = 1.0, 0.0, 0.0, back
    d = np.empty((len(e), 4)) if slopes else np.empty((0, 4))
    for i, v in enumerate(e.tolist()):
        out[i] = h
        if slopes:
            d[i, 0], d[i, 1], d[i, 2], d[i, 3] = d0, d1, d2, d3
        z = v * exp(-0.5 * max(min(h, 60.0), -60.0))
        size = abs(z) - MEAN_ABS
        if slopes:
            keep = beta - 0.5 * (alpha * abs(z) + gamma * z)
            d0, d1, d2, d3 = 1 + keep * d0, size + keep * d1, z + keep * d2, h + keep * d3
        h = omega + alpha * size + gamma * z + beta * h
    return out, d


def fit_egarch(e: np.ndarray) -> np.ndarray:
    def f(t: np.ndarray) -> tuple[float, np.ndarray]:
        h, d = egarch_path(e, t)
        with np.errstate(over="ignore", invalid="ignore"):
            z2 = e * e * np.exp(-h)
            return 0.5 * float((h + z2).sum()), 0.5 * (1 - z2) @ d

    level = float(np.log((e * e).mean()))
    low, high = np.array([-50.0, -2.0, -2.0, -0.9999]), np.array([50.0, 2.0, 2.0, 0.9999])
    starts = [np.array([(1 - b) * level, a, 0.0, b]) for a, b in ((0.1, 0.95), (0.2, 0.6))]
    t, _, _ = minimise(f, min(starts, key=lambda t: f(t)[0]), low, high, rounds=80)
    return t


def cones(returns: np.ndarray, horizons: list[int], least: int, levels: tuple[float, ...] = LEVELS) -> dict[str, np.ndarray]:
    """Quantiles (a row a horizon) by model; with fewer than `least` returns those of a normal cone."""
    normal = np.array([NormalDist().inv_cdf(q) for q in levels])
    if len(returns) < least or not np.ptp(returns):
        spread = float(returns.std(ddof=1)) if len(returns) > 1 else 0.0
        flat = np.outer(np.sqrt(horizons), normal * spread)
        return {"garch": flat, "egarch": flat}
    e = returns * 100
    omega, alpha, beta = fit_garch(e)
    v = garch_variance(e, omega, alpha, beta)
    path, ahead = np.empty(max(horizons)), omega + alpha * e[-1] ** 2 + beta * v[-1]
    for h in range(len(path)):
        path[h] = ahead
        ahead = omega + (alpha + beta) * ahead
    z = {"garch": e / np.sqrt(v)}
    wide = {"garch": np.sqrt(np.cumsum(path)[np.array(horizons) - 1]) / 100}
    log_v, _ = egarch_path(e, fit_egarch(e), slopes=False)
    # no closed form beyond a day: the last day's deviation, by the root of time
    z["egarch"], wide["egarch"] = e * np.exp(-log_v / 2), np.exp(log_v[-1] / 2) / 100 * np.sqrt(horizons)
    shape = {m: np.quantile(x, levels) if len(x) >= 50 else normal for m, x in z.items()}
    return {m: np.outer(wide[m], shape[m]) for m in z}


def volatility_cones(bars: DataFrame, horizons: tuple[int, ...] = (1, 3, 7, 15), every: int = 30, least: int = 500, history: int = HISTORY) -> DataFrame:
    """forecaster (garch or egarch), symbol, day, horizon and five quantiles of each day.

    A refit is due every `every` days and on the first day that knows `least` returns; before that each day has a
    normal cone with the deviation of what is known.
    """
    day = F.row_number().over(O.spec) - 1
    close = F.col("close")
    df = bars.select("symbol", "day", F.when((close > 0) & (F.lag(close).over(O.spec) > 0), F.ln(close / F.lag(close).over(O.spec))).alias("r"), day.alias("row"))
    known = df.withColumn("known", F.count("r").over(O.spec.rowsBetween(Window.unboundedPreceding, 0)))
    # the row of the last refit; days without enough returns are refits of their own
    enough = F.col("known") >= least
    first = F.min(F.when(enough, F.col("row"))).over(Window.partitionBy("symbol"))
    refit = F.when(~enough, F.col("row")).otherwise(F.greatest(F.col("row") - F.col("row") % every, first))
    dated = known.withColumn("refit", refit)
    late = dated.where(enough).select("symbol", "refit").distinct()
    # the refits that may know a row: each is the row's own or one of the next ones, at most history / every of them
    at = df.where(F.col("r").isNotNull()).select("symbol", "row", "r", F.explode(F.sequence(F.col("row") - F.col("row") % every, F.col("row") + history, F.lit(every))).alias("refit"))
    start = dated.where(enough & (F.col("known") == least)).select("symbol", F.col("row").alias("refit"))
    to_first = df.where(F.col("r").isNotNull()).select("symbol", "row", "r").join(F.broadcast(start), "symbol")  # a row a symbol
    dealt = at.unionByName(to_first).where((F.col("row") <= F.col("refit")) & (F.col("row") > F.col("refit") - history)).distinct().join(late, ["symbol", "refit"], "left_semi")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        found = cones(frame["r"].to_numpy(float)[-history:], list(horizons), 1)
        rows = [(frame["symbol"].iat[0], int(frame["refit"].iat[0]), m, h, *map(float, q)) for m, x in found.items() for h, q in zip(horizons, x, strict=True)]
        return pd.DataFrame(rows, columns=["symbol", "refit", "forecaster", "horizon", *NAMES])

    fitted = dealt.groupBy("symbol", "refit").applyInPandas(fit, "symbol string, refit int, forecaster string, horizon int, " + ", ".join(f"{n} double" for n in NAMES))
    made = dated.where(enough).select("symbol", "day", "refit").join(fitted, ["symbol", "refit"]).drop("refit")
    spread = F.coalesce(F.stddev_samp("r").over(O.spec.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    early = known.withColumn("spread", spread).where(~enough)
    early = early.select("symbol", "day", "spread", F.explode(F.array(*[F.lit(m) for m in ("garch", "egarch")])).alias("forecaster"))
    early = early.select("symbol", "day", "forecaster", "spread", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    normal = {n: F.col("spread") * F.sqrt("horizon") * NormalDist().inv_cdf(q) for n, q in zip(NAMES, LEVELS, strict=True)}
    return made.unionByName(early.withColumns(normal).drop("spread"))
