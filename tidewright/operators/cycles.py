"""Indicators whose own estimate of a cycle's length decides how far back they look.

The estimate of a row follows from that of the row before it, so a symbol's
daily rows are one group. Its filters with fixed lags are array operations;
the loop holds the recursion alone, and values at varying lags are gathered
at once with running sums.
"""

from __future__ import annotations

from math import atan, cos, exp, pi, radians

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewright.operators.recursion import ema, fold_rows

# Taps of the Hilbert transform at lags 0, 2, 4 and 6.
HILBERT = (0.0962, 0.5769, -0.5769, -0.0962)


def lagged(x: np.ndarray, n: int) -> np.ndarray:
    """x of n rows before; 0 before the first row."""
    return x if not n else np.concatenate([np.zeros(min(n, len(x))), x[:-n]])


def taps(x: np.ndarray, weights: tuple[float, ...], step: int = 1) -> np.ndarray:
    return sum((w * lagged(x, k * step) for k, w in enumerate(weights) if w), np.zeros(len(x)))


def look_back(x: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """x less its value `lag` rows before, with a lag for each row; NaN where there is none."""
    at = np.arange(len(x)) - lag
    return np.where(at >= 0, x - x[np.maximum(at, 0)], np.nan)


def homodyne_cycle(close: np.ndarray) -> np.ndarray:
    """Smoothed length of the dominant cycle, from the phase step of two smoothed quadrature components."""
    n = len(close)
    smooth = np.zeros(n)
    if n > 3:
        smooth[3:] = (4 * close[3:] + 3 * close[2:-1] + 2 * close[1:-2] + close[:-3]) / 10
    smooth = np.nan_to_num(smooth)
    started = np.arange(n) >= 6
    in_phase = np.where(started, taps(smooth, HILBERT, 2), 0)
    w0, w2, w4, w6 = HILBERT
    quadrature = np.where(started, taps(smooth, (w0, w2, -w2, -w0), 2), 0)
    # the newest tap of both second transforms is 0
    real = in_phase - taps(quadrature, (0.0, w2, w4, w6), 2)
    imaginary = quadrature + taps(in_phase, (0.0, w2, w4, w6), 2)
    out, a, b, re, im, period, length = np.zeros(n), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    for t in range(6, n):
        a1, b1 = a, b
        a, b = 0.2 * real[t] + 0.8 * a, 0.2 * imaginary[t] + 0.8 * b
        re, im = 0.2 * (a * a1 + b * b1) + 0.8 * re, 0.2 * (a * b1 - b * a1) + 0.8 * im
        found = 2 * pi / atan(im / re) if re and im else period
        period = min(max(min(max(found, 0.67 * period), 1.5 * period), 6.0), 50.0)
        length = 0.2 * period + 0.8 * length
        out[t] = length
    return out


def signal_to_noise(close: np.ndarray, cycle: np.ndarray) -> np.ndarray:
    """Decibels of the squared move over a cycle against its mean squared daily move; 0 where there is none."""
    moved = look_back(close, cycle) ** 2
    squares = np.cumsum(np.nan_to_num(np.diff(close, prepend=close[:1])) ** 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = moved / (look_back(squares, cycle) / cycle)
        out = np.where((cycle > 0) & (share > 0) & np.isfinite(share), 10 * np.log10(share), 0.0)
    return out


def cycle_regime(bars: DataFrame, threshold: float = 6.0, ratio_scale: float = 6.0, trend_scale: float = 0.01, bound: float = 2.0) -> DataFrame:
    """cycle, snr, regime (-1, 0, 1) and strength of each symbol and day."""

    def f(frame: pd.DataFrame) -> dict[str, np.ndarray]:
        close = frame["close"].to_numpy(float)
        cycle = np.rint(homodyne_cycle(close)).astype(np.int64)
        ratio = signal_to_noise(close, cycle)
        fast, slow = ema(close, 10), ema(close, 20)
        side = np.where((fast > slow) & (close > slow), 1.0, np.where((fast < slow) & (close < slow), -1.0, 0.0))
        regime = np.where(ratio > threshold, side, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            apart = np.nan_to_num(np.abs(fast - slow) / np.abs(np.where(close == 0, np.nan, close)))
        strength = regime * np.clip((ratio - threshold) / ratio_scale, 0, bound) * np.clip(apart / trend_scale, 0, bound)
        return {"cycle": cycle.astype(float), "snr": ratio, "regime": regime, "strength": strength}

    return fold_rows(bars.select("symbol", "day", "close"), f, ["cycle", "snr", "regime", "strength"]).drop("close")


def super_smoother(cutoff: float = 8.0) -> tuple[float, float, float, float]:
    """Weights of the input and of the last three outputs of a three-pole smoother."""
    a = exp(-pi / cutoff)
    b, c = 2 * a * cos(radians(1.738 * 180 / cutoff)), a * a
    return 1 - (b + c) + (c + b * c) - c * c, b + c, -(c + b * c), c * c


def cycle_lag(price: np.ndarray, alpha: float = 0.07, most: int = 75) -> np.ndarray:
    """Rows to look back: the dominant cycle's length by differences of phase, medians of five and two smoothings."""
    n = len(price)
    smooth = taps(price, (1.0, 2.0, 2.0, 1.0)) / 6
    drive = (1 - alpha / 2) ** 2 * taps(smooth, (1.0, -2.0, 1.0))
    cycle = np.zeros(n + 6)  # six rows of zeros come first
    for t in range(n):
        cycle[t + 6] = drive[t] + 2 * (1 - alpha) * cycle[t + 5] - (1 - alpha) ** 2 * cycle[t + 4]
    w0, w2, w4, w6 = HILBERT
    raw = w0 * cycle[6:] + w2 * cycle[4:-2] + w4 * cycle[2:-4] + w6 * cycle[:-6]
    in_phase = cycle[3:-3]
    out, period, length, q1, i1, steps = np.zeros(n, np.int64), 0.0, 0.0, 0.0, 0.0, [0.0] * 5
    for t in range(n):
        q, i = raw[t] * (0.5 + 0.08 * period), in_phase[t]
        step = 0.0
        if q and q1:
            below = 1 + i * i1 / (q * q1)
            step = (i / q - i1 / q1) / below if below else 0.0
        steps = [min(max(step, 0.1), 1.1), *steps[:4]]
        middle = sorted([steps[0], steps[1], sorted(steps[2:])[1]])[1]
        period = 0.33 * (2 * pi / middle + 0.5 if middle else 15.0) + 0.67 * period
        length = 0.15 * period + 0.85 * length
        out[t] = min(most, round(abs(length - 1)))
        q1, i1 = q, i
    return out


def adaptive_momentum(bars: DataFrame) -> DataFrame:
    """lag and momentum: the middle price's move over as many rows as the cycle has, by a three-pole smoother."""

    def f(frame: pd.DataFrame) -> dict[str, np.ndarray]:
        price = np.nan_to_num(((frame["high"] + frame["low"]) / 2).to_numpy(float))
        lag = cycle_lag(price)
        moved = np.nan_to_num(look_back(price, lag))
        w, f1, f2, f3 = super_smoother()
        out, a, b, c = np.zeros(len(price)), 0.0, 0.0, 0.0
        for t, v in enumerate(moved.tolist()):
            a, b, c = w * v + f1 * a + f2 * b + f3 * c, a, b
            out[t] = a
        return {"lag": lag.astype(float), "momentum": out}

    return fold_rows(bars.select("symbol", "day", "high", "low"), f, ["lag", "momentum"]).drop("high", "low")
