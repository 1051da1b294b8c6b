"""Null-aware scalar functions. NaN and infinities count as missing and become null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; null stays null."""
    y = x if low is None else F.greatest(x, F.lit(float(low)))
    y = y if high is None else F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -40, 40)))


def row_mean(columns: list[Column]) -> Column:
    """Mean of the values that are there; null if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return ratio(total, count)


def weighted_mean(columns: list[Column], weights: list[float]) -> Column:
    """Weighted mean of the values that are there; negative weights count as 0."""
    pairs = [(c, max(w, 0.0)) for c, w in zip(columns, weights, strict=True)]
    total = reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for c, w in pairs])
    weight = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in pairs])
    return ratio(total, weight)


def entropy(columns: list[Column]) -> Column:
    """Normalised entropy of nonnegative weights."""
    import math

    total = reduce(lambda a, b: a + b, columns)
    terms = [F.when(c > 0, -(c / total) * F.ln(c / total)).otherwise(0.0) for c in columns]
    return reduce(lambda a, b: a + b, terms) / math.log(len(columns))


def project_price(base: Column, change: Column, log: bool = True) -> Column:
    """Price after a return; null for changes out of bounds."""
    return F.when((F.abs(change) <= 2) & (change > -0.99), base * F.exp(change) if log else base * (1 + change))


def slug(name: Column) -> Column:
    """Lower case, other characters as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_|_$", "")


def pinball(actual: Column, predicted: Column, q: float) -> Column:
    e = actual - predicted
    return F.greatest(e * q, e * (q - 1))


def interval_score(y: Column, low: Column, high: Column, alpha: float) -> Column:
    zero = F.lit(0.0)
    return (high - low) + (2 / alpha) * F.greatest(low - y, zero) + (2 / alpha) * F.greatest(y - high, zero)


def wis_sum(y: Column, q05: Column, q25: Column, q50: Column, q75: Column, q95: Column) -> Column:
    """Half the median error and a quarter of each interval score."""
    return 0.5 * F.abs(y - q50) + 0.25 * interval_score(y, q25, q75, 0.5) + 0.25 * interval_score(y, q05, q95, 0.1)


def wis_canonical(y: Column, q05: Column, q25: Column, q50: Column, q75: Column, q95: Column) -> Column:
    """Interval scores weighted by half their level, over 2.5. Not comparable with `wis_sum`."""
    return (0.5 * F.abs(y - q50) + 0.05 * interval_score(y, q05, q95, 0.1) + 0.25 * interval_score(y, q25, q75, 0.5)) / 2.5
