"""Isotonic calibration: pooled adjacent violators over blocks of equal forecasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.forecasts import NAMES


def pooled(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing values closest to y by weighted squares."""
    level: list[list[float]] = []  # mean, weight, rows
    for v, w in zip(y.tolist(), weight.tolist(), strict=True):
        level.append([v, w, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            v2, w2, n2 = level.pop()
            v1, w1, n1 = level[-1]
            level[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([x[0] for x in level], [int(x[2]) for x in level])


def curves(blocks: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """xs and ys of each key's curve from blocks(keys, x, total, n, median): a row for each different forecast.

    Fewer than `least` rows give the identity on [0, 1]; one forecast alone gives the median outcome.
    """
    types = dict(blocks.dtypes)

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("x")
        x, n = frame["x"].to_numpy(float), frame["n"].to_numpy(float)
        if n.sum() < least:
            x, y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        elif len(x) < 2:
            y = frame["median"].to_numpy(float)
        else:
            y = pooled(frame["total"].to_numpy(float) / n, n)
            # inside a flat piece only its ends matter
            keep = np.ones(len(y), bool)
            keep[1:-1] = (y[1:-1] != y[:-2]) | (y[1:-1] != y[2:])
            x, y = x[keep], y[keep]
        return pd.DataFrame([(*(frame[k].iat[0] for k in keys), x.tolist(), y.tolist())], columns=[*keys, "xs", "ys"])

    return blocks.groupBy(*keys).applyInPandas(f, ", ".join(f"{k} {types[k]}" for k in keys) + ", xs array<double>, ys array<double>")


def on_curve(x: Column, xs: Column, ys: Column) -> Column:
    """y at x by linear interpolation, flat beyond the ends; x itself without a curve."""
    k = F.size(F.filter(xs, lambda t: t <= x))
    low, high = F.element_at(xs, k), F.element_at(xs, k + 1)
    inside = F.element_at(ys, k) + (F.element_at(ys, k + 1) - F.element_at(ys, k)) * (x - low) / (high - low)
    return F.when(xs.isNull() | x.isNull(), x).when(k == 0, F.element_at(ys, 1)).when(k == F.size(xs), F.element_at(ys, -1)).otherwise(inside)


def isotonic_calibrated(df: DataFrame, actual: str = "y", fit_share: float = 0.65, least: int = 8) -> DataFrame:
    """Rows after the fitting share of each symbol and horizon, with sorted calibrated quantiles.

    df: symbol, day, horizon, the outcome and the five quantiles. Blocks of equal forecasts are added up before any
    row meets a curve's kernel.
    """
    k = Window.partitionBy("symbol", "horizon")
    dated = df.withColumn("_f", F.row_number().over(k.orderBy("day")) / F.count(F.lit(1)).over(k))
    long = dated.where((F.col("_f") <= fit_share) & F.col(actual).isNotNull()).select("symbol", "horizon", F.col(actual).alias("_y"), F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("x")) for n in NAMES])))
    blocks = long.where(F.col("x").isNotNull()).groupBy("symbol", "horizon", "name", "x").agg(F.sum("_y").alias("total"), F.count(F.lit(1)).alias("n"), F.percentile("_y", 0.5).alias("median"))
    # five arrays a symbol and horizon
    fitted = curves(blocks, ["symbol", "horizon", "name"], least).groupBy("symbol", "horizon").pivot("name", list(NAMES)).agg(F.first(F.struct("xs", "ys")))
    fitted = fitted.toDF("symbol", "horizon", *[f"_c_{n}" for n in NAMES])
    later = dated.where(F.col("_f") > fit_share).join(fitted, ["symbol", "horizon"], "left")
    made = F.array_sort(F.array(*[on_curve(F.col(n), F.col(f"_c_{n}.xs"), F.col(f"_c_{n}.ys")) for n in NAMES]))
    later = later.withColumn("_q", made)
    return later.select("symbol", "day", "horizon", F.col(actual).alias("actual"), *[F.col("_q")[i].alias(n) for i, n in enumerate(NAMES)])
