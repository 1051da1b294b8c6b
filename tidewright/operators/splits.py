"""Purged splits, audits of features, redundancy and small linear models."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def purged_split(df: DataFrame, order: str, train: float, select: float, purge: int, keys: list[str] | None = None) -> DataFrame:
    """part: train, purged, select or test, by row number; `purge` rows before each border are not used."""
    w = Window.partitionBy(*(keys or [])).orderBy(order)
    whole = Window.partitionBy(*(keys or []))
    d = df.withColumns({"_r": F.row_number().over(w), "_n": F.count(F.lit(1)).over(whole)})
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * select)
    r = F.col("_r")
    part = F.when(r <= a - purge, "train").when(r <= a, "purged").when(r <= b - purge, "select").when(r <= b, "purged").otherwise("test")
    return d.withColumn("part", part).drop("_r", "_n")


def outer_folds(n: int, test: int, step: int, count: int, least: int) -> list[tuple[int, int]]:
    """(train end, test end) of folds anchored at the latest row, oldest first."""
    ends = [n - i * step for i in range(count)]
    return [(e - test, e) for e in reversed(ends) if e - test >= least]


def sanitation(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: share of missing values, distinct values, spread, and whether it is constant.

    One column at a time: several exact distinct counts in one aggregation would copy every row for each of them.
    """
    parts = [df.agg(F.lit(c).alias("feature"), F.avg(F.col(c).isNull().cast("double")).alias("missing"), F.countDistinct(c).alias("distinct_values"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias("sd"), F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias("constant")) for c in columns]
    return reduce(DataFrame.unionByName, parts)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Upper triangle of the correlation matrix in one aggregation; as many columns as features."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("p")).select("p.*")


def clusters(df: DataFrame, columns: list[str], least: float = 0.95) -> dict[str, str]:
    """First feature of each group of features tied by absolute correlations; features are few, so the driver joins them."""
    top = {c: c for c in columns}

    def find(c: str) -> str:
        while top[c] != c:
            c = top[c]
        return c

    for a, b, r in correlations(df, columns).collect():
        if r is not None and abs(r) >= least:
            x, y = sorted((find(a), find(b)), key=columns.index)
            top[y] = x
    return {c: find(c) for c in columns}


def principal(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, loadings (rows, by variance) and variances from one covariance aggregation; signs by the largest loading."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[F.avg(c) for c in columns], *[F.covar_pop(a, b) for a, b in pairs]).first()
    k = len(columns)
    cov = np.array(row[k:], float).reshape(k, k)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    load = vectors[:, order].T
    load *= np.sign(load[np.arange(k), np.abs(load).argmax(1)])[:, None]
    return np.array(row[:k], float), load, values[order]


def scores(df: DataFrame, columns: list[str], mean: np.ndarray, loading: np.ndarray) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(c) - float(m)) * float(w) for c, m, w in zip(columns, mean, loading, strict=True)])
