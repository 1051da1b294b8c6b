"""Ridge fits over many features from Gram matrices alone, and the choice of a prefix of ranked features.

One aggregation a (key, segment) sums all products of features and target;
fits, their errors on any other segment and all prefixes of a ranking follow
from these sums, so no row is read twice and only matrices as wide as the
features reach a kernel. A ranking's prefixes are leading blocks of one
Cholesky factor, so the next prefix costs one row of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.frames import Ordered

O = Ordered()  # noqa: E741


@dataclass(frozen=True)
class Selection:
    """Weights and bounds of the choice."""

    alpha: float = 1.0
    downstream: float = 0.5
    stability_penalty: float = 0.5
    sign_penalty: float = 0.1
    selection_weight: float = 0.5
    complexity_penalty: float = 0.002
    least_train: float = -1.0
    least_selection: float = -1.0
    budget: int = 4
    pool: int = 3
    least_folds: int = 1


def filled(df: DataFrame, features: Sequence[str], train: Column) -> DataFrame:
    """Missing values are the symbol's median over its train rows, or 0."""
    medians = df.where(train).groupBy("symbol").agg(*[F.percentile(c, 0.5).alias(f"_m_{c}") for c in features])
    df = df.join(medians, "symbol", "left")  # a row a symbol
    return df.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in features}).drop(*[f"_m_{c}" for c in features])


def grams(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """n, sums and the upper triangle of products of the columns, by key; one aggregation with partial sums."""
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in columns]).alias("sums"), F.array(*products).alias("products"))


def square(products: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = products
    return out + np.triu(out, 1).T


@dataclass
class Moments:
    """Counts, means and mean products of features (first) and target (last)."""

    n: int
    mean: np.ndarray
    product: np.ndarray

    @classmethod
    def of(cls, row: pd.Series, k: int) -> Moments:
        return cls(int(row["n"]), np.array(row["sums"], float) / row["n"], square(row["products"], k) / row["n"])


@dataclass
class Fit:
    coefficients: np.ndarray
    utility: float
    mse: float
    base_mse: float


def prefix_fits(train: Moments, other: Moments, order: Sequence[int], alpha: float) -> list[Fit]:
    """A ridge fit on the standardised first 0, 1, ... features of the order, and its errors on the other segment.

    Utility: 1 less the error relative to that of the train mean.
    """
    at = np.array(order, int)
    mean, spread = train.mean, np.sqrt(np.maximum(np.diag(train.product) - train.mean**2, 0))
    scale = np.where(spread[at] > 0, spread[at], 1.0)
    y = len(train.mean) - 1
    inside = (train.product[np.ix_(at, at)] - np.outer(mean[at], mean[at])) / np.outer(scale, scale) * train.n + alpha * np.eye(len(at))
    toward = (train.product[at, y] - mean[at] * mean[y]) / scale * train.n
    factor = np.linalg.cholesky(inside) if len(at) else np.zeros((0, 0))
    # the other segment's products around the train means, in train units
    around = other.product - np.outer(other.mean, mean) - np.outer(mean, other.mean) + np.outer(mean, mean)
    base, cross, gram = float(around[y, y]), around[at, y] / scale, around[np.ix_(at, at)] / np.outer(scale, scale)
    half = np.zeros(len(at))
    out = [Fit(np.zeros(0), 0.0, base, base)]
    for k in range(1, len(at) + 1):
        half[k - 1] = (toward[k - 1] - factor[k - 1, : k - 1] @ half[: k - 1]) / factor[k - 1, k - 1]
        b = np.linalg.solve(factor[:k, :k].T, half[:k])
        mse = base - 2 * b @ cross[:k] + b @ gram[:k, :k] @ b
        out.append(Fit(b, 1 - mse / base if base > 1e-15 else 0.0, float(mse), base))
    return out


def persistence_utility(train: Moments, other: Moments, alpha: float) -> float:
    """Gain of a one-feature fit of the feature's own future value over the last value; columns: feature, future."""
    fit = prefix_fits(train, other, [0], alpha)[1]
    stay = float(other.product[0, 0] - 2 * other.product[0, 1] + other.product[1, 1])
    return 1 - fit.mse / stay if stay > 1e-15 else 0.0


def choose(names: Sequence[str], folds: list[tuple[Moments, Moments]], future: dict[str, list[tuple[Moments, Moments]]], last: tuple[Moments, Moments], future_last: dict[str, tuple[Moments, Moments]], how: Selection) -> pd.DataFrame:
    """One row a feature: train scores over folds, selection score, place in the ranking, prefix objective and whether it is selected.

    folds: (train, validation) moments of features and target; future: for each feature the same with its own future
    value as target; last and future_last: (train, selection).
    """
    other = 1 - how.downstream
    rows = []
    for i, name in enumerate(names):
        scores, signs = [], []
        for f, (a, b) in enumerate(folds):
            fit = prefix_fits(a, b, [i], how.alpha)[1]
            scores.append(how.downstream * fit.utility + other * persistence_utility(*future[name][f], how.alpha))
            signs.append(np.sign(fit.coefficients[0]))
        known = np.array([s for s in signs if s])
        agree = max((known > 0).mean(), (known < 0).mean()) if len(known) else 0.0
        stable = float(np.mean(scores) - how.stability_penalty * np.std(scores)) if scores else -np.inf
        rows.append({"feature": name, "folds": len(scores), "mean_utility": float(np.mean(scores)) if scores else np.nan, "sign_agreement": float(agree), "stable_utility": stable, "train_score": stable - how.sign_penalty * (1 - agree)})
    out = pd.DataFrame(rows)
    able = out[(out["folds"] >= how.least_folds) & (out["stable_utility"] >= how.least_train)].sort_values(["train_score", "feature"], ascending=[False, True])
    pool = able["feature"].tolist()[: max(how.budget, how.budget * how.pool)]
    ahead = {n: persistence_utility(*future_last[n], how.alpha) for n in pool}
    select = {n: how.downstream * prefix_fits(*last, [list(names).index(n)], how.alpha)[1].utility + other * ahead[n] for n in pool}
    train_score = dict(zip(out["feature"], out["train_score"], strict=True))
    combined = {n: (1 - how.selection_weight) * train_score[n] + how.selection_weight * select[n] for n in pool}
    ranked = sorted((n for n in pool if select[n] >= how.least_selection), key=lambda n: (-combined[n], n))[: how.budget]
    fits = prefix_fits(*last, [list(names).index(n) for n in ranked], how.alpha)
    worth = [how.downstream * f.utility + other * float(np.mean([ahead[n] for n in ranked[:k]])) - how.complexity_penalty * k for k, f in enumerate(fits) if k]
    best = int(np.argmax(worth)) + 1 if worth else 0
    place = {n: k for k, n in enumerate(ranked, 1)}
    return out.assign(
        selection_utility=[select.get(n, np.nan) for n in names], combined=[combined.get(n, np.nan) for n in names], place=[place.get(n, 0) for n in names],
        prefix_utility=[fits[place[n]].utility if n in place else np.nan for n in names], objective=[worth[place[n] - 1] if n in place else np.nan for n in names], selected=[0 < place.get(n, 0) <= best for n in names],
    )


SCHEMA = "symbol string, feature string, folds int, mean_utility double, sign_agreement double, stable_utility double, train_score double, selection_utility double, combined double, place int, prefix_utility double, objective double, selected boolean"


def select_features(df: DataFrame, features: Sequence[str], target: str, horizon: int, folds: int = 3, purge: int = 15, train: float = 0.65, select: float = 0.82, how: Selection = Selection()) -> DataFrame:
    """A row a symbol and feature (see `choose`) from df(symbol, day, features, target).

    Rows are numbered within the symbol. The train part is cut into folds + 1 blocks: fold k validates on block k + 1
    and trains on all before it but the last `purge` rows. A feature's own future value must lie in the same segment.
    """
    names = list(features)
    rows = df.withColumns({"_r": F.row_number().over(O.spec) - 1, "_n": F.count(F.lit(1)).over(O.whole()), **{f"_f_{c}": O.lead(F.col(c), horizon) for c in names}})
    rows = rows.withColumns({"_a": F.floor(F.col("_n") * train), "_b": F.floor(F.col("_n") * select)})
    rows = filled(rows, names, F.col("_r") < F.col("_a") - purge)
    size = F.floor(F.col("_a") / (folds + 1))
    pieces = []
    for k in range(1, folds + 1):
        pieces += [(f"train{k}", F.lit(0), k * size - purge), (f"test{k}", k * size, (k + 1) * size if k < folds else F.col("_a"))]
    pieces += [("train0", F.lit(0), F.col("_a") - purge), ("test0", F.col("_a"), F.col("_b") - purge)]
    segments = F.array(*[F.struct(F.lit(n).alias("segment"), low.cast("long").alias("_low"), high.cast("long").alias("_high")) for n, low, high in pieces])
    dealt = rows.select("symbol", "_r", *names, target, *[f"_f_{c}" for c in names], F.inline(segments)).where((F.col("_r") >= F.col("_low")) & (F.col("_r") < F.col("_high")))
    main = grams(dealt.where(F.col(target).isNotNull()), [*names, target], ["symbol", "segment"]).withColumn("feature", F.lit(""))
    # a feature with its own future: one row a feature, summed in one aggregation
    pairs = dealt.where(F.col("_r") + horizon < F.col("_high")).select("symbol", "segment", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x"), F.col(f"_f_{c}").alias("y")) for c in names]))).where(F.col("y").isNotNull())
    sums = main.unionByName(grams(pairs, ["x", "y"], ["symbol", "segment", "feature"]))

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        own = {(r["segment"], r["feature"]): Moments.of(r, 2 if r["feature"] else len(names) + 1) for _, r in frame.iterrows()}
        pair = lambda k, c: (own.get((f"train{k}", c)), own.get((f"test{k}", c)))
        whole = [k for k in range(1, folds + 1) if all(None not in pair(k, c) for c in ("", *names))]
        if any(None in pair(0, c) for c in ("", *names)):
            return pd.DataFrame(columns=[c.split()[0] for c in SCHEMA.split(", ")])
        made = choose(names, [pair(k, "") for k in whole], {c: [pair(k, c) for k in whole] for c in names}, pair(0, ""), {c: pair(0, c) for c in names}, how)
        return made.assign(symbol=frame["symbol"].iat[0])[[c.split()[0] for c in SCHEMA.split(", ")]]

    # a few dozen matrices a symbol
    return sums.groupBy("symbol").applyInPandas(f, SCHEMA)
