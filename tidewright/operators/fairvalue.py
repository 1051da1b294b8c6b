"""Fair value of a price from slow features: detrended returns, a fitted two-state filter, and bands.

A symbol's history is one group; nothing of a test row enters the fit (means,
deviations, loadings and parameters are those of the train rows), and the
filter goes on from its last train state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewright.operators.likelihood import TwoStateFilter, two_state

OUT = ["fair_value", "deviation_z", "upper_1", "lower_1", "upper_2", "lower_2", "liquidity_level"]
DAYS_A_MONTH = 30.0


@dataclass(frozen=True)
class FairValue:
    """How the value is made; the defaults are those of daily rows."""

    features: tuple[str, ...]
    #: Features that stand beside the first component of the others.
    apart: tuple[str, ...] = ()
    train: float = 0.8
    #: Days up to which rows train, if given (instead of the share).
    train_end: str | None = None
    months: float = 15.0
    lag_span: int = 60
    lag_scale: float = 1.25
    rho: float = 0.97
    squash: float | None = 1.3
    residual_scale: float = 1.0
    curvature: float = 0.5
    #: Rows of a random train set are drawn with this seed; None: the first rows train.
    seed: int | None = None


def first_component(train: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
    """Scores of all rows on the train rows' first principal component."""
    mean, spread = train.mean(), train.std().replace(0, 1.0).fillna(1.0)
    _, _, loadings = np.linalg.svd(((train - mean) / spread).to_numpy(), full_matrices=False)
    return ((rows - mean) / spread).to_numpy() @ loadings[0]


def level_of(returns: np.ndarray, rho: float, squash: float | None, base: float) -> np.ndarray:
    """Mean-reverting sum of returns that starts from a level."""
    out, y = np.empty(len(returns)), base
    for i, r in enumerate(returns.tolist()):
        y = rho * y + r
        if squash:
            y = float(np.tanh(y / squash) * squash)
        out[i] = y
    return out


def train_rows(n: int, share: float, seed: int | None) -> np.ndarray:
    """Which rows train: the first ones, or a random draw."""
    if not 0 < share <= 1:
        return np.ones(n, bool)
    k = max(1, int(n * share))
    out = np.zeros(n, bool)
    out[:k if seed is None else 0] = True
    if seed is not None:
        out[np.random.default_rng(seed).permutation(n)[:k]] = True
    return out


def fair_value_of(frame: pd.DataFrame, how: FairValue) -> pd.DataFrame:
    """The rows (in time order) that have all inputs, with part, parameters' phi and the columns of OUT."""
    price = np.log(frame["price"].astype(float))
    span = max(5, round(how.months * DAYS_A_MONTH))
    secular = price.ewm(span=span, min_periods=max(5, span // 4)).mean()
    apart = price - secular
    moved = apart.dropna().diff().reindex(frame.index)
    lagged = moved.dropna().ewm(span=how.lag_span, min_periods=max(5, how.lag_span // 4)).mean().shift(1).reindex(frame.index) * how.lag_scale
    data = frame[list(how.features)].astype(float).assign(_y=moved, _lag=lagged).dropna()
    if len(data) < 20:
        return frame.iloc[:0].assign(part="", phi=0.0, **dict.fromkeys(OUT, 0.0))
    train = (pd.to_datetime(frame.loc[data.index, "day"]) <= pd.Timestamp(how.train_end)).to_numpy() if how.train_end else train_rows(len(data), how.train, how.seed)
    joined = [c for c in how.features if c not in how.apart]
    x = pd.DataFrame(index=data.index)
    if len(joined) > 1:
        x["_first"] = first_component(data.loc[train, joined], data[joined])
    else:
        x[joined] = data[joined]
    x[[*how.apart, "_lag"]] = data[[*how.apart, "_lag"]]
    x = ((x - x[train].mean()) / x[train].std().replace(0, 1.0).fillna(1.0)).to_numpy()
    y = data["_y"].to_numpy()
    fit = TwoStateFilter(y[train], x[train], curvature=how.curvature).fit()
    level, deviation, state = two_state(y[train], x[train], fit)
    later, later_deviation, _ = two_state(y[~train], x[~train], fit, state)
    # a random draw's rows are filtered by parts too, and put in time order afterwards
    place = np.concatenate([np.flatnonzero(train), np.flatnonzero(~train)])
    order = np.argsort(place)
    level, deviation = np.concatenate([level, later])[order], np.concatenate([deviation, later_deviation])[order]
    rows = frame.loc[data.index]
    base = float(apart.loc[data.index[0]])
    own = secular.loc[data.index].to_numpy()
    liquidity = own + level_of(level, how.rho, how.squash, base)
    value = own + level_of(level + deviation, how.rho, how.squash, base)
    logged = price.loc[data.index].to_numpy()
    spread = np.std((logged - value)[train], ddof=1)
    spread = (spread if np.isfinite(spread) and spread > 0 else 1e-6) * how.residual_scale
    returns = price.diff()
    usual = returns.loc[data.index][train].std()
    volatility = (returns.rolling(12).std() / (usual if np.isfinite(usual) and usual > 0 else 1.0)).loc[data.index].fillna(1.0).clip(0.8, 1.3).to_numpy()
    off = rows["price"].to_numpy(float) - np.exp(value)
    wide = off.std()
    made = [np.exp(value), (off - off.mean()) / (wide if np.isfinite(wide) and wide > 0 else 1.0), *(np.exp(value + k * spread * volatility) for k in (1, -1, 2, -2)), np.exp(liquidity)]
    return rows.assign(part=np.where(train, "train", "test"), phi=float(fit["phi"]), **dict(zip(OUT, made, strict=True)))


def fair_values(df: DataFrame, how: FairValue) -> DataFrame:
    """symbol, day, price, part, phi and the columns of OUT from df(symbol, day, price and the features)."""
    schema = "symbol string, day date, price double, part string, phi double, " + ", ".join(f"{c} double" for c in OUT)

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        made = fair_value_of(frame.sort_values("day").reset_index(drop=True), how)
        return made[["symbol", "day", "price", "part", "phi", *OUT]]

    return df.select("symbol", "day", "price", *how.features).groupBy("symbol").applyInPandas(f, schema)
