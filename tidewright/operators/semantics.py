"""Semantic targets of the environment, edges and movement buckets, by one shape.

A group names its components with a transformation and a window; their robust
z scores come from one ordered pass a symbol for all groups' windows. A column
that a bucket lacks counts as 0, as does a score without history.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scalars import clip, ratio, row_mean, sigmoid
from tidewright.operators.frames import Ordered
from tidewright.operators.recursion import fold_rows, robust_z
from tidewright.operators.states import confidence, row_deviation, total

O = Ordered()  # noqa: E741


def column(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(0.0)


def prefix_mean(df: DataFrame, prefix: str) -> Column:
    """Mean of what is there in the columns that begin with the prefix."""
    found = [F.col(c).cast("double") for c in df.columns if c.startswith(prefix)]
    return row_mean(found) if found else F.lit(0.0)


def change(df: DataFrame, name: str, n: int = 30) -> Column:
    return ratio(column(df, name), O.lag(column(df, name), n)) - 1 if name in df.columns else F.lit(0.0)


def scored(df: DataFrame, components: dict[str, tuple[Column, int]]) -> DataFrame:
    """df with the robust z score of each component over its own window, in one pass."""
    df = df.withColumns({f"_x_{n}": c for n, (c, _) in components.items()})

    def f(frame: pd.DataFrame) -> dict[str, np.ndarray]:
        return {n: np.nan_to_num(robust_z(frame[f"_x_{n}"].to_numpy(float, na_value=np.nan), w, max(w // 4, 20))) for n, (_, w) in windows.items()}

    windows = {n: (None, w) for n, (_, w) in components.items()}
    return fold_rows(df, f, list(components)).drop(*[f"_x_{n}" for n in components])


def spread(x: Column, n: int) -> Column:
    return F.coalesce(O.deviation(x, n, max(n // 4, 5)), F.lit(0.0))


def mean(names: Sequence[str]) -> Column:
    return total([F.col(n) for n in names]) / len(names)


def deviation(names: Sequence[str]) -> Column:
    return F.coalesce(row_deviation([F.col(n) for n in names]), F.lit(0.0))


def positive(x: Column, scale: float = 1.0) -> Column:
    return F.greatest(F.tanh(x / scale), F.lit(0.0))


def probability(x: Column, scale: float = 1.0) -> Column:
    return sigmoid(F.coalesce(x, F.lit(0.0)) / scale)


def trust(names: Sequence[str], support: Column) -> Column:
    return confidence([F.col(n) for n in names], F.col("freshness"), F.col("missing"), support)


def environment_targets(df: DataFrame) -> DataFrame:
    """Liquidity and risk on both sides, transition risk and confidence; df: symbol, day, freshness, missing and the bucket's columns."""
    year = lambda c: (c, 365)
    liquid = {"fed": change(df, "fed_liquidity"), "m2_usd": column(df, "m2_yoy_usd"), "m2_fx": column(df, "m2_yoy_fixed_fx"), "dxy": change(df, "dxy_inverse"), "fair": change(df, "liquidity_fair_value")}
    risk = {"stocks": change(df, "stocks"), "emerging": change(df, "emerging_markets"), "activity": column(df, "business_activity"), "ism_m": column(df, "manual_us_ism_manufacturing_pmi"), "ism_s": column(df, "manual_us_ism_service_index"), "nfci": column(df, "manual_nfci"), "anfci": column(df, "manual_anfci"), "credit": column(df, "manual_credit")}
    names, risks = [f"_l_{n}" for n in liquid], [f"_r_{n}" for n in risk]
    df = scored(df, {f"_l_{n}": year(c) for n, c in liquid.items()} | {f"_r_{n}": year(c) for n, c in risk.items()} | {"_gold": year(change(df, "gold"))})
    df = df.withColumns({f"_r_{n}": -F.col(f"_r_{n}") for n in ("nfci", "anfci", "credit")})
    df = df.withColumn("_liquidity", mean(names)).withColumn("_risk", mean(risks) + 0.3 * F.col("_liquidity"))
    moved = lambda group: F.coalesce(total([F.abs(O.diff(F.col(n))) for n in group]) / len(group), F.lit(0.0))
    df = df.withColumn("_turn", moved(names) + moved(risks) + spread(F.col("_liquidity"), 30) + spread(F.col("_risk"), 30))
    return df.select(
        "symbol", "day", positive(F.col("_liquidity")).alias("liquidity_tailwind"), positive(-F.col("_liquidity")).alias("liquidity_headwind"), positive(F.col("_risk")).alias("macro_risk_on"),
        positive(-F.col("_risk") + 0.25 * F.col("_gold")).alias("macro_risk_off"), probability(F.col("_turn"), 1.5).alias("macro_transition_risk"), trust([*names, *risks], 1 / (1 + deviation([*names, *risks]))).alias("environment_confidence"),
    )


def edges_targets(df: DataFrame) -> DataFrame:
    """Stretch on both sides, reversion pressure, instability, asymmetry and confidence; df holds edges_pca, mr_*, vol_* and volatility_pca."""
    back = {"_m_edges": column(df, "edges_pca"), "_m_pca": column(df, "mr_pca"), "_m_mean": prefix_mean(df, "mr_")}
    volatile = {"_v_pca": column(df, "volatility_pca"), "_v_mean": prefix_mean(df, "vol_")}
    edge = column(df, "edges_pca")
    df = scored(df.withColumn("_edge", edge), {n: (c, 90) for n, c in (back | volatile).items()})
    df = df.withColumns({"_mr": mean([*back]), "_vol": mean([*volatile])})
    df = df.withColumns({"upside_stretch": positive(F.col("_mr")), "downside_stretch": positive(-F.col("_mr"))})
    return df.select(
        "symbol", "day", "upside_stretch", "downside_stretch", probability(F.abs("_mr") + 0.3 * F.abs("_edge"), 1.4).alias("mean_reversion_pressure"), probability(F.col("_vol")).alias("local_volatility_instability"),
        F.tanh((F.col("upside_stretch") - F.col("downside_stretch")) / 0.5).alias("edge_asymmetry"), trust([*back, *volatile], 1 / (1 + deviation([*back]) + deviation([*volatile]))).alias("edge_confidence"),
    )


def movement_targets(df: DataFrame) -> DataFrame:
    """Trend pressure on both sides, persistence, momentum quality, chop risk, strategy influences and confidence.

    df holds movement_pca, trend_*, momentum_*, mreg_*, the choppiness weights and the strategies' influences.
    """
    trend = {"_t_move": (column(df, "movement_pca"), 90), "_t_pca": (column(df, "trend_pca"), 90), "_t_mean": (prefix_mean(df, "trend_"), 90)}
    momentum = {"_p_pca": (column(df, "momentum_pca"), 60), "_p_mean": (prefix_mean(df, "momentum_"), 60)}
    regime = {"_g_pca": (column(df, "mreg_pca"), 60), "_g_mean": (prefix_mean(df, "mreg_"), 60)}
    every = [*trend, *momentum, *regime]
    there = lambda name, default, low: clip(F.coalesce(column(df, name), default), low, 1)
    half = F.lit(0.5)
    inputs = {"_wt": there("chop_trend_weight", half, 0), "_wm": there("chop_mean_reversion_weight", half, 0), "_balance": there("chop_regime_balance", F.lit(0.0), -1)}
    inputs |= {"_st": column(df, "strategy_trend_influence"), "_sp": column(df, "strategy_momentum_influence"), "_sm": column(df, "strategy_mean_reversion_influence")}
    df = scored(df.withColumns(inputs), trend | momentum | regime)
    df = df.withColumns({"_t": mean([*trend]), "_p": mean([*momentum]), "_g": mean([*regime])}).withColumn("_a", F.abs("_t"))
    df = df.withColumn("_way", F.col("_t") * (0.75 + 0.5 * F.col("_wt")) + 0.5 * F.col("_p") * (0.5 + 0.5 * F.col("_wt")) - 0.25 * F.abs("_g") * (0.5 + F.col("_wm")))
    steady = F.coalesce(O.mean(F.col("_a"), 10, 5), F.lit(0.0)) - spread(F.col("_t"), 10) - 0.25 * F.abs("_g") + 0.75 * (F.col("_wt") - 0.5)
    df = df.withColumns({"_steady": steady, "_chop": -F.abs("_t") + F.abs("_g") + spread(F.col("_way"), 10) + 1.15 * F.col("_balance")})
    return df.select(
        "symbol", "day", positive(F.col("_way")).alias("trend_pressure_up"), positive(-F.col("_way")).alias("trend_pressure_down"), probability(F.col("_steady"), 1.1).alias("trend_persistence"),
        probability(F.col("_p") * (0.75 + 0.25 * F.col("_wt")) - 0.35 * F.abs("_g")).alias("momentum_quality"), probability(F.col("_chop"), 1.1).alias("chop_risk"),
        clip(F.coalesce("_st", F.col("_wt") / 2), 0, 1).alias("trend_strategy_influence"), clip(F.coalesce("_sp", F.lit(0.0)), 0, 1).alias("momentum_strategy_influence"), clip(F.coalesce("_sm", F.col("_wm") / 2), 0, 1).alias("mean_reversion_strategy_influence"),
        trust(every, 1 / (1 + deviation(every))).alias("movement_confidence"),
    )
