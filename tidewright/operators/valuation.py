"""Holder, liquidity, choppiness and strategy features of daily series."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.scalars import clip, ratio, row_mean, safe_log, weighted_mean
from tidewright.operators.frames import Ordered
from tidewright.operators.recursion import Recursion, fold
from tidewright.operators.relational import align, calendar

O = Ordered()  # noqa: E741
# Choppiness levels and the weights of its three time frames.
TREND_LEVEL, CONSOLIDATION_LEVEL, EPSILON = 23.6, 61.8, 0.05
CHOP_WEIGHTS = (0.55, 0.30, 0.15)


def log_shift_z(x: Column) -> Column:
    """z score over the key's history of the log, shifted above 0 where a value is not; within 3. Looks ahead by design."""
    least = F.min(x).over(O.whole())
    logged = F.ln(F.when(least <= 0, x + (1 - least)).otherwise(x))
    return logged


def with_base(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as the clipped z score of its shifted log."""
    df = df.withColumns({f"_l_{c}": log_shift_z(F.col(c)) for c in columns})
    return df.withColumns({c: clip(O.zscore(F.col(f"_l_{c}")), -3, 3) for c in columns}).drop(*[f"_l_{c}" for c in columns])


def with_equal_amplitude(df: DataFrame, columns: list[str], window: int = 365, alpha: float = 0.5) -> DataFrame:
    """Each column stretched towards the 5 to 95 % range of its whole history where its own range is small."""
    w = O.whole()
    df = df.withColumns({f"_g_{c}": F.percentile(c, F.array(F.lit(0.05), F.lit(0.95))).over(w) for c in columns})

    def scaled(c: str) -> Column:
        own = O.high(F.col(c), window, window // 2) - O.low(F.col(c), window, window // 2)
        wide = F.col(f"_g_{c}")[1] - F.col(f"_g_{c}")[0]
        return F.col(c) * clip(F.pow(ratio(wide, own), F.lit(alpha)), 0.2, 5)

    return df.withColumns({c: scaled(c) for c in columns}).drop(*[f"_g_{c}" for c in columns])


def boost(columns: list[Column], bound: float) -> Column:
    """Product of the clipped sizes with the sign of the summed signs; null unless all are there."""
    parts = [clip(c, -bound, bound) for c in columns]
    size = reduce(lambda a, b: a * b, [F.abs(p) for p in parts])
    return size * F.signum(reduce(lambda a, b: a + b, [F.signum(p) for p in parts]))


def holder_summary(df: DataFrame, columns: list[str], bound: float, scale: float, offsets: Mapping[str, tuple[float, float]] = {}) -> DataFrame:  # noqa: B006
    """symbol, day, average of the components and their boost over `scale`; offsets: factor and addend of a component."""
    made = with_equal_amplitude(with_base(df, columns), columns)
    parts = [F.col(c) * offsets.get(c, (1.0, 0.0))[0] + offsets.get(c, (1.0, 0.0))[1] for c in columns]
    return made.select("symbol", "day", row_mean(parts).alias("average"), (boost(parts, bound) / scale).alias("boost"))


def sell_side_risk(df: DataFrame, suffix: str = "") -> DataFrame:
    """Add (profit + loss) / cap of the suffix where all three columns are there."""
    need = [f"realized_{x}{suffix}" for x in ("profit", "loss", "cap")]
    if any(c not in df.columns for c in need):
        return df
    return df.withColumn(f"sell_side_risk{suffix}", ratio(F.col(need[0]) + F.col(need[1]), F.col(need[2])))


def daily(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Every calendar day with the last known value of each column."""
    keyed = wide.withColumn("_k", F.lit(0))
    return align(calendar(keyed, "_k"), keyed, "day", columns, ["_k"]).drop("_k")


def net_liquidity(wide: DataFrame, assets: str, treasury: str, repo: str, funding: str, credit: str, money: str, dollar: str) -> DataFrame:
    """day, liquidity (billions), money supply 42 days later, inverse dollar: days with any of them.

    assets, treasury, funding and credit are in millions, repo in billions. A 0 is a placeholder.
    """
    names = list(dict.fromkeys([assets, treasury, repo, funding, credit, money, dollar]))
    df = daily(wide, names)
    x = {c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in names}
    total = x[assets] / 1000 - x[treasury] / 1000 - x[repo] + x[funding] / 1000 + x[credit] / 1000
    now = df.select("day", F.nullif(total, F.lit(0.0)).alias("liquidity"), ratio(F.lit(1.0), x[dollar]).alias("inv_dollar"))
    later = df.select(F.date_add("day", 42).alias("day"), F.nullif(x[money], F.lit(0.0)).alias("money_later"))
    return now.join(later, "day", "full_outer").select("day", "liquidity", "money_later", "inv_dollar").na.drop("all", subset=["liquidity", "money_later", "inv_dollar"])


def ewm_adjusted(x: np.ndarray, span: int, least: int) -> np.ndarray:
    """Exponential mean whose weights are normalised over what was seen; null until `least` values."""
    keep = 1 - 2 / (span + 1)
    out, total, weight, seen = np.full(len(x), np.nan), 0.0, 0.0, 0
    for i, v in enumerate(x):
        total, weight = total * keep, weight * keep
        if v == v:
            total, weight, seen = total + v, weight + 1, seen + 1
        if seen >= least and weight > 0:
            out[i] = total / weight
    return out


def slow_changes(weekly: DataFrame, value: str, periods: int = 52, span: int = 120) -> DataFrame:
    """symbol, week and the smoothed log change over `periods` weeks; weekly has every week."""
    w = Ordered(time="week")
    x = safe_log(F.col(value))
    df = weekly.select("symbol", "week", (x - w.lag(x, periods)).alias("change"))
    made = fold(df, [Recursion("slow", "change", partial(ewm_adjusted, span=span, least=max(span // 4, 1)))], time="week")
    return made.where(F.col("slow").isNotNull()).select("symbol", "week", "slow")


def trend_weight(chop: Column) -> Column:
    return clip((CONSOLIDATION_LEVEL - chop) / (CONSOLIDATION_LEVEL - TREND_LEVEL), 0, 1)


def choppiness(df: DataFrame, columns: tuple[str, str, str]) -> DataFrame:
    """df with the weights of trend and reversion of each time frame and of their blend; neutral where none is known."""
    per = {}
    for c in columns:
        t = trend_weight(F.col(c))
        per |= {f"{c}_trend": t, f"{c}_balance": 1 - 2 * t}
    df = df.withColumns(per).withColumn("blend", F.coalesce(weighted_mean([F.col(c) for c in columns], list(CHOP_WEIGHTS)), F.lit((TREND_LEVEL + CONSOLIDATION_LEVEL) / 2)))
    df = df.withColumn("trend_weight", trend_weight(F.col("blend")))
    t = F.col("trend_weight")
    df = df.withColumn("mr_trend_ratio", (1 - t + EPSILON) / (t + EPSILON))
    return df.withColumns({"log_ratio": F.ln("mr_trend_ratio"), "balance": 1 - 2 * t, "intensity": F.abs(1 - 2 * t), "above_consolidation": (F.col("blend") >= CONSOLIDATION_LEVEL).cast("int"), "below_trend": (F.col("blend") <= TREND_LEVEL).cast("int")})


def _hit_rate(signal: Column, change: Column, window: int) -> Column:
    ok = (F.abs(signal) > 1e-12) & change.isNotNull()
    hit = F.when(ok, (F.signum(signal) * F.signum(change) > 0).cast("double"))
    return F.coalesce(O.mean(hit, window, max(20, window // 3)), F.lit(0.5))


def _information(signal: Column, change: Column, window: int) -> Column:
    w = O.spec.rowsBetween(-(window - 1), 0)
    both = F.when(signal.isNotNull(), change)
    n = F.count(both).over(w)
    mine = F.when(change.isNotNull(), signal)
    spread = F.stddev_pop(mine).over(w) * F.stddev_pop(both).over(w)
    value = F.covar_pop(mine, both).over(w) / F.when(spread > 1e-14, spread)
    return F.coalesce(F.when(n >= max(20, window // 3), clip(value, -1, 1)), F.lit(0.0))


STRATEGIES = ("trend", "momentum", "reversion")


def strategy_influence(df: DataFrame, horizons: tuple[int, ...] = (1, 3), window: int = 90) -> DataFrame:
    """Hit rates and information coefficients of past signals, and each strategy's share of the pressure.

    df: symbol, day, close, trend, momentum, regime (signals, not null) and trend_weight. The first strategy wins a tie.
    """
    t, m, g, tw = (F.col(c) for c in ("trend", "momentum", "regime", "trend_weight"))
    df = df.withColumns({"_trend": t * tw, "_momentum": m * (0.5 + 0.5 * tw), "_reversion": -t * (1 - tw) * (0.5 + 0.5 * F.abs(g)), "_log": safe_log(F.col("close"))})
    for h in horizons:
        df = df.withColumns({f"_r{h}": O.diff(F.col("_log"), h), **{f"_{s}{h}": O.lag(F.col(f"_{s}"), h) for s in STRATEGIES}})
        df = df.withColumns({f"{s}_{x}_{h}": f(F.col(f"_{s}{h}"), F.col(f"_r{h}"), window) for s in STRATEGIES for x, f in (("hit", _hit_rate), ("ic", _information))})
    rate = {s: row_mean([F.col(f"{s}_hit_{h}") for h in horizons]) for s in STRATEGIES}
    df = df.withColumns({"p_trend": F.abs(t) * tw * (0.5 + rate["trend"]), "p_momentum": F.abs(m) * (0.5 + 0.5 * tw) * (0.5 + rate["momentum"]), "p_reversion": (0.65 * F.abs(t) + 0.35 * F.abs(g)) * (1 - tw) * (0.5 + rate["reversion"])})
    total = F.col("p_trend") + F.col("p_momentum") + F.col("p_reversion")
    df = df.withColumns({f"share_{s}": F.coalesce(ratio(F.col(f"p_{s}"), total), F.lit(1 / 3)) for s in STRATEGIES})
    shares = [F.col(f"share_{s}") for s in STRATEGIES]
    ranked = F.array_sort(F.array(*shares))
    first = F.when((shares[0] >= shares[1]) & (shares[0] >= shares[2]), STRATEGIES[0]).when(shares[1] >= shares[2], STRATEGIES[1]).otherwise(STRATEGIES[2])
    names = [f"{s}_{x}_{h}" for h in horizons for s in STRATEGIES for x in ("hit", "ic")]
    return df.select("symbol", "day", *names, *[f"share_{s}" for s in STRATEGIES], first.alias("dominant"), (ranked[2] - ranked[1]).alias("margin"))


def initial_static_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """df without its first rows that stand still: pairs of equal values are cut, the longest cut of any column counts.

    Rows 1 and 2 are a pair, rows 3 and 4 the next; a column's cut ends before its first pair with two values.
    """
    n = F.row_number().over(O.spec)
    df = df.withColumns({"_n": n, **{f"_next_{c}": O.lead(F.col(c)) for c in columns}})
    odd = F.col("_n") % 2 == 1
    # the first odd row whose next row differs or is not there
    moves = {c: F.min(F.when(odd & ~F.coalesce(F.col(c) == F.col(f"_next_{c}"), F.lit(False)), F.col("_n"))).over(Window.partitionBy("symbol")) for c in columns}
    size = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    df = df.withColumn("_cut", F.greatest(*[F.coalesce(m - 1, size - size % 2) for m in moves.values()], F.lit(0)))
    return df.where(F.col("_n") > F.col("_cut")).drop("_n", "_cut", *[f"_next_{c}" for c in columns])


def stabilised(df: DataFrame, bounds: Mapping[str, tuple[float, float] | None], bound: float = 5.0) -> DataFrame:
    """Robust z scores over each symbol's history after its static head, clipped per column; missing values are 0."""
    columns = list(bounds)
    df = initial_static_pairs(df, columns)
    w = O.whole()
    df = df.withColumns({f"_m_{c}": F.percentile(c, 0.5).over(w) for c in columns})
    df = df.withColumns({f"_d_{c}": 1.4826 * F.percentile(F.abs(F.col(c) - F.col(f"_m_{c}")), 0.5).over(w) for c in columns})

    def one(c: str) -> Column:
        z = F.when(F.col(f"_d_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_d_{c}"))
        low, high = bounds[c] or (-bound, bound)
        return F.coalesce(clip(clip(z, low, high), -bound, bound), F.lit(0.0))

    return df.select("symbol", "day", *[one(c).alias(c) for c in columns])
