"""Queries of the semantic targets of the environment, edges and movement buckets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import indicators as ta
from tidewright.operators import semantics as sm
from tidewright.plans.market import BARS_SQL, bars, series
from tidewright.plans.registry import _SQL, O, W, query, roll, rounded
from tidewright.plans.states import _avg, _robust_sql, _sd
from tidewright.sources import tables as src


def _trust(names: list[str], support: str) -> str:
    return f"greatest(least(0.7 * (0.45 / (1 + {_sd(names)}) + 0.35 * freshness + 0.2 * (1 - missing)) + 0.3 * greatest(least({support}, 1), 0), 1), 0)"


def _p(x: str, scale: float = 1.0) -> str:
    return f"1 / (1 + exp(-greatest(least(coalesce({x}, 0) / {scale}, 40), -40)))"


def _up(x: str) -> str:
    return f"greatest(tanh({x}), 0)"


_FRESH = "pow(2, -(trades % 10) / 10) AS freshness, (trades % 4) / 10 AS missing"
def _unrounded(name: str) -> str:
    return f"SELECT * REPLACE (CAST(day AS DATE) AS day) FROM ({_SQL[name].replace('round(', '(').replace(', 5) AS', ') AS')})"


_IND = f"""mri AS ({_unrounded('mean_reversion_indicators')}), tri AS ({_unrounded('trend_indicators')}),
b AS (SELECT symbol, day, {_FRESH}, vz_score, range_oscillator, commodity_channel, detrended, imi, adx, volatility_30, ls_volatility FROM bars JOIN mri USING (symbol, day) JOIN tri USING (symbol, day))"""
_SERIES = {"1-URGENT": "fed_liquidity", "2-HIGH": "m2_yoy_usd", "3-MEDIUM": "dxy_inverse", "4-NOT SPECIFIED": "stocks", "5-LOW": "manual_nfci"}


def _base(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).select("symbol", "day", F.pow(F.lit(2.0), -(F.col("trades") % 10) / 10).alias("freshness"), ((F.col("trades") % 4) / 10).alias("missing"))


def _indicators(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return _base(spark, d).join(ta.mean_reversion(b), ["symbol", "day"]).join(ta.trend_windows(b), ["symbol", "day"])


_L, _R = ["l_fed", "l_m2_usd", "l_dxy"], ["r_stocks", "r_nfci"]
_ZERO = ["0"]


@query(f"""WITH {BARS_SQL}, s AS (SELECT CAST(o_orderdate AS DATE) AS day, {', '.join(f"avg(o_totalprice) FILTER (WHERE o_orderpriority = '{p}') AS {c}" for p, c in _SERIES.items())} FROM orders GROUP BY 1),
j AS (SELECT symbol, day, {_FRESH}, {', '.join(f'last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS {c}' for c in _SERIES.values())} FROM bars LEFT JOIN s USING (day)),
{_robust_sql('z', 'j', {'l_fed': f'fed_liquidity / lag(fed_liquidity, 30) {W} - 1', 'l_m2_usd': 'm2_yoy_usd', 'l_dxy': f'dxy_inverse / lag(dxy_inverse, 30) {W} - 1', 'r_stocks': f'stocks / lag(stocks, 30) {W} - 1', 'r_nfci0': 'manual_nfci'}, 365, 91)},
m AS (SELECT *, -r_nfci0 AS r_nfci FROM z), l AS (SELECT *, ({' + '.join(_L)}) / 5 AS liq FROM m), k AS (SELECT *, ({' + '.join(_R)}) / 8 + 0.3 * liq AS risk FROM l),
t AS (SELECT *, coalesce(({' + '.join(f'abs({c} - lag({c}) {W})' for c in _L)}) / 5, 0) + coalesce(({' + '.join(f'abs({c} - lag({c}) {W})' for c in _R)}) / 8, 0) + coalesce({roll('stddev_samp', 'liq', 30, 7)}, 0) + coalesce({roll('stddev_samp', 'risk', 30, 7)}, 0) AS turn FROM k)
SELECT symbol, day, round({_up('liq')}, 5) AS liquidity_tailwind, round({_up('-liq')}, 5) AS liquidity_headwind, round({_up('risk')}, 5) AS macro_risk_on, round({_up('-risk')}, 5) AS macro_risk_off, round({_p('turn', 1.5)}, 5) AS macro_transition_risk,
round({_trust([*_L, *_ZERO * 2, *_R, *_ZERO * 6], f"1 / (1 + {_sd([*_L, *_ZERO * 2, *_R, *_ZERO * 6])})")}, 5) AS environment_confidence FROM t""")
def environment_targets(spark: SparkSession, d: str) -> DataFrame:
    wide = src.pivot_last(series(spark, d), "day", list(_SERIES), ["source", "series_name"]).toDF("day", *_SERIES.values())
    df = _base(spark, d).join(wide, "day", "left")
    df = df.select("symbol", "day", "freshness", "missing", *[O.last_known(F.col(c)).alias(c) for c in _SERIES.values()])
    return rounded(sm.environment_targets(df), 5)


_M, _V = ["m_edges", "m_pca", "m_mean"], ["v_pca", "v_mean"]


@query(f"""WITH {BARS_SQL}, {_IND}, {_robust_sql('z', 'b', {'m_edges': 'vz_score', 'm_pca': 'range_oscillator', 'm_mean': 'list_avg([range_oscillator, commodity_channel])', 'v_pca': 'volatility_30', 'v_mean': 'list_avg([volatility_30, ls_volatility])'}, 90, 22)},
t AS (SELECT *, {_avg(_M)} AS mr, {_avg(_V)} AS vol FROM z)
SELECT symbol, day, round({_up('mr')}, 5) AS upside_stretch, round({_up('-mr')}, 5) AS downside_stretch, round({_p('abs(mr) + 0.3 * abs(vz_score)', 1.4)}, 5) AS mean_reversion_pressure, round({_p('vol')}, 5) AS local_volatility_instability,
round(tanh(({_up('mr')} - {_up('-mr')}) / 0.5), 5) AS edge_asymmetry, round({_trust(_M + _V, f'1 / (1 + {_sd(_M)} + {_sd(_V)})')}, 5) AS edge_confidence FROM t""")
def edges_targets(spark: SparkSession, d: str) -> DataFrame:
    x = F.col
    df = _indicators(spark, d).select("symbol", "day", "freshness", "missing", x("vz_score").alias("edges_pca"), x("range_oscillator").alias("mr_pca"), x("commodity_channel").alias("mr_channel"), x("volatility_30").alias("volatility_pca"), x("volatility_30").alias("vol_30"), x("ls_volatility").alias("vol_ls"))
    return rounded(sm.edges_targets(df), 5)


_T, _P, _G = ["t_move", "t_pca", "t_mean"], ["p_pca", "p_mean"], ["g_pca", "g_mean"]
_WT, _WM = "greatest(least(coalesce(wt, 0.5), 1), 0)", "greatest(least(coalesce(wm, 0.5), 1), 0)"


@query(f"""WITH {BARS_SQL}, {_IND}, c AS (SELECT *, (adx - 10) / 60 AS wt, 1 - imi / 100 AS wm, tanh(detrended / 500) AS balance, CASE WHEN adx > 20 THEN imi / 100 END AS st FROM b),
{_robust_sql('zt', 'c', {'t_move': 'detrended', 't_pca': 'adx', 't_mean': 'list_avg([adx, detrended])'}, 90, 22)}, {_robust_sql('z', 'zt', {'p_pca': 'imi', 'p_mean': 'list_avg([imi, vz_score])', 'g_pca': 'commodity_channel', 'g_mean': 'list_avg([commodity_channel])'}, 60, 20)},
m AS (SELECT *, {_avg(_T)} AS t, {_avg(_P)} AS p, {_avg(_G)} AS g, abs({_avg(_T)}) AS a, {_WT} AS w1, {_WM} AS w2 FROM z), n AS (SELECT *, t * (0.75 + 0.5 * w1) + 0.5 * p * (0.5 + 0.5 * w1) - 0.25 * abs(g) * (0.5 + w2) AS way FROM m),
o AS (SELECT *, coalesce({roll('avg', 'a', 10, 5)}, 0) - coalesce({roll('stddev_samp', 't', 10, 5)}, 0) - 0.25 * abs(g) + 0.75 * (w1 - 0.5) AS steady, -abs(t) + abs(g) + coalesce({roll('stddev_samp', 'way', 10, 5)}, 0) + 1.15 * greatest(least(coalesce(balance, 0), 1), -1) AS chop FROM n)
SELECT symbol, day, round({_up('way')}, 5) AS trend_pressure_up, round({_up('-way')}, 5) AS trend_pressure_down, round({_p('steady', 1.1)}, 5) AS trend_persistence, round({_p('p * (0.75 + 0.25 * w1) - 0.35 * abs(g)')}, 5) AS momentum_quality, round({_p('chop', 1.1)}, 5) AS chop_risk,
round(greatest(least(coalesce(st, w1 / 2), 1), 0), 5) AS trend_strategy_influence, 0.0::DOUBLE AS momentum_strategy_influence, 0.0::DOUBLE AS mean_reversion_strategy_influence, round({_trust(_T + _P + _G, f'1 / (1 + {_sd(_T + _P + _G)})')}, 5) AS movement_confidence FROM o""")
def movement_targets(spark: SparkSession, d: str) -> DataFrame:
    x = F.col
    df = _indicators(spark, d).select(
        "symbol", "day", "freshness", "missing", x("detrended").alias("movement_pca"), x("adx").alias("trend_pca"), x("detrended").alias("trend_detrended"), x("imi").alias("momentum_pca"), x("vz_score").alias("momentum_vz"), x("commodity_channel").alias("mreg_pca"),
        ((x("adx") - 10) / 60).alias("chop_trend_weight"), (1 - x("imi") / 100).alias("chop_mean_reversion_weight"), F.tanh(x("detrended") / 500).alias("chop_regime_balance"), F.when(x("adx") > 20, x("imi") / 100).alias("strategy_trend_influence"),
    )
    return rounded(sm.movement_targets(df), 5)
