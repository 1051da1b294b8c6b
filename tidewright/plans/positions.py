"""Queries of open positions, walls and their features, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import leverage as lv
from tidewright.plans.market import BARS_SQL, MARKET_SQL, bars, market_bars, table
from tidewright.plans.registry import O, W, frame, query, roll, rounded


def _amount(x: str, out: str, source: str, name: str) -> str:
    """SQL of the share of the 90th percentile of earlier positive values, as the tables `name`_h and `name`."""
    p = f"(PARTITION BY symbol, {x} > 0 ORDER BY day ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING)"
    return f"""{name}_h AS (SELECT *, quantile_cont({x}, 0.9) OVER {p} AS _hi, count({x}) OVER {p} AS _n FROM {source}),
{name} AS (SELECT * EXCLUDE (_hi, _n), CASE WHEN {x} <= 0 THEN 0 WHEN {x} IS NULL OR _n < 60 THEN NULL WHEN _hi <= 0 THEN 0 ELSE least(greatest(100 * {x} / _hi, 0), 100) END AS {out} FROM {name}_h)"""


def _clamp(x: str, low: float, high: float) -> str:
    return f"greatest(least({x}, {high}), {low})"


_DAILY = f"""WITH {MARKET_SQL}, a AS (SELECT symbol, day, close AS price, fmod(close, 200) - 100 AS funding, CASE WHEN trades % 3 > 0 THEN (20 - fmod(open, 40)) * 5 END AS liquidation, volume - lag(volume, 7) {W} AS oi, ln(close / lag(close) {W}) AS r FROM bars),
b AS (SELECT *, CASE WHEN count(r) {frame(30, 1)} >= 15 THEN stddev_pop(r) {frame(30, 1)} END AS baseline, sqrt(avg(r * r) {frame(7)}) AS realised, -oi AS closing FROM a), {_amount('oi', 'added', 'b', 'c')}, {_amount('realised', 'regime_score', 'c', 'e')}, {_amount('closing', 'gone', 'e', 'f')},
g AS (SELECT *, CASE WHEN r IS NOT NULL AND baseline IS NOT NULL THEN {_clamp('(abs(r) / greatest(baseline, 0.005) - 0.75) / 1.75 * 100', 0, 100)} END AS trig, CASE WHEN baseline IS NULL THEN 0.04 ELSE {_clamp('2 * baseline * sqrt(7)', 0.04, 0.18)} END AS band, row_number() {W} AS n, sum(ln({lv.DECAY!r} * (1 - 0.35 * coalesce(gone / 100, 0) / 7))) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS cum FROM f),
t AS (SELECT x.symbol, x.day, sum(w) AS total, sum(w * near) AS active, sum(w * near * side) AS directional, sum(w * near * lp) AS anchor_log FROM
 (SELECT g.symbol, g.day, g.n, s.n AS m, s.added / 700 * exp(g.cum - s.cum) AS w, exp(-0.5 * pow(ln(g.price / s.price) / g.band, 2)) AS near, {_clamp('s.funding', -100, 100)} / 100 AS side, ln(s.price) AS lp FROM g JOIN g AS s ON s.symbol = g.symbol AND s.n <= g.n AND s.added > 0) x WHERE x.n = x.m OR w >= 0.001 GROUP BY 1, 2),
u AS (SELECT g.*, coalesce(total, 0) AS total, coalesce(active, 0) AS active, coalesce(directional, 0) AS directional, coalesce(anchor_log, 0) AS anchor_log FROM g LEFT JOIN t USING (symbol, day)),
v AS (SELECT *, CASE WHEN count(active) {frame(365, 1)} >= 60 THEN CASE WHEN quantile_cont(active, 0.9) {frame(365, 1)} > 0 THEN {_clamp(f'100 * active / quantile_cont(active, 0.9) {frame(365, 1)}', 0, 100)} ELSE coalesce(added, 0) END END AS fuel, CASE WHEN total > 0 THEN {_clamp('100 * active / total', 0, 100)} ELSE 0 END AS reactivation, CASE WHEN active > 0 THEN {_clamp('100 * directional / active', -100, 100)} ELSE 0 END AS side FROM u),
w AS (SELECT *, side * reactivation / 100 AS pressure, coalesce(sign(r), 0) * coalesce(trig, 0) * coalesce(fuel, 0) / 100 * greatest(coalesce(sign(r), 0) * side / 100, 0) AS cascade FROM v),
y AS (SELECT *, {_clamp('0.45 * cascade + 0.2 * coalesce(liquidation, 0) + 0.2 * pressure + 0.15 * coalesce(funding, 0)', -100, 100)} AS direction_score FROM w),
z AS (SELECT *, {_clamp('0.55 * coalesce(regime_score, 0) + 0.2 * coalesce(trig, 0) + 0.15 * coalesce(fuel, 0) + 0.1 * abs(direction_score)', 0, 100)} AS potential_score FROM y),
l AS (SELECT *, CASE WHEN direction_score >= 12 THEN 'upside' WHEN direction_score <= -12 THEN 'downside' ELSE 'neutral' END AS direction, CASE WHEN potential_score >= 65 THEN 'high' WHEN potential_score >= 35 THEN 'elevated' ELSE 'low' END AS potential FROM z)"""


def _positions(spark: SparkSession, d: str) -> DataFrame:
    b = market_bars(spark, d)
    return b.select("symbol", "day", F.col("close").alias("price"), O.diff(F.col("volume"), 7).alias("oi"), (F.col("close") % 200 - 100).alias("funding"), F.when(F.col("trades") % 3 > 0, (20 - F.col("open") % 40) * 5).alias("liquidation"))


@query(f"{_DAILY} SELECT day, round(added, 5) AS added, round(total, 5) AS total, round(active, 5) AS active, round(CASE WHEN active > 0 THEN exp(anchor_log / active) END, 4) AS anchor, round(fuel, 4) AS fuel, round(reactivation, 4) AS reactivation, round(side, 4) AS side FROM l")
def tranche_inventory(spark: SparkSession, d: str) -> DataFrame:
    df = lv.daily_scores(_positions(spark, d))
    return df.select("day", *[F.round(F.col(c) + 10.0 ** -(k + 3), k).alias(c) for c, k in (("added", 5), ("total", 5), ("active", 5), ("anchor", 4), ("fuel", 4), ("reactivation", 4), ("side", 4))])


@query(f"""{_DAILY} SELECT day, round(regime_score, 4) AS regime_score, round(trig, 4) AS trigger, round(pressure, 4) AS pressure, round(cascade, 4) AS cascade, round(direction_score, 4) AS direction_score, round(potential_score, 4) AS potential_score, direction, potential,
CASE WHEN direction = 'neutral' THEN CASE WHEN coalesce(fuel, 0) >= 65 THEN 'high-fuel neutral' ELSE 'neutral' END WHEN potential = 'low' THEN 'low ' || direction || ' pressure' ELSE potential || ' ' || direction || ' volatility potential' END AS regime,
CASE WHEN coalesce(abs(liquidation) >= 10, FALSE) AND abs(pressure) >= 10 THEN CASE WHEN liquidation * pressure > 0 THEN 1.0 ELSE 0.0 END WHEN coalesce(abs(liquidation) >= 10, FALSE) OR abs(pressure) >= 10 THEN 0.5 ELSE 0.25 END::DOUBLE AS agreement, round(CASE WHEN abs(direction_score) >= 12 THEN sign(direction_score) * potential_score ELSE 0 END, 4) AS signed_potential FROM l""")
def daily_position_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lv.daily_scores(_positions(spark, d)).select("day", "regime_score", "trigger", "pressure", "cascade", "direction_score", "potential_score", "direction", "potential", "regime", "agreement", "signed_potential"), 4)


_KINDS = [(k, s) for k in ("wall", "area") for s in ("up", "down")]


@query(f"""WITH e AS (SELECT event_type AS symbol, CAST(l_shipdate AS DATE) AS day, kind, side, dist, notional FROM (SELECT l_returnflag AS event_type, l_shipdate, CASE WHEN l_linenumber % 2 = 0 THEN 'wall' ELSE 'area' END AS kind, CASE WHEN l_suppkey % 2 = 0 THEN 'up' ELSE 'down' END AS side, l_quantity * 12 AS dist, l_extendedprice AS notional FROM lineitem)),
s AS (SELECT *, notional * 100 * exp(-0.5 * pow(dist / 300.0, 2)) AS score FROM e), d AS (SELECT symbol, day, {', '.join(f"arg_max(notional, (score, -abs(dist), notional)) FILTER (WHERE kind = '{k}' AND side = '{s}') AS {k}_{s}_n, arg_max(dist, (score, -abs(dist), notional)) FILTER (WHERE kind = '{k}' AND side = '{s}') AS {k}_{s}_d" for k, s in _KINDS)}, max(notional) FILTER (WHERE kind = 'wall') AS wall_most, max(notional) FILTER (WHERE kind = 'area') AS area_most FROM s GROUP BY 1, 2),
{BARS_SQL}, p AS (SELECT symbol, day, CASE WHEN trades % 7 > 0 THEN volume - 100 END AS up, close - 1000 AS down FROM bars), {_amount('up', 'p_up', 'p', 'q')}, {_amount('down', 'p_down', 'q', 'r')},
h AS (SELECT *, {', '.join(f'quantile_cont({k}_most, 0.9) {frame(365, 1)} AS {k}_hi, count({k}_most) {frame(365, 1)} AS {k}_c' for k in ('wall', 'area'))} FROM d),
w AS (SELECT h.symbol, h.day, p_up, p_down, {', '.join(f"sqrt(CASE WHEN {k}_{s}_n <= 0 THEN 0 WHEN {k}_{s}_n IS NOT NULL AND {k}_c >= 60 THEN CASE WHEN {k}_hi > 0 THEN greatest(least(100 * {k}_{s}_n / {k}_hi, 100), 0) ELSE 0 END END * 100 * exp(-0.5 * pow({k}_{s}_d / 300.0, 2))) AS {k}_{s}" for k, s in _KINDS)} FROM h JOIN r USING (symbol, day)),
x AS (SELECT *, greatest(wall_up, area_up, p_up) AS tu, greatest(wall_down, area_down, p_down) AS td, CASE WHEN p_up IS NOT NULL OR p_down IS NOT NULL THEN greatest(least(coalesce(p_up, 0) - coalesce(p_down, 0), 100), -100) END AS net FROM w),
y AS (SELECT *, CASE WHEN tu IS NOT NULL OR td IS NOT NULL THEN greatest(coalesce(tu, 0), coalesce(td, 0)) END AS cascade, CASE WHEN tu IS NOT NULL OR td IS NOT NULL THEN greatest(least(coalesce(tu, 0) - coalesce(td, 0), 100), -100) END AS raw FROM x)
SELECT symbol, day, {', '.join(f'round({k}_{s}, 4) AS {k}_{s}_score' for k, s in _KINDS)}, round(net, 4) AS net, round(cascade, 4) AS cascade, round(CASE WHEN raw IS NOT NULL AND net IS NOT NULL THEN greatest(least(0.75 * raw + 0.25 * net, 100), -100) ELSE raw END, 4) AS direction,
CASE WHEN cascade >= 65 THEN 'cascade-ready' WHEN cascade >= 35 THEN 'watch' WHEN cascade > 0 THEN 'building' WHEN cascade IS NOT NULL THEN 'none' ELSE '' END AS state FROM y""")
def space_scores(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("day"), F.when(F.col("l_linenumber") % 2 == 0, "wall").otherwise("area").alias("kind"), F.when(F.col("l_suppkey") % 2 == 0, "up").otherwise("down").alias("side"), (F.col("l_quantity") * 12).alias("distance_bps"), F.col("l_extendedprice").alias("notional"), F.lit(300.0).alias("band"))
    p = bars(spark, d).select("symbol", "day", F.when(F.col("trades") % 7 > 0, F.col("volume") - 100).alias("up"), (F.col("close") - 1000).alias("down"))
    s = lv.space_scores(lv.space_days(li), p)
    return rounded(s.select("symbol", "day", *[f"{k}_{x}_score" for k, x in _KINDS], "net", "cascade", "direction", "state"), 4)


@query(f"""WITH {BARS_SQL}, a AS (SELECT symbol, day, CASE WHEN trades % 5 > 0 THEN volume END AS v, close AS c, CASE WHEN close > 1500 THEN 'high' WHEN close > 1000 THEN 'low' END AS state FROM bars), b AS (SELECT symbol, day, state, (v IS NULL)::INT::DOUBLE AS v_missing, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), 0) AS v, c FROM a),
m AS (SELECT *, {', '.join(f'{roll("quantile_cont({}, 0.5)", x, 180, 30)} AS m_{x}' for x in 'vc')} FROM b), o AS (SELECT *, abs(v - m_v) AS o_v, abs(c - m_c) AS o_c FROM m), q AS (SELECT *, {', '.join(f'1.4826 * {roll("quantile_cont({}, 0.5)", f"o_{x}", 180, 30)} AS q_{x}' for x in 'vc')} FROM o)
SELECT symbol, day, (coalesce(state, '') = 'high')::INT::DOUBLE AS state_high, (coalesce(state, '') = 'low')::INT::DOUBLE AS state_low, (coalesce(state, '') = '')::INT::DOUBLE AS "state_", v_missing, {', '.join(f'round({x}, 5) AS {x}, round(coalesce({roll("stddev_samp", x, 7, 3)}, 0), 5) AS {x}_roll7_std, round(coalesce({roll("stddev_samp", x, 30, 10)}, 0), 5) AS {x}_roll30_std, round(tanh(coalesce(({x} - m_{x}) / nullif(q_{x}, 0), 0) / 2), 5) AS {x}_signalboost' for x in 'vc')} FROM q""")
def leverage_features(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).select("symbol", "day", F.when(F.col("trades") % 5 > 0, F.col("volume")).alias("v"), F.col("close").alias("c"), F.when(F.col("close") > 1500, "high").when(F.col("close") > 1000, "low").alias("state"))
    b = b.withColumns(lv.one_hot(b, "state", ["high", "low", ""]) | lv.missing_flags(b, ["v", "c"])).drop("state")
    return rounded(lv.enriched(b, ["v", "c"]), 5)


_PARTS = {"direction": "fmod(close, 200) - 100", "space_direction": "fmod(open, 150) - 75", "cascade": "fmod(high, 130)", "potential": "fmod(low, 110)", "fuel": "fmod(volume, 90)", "confidence": "fmod(close, 100)", "wall_up": "fmod(high, 70)", "wall_down": "fmod(low, 60)", "area_up": "fmod(open, 80)", "area_down": "fmod(close, 50)", "trigger": "fmod(volume, 120)", "activation": "fmod(open, 40) - 20", "funding": "CASE WHEN trades % 2 = 0 THEN fmod(high, 60) - 30 END"}


def _part(c: str) -> str:
    return _clamp(f"coalesce({c}, 0) / 100", -1, 1) if c in _PARTS else "0"


def _semantic_sql() -> str:
    p = {c: f"greatest({_part(c)}, 0)" for c in (*_PARTS, "added", "reactivation", "volatility")}
    return f"""WITH {BARS_SQL}, s AS (SELECT symbol, day, {', '.join(f'{x} AS {c}' for c, x in _PARTS.items())} FROM bars), t AS (SELECT *, tanh((0.45 * {_part('direction')} + 0.25 * {_part('space_direction')}) * 1.4) AS dp FROM s)
SELECT symbol, day, round({_clamp(f"0.45 * {p['cascade']} + 0.35 * {p['potential']} + 0.2 * abs({_part('activation')})", 0, 1)}, 6) AS cascade_pressure, round(dp, 6) AS directional_pressure, round({_clamp(f"0.35 * {p['fuel']} + 0.1 * ({p['area_down']} + {p['area_up']})", 0, 1)}, 6) AS leverage_fuel,
round({_clamp(f"0.3 * {p['trigger']} + 0.3 * {p['potential']}", 0, 1)}, 6) AS instability, round(tanh((0.45 * dp + 0.25 * (0.6 * ({_part('wall_up')} - {_part('wall_down')}) + 0.4 * ({_part('area_up')} - {_part('area_down')})) + 0.15 * {_part('funding')}) * 1.2), 6) AS cascade_asymmetry, round({p['confidence']}, 6) AS confidence FROM t"""


@query(_semantic_sql())
def leverage_targets(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    df = b.select("symbol", "day", *[F.expr(x.replace("fmod(", "mod(")).alias(c) for c, x in _PARTS.items()])
    return rounded(lv.semantic_targets(df))
