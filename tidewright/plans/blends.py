"""Queries of price states by profile and of the forecasters blended from them, with their SQL."""

from __future__ import annotations

from dataclasses import astuple, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import blends as bl
from tidewright.operators import forecasts as fc
from tidewright.plans.market import BARS_SQL, bars
from tidewright.plans.registry import _TARGETS, O, W, _cone_sql, _recursion, query, roll, rounded


def _value(v: object) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"{v!r}::DOUBLE"


def _table(name: str, rows: tuple) -> str:
    columns = ["uncertainty_weight" if f.name == "uncertainty" else f.name for f in fields(rows[0])]
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(_value, astuple(r))) + ')' for r in rows)})"


_G, _H = "((r.a + o.q1 + o.phi * r.c) / s)", "((o.phi * r.c + o.phi * o.phi * r.e + o.q2) / s)"
_S = "(r.a + o.q1 + 2 * o.phi * r.c + o.phi * o.phi * r.e + o.q2 + o.r0)"
_MISS = "(o.y - r.f - o.phi * r.d)"
_GAIN, _GAIN2 = _G.replace(" s)", f" {_S})"), _H.replace(" s)", f" {_S})")
_LOCAL = [f"r.f + {_GAIN} * {_MISS} AS f", f"o.phi * r.d + {_GAIN2} * {_MISS} AS d", f"r.a + o.q1 - {_GAIN} * {_GAIN} * {_S} AS a", f"o.phi * r.c - {_GAIN} * {_GAIN2} * {_S} AS c", f"o.phi * o.phi * r.e + o.q2 - {_GAIN2} * {_GAIN2} * {_S} AS e", f"{_MISS} AS miss", f"{_S} AS s"]
_FIRST_S = "(0.02 + o.q1 + o.phi * o.phi * 0.02 + o.q2 + o.r0)"
_FIRST = ["o.y AS f", "0.0::DOUBLE AS d", f"0.02 + o.q1 - pow(0.02 + o.q1, 2) / {_FIRST_S} AS a", f"-(0.02 + o.q1) * (o.phi * o.phi * 0.02 + o.q2) / {_FIRST_S} AS c", f"o.phi * o.phi * 0.02 + o.q2 - pow(o.phi * o.phi * 0.02 + o.q2, 2) / {_FIRST_S} AS e", "0.0::DOUBLE AS miss", f"{_FIRST_S} AS s"]


def _slow(m: str, v: str) -> list[str]:
    to = f"coalesce(o.anchor, {m})"
    pull = f"least(greatest(0.012 + 0.020 * least(abs({to} - {m}), 0.5), 0.008), 0.075)"
    ahead, wide = f"((1 - {pull}) * {m} + {pull} * {to})", f"({v} + o.q1)"
    gain = f"least(greatest({wide} / ({wide} + o.r0), 0), 0.04)"
    return [f"{ahead} + {gain} * (o.y - {ahead}) AS f", f"greatest((1 - {gain}) * {wide}, 1e-8) AS a", f"o.y - {ahead} AS miss", f"{wide} + o.r0 AS s"]


_P95 = "quantile_cont({}, 0.95)"
_STATES = f"""{_table('profiles', bl.PROFILES)}, x0 AS (SELECT symbol, day, row_number() {W} AS n, ln(close) AS y, ln(close / lag(close) {W}) AS r, {roll('avg', 'ln(close)', 365, 90)} AS anchor, {roll('avg', 'ln(close)', 120, 30)} AS liquidity FROM bars),
x1 AS (SELECT *, abs(r) AS z, coalesce({roll('var_samp', 'r', 180, 60, 1)}, {roll('var_samp', 'r', None, 60, 1)}) AS va, coalesce({roll('var_samp', 'r', 365, 120, 1)}, {roll('var_samp', 'r', None, 120, 1)}) AS vb, {roll('stddev_samp', 'r', 180, 60, 1)} AS sr, {roll('stddev_samp', 'r', 30, 20)} AS sv FROM x0),
x2 AS (SELECT *, coalesce(z / nullif({roll(_P95, 'z', 365, 90, 1)}, 0), 0) AS tail, coalesce((z - {roll('avg', 'z', 365, 90, 1)}) / nullif({roll('stddev_samp', 'z', 365, 90, 1)}, 0), 0) AS tail_z, coalesce(sv / nullif({roll('quantile_cont({}, 0.5)', 'sv', None, 180, 1)}, 0), 0) > 1 AS volatile, first_value(anchor IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS anchor0 FROM x1),
x3 AS (SELECT x2.* EXCLUDE (symbol), p.*, symbol || '/' || state AS symbol, greatest(coalesce(CASE WHEN slow THEN vb ELSE va END, 1e-4), 1e-8) AS v FROM x2, profiles p),
x4 AS (SELECT *, greatest(v * level_noise, CASE WHEN slow THEN 1e-10 ELSE 1e-9 END) AS q1, greatest(v * deviation_noise, 1e-9) AS q2, greatest(v * observation_noise, CASE WHEN slow THEN 1e-5 ELSE 1e-8 END) AS r0 FROM x3),
xl AS (SELECT * FROM x4 WHERE NOT slow), xs AS (SELECT * FROM x4 WHERE slow), {_recursion('lo', 'xl', _LOCAL, _FIRST)}, {_recursion('sl', 'xs', _slow('r.f', 'r.a'), _slow('coalesce(o.anchor0, o.y)', '0.05'))},
f0 AS (SELECT symbol, n, f, a, e, miss, s FROM lo UNION ALL SELECT symbol, n, f, a, 0.0, miss, s FROM sl),
f1 AS (SELECT x4.*, CASE WHEN anchor_weight > 0 AND liquidity IS NOT NULL THEN (1 - anchor_weight) * f + anchor_weight * liquidity ELSE f END AS level, sqrt(greatest(greatest(a, 0) + greatest(e, 0), 0)) AS uncertainty, miss / sqrt(greatest(s, 1e-8)) AS innovation_z FROM x4 JOIN f0 USING (symbol, n)),
f2 AS (SELECT *, y - level AS gap, level - lag(level) {W} AS move, (volatile OR tail >= 1 OR CASE WHEN slow THEN tail_z >= 2.5 ELSE abs(innovation_z) >= 2 END)::INT::DOUBLE AS odd FROM f1),
{_recursion('fe', 'f2', ['CASE WHEN r.drift IS NULL THEN o.move ELSE r.drift + 2.0 / (o.drift_span + 1) * (o.move - r.drift) END AS drift', 'r.hot + 2.0 / 11 * (o.odd - r.hot) AS hot'], ['CAST(NULL AS DOUBLE) AS drift', 'o.odd AS hot'])},
states AS MATERIALIZED (SELECT split_part(f2.symbol, '/', 1) AS symbol, f2.day, state, f2.n AS history, y AS log_close, level, gap, CASE WHEN f2.n > greatest(least(drift_span // 4, CASE WHEN slow THEN 30 ELSE 20 END), 2) THEN drift END AS drift,
 greatest(coalesce(CASE WHEN slow THEN {roll('stddev_samp', 'gap', 365, 120, 1)} ELSE {roll('stddev_samp', 'gap', 180, 60, 1)} END, sr, sqrt(v)), 1e-6) AS residual_sigma,
 coalesce(CASE WHEN slow THEN (gap - {roll('avg', 'gap', 730, 180, 1)}) / nullif({roll('stddev_samp', 'gap', 730, 180, 1)}, 0) ELSE (gap - {roll('avg', 'gap', 365, 90, 1)}) / nullif({roll('stddev_samp', 'gap', 365, 90, 1)}, 0) END, 0) AS gap_z,
 innovation_z, uncertainty, least(greatest(greatest(tail - 1, 0) + 0.25 * greatest(tail_z - 2, 0) + CASE WHEN slow THEN 0 ELSE 0.35 * greatest(abs(innovation_z) - 2, 0) END, 0), 5) AS tail_flare, least(greatest(hot, 0), 1) AS high_vol
 FROM (SELECT * FROM f2) f2 JOIN (SELECT symbol AS k, n AS m, drift, hot FROM fe) fe ON fe.k = f2.symbol AND fe.m = f2.n)"""


@query(f"WITH RECURSIVE {BARS_SQL}, {_STATES} SELECT symbol, day, state, history, {', '.join(f'round({c}, 5) AS {c}' for c in bl.STATE)} FROM states")
def level_states(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_states(spark, d), 5)


def _states(spark: SparkSession, d: str) -> DataFrame:
    y = F.ln("close")
    return bl.level_states(bars(spark, d).select("symbol", "day", "close", O.mean(y, 120, 30).alias("liquidity"), O.mean(y, 365, 90).alias("anchor"), F.lit(0.0).alias("reversion")))


def _steps() -> tuple[str, str]:
    out, last = [], "z"
    for i, step in enumerate(bl.STEPS):
        out.append(f"z{i} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in step.items())} FROM {last})")
        last = f"z{i}"
    return ", ".join(out), last


_MADE, _LAST = _steps()
_TARGETS_OF = _TARGETS.removeprefix(f"{BARS_SQL}, ")


@query(f"""WITH RECURSIVE {BARS_SQL}, {_STATES}, {_TARGETS_OF}, f AS MATERIALIZED ({_cone_sql(None)}), g AS MATERIALIZED ({_cone_sql(365)}), {_table('blends', bl.BLENDS)},
z AS (SELECT f.*, g.q05 AS e05, g.q25 AS e25, g.q75 AS e75, g.q95 AS e95, p.state, p.phi, p.drift_weight, p.reversion_weight, s.history, s.gap, s.drift, s.residual_sigma, s.gap_z, s.innovation_z, s.uncertainty, s.tail_flare, s.high_vol, CAST(NULL AS DOUBLE) AS scope_days, CAST(NULL AS DOUBLE) AS pressure, b.*
 FROM f LEFT JOIN g USING (symbol, day, horizon), profiles p, blends b, states s WHERE s.symbol = f.symbol AND s.day = f.day AND s.state = p.state), {_MADE},
o AS (SELECT state, blend, y, list_sort([n05, n25, middle, n75, n95]) AS made, usable, q05, q25, q50, q75, q95, projected, projected_sigma, horizon FROM {_LAST} WHERE y IS NOT NULL),
w AS (SELECT state, blend, y, horizon, usable, projected, projected_sigma, {', '.join(f'CASE WHEN usable THEN made[{i}] ELSE {n} END AS {n}' for i, n in enumerate(fc.NAMES, 1))} FROM o)
SELECT 'blend_' || state || '_' || blend AS forecaster, horizon, count(*) AS observations, sum(usable::INT)::BIGINT AS blended, {', '.join(f'round(avg({n}), 5) AS {n}' for n in fc.NAMES)}, round(avg(CASE WHEN usable THEN projected END), 5) AS projected, round(avg(CASE WHEN usable THEN projected_sigma END), 5) AS projected_sigma,
round(avg(0.5 * abs(y - q50) + 0.25 * (q75 - q25 + 4 * greatest(q25 - y, 0) + 4 * greatest(y - q75, 0)) + 0.25 * (q95 - q05 + 20 * greatest(q05 - y, 0) + 20 * greatest(y - q95, 0))), 5) AS wis FROM w GROUP BY ALL""", date=None)
def blend_panel(spark: SparkSession, d: str) -> DataFrame:
    """All 45 forecasters over every forecast with an outcome, summed up by forecaster and horizon."""
    targets = fc.forward_targets(bars(spark, d))
    rows, recent = fc.cone(targets), fc.window_cone(targets)
    made = bl.blended(rows, _states(spark, d), recent, extra=["actual"]).where(F.col("actual").isNotNull())
    wis = fc.wis_sum(F.col("actual"), *[F.col(n) for n in fc.NAMES])
    return rounded(made.groupBy("forecaster", "horizon").agg(F.count(F.lit(1)).alias("observations"), F.count("projected").alias("blended"), *[F.avg(c).alias(c) for c in (*fc.NAMES, "projected", "projected_sigma")], F.avg(wis).alias("wis")), 5)
