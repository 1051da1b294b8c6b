"""The query of the whole daily scorer, with its SQL: windows over known rows instead of running histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import leverage as lv
from tidewright.operators import signals as sg
from tidewright.plans.market import BARS_SQL, bars, table
from tidewright.plans.positions import _clamp
from tidewright.plans.registry import O, W, frame, query, rounded

_N = frame(365, 1)
_DIGITS = 4


def _share(x: str, history: str) -> str:
    """x against the 90th percentile of the known values of the 365 rows before, where all rows are known."""
    return f"CASE WHEN {x} <= 0 THEN 0 WHEN count({history}) {_N} >= 60 THEN CASE WHEN quantile_cont({history}, 0.9) {_N} > 0 THEN {_clamp(f'100 * {x} / quantile_cont({history}, 0.9) {_N}', 0, 100)} ELSE 0 END END"


def _of_known(name: str, x: str, out: str, source: str, where: str, value: str) -> str:
    """A table `name`: source with `out`, a value made on the rows that satisfy `where` alone."""
    return f"{name} AS (SELECT s.*, k.{out} FROM {source} s LEFT JOIN (SELECT symbol, day, {value} AS {out} FROM {source} WHERE {where}) k USING (symbol, day))"


def _robust(x: str) -> str:
    m = f"quantile_cont({x}, 0.5) {_N}"
    return f"CASE WHEN count({x}) {_N} >= 60 THEN [{x}, {m}, stddev_pop({x}) {_N}] || list({x}) {_N} END"


def _tanh(a: str) -> str:
    mad = f"(1.4826 * list_median(list_transform({a}[4:], lambda v: abs(v - {a}[2]))))"
    return f"CASE WHEN {a} IS NULL THEN NULL WHEN {mad} > 1e-12 THEN 100 * tanh({_clamp(f'({a}[1] - {a}[2]) / {mad}', -4, 4)} / 2) WHEN {a}[3] > 1e-12 THEN 100 * tanh({_clamp(f'({a}[1] - {a}[2]) / {a}[3]', -4, 4)} / 2) ELSE 0 END"


_WALLS = "wl AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linenumber % 2 = 0 THEN 'wall' ELSE 'area' END AS kind, CASE WHEN l_suppkey % 2 = 0 THEN 'up' ELSE 'down' END AS side, l_quantity * 12 AS dist, l_extendedprice AS notional FROM lineitem WHERE l_partkey % 4 > 0)"
_AMOUNT = {c: f"CASE WHEN {c}_n IS NULL THEN NULL WHEN {c}_n <= 0 THEN 0 WHEN {k}_c >= 60 THEN CASE WHEN {k}_hi > 0 THEN {_clamp(f'100 * {c}_n / {k}_hi', 0, 100)} ELSE 0 END END" for k, s in sg.KINDS for c in (f"{k}_{s}",)}
_SQL = f"""WITH {BARS_SQL}, a AS (SELECT symbol, day, CASE WHEN trades % 11 > 0 THEN close END AS price, ln(high / low) - 0.3 AS funding, CASE WHEN trades % 6 > 0 THEN ln(high / close) - 0.2 END AS predicted, volume - lag(volume, 7) {W} AS oi, CASE WHEN trades % 3 > 0 THEN 40 * (close - open) / high END AS dominance, CASE WHEN trades % 5 > 0 THEN 30 * (open - close) / high END AS heat, fmod(volume, 17) AS v1, fmod(volume, 13) AS v2, trades % 4 > 0 AS has_space, volume - 20 AS p_up, close - 1000 AS p_down FROM bars),
k0 AS (SELECT symbol, day, ln(price / lag(price) {W}) AS r FROM a WHERE price IS NOT NULL), k1 AS (SELECT symbol, day, r, CASE WHEN count(r) {frame(30, 1)} >= 15 THEN stddev_pop(r) {frame(30, 1)} END AS usual, sqrt(avg(r * r) {frame(7)}) AS present, CASE WHEN count(r) {frame(30)} >= 15 THEN stddev_pop(r) {frame(30)} END AS usual_after, sqrt(avg(r * r) {frame(6)}) AS present_after FROM k0),
b0 AS (SELECT a.*, k1.r, k1.usual, k1.present, k.usual_after, k.present_after FROM a ASOF LEFT JOIN k1 k ON a.symbol = k.symbol AND a.day >= k.day LEFT JOIN k1 ON k1.symbol = a.symbol AND k1.day = a.day),
b AS (SELECT * REPLACE (CASE WHEN price IS NULL THEN usual_after ELSE usual END AS usual, CASE WHEN price IS NULL THEN present_after ELSE present END AS present) FROM b0),
{_of_known('c1', 'funding', 'fz', 'b', 'funding IS NOT NULL', _robust('funding'))}, {_of_known('c2', 'predicted', 'pz', 'c1', 'predicted IS NOT NULL', _robust('predicted'))},
{_of_known('c3', 'oi', 'added0', 'c2', 'oi > 0', _share('oi', 'oi'))}, {_of_known('c4', 'oi', 'gone0', 'c3', 'oi < 0', _share('(-oi)', '(-oi)'))}, {_of_known('c5', 'present', 'regime_score', 'c4', 'present IS NOT NULL', _share('present', 'present'))},
{_of_known('c6', 'p_up', 'up0', 'c5', 'has_space AND p_up > 0', _share('p_up', 'p_up'))}, {_of_known('c7', 'p_down', 'down0', 'c6', 'has_space AND p_down > 0', _share('p_down', 'p_down'))},
d AS (SELECT *, {_tanh('fz')} AS f1, {_tanh('pz')} AS p1, CASE WHEN oi <= 0 THEN 0 ELSE added0 END AS added, CASE WHEN oi < 0 THEN coalesce(gone0, 0) / 100 ELSE 0 END AS gone, CASE WHEN r IS NOT NULL AND usual IS NOT NULL THEN {_clamp('(abs(r) / greatest(usual, 0.005) - 0.75) / 1.75 * 100', 0, 100)} END AS trig, CASE WHEN usual IS NULL THEN 0.04 ELSE {_clamp('2 * usual * sqrt(7)', 0.04, 0.18)} END AS near_band,
 {_clamp('2 * coalesce(nullif(usual, 0), nullif(present, 0), 0.005) * sqrt(7) * 10000', 150, 1200)} AS band, CASE WHEN has_space THEN CASE WHEN p_up <= 0 THEN 0 ELSE up0 END END AS su, CASE WHEN has_space THEN CASE WHEN p_down <= 0 THEN 0 ELSE down0 END END AS sd, {_clamp('-dominance / 20 * 100', -100, 100)} + dominance * 0 AS i1, CASE WHEN has_space THEN {_clamp('-heat / 20 * 100', -100, 100)} + heat * 0 END AS i2 FROM c7),
e AS (SELECT *, -CASE WHEN f1 IS NULL THEN p1 WHEN p1 IS NULL THEN f1 ELSE 0.6 * f1 + 0.4 * p1 END AS crowd, CASE WHEN i1 IS NULL THEN i2 WHEN i2 IS NULL THEN i1 ELSE 0.65 * i1 + 0.35 * i2 END AS liq, row_number() {W} AS n, sum(ln({lv.DECAY!r} * (1 - 0.35 * gone / 7))) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS cum FROM d),
t AS (SELECT symbol, day, sum(w) AS total, sum(w * near) AS active, sum(w * near * sd0) AS directional, sum(w * near * lp) AS anchored FROM (SELECT g.symbol, g.day, g.n, s.n AS m, s.added / 700 * exp(g.cum - s.cum) AS w, exp(-0.5 * pow(ln(g.price / s.price) / g.near_band, 2)) AS near, {_clamp('coalesce(s.crowd, 0)', -100, 100)} / 100 AS sd0, ln(s.price) AS lp FROM e g JOIN e s ON s.symbol = g.symbol AND s.n <= g.n AND s.added > 0 AND s.price IS NOT NULL AND g.price IS NOT NULL) x WHERE n = m OR w >= 0.001 GROUP BY 1, 2),
u0 AS (SELECT e.*, coalesce(total, 0) AS total, coalesce(active, 0) AS active, coalesce(directional, 0) AS directional, coalesce(anchored, 0) AS anchored FROM e LEFT JOIN t USING (symbol, day)),
u1 AS (SELECT symbol, day, count(*) {_N} AS c, quantile_cont(active, 0.9) {_N} AS hi, count(*) {frame(365)} AS c_after, quantile_cont(active, 0.9) {frame(365)} AS hi_after FROM u0 WHERE price IS NOT NULL),
u AS (SELECT u0.*, coalesce(CASE WHEN price IS NULL THEN k.c_after ELSE k.c END, 0) AS ac, CASE WHEN price IS NULL THEN k.hi_after ELSE k.hi END AS ahi FROM u0 ASOF LEFT JOIN u1 k ON u0.symbol = k.symbol AND u0.day >= k.day),
v AS (SELECT *, CASE WHEN ac >= 60 THEN CASE WHEN ahi > 0 THEN {_clamp('100 * active / ahi', 0, 100)} ELSE coalesce(added, 0) END END AS fuel, CASE WHEN total > 0 THEN {_clamp('100 * active / total', 0, 100)} ELSE 0 END AS again, CASE WHEN active > 0 THEN {_clamp('100 * directional / active', -100, 100)} ELSE 0 END AS side FROM u),
{_WALLS}, ws AS (SELECT wl.*, notional * exp(-0.5 * pow(dist / band, 2)) AS score FROM wl JOIN v USING (symbol, day) WHERE notional > 0),
wd AS (SELECT symbol, day, {', '.join(f"arg_max(notional, (score, -abs(dist), notional)) FILTER (WHERE kind = '{k}' AND side = '{s}') AS {k}_{s}_n, arg_max(dist, (score, -abs(dist), notional)) FILTER (WHERE kind = '{k}' AND side = '{s}') AS {k}_{s}_d" for k, s in sg.KINDS)}, max(notional) FILTER (WHERE kind = 'wall') AS wall_most, max(notional) FILTER (WHERE kind = 'area') AS area_most FROM ws GROUP BY 1, 2),
wh AS (SELECT v.symbol, v.day, wd.* EXCLUDE (symbol, day), {', '.join(f'coalesce(k{k}.c, 0) AS {k}_c, k{k}.hi AS {k}_hi' for k in ('wall', 'area'))} FROM v LEFT JOIN wd ON wd.symbol = v.symbol AND wd.day = v.day
 {' '.join(f'ASOF LEFT JOIN (SELECT symbol, day, count(*) {frame(365)} AS c, quantile_cont({k}_most, 0.9) {frame(365)} AS hi FROM wd WHERE {k}_most IS NOT NULL) k{k} ON k{k}.symbol = v.symbol AND k{k}.day < v.day' for k in ('wall', 'area'))}),
x0 AS (SELECT v.*, wall_c, has_space OR wall_most IS NOT NULL OR area_most IS NOT NULL AS spaced, {', '.join(f'sqrt({_AMOUNT[f"{k}_{s}"]} * 100 * exp(-0.5 * pow({k}_{s}_d / band, 2))) AS {k}_{s}' for k, s in sg.KINDS)} FROM v JOIN wh USING (symbol, day)),
x1 AS (SELECT *, greatest(wall_up, area_up, su) AS tu, greatest(wall_down, area_down, sd) AS td, CASE WHEN su IS NOT NULL OR sd IS NOT NULL THEN {_clamp('coalesce(su, 0) - coalesce(sd, 0)', -100, 100)} END AS net FROM x0),
x2 AS (SELECT *, CASE WHEN tu IS NOT NULL OR td IS NOT NULL THEN greatest(coalesce(tu, 0), coalesce(td, 0)) END AS space_cascade, CASE WHEN tu IS NOT NULL OR td IS NOT NULL THEN {_clamp('coalesce(tu, 0) - coalesce(td, 0)', -100, 100)} END AS raw FROM x1),
x3 AS (SELECT *, CASE WHEN net IS NOT NULL THEN {_clamp('0.75 * raw + 0.25 * net', -100, 100)} + raw * 0 ELSE raw END AS toward, coalesce(sign(r), 0) * coalesce(trig, 0) * coalesce(fuel, 0) / 100 * greatest(coalesce(sign(r), 0) * side / 100, 0) AS activation, side * again / 100 AS pressure FROM x2),
y0 AS (SELECT *, {_clamp('0.45 * activation + 0.2 * coalesce(liq, 0) + 0.2 * pressure + 0.15 * coalesce(crowd, 0)', -100, 100)} AS base FROM x3), y1 AS (SELECT *, CASE WHEN toward IS NULL THEN base ELSE {_clamp('0.72 * base + 0.28 * toward', -100, 100)} END AS ds FROM y0),
y2 AS (SELECT *, {_clamp('0.55 * coalesce(regime_score, 0) + 0.2 * coalesce(trig, 0) + 0.15 * coalesce(fuel, 0) + 0.1 * abs(ds)', 0, 100)} AS base_potential FROM y1), y3 AS (SELECT *, CASE WHEN space_cascade IS NULL THEN base_potential ELSE {_clamp('0.78 * base_potential + 0.22 * space_cascade', 0, 100)} END AS ps, coalesce(toward, CASE WHEN price IS NOT NULL THEN pressure ELSE crowd END) AS peer FROM y2),
z AS (SELECT *, CASE WHEN abs(liq) >= 10 AND abs(peer) >= 10 THEN CASE WHEN liq * peer > 0 THEN 1 ELSE 0 END WHEN coalesce(abs(liq) >= 10, FALSE) OR coalesce(abs(peer) >= 10, FALSE) THEN 0.5 ELSE 0.25 END AS agree,
 ((funding IS NOT NULL)::INT + (predicted IS NOT NULL)::INT + (oi IS NOT NULL)::INT + (dominance IS NOT NULL)::INT + (price IS NOT NULL)::INT + has_space::INT) / 6 AS whole, (least(v1 / {sg.FUNDING_VENUES}, 1) + least(v2 / {sg.PREDICTED_VENUES}, 1)) / 2 AS venues,
 (least(coalesce(count(funding) {frame(None, 1)}, 0) / 60, 1) + least(coalesce(count(*) FILTER (WHERE oi > 0) {frame(None, 1)}, 0) / 60, 1) + least(coalesce(count(r) {frame(None, 1)}, 0) / 15, 1) + least(coalesce(count(price) {frame(None, 1)}, 0) / 60, 1) + least(wall_c / 60, 1)) / 5 AS ready FROM y3)
SELECT symbol, day, {', '.join(f'round({x}, {_DIGITS}) AS {n}' for x, n in (('liq', 'liquidation'), ('crowd', 'funding_score'), ('added', 'added'), ('fuel', 'fuel'), ('again', 'reactivation'), ('side', 'side'), ('CASE WHEN active > 0 THEN exp(anchored / active) END', 'anchor'), ('trig', 'trigger'), ('regime_score', 'regime_score'), ('activation', 'activation'), ('space_cascade', 'space_cascade'), ('toward', 'space_direction'), ('ds', 'direction_score'), ('ps', 'potential_score'), ('CASE WHEN abs(ds) >= 12 THEN sign(ds) * ps ELSE 0 END', 'signed_potential'), ('100 * (0.3 * whole + 0.2 * venues + 0.25 * agree + 0.25 * ready)', 'confidence')))},
CASE WHEN ds >= 12 THEN 'upside' WHEN ds <= -12 THEN 'downside' ELSE 'neutral' END AS direction, CASE WHEN ps >= 65 THEN 'high' WHEN ps >= 35 THEN 'elevated' ELSE 'low' END AS potential, CASE WHEN space_cascade >= 65 THEN 'cascade-ready' WHEN space_cascade >= 35 THEN 'watch' WHEN space_cascade > 0 THEN 'building' WHEN space_cascade IS NOT NULL THEN 'none' ELSE '' END AS state FROM z"""


@query(_SQL)
def daily_signals(spark: SparkSession, d: str) -> DataFrame:
    """Days without a price, predicted funding, dominance or space are among the rows."""
    c, has = F.col("close"), F.col("trades") % 4 > 0
    b = bars(spark, d)
    b = b.select(
        "symbol", "day", F.when(F.col("trades") % 11 > 0, c).alias("price"), (F.ln(F.col("high") / F.col("low")) - 0.3).alias("funding"), F.when(F.col("trades") % 6 > 0, F.ln(F.col("high") / c) - 0.2).alias("predicted"), O.diff(F.col("volume"), 7).alias("oi"),
        F.when(F.col("trades") % 3 > 0, 40 * (c - F.col("open")) / F.col("high")).alias("dominance"), F.when(F.col("trades") % 5 > 0, 30 * (F.col("open") - c) / F.col("high")).alias("heat_dominance"),
        (F.col("volume") % 17).alias("funding_venues"), (F.col("volume") % 13).alias("predicted_venues"), has.alias("has"), (F.col("volume") - 20).alias("p_up"), (c - 1000).alias("p_down"),
    )
    li = table(spark, d, "lineitem").where(F.col("l_partkey") % 4 > 0)
    walls = li.select(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("day"), F.when(F.col("l_linenumber") % 2 == 0, "wall").otherwise("area").alias("kind"), F.when(F.col("l_suppkey") % 2 == 0, "up").otherwise("down").alias("side"), (F.col("l_quantity") * 12).alias("distance_bps"), F.col("l_extendedprice").alias("notional"))
    return rounded(sg.daily_signals(b, walls, b.where("has")).drop("regime"), _DIGITS)
