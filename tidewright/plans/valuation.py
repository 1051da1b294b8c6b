"""Queries of holder, liquidity, choppiness and strategy features, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import relational as rel
from tidewright.operators import valuation as va
from tidewright.plans.market import BARS_SQL, PRIORITIES, SERIES_SQL, bars, series
from tidewright.plans.registry import O, W, frame, query, roll, rounded, rounded_column
from tidewright.sources import tables as src

_HOLD = ["close", "volume", "open"]


def _base_sql(names: list[str]) -> str:
    """Common tables that end in `eq`, with each column as the operator's equalised base."""
    part = "OVER (PARTITION BY symbol)"
    return f"""l AS (SELECT symbol, day, {', '.join(f'ln(CASE WHEN min({c}) {part} <= 0 THEN {c} + 1 - min({c}) {part} ELSE {c} END) AS {c}' for c in names)} FROM comp),
z AS (SELECT symbol, day, {', '.join(f'greatest(least(({c} - avg({c}) {part}) / nullif(stddev_samp({c}) {part}, 0), 3), -3) AS {c}' for c in names)} FROM l),
g AS (SELECT *, {', '.join(f'quantile_cont({c}, 0.95) {part} - quantile_cont({c}, 0.05) {part} AS g_{c}, {roll("max", c, 365, 182)} - {roll("min", c, 365, 182)} AS r_{c}' for c in names)} FROM z),
eq AS (SELECT symbol, day, {', '.join(f'CASE WHEN r_{c} <> 0 THEN {c} * greatest(least(sqrt(g_{c} / r_{c}), 5), 0.2) END AS {c}' for c in names)} FROM g)"""


def _summary_sql(parts: list[str], bound: float, scale: float) -> str:
    n = " + ".join(f"({p} IS NOT NULL)::INT" for p in parts)
    total = " + ".join(f"coalesce({p}, 0)" for p in parts)
    cut = [f"greatest(least({p}, {bound}), -{bound})" for p in parts]
    size, sign = " * ".join(f"abs({c})" for c in cut), " + ".join(f"sign({c})" for c in cut)
    return f"round(({total}) / nullif({n}, 0), 5) AS average, round(CASE WHEN ({n}) = {len(parts)} THEN {size} * sign({sign}) / {scale} END, 5) AS boost"


_COMP = f"{BARS_SQL}, comp AS (SELECT symbol, day, close, volume - 300 AS volume, open, (high + low) / nullif(close, 0) AS risk FROM bars)"


@query(f"WITH {_COMP}, {_base_sql(['close', 'volume', 'open', 'risk'])} SELECT symbol, day, {_summary_sql(['close', 'volume', 'open', 'risk'], 1.8, 4)} FROM eq")
def long_holder_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(va.holder_summary(_components(spark, d), ["close", "volume", "open", "risk"], 1.8, 4), 5)


@query(f"WITH {_COMP}, {_base_sql(['close', 'volume', 'risk'])} SELECT symbol, day, {_summary_sql(['close', '(volume * 1.3 + 0.4)', '(risk + 0.2)'], 1.5, 3)} FROM eq")
def short_holder_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(va.holder_summary(_components(spark, d), ["close", "volume", "risk"], 1.5, 3, {"volume": (1.3, 0.4), "risk": (1.0, 0.2)}), 5)


def _components(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).select("symbol", "day", "close", (F.col("volume") - 300).alias("volume"), "open", F.col("high").alias("realized_profit"), F.col("low").alias("realized_loss"), F.col("close").alias("realized_cap"))
    return va.sell_side_risk(b).withColumnRenamed("sell_side_risk", "risk")


_WIDE = f"{SERIES_SQL}, w AS (SELECT day, " + ", ".join(f"max(value) FILTER (WHERE series_name = '{p}') AS s{i}" for i, p in enumerate(PRIORITIES, 1)) + " FROM series GROUP BY day)"
_DAILY = f"{_WIDE}, cal AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM w), f AS (SELECT cal.day, " + ", ".join(f"last_value(s{i} IGNORE NULLS) OVER (ORDER BY cal.day ROWS UNBOUNDED PRECEDING) AS s{i}" for i in range(1, 6)) + " FROM cal LEFT JOIN w USING (day))"


@query(f"""WITH {_DAILY.replace("max(value) FILTER (WHERE series_name = '5-LOW')", "max(CASE WHEN day >= DATE '1995-03-01' THEN value ELSE 0 END) FILTER (WHERE series_name = '5-LOW')")},
c AS (SELECT day, {', '.join(f'coalesce(s{i}, 0) AS s{i}' for i in range(1, 6))} FROM f), n AS (SELECT day, nullif(s1 / 1000 - s2 / 1000 - s3 + s4 / 1000 + s5 / 1000, 0) AS liquidity, 1 / nullif(s5, 0) AS inv_dollar FROM c), m AS (SELECT day + 42 AS day, nullif(s2, 0) AS money_later FROM c)
SELECT day, round(liquidity, 6) AS liquidity, round(money_later, 6) AS money_later, round(inv_dollar, 9) AS inv_dollar FROM n FULL JOIN m USING (day) WHERE liquidity IS NOT NULL OR money_later IS NOT NULL OR inv_dollar IS NOT NULL""")
def net_liquidity(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d)
    s = s.withColumn("value", F.when((F.col("series_name") == "5-LOW") & (F.col("day") < F.lit("1995-03-01").cast("date")), 0.0).otherwise(F.col("value")))
    wide = src.pivot_last(s, "day", PRIORITIES, ["source", "series_name"])
    a = dict(zip(("assets", "treasury", "repo", "funding", "credit"), PRIORITIES, strict=True))
    df = va.net_liquidity(wide, **a, money=PRIORITIES[1], dollar=PRIORITIES[4])
    return df.select("day", rounded_column("liquidity", 6).alias("liquidity"), rounded_column("money_later", 6).alias("money_later"), rounded_column("inv_dollar", 9).alias("inv_dollar"))


@query(f"""WITH {BARS_SQL}, k AS (SELECT symbol, (day + CAST((13 - (dayofweek(day) + 1)) % 7 AS INTEGER))::DATE AS week, arg_max(close, day) AS close FROM bars GROUP BY 1, 2),
c AS (SELECT symbol, week, row_number() OVER s AS n, ln(close) - lag(ln(close), 52) OVER s AS x FROM k WINDOW s AS (PARTITION BY symbol ORDER BY week)),
e AS (SELECT symbol, week, count(x) OVER s AS seen, sum(x * pow(119.0 / 121, -n)) OVER s / sum(CASE WHEN x IS NOT NULL THEN pow(119.0 / 121, -n) END) OVER s AS slow FROM c WINDOW s AS (PARTITION BY symbol ORDER BY week ROWS UNBOUNDED PRECEDING))
SELECT symbol, week, round(slow, 6) AS slow FROM e WHERE seen >= 30""", date="week")
def slow_liquidity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(va.slow_changes(rel.week_ends(bars(spark, d), "symbol", "close"), "close"))


_CHOP = f"""{BARS_SQL}, ch AS (SELECT symbol, day, close, fmod(close, 100) AS c1, CASE WHEN trades % 4 > 0 THEN fmod(open, 100) END AS c2, CASE WHEN trades % 3 > 0 THEN fmod(high, 100) END AS c3, close / {roll('avg', 'close', 20)} - 1 AS t, close / lag(close, 7) {W} - 1 AS m, close / lag(close, 30) {W} - 1 AS g FROM bars),
bl AS (SELECT *, coalesce((coalesce(0.55 * c1, 0) + coalesce(0.3 * c2, 0) + coalesce(0.15 * c3, 0)) / nullif(0.55 * (c1 IS NOT NULL)::INT + 0.3 * (c2 IS NOT NULL)::INT + 0.15 * (c3 IS NOT NULL)::INT, 0), 42.7) AS blend FROM ch),
tw AS (SELECT *, greatest(least((61.8 - blend) / 38.2, 1), 0) AS tw FROM bl)"""


def _chopped(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("close")
    df = bars(spark, d).select("symbol", "day", "close", (c % 100).alias("c1"), F.when(F.col("trades") % 4 > 0, F.col("open") % 100).alias("c2"), F.when(F.col("trades") % 3 > 0, F.col("high") % 100).alias("c3"), (c / O.mean(c, 20) - 1).alias("trend"), (c / O.lag(c, 7) - 1).alias("momentum"), (c / O.lag(c, 30) - 1).alias("regime"))
    return va.choppiness(df.na.fill(0.0, subset=["trend", "momentum", "regime"]), ("c1", "c2", "c3"))


def _tw(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN greatest(least((61.8 - {c}) / 38.2, 1), 0) END"


@query(f"""WITH {_CHOP} SELECT symbol, day, {', '.join(f'round({_tw(c)}, 6) AS {c}_trend, round(1 - 2 * {_tw(c)}, 6) AS {c}_balance' for c in ('c1', 'c2', 'c3'))}, round(blend, 6) AS blend, round(tw, 6) AS trend_weight,
round((1 - tw + 0.05) / (tw + 0.05), 6) AS mr_trend_ratio, round(ln((1 - tw + 0.05) / (tw + 0.05)), 6) AS log_ratio, round(1 - 2 * tw, 6) AS balance, round(abs(1 - 2 * tw), 6) AS intensity, (blend >= 61.8)::INT AS above_consolidation, (blend <= 23.6)::INT AS below_trend FROM tw""")
def choppiness_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_chopped(spark, d).drop("close", "c1", "c2", "c3", "trend", "momentum", "regime"))


def _strategy_sql() -> str:
    names = ("trend", "momentum", "reversion")
    shift = ", ".join(f"ln(close) - lag(ln(close), {h}) {W} AS r{h}, " + ", ".join(f"lag(s_{s}, {h}) {W} AS {s}{h}" for s in names) for h in (1, 3))
    hits = ", ".join(f"CASE WHEN abs({s}{h}) > 1e-12 AND r{h} IS NOT NULL THEN (sign({s}{h}) * sign(r{h}) > 0)::INT END AS k_{s}{h}, CASE WHEN {s}{h} IS NOT NULL THEN r{h} END AS y_{s}{h}, CASE WHEN r{h} IS NOT NULL THEN {s}{h} END AS x_{s}{h}" for h in (1, 3) for s in names)
    rates = ", ".join(f"coalesce({roll('avg', f'k_{s}{h}', 90, 30)}, 0.5) AS {s}_hit_{h}, coalesce(CASE WHEN count(y_{s}{h}) {frame(90)} >= 30 AND stddev_pop(x_{s}{h}) {frame(90)} * stddev_pop(y_{s}{h}) {frame(90)} > 1e-14 THEN greatest(least(corr(x_{s}{h}, y_{s}{h}) {frame(90)}, 1), -1) END, 0) AS {s}_ic_{h}" for h in (1, 3) for s in names)
    return f"""WITH {_CHOP}, s0 AS (SELECT symbol, day, close, tw, coalesce(t, 0) AS t, coalesce(m, 0) AS m, coalesce(g, 0) AS g FROM tw), s1 AS (SELECT *, t * tw AS s_trend, m * (0.5 + 0.5 * tw) AS s_momentum, -t * (1 - tw) * (0.5 + 0.5 * abs(g)) AS s_reversion FROM s0),
s2 AS (SELECT *, {shift} FROM s1), s3 AS (SELECT *, {hits} FROM s2), s4 AS (SELECT symbol, day, t, m, g, tw, {rates} FROM s3),
s5 AS (SELECT *, abs(t) * tw * (0.5 + (trend_hit_1 + trend_hit_3) / 2) AS p1, abs(m) * (0.5 + 0.5 * tw) * (0.5 + (momentum_hit_1 + momentum_hit_3) / 2) AS p2, (0.65 * abs(t) + 0.35 * abs(g)) * (1 - tw) * (0.5 + (reversion_hit_1 + reversion_hit_3) / 2) AS p3 FROM s4),
s6 AS (SELECT *, coalesce(p1 / nullif(p1 + p2 + p3, 0), 1 / 3) AS a, coalesce(p2 / nullif(p1 + p2 + p3, 0), 1 / 3) AS b, coalesce(p3 / nullif(p1 + p2 + p3, 0), 1 / 3) AS c FROM s5)
SELECT symbol, day, {', '.join(f'round({s}_{x}_{h}, 5) AS {s}_{x}_{h}' for h in (1, 3) for s in names for x in ('hit', 'ic'))}, round(a, 5) AS share_trend, round(b, 5) AS share_momentum, round(c, 5) AS share_reversion,
CASE WHEN a >= b AND a >= c THEN 'trend' WHEN b >= c THEN 'momentum' ELSE 'reversion' END AS dominant, round(list_sort([a, b, c])[3] - list_sort([a, b, c])[2], 5) AS margin FROM s6"""


@query(_strategy_sql())
def strategy_influence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(va.strategy_influence(_chopped(spark, d)), 5)


_STAB = {"a": (-1.6, 1.6), "b": None, "c": (-2.0, 2.0)}
_PART = "OVER (PARTITION BY symbol)"


@query(f"""WITH {BARS_SQL}, o AS (SELECT symbol, day, row_number() {W} AS n, count(*) {_PART} AS size, volume AS b, trades::DOUBLE AS c, close AS raw FROM bars), h AS (SELECT * EXCLUDE raw, CASE WHEN n <= 5 THEN 7 ELSE raw END AS a FROM o),
p AS (SELECT *, {', '.join(f'CASE WHEN n % 2 = 1 AND {c} IS DISTINCT FROM lead({c}) {W} THEN n END AS v_{c}' for c in _STAB)} FROM h), t AS (SELECT * FROM p QUALIFY n > greatest({', '.join(f'coalesce(min(v_{c}) {_PART} - 1, size - size % 2)' for c in _STAB)})),
m AS (SELECT *, {', '.join(f'quantile_cont({c}, 0.5) {_PART} AS m_{c}' for c in _STAB)} FROM t), x AS (SELECT *, {', '.join(f'abs({c} - m_{c}) AS o_{c}' for c in _STAB)} FROM m), y AS (SELECT *, {', '.join(f'1.4826 * quantile_cont(o_{c}, 0.5) {_PART} AS d_{c}' for c in _STAB)} FROM x)
SELECT symbol, day, {', '.join(f'round(greatest(least(CASE WHEN d_{c} = 0 THEN 0 ELSE ({c} - m_{c}) / d_{c} END, {(b or (-5.0, 5.0))[1]}), {(b or (-5.0, 5.0))[0]}), 6) AS {c}' for c, b in _STAB.items())} FROM y""")
def stabilised_indicators(spark: SparkSession, d: str) -> DataFrame:
    """The first five rows of column a stand still, so its first two pairs are cut."""
    df = bars(spark, d).select("symbol", "day", F.col("volume").alias("b"), F.col("trades").cast("double").alias("c"), F.when(F.row_number().over(O.spec) <= 5, 7.0).otherwise(F.col("close")).alias("a"))
    return rounded(va.stabilised(df, _STAB))
