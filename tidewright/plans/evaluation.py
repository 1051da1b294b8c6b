"""Queries of the tables that judge forecasts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import attention as at
from tidewright.operators import evaluation as ev
from tidewright.operators import forecasts as fc
from tidewright.operators import leverage as lv
from tidewright.plans.market import BARS_SQL, MARKET_SQL, SERIES_SQL, bars, market_bars, series
from tidewright.plans.registry import O, W, _PANEL, _PB, _TARGETS, _W1, _cone_sql, _ema, _panel, _recursion, frame, query, roll, rounded

_F = f"{_TARGETS}, f AS ({_cone_sql(None)})"
_NAMES = ", ".join(fc.NAMES)


def _expanding(spark: SparkSession, d: str) -> DataFrame:
    return fc.cone(fc.forward_targets(bars(spark, d)))


@query(f"""WITH {_F} SELECT symbol, horizon, year(day)::INTEGER AS year, count(*) AS observations, round(avg({_PB}), 6) AS avg_pinball, round(avg({_W1}), 6) AS wis, round(avg((y < q05)::INT), 6) AS q05_miss_rate, round(avg((y > q95)::INT), 6) AS q95_miss_rate,
round(avg((y BETWEEN q25 AND q75)::INT), 6) AS coverage_50, round(avg((y BETWEEN q05 AND q95)::INT), 6) AS coverage_90, round(avg(q95 - q05), 6) AS width_90 FROM f WHERE y IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 200""", date=None)
def yearly_calibration(spark: SparkSession, d: str) -> DataFrame:
    losses = fc.with_losses(_expanding(spark, d)).withColumn("year", F.year("day"))
    return rounded(ev.grouped_calibration(losses, ["symbol", "horizon", "year"], 200))


@query(f"""WITH {_F}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon ORDER BY day DESC) AS k FROM f WHERE y IS NOT NULL), w AS (SELECT r.*, n AS "window" FROM r, (VALUES (30), (90), (180), (365), (1000000)) AS s(n) WHERE k <= n)
SELECT symbol, horizon, CASE WHEN "window" = 1000000 THEN 'all' ELSE 'last_' || "window" END AS "window", count(*) AS observations, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, round(avg(abs(q50 - y)), 6) AS mae, round(avg(q50 - y), 6) AS bias, round(sqrt(avg((q50 - y) * (q50 - y))), 6) AS rmse,
round(avg(CASE WHEN y <> 0 AND q50 <> 0 THEN (sign(y) = sign(q50))::INT END), 6) AS hit_rate, round(avg((y BETWEEN q25 AND q75)::INT), 6) AS coverage_50, round(avg((y BETWEEN q05 AND q95)::INT), 6) AS coverage_90, round(avg((y < q05)::INT), 6) AS q05_miss_rate, round(avg((y > q95)::INT), 6) AS q95_miss_rate, round(avg(q75 - q25), 6) AS width_50, round(avg(q95 - q05), 6) AS width_90
FROM w GROUP BY symbol, horizon, w."window" """, date=None)
def trailing_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.trailing_windows(_expanding(spark, d), ["symbol", "horizon"]))


@query(f"""WITH {_F}, s AS (SELECT *, {_W1} AS wis, {_PB} AS pb FROM f WHERE y IS NOT NULL) SELECT symbol, horizon, """ + ", ".join(f"count(*) FILTER (WHERE {m}) AS {n}_n, round(avg(wis) FILTER (WHERE {m}), 6) AS {n}_wis, round(avg(pb) FILTER (WHERE {m}), 6) AS {n}_pinball, round(avg(abs(q50 - y)) FILTER (WHERE {m}), 6) AS {n}_error" for n, m in (("wide", "q95 - q05 > 0.5"), ("large", "abs(y) > 0.1"), ("falling", "q50 < 0"), ("none", "q05 > 5"))) + " FROM s GROUP BY 1, 2", date=None)
def subset_losses(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("actual")
    losses = fc.with_losses(ev.realised(_expanding(spark, d)))
    return rounded(ev.subset_losses(losses, ["symbol", "horizon"], {"wide": F.col("width_90") > 0.5, "large": F.abs(y) > 0.1, "falling": F.col("q50") < 0, "none": F.col("q05") > 5}))


@query(f"""WITH {SERIES_SQL}, s AS (SELECT series_name, day, CASE WHEN value > 140000 THEN value END AS a, value AS b FROM series WHERE day NOT BETWEEN DATE '1996-02-01' AND DATE '1996-03-01'), g AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY series_name ORDER BY day), day) AS g FROM s),
m AS (SELECT series_name, g, count(*) AS c, sum(count(*)) OVER (PARTITION BY series_name) AS total FROM g WHERE g IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY series_name ORDER BY c DESC, g) = 1)
SELECT g.series_name, count(*) AS n_rows, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, round(avg(((a IS NULL)::INT + (b IS NULL)::INT) / 2), 6) AS missing_ratio, count(*) FILTER (WHERE g.g > 1) AS large_gaps, any_value(m.g)::INTEGER AS mode_days, round(any_value(m.c / m.total), 6) AS mode_share FROM g JOIN m USING (series_name) GROUP BY 1""", date=None)
def gap_report(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d).where(~F.col("day").between(F.lit("1996-02-01").cast("date"), F.lit("1996-03-01").cast("date"))).select("series_name", "day", F.when(F.col("value") > 140000, F.col("value")).alias("a"), F.col("value").alias("b"))
    return rounded(ev.gap_report(s, "series_name", ["a", "b"]))


@query(f"""WITH {BARS_SQL}, t AS (SELECT symbol, day, lead(close) {W} / close - 1 AS y, close / lag(close) {W} - 1 AS p FROM bars), d AS (SELECT *, (abs(y) >= 0.05)::INT AS e, 1 / (1 + exp(-greatest(least((abs(p) - 0.05) / 0.05, 40), -40))) AS s FROM t WHERE y IS NOT NULL AND p IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY s) + (count(*) OVER (PARTITION BY symbol, s) - 1) / 2 AS k FROM d), b AS (SELECT symbol, s, sum(e) AS t, count(*) AS c FROM d GROUP BY 1, 2), c AS (SELECT *, sum(t) OVER w / sum(c) OVER w AS pr FROM b WINDOW w AS (PARTITION BY symbol ORDER BY s DESC)),
a AS (SELECT symbol, sum(pr * t) AS ap FROM c GROUP BY 1), x AS (SELECT symbol, count(*) AS n, sum(e) AS ev, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, avg(CASE WHEN abs(y) >= 1e-9 THEN (sign(p) = sign(y))::INT END) AS dir, sum(k * e) AS ks, avg((s - e) * (s - e)) AS brier FROM r GROUP BY 1)
SELECT symbol, n, ev::BIGINT AS events, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(dir, 6) AS direction, round(CASE WHEN n >= 10 AND ev BETWEEN 1 AND n - 1 THEN (ks - ev * (ev + 1) / 2) / (ev * (n - ev)) END, 6) AS auc, round(CASE WHEN n >= 10 AND ev BETWEEN 1 AND n - 1 THEN ap / ev END, 6) AS average_precision, round(CASE WHEN n >= 10 AND ev BETWEEN 1 AND n - 1 THEN brier END, 6) AS brier FROM x JOIN a USING (symbol)""", date=None)
def event_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("close")
    df = bars(spark, d).select("symbol", "day", (O.lead(c) / c - 1).alias("y"), (c / O.lag(c) - 1).alias("p"))
    return rounded(ev.event_metrics(df, ["symbol"], "y", "p", 0.05))


@query(f"""WITH {BARS_SQL}, t AS (SELECT symbol, day, open / 100 AS t1, close / 100 AS t2, lag(open) {W} / 100 AS p1, lag(close) {W} / 100 AS p2, volume / 1000 AS conf FROM bars), e AS (SELECT *, (abs(p1 - t1) + abs(p2 - t2)) / 2 AS a, ((p1 - t1) * (p1 - t1) + (p2 - t2) * (p2 - t2)) / 2 AS s, (abs(p1 - lag(p1) {W}) + abs(p2 - lag(p2) {W})) / 2 AS m FROM t),
x AS (SELECT symbol, avg(a) AS mae, avg(s) AS mse, avg(m) AS smoothness, coalesce(-covar_pop(a, conf) / nullif(stddev_pop(a) * stddev_pop(CASE WHEN TRUE THEN conf END), 0), 0) AS u FROM e GROUP BY 1)
SELECT symbol, round(mae, 6) AS mae, round(mse, 6) AS mse, round(smoothness, 6) AS smoothness, round(u, 6) AS confidence_utility, round(mse + 0.2 * smoothness - 0.1 * u, 6) AS selection_score FROM x""", date=None)
def regression_block(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).select("symbol", "day", (F.col("open") / 100).alias("t1"), (F.col("close") / 100).alias("t2"), (F.col("volume") / 1000).alias("conf"))
    df = df.withColumns({"p1": O.lag(F.col("t1")), "p2": O.lag(F.col("t2"))})
    return rounded(ev.regression_block(df, "symbol", {"t1": "p1", "t2": "p2"}, "conf"))


@query(f"""WITH {BARS_SQL}, p AS (SELECT symbol, day, high / (high + low + close) AS a, low / (high + low + close) AS b, close / (high + low + close) AS c FROM bars), q AS (SELECT *, greatest(a, b, c) AS top, CASE WHEN a = greatest(a, b, c) THEN 0 WHEN b = greatest(a, b, c) THEN 1 ELSE 2 END AS dom FROM p),
t AS (SELECT *, (dom <> lag(dom) {W})::INT AS turn FROM q), x AS (SELECT symbol, count(*) AS n, avg(top) AS conf, coalesce(sum(turn), 0) AS turns, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM t GROUP BY 1)
SELECT symbol, n AS n_rows, round(exp(-(a * ln(greatest(a, 1e-12)) + b * ln(greatest(b, 1e-12)) + c * ln(greatest(c, 1e-12)))), 6) AS effective_regimes, round(conf, 6) AS confidence, round(greatest(a, b, c), 6) AS greatest_share, turns::BIGINT AS transitions, round(100 * turns / greatest(n - 1, 1), 6) AS transitions_per_100 FROM x""", date=None)
def regime_usage(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).select("symbol", "day", F.col("high").alias("a"), F.col("low").alias("b"), F.col("close").alias("c"))
    return rounded(ev.regime_usage(df, "symbol", ["a", "b", "c"]))


_SCORES = f"WITH {_PANEL}, s AS (SELECT forecaster, symbol, horizon, avg({_W1}) AS wis, avg({_PB}) AS avg_pinball FROM f WHERE y IS NOT NULL GROUP BY ALL)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return fc.summarise(_panel(spark, d), ["forecaster", "symbol", "horizon"]).select("forecaster", "symbol", "horizon", "wis", "avg_pinball")


@query(f"""{_SCORES}, k AS (SELECT forecaster, symbol || horizon AS fold, wis AS score FROM s), b AS (SELECT fold, arg_min(forecaster, (round(score, 12), forecaster)) AS best FROM k GROUP BY 1), x AS (SELECT forecaster, count(*) AS folds, avg(score) AS m, stddev_pop(score) AS sd, count(*) FILTER (WHERE forecaster = best) AS wins FROM k JOIN b USING (fold) GROUP BY 1)
SELECT forecaster, folds, round(m, 6) AS mean_score, round(sd, 6) AS spread, wins, round(m + 0.5 * sd, 6) AS total, row_number() OVER (ORDER BY m + 0.5 * sd, forecaster)::INTEGER AS place FROM x""", date=None)
def fold_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d).select("forecaster", F.concat("symbol", F.col("horizon").cast("string")).alias("fold"), F.col("wis").alias("score"))
    return rounded(ev.leaderboard(s))


@query(f"""{_SCORES} SELECT symbol, horizon, round(max(wis) FILTER (WHERE forecaster = 'expanding'), 6) AS model_wis, arg_min(forecaster, (round(wis, 12), avg_pinball, forecaster)) FILTER (WHERE forecaster <> 'window_365') AS best_forecaster, round(min(wis) FILTER (WHERE forecaster <> 'window_365'), 6) AS best_wis,
round(min(wis) FILTER (WHERE forecaster <> 'window_365') - max(wis) FILTER (WHERE forecaster = 'expanding'), 6) AS best_minus_model, round(max(wis) FILTER (WHERE forecaster = 'window_365'), 6) AS selected_wis, round(max(wis) FILTER (WHERE forecaster = 'window_365') - max(wis) FILTER (WHERE forecaster = 'expanding'), 6) AS selected_minus_model FROM s GROUP BY 1, 2""", date=None)
def selection_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.selection_table(_scores(spark, d), ["symbol", "horizon"], "expanding", "window_365"))


@query(f"""{_SCORES} SELECT symbol, horizon, arg_min(forecaster, (round(wis, 12), forecaster)) AS forecaster, round(min(wis), 6) AS wis, round(arg_min(avg_pinball, (round(wis, 12), forecaster)), 6) AS avg_pinball FROM s WHERE forecaster IN ('window_365', 'random_walk') GROUP BY 1, 2""", date=None)
def strongest_baseline(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.strongest(_scores(spark, d), ["symbol", "horizon"], ["window_365", "random_walk"]))


@query(f"""{_SCORES}, c AS (SELECT symbol, horizon, max(wis) FILTER (WHERE forecaster = 'expanding') AS d, min(wis) AS b, arg_min(forecaster, (round(wis, 12), forecaster)) AS best FROM s GROUP BY 1, 2)
SELECT symbol, horizon, round(d, 6) AS default_score, best AS best_method, round(b, 6) AS best_score, CASE WHEN best <> 'expanding' AND d - b > 0.0005 THEN best ELSE 'expanding' END AS deployed_method FROM c""", date=None)
def deployed_calibrator(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.deployed_calibrator(_scores(spark, d).withColumnsRenamed({"forecaster": "method", "wis": "score"}), ["symbol", "horizon"], "expanding", 0.0005))


@query(f"""WITH {_F}, a AS (SELECT symbol, horizon, avg({_W1}) AS wis, abs(avg((y BETWEEN q05 AND q95)::INT) - 0.9) AS gap, avg((y < q05)::INT) AS lo, avg((y > q95)::INT) AS hi, avg(q95 - q05) AS width, coalesce(covar_pop(q95 - q05, abs(y - q50)) / nullif(stddev_pop(q95 - q05) * stddev_pop(abs(y - q50)), 0), 0) AS u FROM f WHERE y IS NOT NULL GROUP BY 1, 2)
SELECT symbol, horizon, round(wis + gap + 0.5 * 0.5 * (abs(lo - 0.05) + abs(hi - 0.05)) + 0.15 * abs(width - 0.5) + 0.1 * greatest(-u, 0), 6) AS score FROM a""", date=None)
def deployment_scores(spark: SparkSession, d: str) -> DataFrame:
    r = fc.with_losses(ev.realised(_expanding(spark, d))).withColumn("size", F.abs(F.col("actual") - F.col("q50")))
    s = fc.summarise(r, ["symbol", "horizon"])
    u = r.groupBy("symbol", "horizon").agg(F.coalesce(F.covar_pop("width_90", "size") / F.nullif(F.stddev_pop("width_90") * F.stddev_pop("size"), F.lit(0.0)), F.lit(0.0)).alias("u"))
    j = s.join(u, ["symbol", "horizon"])
    return rounded(j.select("symbol", "horizon", ev.deployment_score(F.col("wis"), F.abs(F.col("coverage_90") - 0.9), F.col("q05_miss_rate"), F.col("q95_miss_rate"), F.abs(F.col("width_90") - 0.5), F.col("u")).alias("score")))


@query(f"""WITH {_F}, k AS (SELECT *, CASE horizon {' '.join(f"WHEN {h} THEN lag(y - q05, {h}) OVER p" for h in fc.HORIZONS)} END AS k05, CASE horizon {' '.join(f"WHEN {h} THEN lag(y - q25, {h}) OVER p" for h in fc.HORIZONS)} END AS k25 FROM f WINDOW p AS (PARTITION BY symbol, horizon ORDER BY day)),
s AS (SELECT *, CASE WHEN count(k05) OVER e >= 60 THEN quantile_cont(k05, 0.05) OVER e ELSE 0 END AS s05, CASE WHEN count(k25) OVER e >= 60 THEN quantile_cont(k25, 0.25) OVER e ELSE 0 END AS s25 FROM k WINDOW e AS (PARTITION BY symbol, horizon ORDER BY day ROWS UNBOUNDED PRECEDING)), a AS (SELECT *, least(q25 + s25, q50 - 1e-9) AS n25 FROM s)
SELECT symbol, horizon, day, round(least(q05 + s05, n25 - 1e-9), 6) AS q05, round(n25, 6) AS q25, round(q50, 6) AS q50 FROM a""")
def lower_tail_correction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.lower_tail_corrected(_expanding(spark, d)).select("symbol", "horizon", "day", "q05", "q25", "q50"))


_HIGH = f"CASE WHEN {roll('stddev_samp', 'r', 30, 20)} > {roll('quantile_cont({}, 0.5)', 'size', 365, 60, 1)} THEN 'high' ELSE 'low' END"


@query(f"""WITH {_F}, b0 AS (SELECT symbol, day, ln(close / lag(close) {W}) AS r, abs(ln(close / lag(close) {W})) AS size FROM bars), b1 AS (SELECT symbol, day, {_HIGH} AS regime FROM b0), g AS (SELECT f.*, regime FROM f JOIN b1 USING (symbol, day)),
k AS (SELECT *, row_number() OVER p AS n, {', '.join(f"CASE horizon {' '.join(f'WHEN {h} THEN lag({x}, {h}) OVER p' for h in fc.HORIZONS)} END AS {o}" for x, o in (('y - q05', 'k05'), ('y - q25', 'k25'), ('regime', 'start')))} FROM g WINDOW p AS (PARTITION BY symbol, horizon ORDER BY day)),
s AS (SELECT *, {', '.join(f"list({c}) FILTER (WHERE {c} IS NOT NULL AND start = '{v}') OVER e AS {c}_{v}, list({c}) FILTER (WHERE {c} IS NOT NULL) OVER e AS {c}_all" if v == 'high' else f"list({c}) FILTER (WHERE {c} IS NOT NULL AND start = '{v}') OVER e AS {c}_{v}" for c in ('k05', 'k25') for v in ('high', 'low'))} FROM k WINDOW e AS (PARTITION BY symbol, horizon ORDER BY day ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, {', '.join(f"CASE WHEN len(CASE regime WHEN 'high' THEN {c}_high ELSE {c}_low END) >= 60 THEN CASE regime WHEN 'high' THEN {c}_high ELSE {c}_low END ELSE {c}_all END AS {c}_held" for c in ('k05', 'k25'))} FROM s),
tq AS (SELECT *, CASE WHEN len(k05_held) >= 60 THEN list_aggregate(k05_held, 'quantile_cont', 0.05) ELSE 0 END AS s05, CASE WHEN len(k25_held) >= 60 THEN list_aggregate(k25_held, 'quantile_cont', 0.25) ELSE 0 END AS s25 FROM h), a AS (SELECT *, least(q25 + s25, q50 - 1e-9) AS n25 FROM tq)
SELECT symbol, horizon, day, regime, round(least(q05 + s05, n25 - 1e-9), 6) AS q05, round(n25, 6) AS q25, round(q50, 6) AS q50 FROM a""")
def lower_tail_by_regime(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("close")
    b = bars(spark, d).withColumn("r", F.ln(c / O.lag(c))).withColumn("size", F.abs("r"))
    regime = F.when(O.deviation(F.col("r"), 30, 20) > O.quantile(F.col("size"), 0.5, 365, 60, shift=1), "high").otherwise("low")
    rows = _expanding(spark, d).join(b.select("symbol", "day", regime.alias("regime")), ["symbol", "day"])
    return rounded(ev.lower_tail_corrected(rows, regime="regime").select("symbol", "horizon", "day", "regime", "q05", "q25", "q50"))


_AW, _BW, _SPAN = (365, 90), (180, 60), 21


def _extreme_sql(x: str, w: tuple[int, int]) -> str:
    past = f"list_filter(list({x}) {frame(w[0], 1)}, lambda v: v IS NOT NULL)"
    share = f"(len(list_filter({past}, lambda v: v <= {x})) / len({past}))"
    return f"CASE WHEN {x} IS NOT NULL AND len({past}) >= {w[1]} THEN greatest(least(CASE WHEN {share} >= 0.75 THEN ({share} - 0.75) * 4 WHEN {share} <= 0.25 THEN ({share} - 0.25) * 4 ELSE 0 END, 1), -1) END"


def _quartile_sql(x: str, w: tuple[int, int]) -> str:
    q = lambda p: roll(f"quantile_cont({{}}, {p})", x, *w, 1)
    return f"({x} - {q(0.5)}) / nullif({q(0.75)} - {q(0.25)}, 0)"


def _kept(x: str, low: float, high: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, {high}), {low}) END"


@query(f"""WITH RECURSIVE {BARS_SQL}, i0 AS (SELECT symbol, day, CASE WHEN trades % 7 > 0 THEN close / {roll('avg', 'close', 60, 20)} - 1 END AS a0, CASE WHEN trades % 3 = 0 THEN ln(close / lag(close) {W}) WHEN trades % 3 = 1 THEN 0 END AS b0 FROM bars),
i1 AS (SELECT symbol, day, row_number() {W} AS n, last_value(a0 IGNORE NULLS) {frame(None)} AS a, last_value(b0 IGNORE NULLS) {frame(None)} AS b FROM i0), i2 AS (SELECT *, CASE WHEN a IS NOT NULL THEN abs(b) END AS size FROM i1),
i3 AS (SELECT *, coalesce(size > 1e-9, FALSE) AS event, {_extreme_sql('a', _AW)} AS ea, {_kept(_quartile_sql('a', _AW), -4, 4)} AS za, {_extreme_sql('size', _BW)} AS es, {_kept(_quartile_sql('size', _BW), 0, 4)} AS zs FROM i2),
i4 AS (SELECT *, CASE WHEN ea IS NULL AND za IS NULL THEN tanh(a) ELSE (coalesce(0.7 * ea, 0) + coalesce(0.3 * tanh(za / 2), 0)) / (CASE WHEN ea IS NULL THEN 0 ELSE 0.7 END + CASE WHEN za IS NULL THEN 0 ELSE 0.3 END) END AS position, CASE WHEN NOT event THEN 0 WHEN es IS NOT NULL THEN greatest(es, 0) END AS far FROM i3),
i5 AS (SELECT *, CASE WHEN NOT event THEN 0 WHEN far IS NULL AND zs IS NULL THEN tanh(size / 0.05) ELSE (coalesce(0.65 * far, 0) + coalesce(0.35 * tanh(zs / 2), 0)) / (CASE WHEN far IS NULL THEN 0 ELSE 0.65 END + CASE WHEN zs IS NULL THEN 0 ELSE 0.35 END) END::DOUBLE AS raw FROM i4),
{_recursion('g', 'i5', [f'r.gate + 2.0 / {_SPAN + 1} * (o.raw - r.gate) AS gate'], ['o.raw AS gate'])}, i6 AS (SELECT i5.*, CASE WHEN i5.n >= {_SPAN // 4} THEN gate END AS gate FROM i5 JOIN g USING (symbol, n)), i7 AS (SELECT *, position * gate AS product FROM i6), i8 AS (SELECT *, count(product) {frame(None)} AS seen FROM i7),
{_recursion('h', 'i8', [_ema('product', 'score', max(_SPAN // 3, 5))], ['o.product AS score'])}
SELECT i8.symbol, i8.day, round(position, 5) AS average_position, round(gate, 5) AS attention_gate, round(CASE WHEN seen >= 3 THEN score END, 5) AS attention_score, round(far, 5) AS boost_extreme, (a IS NOT NULL)::INT::DOUBLE AS average_available, event::INT::DOUBLE AS boost_event FROM i8 JOIN h USING (symbol, n)""".replace("SELECT i8.symbol, i8.day,", "SELECT symbol, i8.day,"))
def signal_attention(spark: SparkSession, d: str) -> DataFrame:
    c, t = F.col("close"), F.col("trades") % 3
    df = bars(spark, d).select("symbol", "day", F.when(F.col("trades") % 7 > 0, c / O.mean(c, 60, 20) - 1).alias("a"), F.when(t == 0, F.ln(c / O.lag(c))).when(t == 1, 0.0).alias("b"))
    return rounded(at.attention(df, "a", "b", _AW, _BW, _SPAN), 5)


@query(f"""WITH {MARKET_SQL}, r AS (SELECT symbol, day, close, row_number() OVER (ORDER BY day) AS n, CASE WHEN close > {roll('avg', 'close', 60)} THEN 'high_vol' WHEN close <= {roll('avg', 'close', 60)} THEN 'low_vol' ELSE 'unknown_vol' END AS regime FROM bars),
t AS (SELECT *, ln(close / lag(close, 7) {W}) AS past, lag(regime, 7) {W} AS start FROM r), j AS (SELECT a.day, a.n, a.regime, list(b.past) AS every, list(b.past) FILTER (WHERE b.start = a.regime) AS same FROM t a JOIN t b ON b.n <= a.n AND b.past IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT day, CASE WHEN regime <> 'unknown_vol' AND len(every) >= 180 AND coalesce(len(same), 0) >= 60 THEN regime ELSE 'all' END AS reference, every, same FROM j), u AS (SELECT day, reference, CASE WHEN reference = 'all' THEN every ELSE same END AS held FROM k)
SELECT r.day, coalesce(reference, 'all') AS reference, coalesce(len(held), 0) AS n, {', '.join(f"CASE WHEN len(held) >= 60 THEN round(list_aggregate(held, 'quantile_cont', {q}), 6) END AS {x}" for x, q in zip(fc.NAMES, fc.LEVELS, strict=True))} FROM r LEFT JOIN u USING (day)""")
def conditional_reference(spark: SparkSession, d: str) -> DataFrame:
    b = market_bars(spark, d)
    m = O.mean(F.col("close"), 60)
    b = b.withColumn("regime", F.when(F.col("close") > m, "high_vol").when(F.col("close") <= m, "low_vol").otherwise("unknown_vol"))
    t = fc.forward_targets(b, (7,)).join(b.select("symbol", "day", "regime"), ["symbol", "day"])
    return rounded(ev.conditional_reference(t).drop("symbol", "horizon"))


@query(f"""WITH {_F}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon ORDER BY day) / count(*) OVER (PARTITION BY symbol, horizon) AS part FROM f), s AS (SELECT symbol, horizon, {', '.join(f'quantile_cont(y - {n}, {q}) AS s_{n}' for n, q in zip(fc.NAMES, fc.LEVELS, strict=True))} FROM k WHERE part <= 0.65 AND y IS NOT NULL GROUP BY 1, 2),
r AS (SELECT symbol, unnest([{{'h': 1, 'g': 1}}, {{'h': 1, 'g': 2}}, {{'h': 7, 'g': 10}}, {{'h': 15, 'g': 30}}]) AS u, horizon, day, {_NAMES} FROM k WHERE part > 0.65), v AS (SELECT symbol, u.g AS horizon, day, {_NAMES} FROM r WHERE horizon = u.h),
j AS (SELECT v.symbol, v.horizon, v.day, {', '.join(f'any_value(v.{n}) AS {n}' for n in fc.NAMES)}, max(s.horizon) FILTER (WHERE s.horizon <= v.horizon) AS lo, min(s.horizon) FILTER (WHERE s.horizon >= v.horizon) AS hi, {', '.join(f'arg_max(s_{n}, s.horizon) FILTER (WHERE s.horizon <= v.horizon) AS a_{n}, arg_min(s_{n}, s.horizon) FILTER (WHERE s.horizon >= v.horizon) AS b_{n}' for n in fc.NAMES)} FROM v JOIN s USING (symbol) GROUP BY v.symbol, v.horizon, v.day),
x AS (SELECT symbol, horizon, day, list_sort([{', '.join(f'{n} + coalesce(a_{n} + (b_{n} - a_{n}) * (horizon - lo) / nullif(hi - lo, 0), a_{n}, b_{n})' for n in fc.NAMES)}]) AS q FROM j) SELECT symbol, horizon, day, {', '.join(f'round(q[{i}], 6) AS {n}' for i, n in enumerate(fc.NAMES, 1))} FROM x""")
def horizon_calibrated(spark: SparkSession, d: str) -> DataFrame:
    """Shifts fitted at horizons 1, 3, 7 and 15 are applied at 1, 2, 10 and 30."""
    k = fc.Window.partitionBy("symbol", "horizon")
    f = _expanding(spark, d).withColumn("_f", F.row_number().over(k.orderBy("day")) / F.count(F.lit(1)).over(k))
    later = f.where(F.col("_f") > 0.65)
    h = F.col("horizon")
    to = F.explode(F.when(h == 1, F.array(F.lit(1), F.lit(2))).when(h == 7, F.array(F.lit(10))).when(h == 15, F.array(F.lit(30))))
    return rounded(ev.horizon_calibrated(f.where(F.col("_f") <= 0.65), later.select("symbol", "day", to.alias("horizon"), *fc.NAMES)))


@query(f"""WITH {_F}, c AS (SELECT symbol, day, avg(greatest(least(ln(greatest(q75 - q50, 1e-6) / greatest(q50 - q25, 1e-6)), 5), -5)) AS raw FROM f GROUP BY 1, 2), o AS (SELECT c.*, b.close, row_number() OVER (PARTITION BY c.symbol ORDER BY c.day) AS n FROM c JOIN bars b ON b.symbol = c.symbol AND b.day = c.day),
e AS (SELECT symbol, day, n, raw, close, raw AS edge FROM o WHERE n = 1 UNION ALL SELECT o.symbol, o.day, o.n, o.raw, o.close, e.edge + (o.raw - e.edge) * 2.0 / 31 FROM e JOIN o ON o.symbol = e.symbol AND o.n = e.n + 1)
SELECT symbol, day, round(raw, 6) AS raw, round(edge, 6) AS edge, round((edge - {roll('avg', 'edge', 180, 45)}) / nullif({roll('stddev_samp', 'edge', 180, 45)}, 0), 5) AS edge_z, round(ln(lead(close, 30) {W} / close), 6) AS forward_30, round(ln(lead(close, 60) {W} / close), 6) AS forward_60 FROM e""".replace("WITH bars", "WITH RECURSIVE bars"))
def inner_asymmetry(spark: SparkSession, d: str) -> DataFrame:
    df = ev.inner_asymmetry(_expanding(spark, d)).drop("close")
    return df.select("symbol", "day", *[F.round(F.col(c) + 10.0 ** -(k + 3), k).alias(c) for c, k in (("raw", 6), ("edge", 6), ("edge_z", 5), ("forward_30", 6), ("forward_60", 6))])


@query(f"""WITH {BARS_SQL}, t AS (SELECT symbol, day, volume AS signal, ln(lead(close, 30) {W} / close) AS y FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY signal, day) AS r, count(*) OVER (PARTITION BY symbol) AS n, rank() OVER (PARTITION BY symbol ORDER BY signal) + (count(*) OVER (PARTITION BY symbol, signal) - 1) / 2 AS a, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2 AS b FROM t WHERE y IS NOT NULL),
q AS (SELECT *, greatest(ceil((r - 1) * 5 / (n - 1)) - 1, 0) AS q FROM k) SELECT symbol, count(*) AS observations, round(corr(a, b), 6) AS spearman, round(avg(y) FILTER (WHERE q = 4), 6) AS top, round(avg(y) FILTER (WHERE q = 0), 6) AS bottom, round(avg(y) FILTER (WHERE q = 4) - avg(y) FILTER (WHERE q = 0), 6) AS spread, round(avg((y > 0)::INT) FILTER (WHERE q = 4), 6) AS top_hit, round(avg((y > 0)::INT) FILTER (WHERE q = 0), 6) AS bottom_hit FROM q GROUP BY 1""", date=None)
def quintile_spread(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("close")
    return rounded(ev.quintile_spread(bars(spark, d).select("symbol", "day", F.col("volume").alias("signal"), F.ln(O.lead(c, 30) / c).alias("y")), "signal", "y"))


@query(f"""WITH {_F}, g AS (SELECT *, quantile_cont(q95, 0.9) OVER p AS hi, quantile_cont(q05, 0.1) OVER p AS lo, count(*) OVER p AS n FROM f WHERE y IS NOT NULL WINDOW p AS (PARTITION BY symbol, horizon)), s AS (SELECT symbol, horizon, 'top_decile_long' AS signal, exp(y) - 1 - 0.003 AS net, y FROM g WHERE n >= 50 AND q95 >= hi UNION ALL SELECT symbol, horizon, 'bottom_decile_short', 1 - exp(y) - 0.003, y FROM g WHERE n >= 50 AND q05 <= lo)
SELECT symbol, horizon, signal, count(*) AS observations, round(avg(net), 6) AS mean_net_return, round(avg((net > 0)::INT), 6) AS hit_rate, round(avg(y), 6) AS mean_actual FROM s GROUP BY 1, 2, 3""", date=None)
def tail_signals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.tail_signals(_expanding(spark, d), ["symbol", "horizon"]))


@query(f"""WITH {_F} SELECT symbol, horizon, count(*) FILTER (WHERE NOT (q05 <= q25 AND q25 <= q50 AND q50 <= q75 AND q75 <= q95) OR q95 - q05 > 1.5 OR greatest(abs(q05), abs(q25), abs(q50), abs(q75), abs(q95)) > 1.25) AS bad, count(*) AS n FROM (SELECT symbol, horizon, {', '.join(f'{n} * (1 + horizon / 10) AS {n}' for n in fc.NAMES)} FROM f) GROUP BY 1, 2""", date=None)
def pathological_quantiles(spark: SparkSession, d: str) -> DataFrame:
    wide = _expanding(spark, d).withColumns({n: F.col(n) * (1 + F.col("horizon") / 10) for n in fc.NAMES})
    return wide.groupBy("symbol", "horizon").agg(F.count_if(ev.pathological()).alias("bad"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BARS_SQL}, p AS (SELECT symbol, quantile_cont(close, [0.25, 0.5, 0.75]) AS c, quantile_cont(volume, [0.25, 0.5, 0.75]) AS v FROM bars WHERE day < DATE '1999-01-01' GROUP BY 1) SELECT symbol, day, round((close - c[2]) / coalesce(nullif(c[3] - c[1], 0), 1), 6) AS close, round((volume - v[2]) / coalesce(nullif(v[3] - v[1], 0), 1), 6) AS volume FROM bars JOIN p USING (symbol)""")
def robust_scaler(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).select("symbol", "day", "close", "volume")
    return rounded(ev.robust_scaled(b.where(F.col("day") < F.lit("1999-01-01").cast("date")), b, ["close", "volume"]))


@query(f"""WITH {BARS_SQL} SELECT symbol, day, round((volume - {roll('avg', 'volume', 90, 20)}) / nullif({roll('stddev_samp', 'volume', 90, 20)}, 0), 6) AS z_90, round((volume - {roll('avg', 'volume', 180, 45)}) / nullif({roll('stddev_samp', 'volume', 180, 45)}, 0), 6) AS z_180,
round(CASE WHEN count(close) {frame(60)} >= 5 AND min(close) {frame(60)} < max(close) {frame(60)} AND min(volume) {frame(60)} < max(volume) {frame(60)} THEN corr(close, volume) {frame(60)} END, 6) AS corr_60 FROM bars""")
def rolling_scores(spark: SparkSession, d: str) -> DataFrame:
    v, w = F.col("volume"), O.spec.rowsBetween(-59, 0)
    z = lambda n, k: (v - O.mean(v, n, k)) / F.nullif(O.deviation(v, n, k), F.lit(0.0))
    ok = (F.count("close").over(w) >= 5) & (F.min("close").over(w) < F.max("close").over(w)) & (F.min("volume").over(w) < F.max("volume").over(w))
    spread = F.stddev_pop("close").over(w) * F.stddev_pop("volume").over(w)
    return rounded(bars(spark, d).select("symbol", "day", z(90, 20).alias("z_90"), z(180, 45).alias("z_180"), F.when(ok, F.covar_pop("close", "volume").over(w) / F.nullif(spread, F.lit(0.0))).alias("corr_60")))


@query(f"""WITH {_PANEL}, dd AS (SELECT symbol, day, min(close) OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 30 DAY FOLLOWING) / close - 1 AS drawdown FROM bars),
m AS (SELECT forecaster, symbol, horizon, day, (q05 > y)::INT::DOUBLE AS miss, lag((q05 > y)::INT::DOUBLE) OVER w AS before, drawdown FROM f LEFT JOIN dd USING (symbol, day) WHERE y IS NOT NULL AND q05 IS NOT NULL WINDOW w AS (PARTITION BY forecaster, symbol, horizon ORDER BY day)),
c AS (SELECT *, sum((miss = 1 AND coalesce(before, 0) = 0)::INT) OVER (PARTITION BY forecaster, symbol, horizon ORDER BY day ROWS UNBOUNDED PRECEDING) AS cluster FROM m),
s AS (SELECT forecaster, symbol, horizon, count(*) AS clusters, max(size) AS longest FROM (SELECT forecaster, symbol, horizon, cluster, count(*) AS size FROM c WHERE miss = 1 GROUP BY ALL) GROUP BY ALL),
g AS (SELECT forecaster, symbol, horizon, count(*) AS observations, avg(miss) AS miss_rate, CASE WHEN count(before) >= 5 AND stddev_pop(miss) FILTER (WHERE before IS NOT NULL) > 0 AND stddev_pop(before) > 0 THEN corr(miss, before) END AS autocorrelation, avg(drawdown) FILTER (WHERE miss = 1) AS drawdown_after_miss, avg(drawdown) FILTER (WHERE miss = 0) AS drawdown_without FROM m GROUP BY ALL)
SELECT forecaster, symbol, horizon, observations, round(miss_rate, 6) AS miss_rate, round(autocorrelation, 5) AS autocorrelation, round(drawdown_after_miss, 6) AS drawdown_after_miss, round(drawdown_without, 6) AS drawdown_without, coalesce(clusters, 0) AS clusters, coalesce(longest, 0) AS longest FROM g LEFT JOIN s USING (forecaster, symbol, horizon) WHERE observations >= 20""", date=None)
def miss_clusters(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    made = ev.miss_clusters(_panel(spark, d), b.select("symbol", "day", lv.forward_drawdown(b).alias("drawdown")))
    return rounded(made.withColumn("autocorrelation", F.round(F.col("autocorrelation") + 1e-8, 5)))
