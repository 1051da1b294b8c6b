"""Queries of ensembles, projections, calibrators, folds and bins, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import forecasts as fc
from tidewright.operators import synthesis as sy
from tidewright.plans.market import BARS_SQL, bars, table
from tidewright.plans.registry import _TARGETS, O, W, _cone_sql, _out, frame, query, roll, rounded

_F = f"{_TARGETS}, f AS ({_cone_sql(None)})"
_CAPS = (0.22, 0.5, 0.6)


def _deal() -> str:
    """Eight rounds that cut weights to their caps and deal out the rest by the room that is left."""
    out, before = [], "w0"
    for i in range(1, 9):
        e = "list_sum(list_transform(range(1, 4), lambda k: greatest(v[k] - c[k], 0)))"
        s = "list_sum(list_transform(range(1, 4), lambda k: greatest(c[k] - v[k], 0)))"
        out.append(f"e{i} AS (SELECT *, {e} AS ex, {s} AS sp FROM {before}), w{i} AS (SELECT * EXCLUDE (ex, sp) REPLACE (CASE WHEN done OR ex <= 0 THEN v WHEN sp > 0 THEN list_transform(range(1, 4), lambda k: least(v[k], c[k]) + ex * greatest(c[k] - v[k], 0) / sp) ELSE list_transform(range(1, 4), lambda k: least(v[k], c[k])) END AS v, done OR ex <= 0 OR sp <= 0 AS done) FROM e{i})")
        before = f"w{i}"
    return ", ".join(out)


@query(f"""WITH {BARS_SQL}, b AS (SELECT symbol, day, CASE WHEN trades % 3 > 0 THEN ln(open) END AS a, CASE WHEN trades % 5 > 0 THEN ln(high) END AS b, CASE WHEN trades % 7 > 0 THEN ln(low) END AS c0 FROM bars), n AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c0 IS NOT NULL)::INT AS n, list_median([a, b, c0]) AS med FROM b),
q AS (SELECT *, [CASE WHEN a IS NOT NULL THEN {_CAPS[0]} ELSE 0 END, CASE WHEN b IS NOT NULL THEN {_CAPS[1]} ELSE 0 END, CASE WHEN c0 IS NOT NULL THEN {_CAPS[2]} ELSE 0 END] AS caps FROM n), w0 AS (SELECT *, [CASE WHEN a IS NOT NULL THEN 1.0 / n ELSE 0 END, CASE WHEN b IS NOT NULL THEN 1.0 / n ELSE 0 END, CASE WHEN c0 IS NOT NULL THEN 1.0 / n ELSE 0 END] AS v, CASE WHEN list_sum(caps) < 1 THEN list_transform(caps, lambda x: x / greatest(list_sum(caps), 1e-12)) ELSE caps END AS c, FALSE AS done FROM q),
{_deal()}, z AS (SELECT *, CASE WHEN n = 1 THEN [(a IS NOT NULL)::INT, (b IS NOT NULL)::INT, (c0 IS NOT NULL)::INT] ELSE list_transform(v, lambda x: x / greatest(list_sum(v), 1e-12)) END AS w FROM w8),
e AS (SELECT *, CASE WHEN n > 0 THEN coalesce(least(greatest(a, med - 0.05), med + 0.05) * w[1] + a * 0, 0) + coalesce(least(greatest(b, med - 0.05), med + 0.05) * w[2] + b * 0, 0) + coalesce(least(greatest(c0, med - 0.05), med + 0.05) * w[3] + c0 * 0, 0) END AS ens FROM z)
SELECT symbol, day, n::INTEGER AS source_count, round(CASE WHEN n > 1 THEN 0.75 * ens + 0.25 * med ELSE ens END, 6) AS level, round(w[1], 6) AS weight_a, round(w[2], 6) AS weight_b, round(w[3], 6) AS weight_c FROM e""")
def level_ensemble(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("trades")
    df = bars(spark, d).select("symbol", "day", F.when(t % 3 > 0, F.ln("open")).alias("a"), F.when(t % 5 > 0, F.ln("high")).alias("b"), F.when(t % 7 > 0, F.ln("low")).alias("c"))
    return rounded(sy.level_ensemble(df, ["a", "b", "c"], _CAPS, 0.05).drop("a", "b", "c"))


@query(f"""WITH {BARS_SQL}, b AS (SELECT symbol, day, close, 7 AS horizon, (volume - 300) / 1e6 AS drift, ln(close) - ln({roll('avg', 'close', 60, 1)}) AS gap, CASE WHEN trades % 4 > 0 THEN volume / 10 END AS scope, (fmod(close, 100) - 50) / 80 AS pressure, CASE WHEN trades % 3 > 0 THEN (fmod(open, 60) - 30) / 100 END AS macro, CASE WHEN trades % 3 > 1 THEN (fmod(high, 40) - 20) / 100 END AS onchain FROM bars),
s AS (SELECT *, least(greatest(coalesce(scope, horizon), 7), 240) AS scope_days, greatest(least(coalesce(pressure, 0), 0.45), -0.45) AS p, coalesce(macro, 0) + coalesce(onchain, 0) AS pm FROM b), x AS (SELECT *, CASE WHEN abs(pm) > 1e-12 THEN p / pm ELSE 1 END AS k FROM s),
y AS (SELECT *, 0.6 * coalesce(drift, 0) * scope_days AS drift_part, -0.8 * (1 - pow(0.97, scope_days)) * coalesce(gap, 0) AS reversion_part, coalesce(macro, 0) * k AS macro_part, coalesce(onchain, 0) * k AS onchain_part FROM x), z AS (SELECT *, drift_part + reversion_part + macro_part + onchain_part AS pr FROM y)
SELECT symbol, day, (day + CAST(round_even(scope_days, 0) AS INTEGER))::DATE::VARCHAR AS target_day, round(scope_days, 6) AS scope_days, round(drift_part, 6) AS drift_part, round(reversion_part, 6) AS reversion_part, round(macro_part, 6) AS macro_part, round(onchain_part, 6) AS onchain_part, round(pr, 6) AS projected_return, round(CASE WHEN abs(pr) <= 2 THEN close * exp(pr) END, 4) AS projected_price FROM z""")
def projection_overlay(spark: SparkSession, d: str) -> DataFrame:
    t, c = F.col("trades"), F.col("close")
    df = bars(spark, d).select("symbol", "day", "close", F.lit(7).alias("horizon"), ((F.col("volume") - 300) / 1e6).alias("drift"), (F.ln(c) - F.ln(O.mean(c, 60, 1))).alias("gap"), F.when(t % 4 > 0, F.col("volume") / 10).alias("scope"), ((c % 100 - 50) / 80).alias("pressure"), F.when(t % 3 > 0, (F.col("open") % 60 - 30) / 100).alias("macro"), F.when(t % 3 > 1, (F.col("high") % 40 - 20) / 100).alias("onchain"))
    df = sy.projection_overlay(df, 0.97, 0.6, 0.8)
    names = ("scope_days", "drift_part", "reversion_part", "macro_part", "onchain_part", "projected_return")
    return df.select("symbol", "day", "target_day", *[F.round(F.col(x) + 1e-9, 6).alias(x) for x in names], F.round(F.col("projected_price") + 1e-7, 4).alias("projected_price"))


def _disagreement_sql(shifts: list[str]) -> str:
    return f"""WITH {_F}, k AS (SELECT *, q95 - q05 AS score, row_number() OVER (PARTITION BY symbol, horizon ORDER BY day) / count(*) OVER (PARTITION BY symbol, horizon) AS part FROM f), cuts AS (SELECT symbol, horizon, quantile_cont(score, 0.5) AS cut FROM k WHERE part <= 0.65 GROUP BY 1, 2), g AS (SELECT k.*, score > cut AS high FROM k JOIN cuts USING (symbol, horizon)),
s AS (SELECT symbol, horizon, high, {', '.join(f'{x} AS s_{n}' for x, n in zip(shifts, fc.NAMES, strict=True))} FROM g WHERE part <= 0.65 AND y IS NOT NULL GROUP BY 1, 2, 3), z AS (SELECT g.symbol, g.horizon, day, list_sort([{', '.join(f'{n} + coalesce(s_{n}, 0)' for n in fc.NAMES)}]) AS q FROM g LEFT JOIN s USING (symbol, horizon, high) WHERE part > 0.65)
SELECT symbol, horizon, day, {', '.join(f'round(q[{i}], 6) AS {n}' for i, n in enumerate(fc.NAMES, 1))} FROM z"""


_EXTRA = "quantile_cont(greatest(q05 - y, y - q95, 0), 0.9)"


@query(_disagreement_sql([f"-{_EXTRA}", f"-0.5 * {_EXTRA}", "quantile_cont(y - q50, 0.5)", f"0.5 * {_EXTRA}", _EXTRA]))
def disagreement_width(spark: SparkSession, d: str) -> DataFrame:
    losses = fc.with_losses(fc.cone(fc.forward_targets(bars(spark, d))))
    return rounded(sy.disagreement_calibrated(losses, "width_90", "disagreement_width"))


@query(_disagreement_sql([_out("q05", 0.9, -1), _out("q25", 0.5, -1), "quantile_cont(y - q50, 0.5)", _out("q75", 0.5, 1), _out("q95", 0.9, 1)]))
def disagreement_conformal(spark: SparkSession, d: str) -> DataFrame:
    losses = fc.with_losses(fc.cone(fc.forward_targets(bars(spark, d))))
    return rounded(sy.disagreement_calibrated(losses, "width_90", "disagreement_conformal"))


@query(f"""WITH {BARS_SQL}, r AS (SELECT symbol, day, row_number() {W} AS r, count(*) OVER (PARTITION BY symbol) AS n FROM bars), e AS (SELECT *, n - b * 180 AS stop FROM r, (SELECT unnest(range(0, 4)) AS b)), p AS (SELECT *, CASE WHEN r <= stop - 365 THEN 'train' WHEN r <= stop THEN 'test' END AS p FROM e WHERE stop - 365 >= 700),
g AS (SELECT symbol, b, min(day) FILTER (WHERE p = 'train')::VARCHAR AS train_start, max(day) FILTER (WHERE p = 'train')::VARCHAR AS train_end, min(day) FILTER (WHERE p = 'test')::VARCHAR AS test_start, max(day) FILTER (WHERE p = 'test')::VARCHAR AS test_end, count(*) FILTER (WHERE p = 'train') AS train_rows FROM p GROUP BY 1, 2)
SELECT symbol, (row_number() OVER (PARTITION BY symbol ORDER BY b DESC) - 1)::INTEGER AS fold, train_start, train_end, test_start, test_end, train_rows FROM g""", date=None)
def outer_folds(spark: SparkSession, d: str) -> DataFrame:
    return sy.fold_rows(bars(spark, d), 365, 180, 4, 700)


@query(f"""WITH {BARS_SQL}, r AS (SELECT symbol, day, row_number() {W} AS r, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, CASE WHEN r <= 600 THEN 'validation' WHEN r > n - 300 THEN 'calibration' ELSE 'embargo' END AS segment, count(*) AS n, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day FROM r WHERE n - 900 >= 30 GROUP BY 1, 2""", date=None)
def selection_segments(spark: SparkSession, d: str) -> DataFrame:
    return sy.selection_segments(bars(spark, d), 600, 300, 30).groupBy("symbol", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


_BINS = sy.horizon_bins((1, 3, 7, 15), 5)


def _ahead(x: list[int]) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN {x[0]} FOLLOWING AND {x[-1]} FOLLOWING)"


@query(f"WITH {BARS_SQL} SELECT symbol, day, " + ", ".join(f"round(CASE WHEN count(close) {_ahead(x)} = {len(x)} THEN avg(close) {_ahead(x)} END, 6) AS bin_{h}" for h, x in _BINS.items()) + " FROM bars")
def horizon_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sy.bin_means(bars(spark, d), "close", _BINS))


_STATE = {**{f"return_{k}": f"x - lag(x, {k}) {W}" for k in (1, 3, 7, 15)}, "vol_7": roll("stddev_samp", "r", 7, 3), "vol_30": roll("stddev_samp", "r", 30, 10), "trend_7": f"x - {roll('avg', 'x', 7, 3)}", "trend_30": f"x - {roll('avg', 'x', 30, 10)}"}


@query(f"""WITH {BARS_SQL}, a AS (SELECT symbol, day, ln(close) AS x, ln(close) - lag(ln(close)) {W} AS r FROM bars), f AS (SELECT symbol, day, {', '.join(f'{e} AS {n}' for n, e in _STATE.items())} FROM a), q AS (SELECT symbol, {', '.join(f'quantile_cont({n}, [0.25, 0.5, 0.75]) AS q_{n}' for n in _STATE)} FROM f WHERE day <= DATE '1999-06-30' GROUP BY 1)
SELECT symbol, day, {', '.join(f'round(CASE WHEN {n} IS NULL THEN 0 ELSE greatest(least(({n} - q_{n}[2]) / coalesce(nullif(q_{n}[3] - q_{n}[1], 0), 1), 10), -10) END, 5) AS {n}' for n in _STATE)} FROM f JOIN q USING (symbol)""")
def market_state(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sy.market_state(bars(spark, d), "1999-06-30"), 5)


@query(f"""WITH {BARS_SQL}, b AS (SELECT symbol, day, volume AS f1, close AS f2, lead(close, 7) {W} / close - 1 AS y, day < DATE '1999-01-01' AS t FROM bars), u AS (SELECT symbol, feature, x, y, t FROM (SELECT symbol, 'f1' AS feature, f1 AS x, y, t FROM b UNION ALL SELECT symbol, 'f2', f2, y, t FROM b) WHERE x IS NOT NULL AND y IS NOT NULL),
m AS (SELECT symbol, feature, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) / nullif(var_pop(x) * (count(*) + 1.0), 0) AS slope FROM u WHERE t GROUP BY 1, 2)
SELECT symbol, feature, count(*) AS n, round(any_value(slope), 9) AS slope, round(avg(pow(y - my - coalesce(slope, 0) * (x - mx), 2)) / nullif(avg(pow(y - my, 2)), 0), 6) AS relative_mse FROM u JOIN m USING (symbol, feature) WHERE NOT t GROUP BY 1, 2""", date=None)
def single_utility(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("close")
    df = bars(spark, d).select("symbol", "day", F.col("volume").alias("f1"), c.alias("f2"), (O.lead(c, 7) / c - 1).alias("y"))
    u = sy.single_utility(df, ["f1", "f2"], "y", F.col("day") < F.lit("1999-01-01").cast("date"))
    return u.select("symbol", "feature", "n", F.round(F.col("slope") + 1e-12, 9).alias("slope"), F.round(F.col("relative_mse") + 1e-9, 6).alias("relative_mse"))


_CENTRES = ((0.5, 1.0), (1.5, 1.2), (2.5, 0.4))


@query(f"""WITH {BARS_SQL}, b AS (SELECT symbol, day, close / 1000 AS x, volume / 400 AS y FROM bars), d AS (SELECT *, {', '.join(f'sqrt(pow(x - {a}, 2) + pow(y - {b}, 2)) AS d{i}' for i, (a, b) in enumerate(_CENTRES))} FROM b), e AS (SELECT *, least(d0, d1, d2) AS m FROM d)
SELECT symbol, day, {', '.join(f'round(exp(-(d{i} - m) / 0.7) / (exp(-(d0 - m) / 0.7) + exp(-(d1 - m) / 0.7) + exp(-(d2 - m) / 0.7)), 6) AS regime_{i}' for i in range(3))}, round(m, 6) AS novelty FROM e""")
def soft_codes(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).select("symbol", "day", (F.col("close") / 1000).alias("x"), (F.col("volume") / 400).alias("y"))
    return rounded(sy.soft_codes(df, ["x", "y"], _CENTRES, 0.7).drop("x", "y"))


@query(f"""WITH {BARS_SQL}, w AS (SELECT symbol, day, list([close, volume]) {frame(20)} AS w FROM bars) SELECT symbol, day, len(w) AS n, round(w[1][1], 6) AS first_close, round(list_sum(list_transform(w, lambda x: x[1])), 4) AS close_sum, round(list_sum(list_transform(w, lambda x: x[2])), 4) AS volume_sum FROM w WHERE len(w) = 20""")
def sequence_windows(spark: SparkSession, d: str) -> DataFrame:
    s = sy.sequences(bars(spark, d), ["close", "volume"], 20)
    add = lambda i: F.aggregate("window", F.lit(0.0), lambda a, x: a + x[i])
    return s.select("symbol", "day", F.size("window").cast("long").alias("n"), F.round(F.col("window")[0][0] + 1e-9, 6).alias("first_close"), F.round(add(0) + 1e-7, 4).alias("close_sum"), F.round(add(1) + 1e-7, 4).alias("volume_sum"))


@query("""WITH e AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS position, value FROM events WHERE event_id % 3 > 0) SELECT a.event_type, a.position, round(a.value, 6) AS value, round(b.value, 6) AS value_next FROM e a JOIN e b ON a.event_type = b.event_type AND b.position = a.position + 1""", date=None)
def adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = fc.Window.partitionBy("event_type").orderBy("event_id")
    e = table(spark, d, "events").where(F.col("event_id") % 3 > 0).select("event_type", F.row_number().over(w).cast("long").alias("position"), "value")
    return rounded(sy.adjacent(e, "event_type", "position", ["value"]))
