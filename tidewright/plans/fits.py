"""Queries of fitted models: unit roots, volatility cones, fair value, isotonic calibration; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import codebook as cb
from tidewright.operators import fairvalue as fv
from tidewright.operators import forecasts as fc
from tidewright.operators import isotonic as iso
from tidewright.operators import ridge as rg
from tidewright.operators import unitroots as ur
from tidewright.operators import volatility as vol
from tidewright.plans.market import BARS_SQL, bars, series
from tidewright.plans.registry import _TARGETS, O, W, _cone_sql, _recursion, frame, query, roll, rounded
from tidewright.sources import tables as src


@query()
def unit_root_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Lag searches and break searches; tests/test_fits.py has the plain version of every window."""
    return rounded(ur.unit_root_statistics(bars(spark, d)), 5)


def _dot(x: str, k: str, n: int) -> str:
    return f"list_dot_product({x}[1 + {k}:], {x}[:{n} - {k}])"


_KP, _PP = 40, 100
_FEW = int(_KP ** (2 / 9))
_LAGS = ur.most_lags(_PP)
_S0 = f"(list_dot_product(r, r) / {_KP} + " + " + ".join(f"{_dot('r', str(k), _KP)} / {_KP / 2}" for k in range(1, _FEW + 1)) + ")"
_S1 = "(" + " + ".join(f"{k} * {_dot('r', str(k), _KP)} / {_KP / 2}" for k in range(1, _FEW + 1)) + ")"


@query(f"""WITH {BARS_SQL}, w AS (SELECT symbol, day, row_number() {W} AS n, list(close) {frame(_KP)} AS a, list(close) {frame(_PP)} AS b FROM bars),
k0 AS (SELECT symbol, day, list_transform(a, lambda x: x - list_avg(a)) AS r FROM w WHERE n >= {_KP}), k1 AS (SELECT *, least(CAST(floor(1.1447 * pow(pow({_S1} / {_S0}, 2), 1.0 / 3) * pow({_KP}, 1.0 / 3)) AS BIGINT), {_KP - 1}) AS lags FROM k0),
k AS (SELECT symbol, day, list_sum(list_transform(range(1, {_KP + 1}), lambda i: pow(list_sum(r[:i]), 2))) / {_KP**2} / ((list_dot_product(r, r) + coalesce(list_sum(list_transform(range(1, lags + 1), lambda i: 2 * (1 - i / (lags + 1)) * {_dot('r', 'i', _KP)})), 0)) / {_KP}) AS kpss FROM k1),
p0 AS (SELECT symbol, day, b[2:] AS y, list_transform(b[:{_PP - 1}], lambda x: x - list_avg(b[:{_PP - 1}])) AS z FROM w WHERE n > {_PP}),
p1 AS (SELECT *, list_dot_product(z, z) AS sz, list_dot_product(z, y) / list_dot_product(z, z) AS rho FROM p0), p2 AS (SELECT *, list_transform(list_zip(y, z), lambda t: t[1] - list_avg(y) - rho * t[2]) AS u FROM p1),
p3 AS (SELECT *, list_dot_product(u, u) AS uu, (list_dot_product(u, u) + list_sum(list_transform(range(1, {_LAGS + 1}), lambda i: 2 * (1 - i / {_LAGS + 1}) * {_dot('u', 'i', _PP - 1)}))) / {_PP - 1} AS lam FROM p2),
p AS (SELECT symbol, day, sqrt(uu / {_PP - 1} / lam) * (rho - 1) / sqrt(uu / {_PP - 3} / sz) - 0.5 * (lam - uu / {_PP - 1}) / sqrt(lam) * ({_PP - 1} / sqrt(sz)) AS pp FROM p3)
SELECT w.symbol, w.day, round(kpss, 5) AS kpss, round(pp, 5) AS phillips_perron FROM w LEFT JOIN k USING (symbol, day) LEFT JOIN p USING (symbol, day)""")
def stationarity_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ur.stationarity_statistics(bars(spark, d), _KP, _PP), 5)


@query()
def volatility_cones(spark: SparkSession, d: str) -> DataFrame:
    """Likelihood fits; tests/test_fits.py checks them against plain recursions and the schedule."""
    return rounded(vol.volatility_cones(bars(spark, d), every=90))


@query()
def fair_value_bands(spark: SparkSession, d: str) -> DataFrame:
    """A likelihood fit; tests/test_fits.py checks the filter, its slopes and the pipeline."""
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium"}
    wide = src.pivot_last(series(spark, d), "day", list(names), ["source", "series_name"]).toDF("day", *names.values())
    logs = wide.select("day", *[F.ln(c).alias(c) for c in names.values()])
    df = bars(spark, d).select("symbol", "day", F.col("close").alias("price")).join(logs, "day", "left")
    df = df.select("symbol", "day", "price", *[O.last_known(F.col(c)).alias(c) for c in names.values()])
    return rounded(fv.fair_values(df, fv.FairValue(tuple(names.values()), apart=("medium",))), 4)


_STEP = 0.001
_GRID = f"g AS (SELECT symbol, day, horizon, y, {', '.join(f'round({n} / {_STEP} + 1e-9, 0) * {_STEP} AS {n}' for n in fc.NAMES)} FROM f)"


@query(f"""WITH {_TARGETS}, f AS ({_cone_sql(None)}), {_GRID}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon ORDER BY day) / count(*) OVER (PARTITION BY symbol, horizon) AS part FROM g),
l AS (SELECT symbol, horizon, y, name, x FROM (SELECT * FROM k WHERE part <= 0.65 AND y IS NOT NULL) UNPIVOT (x FOR name IN ({', '.join(fc.NAMES)}))),
b AS MATERIALIZED (SELECT symbol, horizon, name, x, sum(y) AS s, count(*) AS n, median(y) AS med, row_number() OVER (PARTITION BY symbol, horizon, name ORDER BY x) AS i FROM l GROUP BY symbol, horizon, name, x),
c AS (SELECT *, sum(s) OVER q AS cs, sum(n) OVER q AS cn FROM b WINDOW q AS (PARTITION BY symbol, horizon, name ORDER BY i)),
m AS (SELECT a.symbol, a.horizon, a.name, a.i AS j, e.i AS k, (e.cs - a.cs + a.s) / (e.cn - a.cn + a.n) AS mean FROM c a JOIN c e ON a.symbol = e.symbol AND a.horizon = e.horizon AND a.name = e.name AND e.i >= a.i),
lo AS (SELECT *, min(mean) OVER (PARTITION BY symbol, horizon, name, j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM m),
v AS (SELECT symbol, horizon, name, k AS i, max(low) AS y FROM lo GROUP BY ALL),
h AS (SELECT symbol, horizon, name, CASE WHEN sum(n) < 8 THEN [0.0, 1.0] ELSE list(x ORDER BY i) END AS xs, CASE WHEN sum(n) < 8 THEN [0.0, 1.0] WHEN count(*) < 2 THEN [max(med)] ELSE list(y ORDER BY i) END AS ys FROM b JOIN v USING (symbol, horizon, name, i) GROUP BY ALL),
r AS (SELECT symbol, horizon, day, y, name, x FROM (SELECT symbol, horizon, day, y, {', '.join(fc.NAMES)} FROM k WHERE part > 0.65) UNPIVOT (x FOR name IN ({', '.join(fc.NAMES)}))),
u AS (SELECT r.*, xs, ys, len(list_filter(xs, lambda z: z <= x)) AS place FROM r LEFT JOIN h USING (symbol, horizon, name)),
o AS (SELECT symbol, horizon, day, any_value(y) AS y, list_sort(list(CASE WHEN xs IS NULL THEN x WHEN place = 0 THEN ys[1] WHEN place = len(xs) THEN ys[place] ELSE ys[place] + (ys[place + 1] - ys[place]) * (x - xs[place]) / (xs[place + 1] - xs[place]) END)) AS q FROM u GROUP BY ALL)
SELECT symbol, horizon, day, round(y, 6) AS actual, {', '.join(f'round(q[{i}], 6) AS {n}' for i, n in enumerate(fc.NAMES, 1))} FROM o""")
def isotonic_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts are quoted in steps of 0.001, so that equal ones form blocks."""
    cone = fc.cone(fc.forward_targets(bars(spark, d)))
    quoted = fc.with_losses(cone).withColumns({n: F.rint(F.col(n) / _STEP + 1e-9) * _STEP for n in fc.NAMES})
    return rounded(iso.isotonic_calibrated(quoted, actual="actual"))


_FEATURES = ["r1", "r7", "range_share", "volume_share", "trend"]
_CUT = "1999-01-01"
_INPUTS = f"""i0 AS (SELECT symbol, day, ln(close / lag(close) {W}) AS r1, ln(close / lag(close, 7) {W}) AS r7, (high - low) / close AS range_share, volume / {roll('avg', 'volume', 30, 10)} - 1 AS volume_share, ln(close) - {roll('avg', 'ln(close)', 30, 10)} AS trend FROM bars)"""


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("close")
    return bars(spark, d).select(
        "symbol", "day", F.ln(c / O.lag(c)).alias("r1"), F.ln(c / O.lag(c, 7)).alias("r7"), ((F.col("high") - F.col("low")) / c).alias("range_share"),
        (F.col("volume") / O.mean(F.col("volume"), 30, 10) - 1).alias("volume_share"), (F.ln(c) - O.mean(F.ln(c), 30, 10)).alias("trend"), F.ln(O.lead(c, 3) / c).alias("target"),
    )


@query(date=None)
def feature_selection(spark: SparkSession, d: str) -> DataFrame:
    """Ridge fits by matrices; tests/test_fits.py has the plain fits."""
    return rounded(rg.select_features(_inputs(spark, d), _FEATURES, "target", 3), 5)


_STATES, _STARTS, _ROUNDS, _TEMPERATURE, _ALPHA = 3, 3, 8, 0.35, 0.25
_CODED = ["r1", "volume_share", "trend"]


def _codebook_sql() -> str:
    """The same starts and rounds written out, one table a round."""
    d = lambda a, b: "(" + " + ".join(f"pow({a}.{f} - {b}.{f}, 2)" for f in _CODED) + f") / {len(_CODED)}"
    steps = [
        f"known AS MATERIALIZED (SELECT symbol, day, {', '.join(_CODED)} FROM i0 WHERE day < DATE '{_CUT}' AND {' AND '.join(f'{f} IS NOT NULL' for f in _CODED)})",
        f"starts AS (SELECT unnest(range({_STARTS})) AS s)",
        f"book0 AS MATERIALIZED (SELECT s, row_number() OVER (PARTITION BY s ORDER BY h) - 1 AS c, {', '.join(_CODED)} FROM (SELECT s, k.*, md5('7-' || s || '-' || symbol || '-' || CAST(day AS VARCHAR)) AS h FROM known k, starts QUALIFY row_number() OVER (PARTITION BY s ORDER BY h) <= {_STATES}))",
    ]
    for k in range(_ROUNDS):
        steps.append(f"near{k} AS (SELECT k.symbol, k.day, b.s, arg_min(b.c, ({d('k', 'b')}, b.c)) AS c FROM known k, book{k} b GROUP BY k.symbol, k.day, b.s)")
        steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.s, b.c, {', '.join(f'coalesce(m.{f}, b.{f}) AS {f}' for f in _CODED)} FROM book{k} b LEFT JOIN (SELECT s, c, {', '.join(f'avg(k.{f}) AS {f}' for f in _CODED)} FROM near{k} JOIN known k USING (symbol, day) GROUP BY s, c) m USING (s, c))")
    last = f"book{_ROUNDS}"
    steps.append(f"least AS MATERIALIZED (SELECT k.symbol, k.day, b.s, min({d('k', 'b')}) AS v FROM known k, {last} b GROUP BY k.symbol, k.day, b.s)")
    steps.append("best AS (SELECT arg_min(s, (i, s)) AS s FROM (SELECT s, sum(v) AS i FROM least GROUP BY s))")
    steps.append("scale AS (SELECT greatest(quantile_cont(v, 0.5), 1e-6) AS m, greatest(quantile_cont(v, 0.95), 1e-6) AS p FROM least JOIN best USING (s) WHERE v > 1e-10)")
    steps.append(f"centres AS MATERIALIZED (SELECT b.* FROM {last} b JOIN best USING (s))")
    steps.append(f"far AS (SELECT k.symbol, k.day, c.c, {d('k', 'c')} AS v FROM (SELECT * FROM i0 WHERE {' AND '.join(f'{f} IS NOT NULL' for f in _CODED)}) k, centres c)")
    steps.append(f"part AS (SELECT symbol, day, c, v, exp(greatest(-(v - min(v) OVER w) / (m * {_TEMPERATURE}), -60)) AS e, min(v) OVER w / p AS novelty FROM far, scale WINDOW w AS (PARTITION BY symbol, day))")
    steps.append(f"share AS MATERIALIZED (SELECT symbol, day, any_value(novelty) AS novelty, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n, {', '.join(f'sum(e) FILTER (WHERE c = {i}) / sum(e) AS regime_{i}' for i in range(_STATES))} FROM part GROUP BY symbol, day)")
    steps.append(_recursion("smooth", "share", [f"{1 - _ALPHA} * r.smooth_{i} + {_ALPHA} * o.regime_{i} AS smooth_{i}" for i in range(_STATES)], [f"o.regime_{i} AS smooth_{i}" for i in range(_STATES)]))
    shown = [f"round({n}, 5) AS {n}" for n in [*(f"regime_{i}" for i in range(_STATES)), *(f"smooth_{i}" for i in range(_STATES)), "novelty"]]
    return f"WITH RECURSIVE {BARS_SQL}, {_INPUTS}, {', '.join(steps)} SELECT i0.symbol, i0.day, {', '.join(shown)} FROM i0 LEFT JOIN (SELECT symbol, day, n, novelty, {', '.join(f'regime_{i}' for i in range(_STATES))} FROM share) s USING (symbol, day) LEFT JOIN (SELECT symbol, day, {', '.join(f'smooth_{i}' for i in range(_STATES))} FROM smooth) t USING (symbol, day)"


@query(_codebook_sql())
def regime_codebook(spark: SparkSession, d: str) -> DataFrame:
    df = _inputs(spark, d).select("symbol", "day", *_CODED)
    book = cb.fit_codebook(df.where(F.col("day") < F.lit(_CUT).cast("date")), _CODED, ["symbol", "day"], _STATES, _STARTS, _ROUNDS, temperature=_TEMPERATURE)
    return rounded(cb.regime_shares(df, book, _ALPHA).drop(*_CODED, "regime"), 5)
