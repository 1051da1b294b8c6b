"""Queries of the indicators that look back as far as their own cycle, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.operators import cycles as cy
from tidewright.plans.market import BARS_SQL, bars
from tidewright.plans.registry import W, _ema, _recursion, query, rounded

_I, _J, _K, _L = cy.HILBERT


def _back(x: str, n: int) -> str:
    return f"coalesce(lag({x}, {n}) {W}, 0)" if n else x


def _second(x: str) -> str:
    """The transform without its newest tap."""
    return f"({_J} * {_back(x, 2)} + {_K} * {_back(x, 4)} + {_L} * {_back(x, 6)})"


_A, _B = "(0.2 * o.re_in + 0.8 * r.a)", "(0.2 * o.im_in + 0.8 * r.b)"
_RE, _IM = f"(0.2 * ({_A} * r.a + {_B} * r.b) + 0.8 * r.re)", f"(0.2 * ({_A} * r.b - {_B} * r.a) + 0.8 * r.im)"
_FOUND = f"CASE WHEN {_RE} <> 0 AND {_IM} <> 0 THEN 2 * pi() / atan({_IM} / {_RE}) ELSE r.period END"
_PERIOD = f"least(greatest(least(greatest({_FOUND}, 0.67 * r.period), 1.5 * r.period), 6), 50)"
_STEP = [f"CASE WHEN o.n > 6 THEN {x} ELSE 0 END AS {y}" for x, y in ((_A, "a"), (_B, "b"), (_RE, "re"), (_IM, "im"), (_PERIOD, "period"), (f"0.2 * {_PERIOD} + 0.8 * r.length", "length"))]


@query(f"""WITH RECURSIVE {BARS_SQL}, s0 AS (SELECT symbol, day, close, row_number() {W} AS n, coalesce((4 * close + 3 * lag(close) {W} + 2 * lag(close, 2) {W} + lag(close, 3) {W}) / 10, 0) AS x FROM bars),
s1 AS (SELECT *, CASE WHEN n > 6 THEN {_I} * x + {_J} * {_back('x', 2)} + {_K} * {_back('x', 4)} + {_L} * {_back('x', 6)} ELSE 0 END AS i, CASE WHEN n > 6 THEN {_I} * (x - {_back('x', 6)}) + {_J} * ({_back('x', 2)} - {_back('x', 4)}) ELSE 0 END AS q FROM s0),
s2 AS (SELECT *, i - {_second('q')} AS re_in, q + {_second('i')} AS im_in FROM s1),
{_recursion('c0', 's2', [*_STEP, _ema('close', 'fast', 10), _ema('close', 'slow', 20)], [*(f'0.0::DOUBLE AS {x}' for x in ('a', 'b', 're', 'im', 'period', 'length')), 'o.close AS fast', 'o.close AS slow'])},
c1 AS (SELECT c0.*, close, round_even(length, 0)::BIGINT AS cycle, sum(coalesce(move, 0)) OVER (PARTITION BY c0.symbol ORDER BY c0.n ROWS UNBOUNDED PRECEDING) AS squares FROM c0 JOIN (SELECT symbol, n, close, pow(close - lag(close) {W}, 2) AS move FROM s0) m USING (symbol, n)),
c2 AS (SELECT c1.*, pow(c1.close - p.close, 2) / nullif((c1.squares - p.squares) / c1.cycle, 0) AS share FROM c1 LEFT JOIN c1 p ON p.symbol = c1.symbol AND p.n = c1.n - c1.cycle AND c1.cycle > 0),
c3 AS (SELECT *, CASE WHEN share > 0 THEN 10 * log10(share) ELSE 0 END AS snr, CASE WHEN fast > slow AND close > slow THEN 1 WHEN fast < slow AND close < slow THEN -1 ELSE 0 END AS side FROM c2)
SELECT symbol, day, cycle, round(snr, 5) AS snr, CASE WHEN snr > 6 THEN side ELSE 0 END::INTEGER AS regime, round(CASE WHEN snr > 6 THEN side ELSE 0 END * least((greatest(snr, 6) - 6) / 6, 2) * least(abs(fast - slow) / abs(close) / 0.01, 2), 5) AS strength FROM c3""")
def cycle_regime(spark: SparkSession, d: str) -> DataFrame:
    df = cy.cycle_regime(bars(spark, d))
    return rounded(df.withColumns({"cycle": df["cycle"].cast("long"), "regime": df["regime"].cast("int")}), 5)


_ALPHA = 0.07
_D = f"(o.drive + {2 * (1 - _ALPHA)!r} * r.c1 - {(1 - _ALPHA) ** 2!r} * r.c2)"
_Q = f"(({_I} * {_D} + {_J} * r.c2 + {_K} * r.c4 + {_L} * r.c6) * (0.5 + 0.08 * r.period))"
_DP = f"least(greatest(CASE WHEN {_Q} <> 0 AND r.q <> 0 THEN coalesce((r.c3 / {_Q} - r.i / r.q) / nullif(1 + r.c3 * r.i / ({_Q} * r.q), 0), 0) ELSE 0 END, 0.1), 1.1)"


def _middle(*x: str) -> str:
    return f"list_sort([{', '.join(x)}])[2]"


_MD = "m.md"
_SHIFT = ["d AS c1", *(f"c{k} AS c{k + 1}" for k in range(1, 6))]
_W0, _W1, _W2, _W3 = cy.super_smoother()


@query(f"""WITH RECURSIVE {BARS_SQL}, p0 AS (SELECT symbol, day, row_number() {W} AS n, (high + low) / 2 AS price FROM bars), p1 AS (SELECT *, (price + 2 * {_back('price', 1)} + 2 * {_back('price', 2)} + {_back('price', 3)}) / 6 AS s FROM p0),
p2 AS (SELECT *, {(1 - _ALPHA / 2) ** 2!r} * (s - 2 * {_back('s', 1)} + {_back('s', 2)}) AS drive FROM p1),
z AS (SELECT symbol, 0::BIGINT AS n, CAST(NULL AS DATE) AS day, {', '.join(f'0.0::DOUBLE AS {x}' for x in ('c1', 'c2', 'c3', 'c4', 'c5', 'c6', 'q', 'i', 'e1', 'e2', 'e3', 'e4', 'period', 'length'))} FROM (SELECT DISTINCT symbol FROM p2)),
g AS (SELECT * FROM z UNION ALL SELECT symbol, n, day, {', '.join(_SHIFT)}, q, i, dp AS e1, e1 AS e2, e2 AS e3, e3 AS e4, period, 0.15 * period + 0.85 * length AS length FROM (
 SELECT * EXCLUDE (md, before) REPLACE (0.33 * CASE WHEN md = 0 THEN 15 ELSE 2 * pi() / md + 0.5 END + 0.67 * before AS period) FROM (
  SELECT *, {_middle('dp', 'e1', _middle('e2', 'e3', 'e4'))} AS md, period AS before FROM (
   SELECT o.symbol, o.n, o.day, {_D} AS d, r.c1, r.c2, r.c3, r.c4, r.c5, {_Q} AS q, r.c3 AS i, {_DP} AS dp, r.e1, r.e2, r.e3, r.e4, r.period, r.length FROM g r JOIN p2 o ON o.symbol = r.symbol AND o.n = r.n + 1)))),
v AS (SELECT g.symbol, g.day, g.n, least(75, round_even(abs(g.length - 1), 0))::BIGINT AS lag FROM g WHERE g.n > 0),
u AS (SELECT v.symbol, v.day, v.n, v.lag, coalesce(a.price - b.price, 0) AS moved FROM v JOIN p0 a ON a.symbol = v.symbol AND a.n = v.n LEFT JOIN p0 b ON b.symbol = v.symbol AND b.n = v.n - v.lag),
{_recursion('f', 'u', ['o.lag', f'{_W0!r} * o.moved + {_W1!r} * r.x1 + {_W2!r} * r.x2 + {_W3!r} * r.x3 AS x1', 'r.x1 AS x2', 'r.x2 AS x3'], ['o.lag', f'{_W0!r} * o.moved AS x1', '0.0::DOUBLE AS x2', '0.0::DOUBLE AS x3'])}
SELECT symbol, day, lag, round(x1, 5) AS momentum FROM f""")
def adaptive_momentum(spark: SparkSession, d: str) -> DataFrame:
    df = cy.adaptive_momentum(bars(spark, d))
    return rounded(df.withColumn("lag", df["lag"].cast("long")), 5)
