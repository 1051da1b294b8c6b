"""Queries of states, routing, windows ahead and small table operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import forecasts as fc
from tidewright.operators import relational as rel
from tidewright.operators import states as st
from tidewright.plans.market import BARS_SQL, bars, table
from tidewright.plans.registry import _PANEL, _TARGETS, _W1, O, W, _cone_sql, _ema, _panel, _recursion, frame, query, roll, rounded

_MED = "quantile_cont({}, 0.5)"


def _robust_sql(name: str, source: str, exprs: dict[str, str], window: int, least: int) -> str:
    """Common tables that end in `name`: source with the median z of each expression."""
    x = ", ".join(f"{e} AS x_{n}" for n, e in exprs.items())
    m = ", ".join(f"{roll(_MED, f'x_{n}', window, least)} AS m_{n}" for n in exprs)
    o = ", ".join(f"abs(x_{n} - m_{n}) AS o_{n}" for n in exprs)
    z = ", ".join(f"coalesce((x_{n} - m_{n}) / nullif(1.4826 * {roll(_MED, f'o_{n}', window, least)}, 0), 0) AS {n}" for n in exprs)
    drop = ", ".join(f"{k}_{n}" for n in exprs for k in "xmo")
    return f"{name}_x AS (SELECT *, {x} FROM {source}), {name}_m AS (SELECT *, {m} FROM {name}_x), {name}_o AS (SELECT *, {o} FROM {name}_m), {name} AS (SELECT * EXCLUDE ({drop}), {z} FROM {name}_o)"


def _sd(names: list[str]) -> str:
    return f"coalesce(list_stddev_samp([{', '.join(names)}]), 0)"


def _avg(names: list[str]) -> str:
    return f"({' + '.join(names)}) / {len(names)}"


_G, _C, _FR = ["g_a1", "g_a2"], ["c_volume", "c_trades"], ["f_open", "f_low"]


@query(f"""WITH {BARS_SQL}, b AS (SELECT symbol, day, close, volume, trades::DOUBLE AS trades, open, low, {roll('avg', 'close', 60)} AS a1, CASE WHEN trades % 6 > 0 THEN high ELSE 0 END AS a2, pow(2, -(trades % 10) / 10) AS freshness, (trades % 4) / 10 AS missing FROM bars),
{_robust_sql('g', 'b', {'g_a1': 'ln(close) - ln(nullif(a1, 0))', 'g_a2': 'ln(close) - ln(nullif(a2, 0))'}, 252, 63)}, {_robust_sql('c', 'g', {'c_volume': 'volume', 'c_trades': 'trades'}, 180, 45)}, {_robust_sql('f', 'c', {'f_open': 'open', 'f_low': 'low'}, 120, 30)},
s AS (SELECT *, {_avg(_G)} AS gap, {_avg(_FR)} AS weak, {_avg(_C)} AS held, 1 / (1 + {_sd(_G)}) AS coherence FROM f), t AS (SELECT *, 1 / (1 + exp(-greatest(least((held - 0.25 * weak) / 1.2, 40), -40))) AS conviction, 1 / (1 + exp(-greatest(least(weak / 1.2, 40), -40))) AS fragility FROM s)
SELECT symbol, day, round(greatest(tanh(gap / 1.2), 0), 5) AS overvaluation, round(greatest(tanh(-gap / 1.2), 0), 5) AS undervaluation, round(conviction, 5) AS conviction, round(fragility, 5) AS fragility, round(tanh((-gap + 0.35 * (conviction - fragility)) / 1.1), 5) AS reversion,
round(greatest(least(0.7 * (0.45 / (1 + {_sd(_G + _C + _FR)}) + 0.35 * freshness + 0.2 * (1 - missing)) + 0.3 * greatest(least(coherence, 1), 0), 1), 0), 5) AS confidence FROM t""")
def structure_targets(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    df = b.select("symbol", "day", "close", "volume", F.col("trades").cast("double").alias("trades"), "open", "low", O.mean(F.col("close"), 60).alias("a1"), F.when(F.col("trades") % 6 > 0, F.col("high")).otherwise(0.0).alias("a2"), F.pow(F.lit(2.0), -(F.col("trades") % 10) / 10).alias("freshness"), ((F.col("trades") % 4) / 10).alias("missing"))
    return rounded(st.structure_targets(df, ["a1", "a2"], ["volume", "trades"], ["open", "low"]), 5)


_SCALED = f"{BARS_SQL}, sc AS (SELECT symbol, day, row_number() {W} AS n, tanh(close / 1000 - 1.5) AS a, tanh(open / 1000 - 1.5) AS b, tanh(high / 1500 - 1.5) AS c, tanh(low / 800 - 1) AS d, (trades % 7) / 7 AS ca, (trades % 5) / 5 AS cb, pow(2, -(trades % 10) / 10) AS freshness, (trades % 4) / 10 AS missing FROM bars)"


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("trades")
    return bars(spark, d).select("symbol", "day", F.tanh(F.col("close") / 1000 - 1.5).alias("a"), F.tanh(F.col("open") / 1000 - 1.5).alias("b"), F.tanh(F.col("high") / 1500 - 1.5).alias("c"), F.tanh(F.col("low") / 800 - 1).alias("d"), (t % 7 / 7).alias("ca"), (t % 5 / 5).alias("cb"), F.pow(F.lit(2.0), -(t % 10) / 10).alias("freshness"), ((t % 4) / 10).alias("missing"))


@query(f"""WITH RECURSIVE {_SCALED}, t AS (SELECT *, (abs(a) + abs(b)) / 2 AS fast_amplitude, {_sd(['a', 'b'])} AS fast_dispersion, (abs(c) + abs(d)) / 2 AS slow_amplitude, {_sd(['c', 'd'])} AS slow_dispersion, (a + c) / 2 AS summary_direction, (ca + cb) / 2 AS summary_confidence, {_sd(['a', 'c'])} AS disagreement, abs(a) / greatest(abs(a) + abs(c), 1e-8) AS p, abs(c) / greatest(abs(a) + abs(c), 1e-8) AS q FROM sc),
u AS (SELECT *, (fast_amplitude + slow_amplitude) / 2 AS summary_amplitude, (fast_dispersion + slow_dispersion) / 2 AS summary_dispersion, greatest(least(-(p * ln(greatest(p, 1e-8)) + q * ln(greatest(q, 1e-8))) / ln(2), 1), 0) AS entropy, abs(summary_direction - lag(summary_direction) {W}) AS step FROM t),
{_recursion('v1', 'u', [_ema('step', 'velocity', 5)], ['o.step AS velocity'])}, w AS (SELECT u.*, coalesce(velocity, 0) AS velocity FROM u JOIN v1 USING (symbol, day)), x AS (SELECT * EXCLUDE step, abs(velocity - lag(velocity) {W}) AS step FROM w), {_recursion('v2', 'x', [_ema('step', 'acceleration', 5)], ['o.step AS acceleration'])}
SELECT symbol, day, {', '.join(f'round({c}, 6) AS {c}' for c in ('fast_amplitude', 'fast_dispersion', 'slow_amplitude', 'slow_dispersion', 'summary_direction', 'summary_amplitude', 'summary_confidence', 'summary_dispersion', 'disagreement', 'entropy', 'velocity'))}, round(coalesce(acceleration, 0), 6) AS acceleration,
round(1 / (1 + exp(-(2.2 * velocity + 1.4 * disagreement + 0.8 * entropy + 1 - ca))), 6) AS hazard, round(greatest(least(ca * least(freshness, 1) * (1 - missing), 1), 0), 6) AS validity FROM x JOIN v2 USING (symbol, day)""")
def multiscale_states(spark: SparkSession, d: str) -> DataFrame:
    df = st.multiscale(_scaled(spark, d), {"fast": ["a", "b"], "slow": ["c", "d"]}, {"fast": "ca", "slow": "cb"})
    return rounded(df.drop("a", "b", "c", "d", "ca", "cb", "freshness", "missing"))


@query(f"""WITH RECURSIVE {_SCALED}, u AS (SELECT *, coalesce(abs((a - b) - lag(a - b) {W}), 0) AS step FROM sc), {_recursion('v1', 'u', [_ema('step', 'v', 5)], ['o.step AS v'])}
SELECT symbol, day, round(1 / (1 + exp(-(2 * v + 0.75 * {_sd(['a', 'b', 'c', 'd'])} + 1 - ca))), 6) AS hazard, round(greatest(least(ca * freshness * (1 - missing), 1), 0), 6) AS validity FROM u JOIN v1 USING (symbol, day)""")
def meta_channels(spark: SparkSession, d: str) -> DataFrame:
    df = st.meta_channels(_scaled(spark, d), F.col("a") - F.col("b"), "ca", ["a", "b", "c", "d"])
    return rounded(df.select("symbol", "day", "hazard", "validity"))


@query(f"""WITH {_SCALED}, u AS (SELECT symbol, day, a, c, a - lag(a) {W} AS delta_a, c - lag(c) {W} AS delta_c FROM sc) SELECT symbol, day, """ + ", ".join(f"round(coalesce({x}, 0), 6) AS {x}, round(coalesce({roll('avg', x, 7, 3)}, 0), 6) AS roll7_mean_{x}, round(coalesce({roll('stddev_samp', x, 7, 3)}, 0), 6) AS roll7_std_{x}" for x in ("a", "c", "delta_a", "delta_c")) + " FROM u")
def variant_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.variant_features(_scaled(spark, d), ["a", "c"]))


@query(f"""WITH {BARS_SQL}, b AS (SELECT symbol, day, row_number() {W} AS n, CASE WHEN trades % 4 > 0 THEN floor(volume / 100) END AS x FROM bars), c AS (SELECT *, lag(x) {W} AS p FROM b), k AS (SELECT *, CASE WHEN n = 1 OR (x IS NULL) <> (p IS NULL) OR coalesce(abs(x - p) > 1e-12 + 1e-5 * abs(p), FALSE) THEN n END AS changed, CASE WHEN x IS NOT NULL THEN n END AS seen FROM c),
a AS (SELECT *, ln(1 + least(n - coalesce(last_value(seen IGNORE NULLS) {frame(None)}, 0), 365)) / ln(366) AS old, ln(1 + least(n - last_value(changed IGNORE NULLS) {frame(None)}, 365)) / ln(366) AS ch FROM k)
SELECT symbol, day, x, (x IS NOT NULL)::INT::DOUBLE AS x_observed, round(old, 6) AS x_observation_age, round(ch, 6) AS x_change_age, round(CASE WHEN x IS NOT NULL THEN 1 - old ELSE 0 END, 6) AS x_validity, x - p AS x_velocity FROM a""")
def observation_channels(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).select("symbol", "day", F.when(F.col("trades") % 4 > 0, F.floor(F.col("volume") / 100).cast("double")).alias("x"))
    return rounded(st.observation_channels(df, ["x"]))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, (vec_id % 7) - 3 AS gap, (vec_id % 5) - 2 AS pressure, (vec_id % 9) AS flare FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm, tanh(v[1]) AS lead, list_avg(list_transform(v, lambda x: abs(x))) AS size FROM e),
d AS (SELECT *, coalesce(abs(norm - lag(norm) OVER (PARTITION BY label ORDER BY vec_id)), 0) AS delta FROM n)
SELECT label, vec_id, round(norm, 5) AS norm, round(delta, 5) AS delta_norm, round(lead * sign(pressure), 5) AS alignment, round(greatest(least(-tanh(gap / 2) * (1 + 0.25 * abs(lead)), 1.5), -1.5), 5) AS reversion_pressure, round(least(tanh(size) * (1 + least(flare, 5) / 5), 2), 5) AS tail_pressure, round(least(delta + least(flare, 5) / 5, 3), 5) AS uncertainty FROM d""", date=None)
def embedding_fields(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding", (v % 7 - 3).cast("double").alias("gap"), (v % 5 - 2).cast("double").alias("pressure"), (v % 9).cast("double").alias("flare"))
    return rounded(st.embedding_fields(e, "embedding", "vec_id", "label"), 5)


@query(f"""WITH {BARS_SQL}, h AS (SELECT symbol, day, unnest([{', '.join(f"{{'h': {h}, 't': CASE WHEN count(close) {frame(None).replace('UNBOUNDED PRECEDING AND CURRENT ROW', f'{a} FOLLOWING AND {b} FOLLOWING')} = {b - a + 1} THEN avg(close) {frame(None).replace('UNBOUNDED PRECEDING AND CURRENT ROW', f'{a} FOLLOWING AND {b} FOLLOWING')} END, 'a': lead(day, {a}) {W}, 'b': lead(day, {b}) {W}}}" for h, (a, b) in st.TARGET_OFFSETS.items())}]) AS u FROM bars)
SELECT symbol, day, u.h AS horizon, round(u.t, 6) AS target, u.a::VARCHAR AS first_day, u.b::VARCHAR AS last_day FROM h WHERE u.t IS NOT NULL""")
def target_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.target_windows(bars(spark, d), "close"))


@query("""WITH l AS (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'), c AS (SELECT *, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS code FROM l)
SELECT o_orderpriority, CASE WHEN o.o_orderstatus <> 'P' THEN o.o_orderstatus END AS o_orderstatus, coalesce(code, 0)::INTEGER AS code, count(*) AS n FROM orders o LEFT JOIN c USING (o_orderpriority, o_orderstatus) GROUP BY ALL""", date=None)
def label_codes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"))
    return st.label_codes(o, "o_orderpriority", "o_orderstatus").groupBy("o_orderpriority", "o_orderstatus", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_TARGETS}, f AS ({_cone_sql(None)}), a AS (SELECT symbol, day, max(q50) FILTER (WHERE horizon = 1) AS a, max(q50) FILTER (WHERE horizon = 3) AS b, max(q50) FILTER (WHERE horizon = 7) AS c, max(q50) FILTER (WHERE horizon = 15) AS d FROM f GROUP BY 1, 2)
SELECT symbol, day, round(a, 6) AS h05, round(0.5 * a + 0.5 * b, 6) AS h2, round(0.5 * b + 0.5 * c, 6) AS h5, round(0.625 * c + 0.375 * d, 6) AS h10, round(d, 6) AS h30 FROM a WHERE d IS NOT NULL AND c IS NOT NULL AND b IS NOT NULL AND a IS NOT NULL""")
def interpolated_horizons(spark: SparkSession, d: str) -> DataFrame:
    f = fc.cone(fc.forward_targets(bars(spark, d)))
    a = f.groupBy("symbol", "day").agg(F.array(*[F.max(F.when(F.col("horizon") == h, F.col("q50"))) for h in fc.HORIZONS]).alias("v"))
    a = a.where(~F.exists("v", lambda x: x.isNull()))
    return rounded(a.select("symbol", "day", *[st.interpolate_array(F.col("v"), fc.HORIZONS, x).alias(n) for n, x in (("h05", 0.5), ("h2", 2), ("h5", 5), ("h10", 10), ("h30", 30))]))


_LOGITS = ("open / 300 - 5", "close / 250 - 6", "high / 400 - 4")


@query(f"""WITH {BARS_SQL}, b AS (SELECT symbol, day, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_LOGITS))}, (trades % 6) / 3 AS fr, (trades % 5) / 5 AS un, 1 - (trades % 3) / 3 AS va, (trades % 4) / 8 AS mi, trades % 2 = 0 AS o2 FROM bars),
s AS (SELECT *, greatest(l0, l1, CASE WHEN o2 THEN l2 END) AS m, list_reverse_sort([l0, l1, l2]) AS z FROM b), e AS (SELECT *, exp(l0 - m) AS e0, exp(l1 - m) AS e1, CASE WHEN o2 THEN exp(l2 - m) ELSE 0 END AS e2,
 CASE WHEN 1 + 3 * z[3] > z[1] + z[2] + z[3] THEN (z[1] + z[2] + z[3] - 1) / 3 WHEN 1 + 2 * z[2] > z[1] + z[2] THEN (z[1] + z[2] - 1) / 2 ELSE z[1] - 1 END AS tau FROM s)
SELECT symbol, day, round(exp(-fr) * exp(-un) * va * (1 - mi), 6) AS gate, {', '.join(f'round(e{i} / (e0 + e1 + e2), 6) AS soft_{i}, round(greatest(l{i} - tau, 0), 6) AS sparse_{i}' for i in range(3))}, ((l1 > l0)::INT + (l2 > l0)::INT < 2) AS top_0, ((l0 >= l1)::INT + (l2 > l1)::INT < 2) AS top_1, ((l0 >= l2)::INT + (l1 >= l2)::INT < 2) AS top_2 FROM e""")
def router_shares(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("trades")
    df = bars(spark, d).select("symbol", "day", *[F.expr(x).alias(f"l{i}") for i, x in enumerate(_LOGITS)], st.reliability_gate(t % 6 / 3, t % 5 / 5, 1 - t % 3 / 3, t % 4 / 8).alias("gate"), (t % 2 == 0).alias("o2"))
    x = [F.col(f"l{i}") for i in range(3)]
    soft, sparse, top = st.softmax(x, [F.lit(True), F.lit(True), F.col("o2")]), st.sparsemax(x), st.top_k(x, 2)
    return rounded(df.select("symbol", "day", "gate", *[c.alias(f"{n}_{i}") for n, cs in (("soft", soft), ("sparse", sparse), ("top", top)) for i, c in enumerate(cs)]))


def _sp(x: str) -> str:
    return f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


@query(f"""WITH {BARS_SQL}, b AS (SELECT symbol, day, close / 1000 AS c, open / 2000 - 1 AS h, high / 1500 - 2 AS l, low / 900 - 1 AS u, lead(close) {W} / 1000 AS y FROM bars), q AS (SELECT symbol, day, y, c - {_sp('h')} - {_sp('l')} AS q05, c - {_sp('h')} AS q25, c AS q50, c + {_sp('h')} AS q75, c + {_sp('h')} + {_sp('u')} AS q95 FROM b)
SELECT symbol, day, {', '.join(f'round({n}, 6) AS {n}' for n in fc.NAMES)}, round((2 * greatest(0.05 * (y - q05), -0.95 * (y - q05)) + greatest(0.25 * (y - q25), -0.75 * (y - q25)) + greatest(0.5 * (y - q50), -0.5 * (y - q50)) + greatest(0.75 * (y - q75), -0.25 * (y - q75)) + greatest(0.95 * (y - q95), -0.05 * (y - q95))) / 5 + 0.1 * greatest(abs(y - q50) - 0.5 * (q95 - q05), 0) + 0.2 * greatest(0.01 - (q95 - q05), 0), 6) AS loss FROM q WHERE y IS NOT NULL""")
def structured_heads(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).select("symbol", "day", (F.col("close") / 1000).alias("c"), (F.col("open") / 2000 - 1).alias("h"), (F.col("high") / 1500 - 2).alias("l"), (F.col("low") / 900 - 1).alias("u"), (O.lead(F.col("close")) / 1000).alias("y"))
    q = st.structured_quantiles(*[F.col(x) for x in "chlu"])
    df = df.where(F.col("y").isNotNull()).select("symbol", "day", "y", *[x.alias(n) for x, n in zip(q, fc.NAMES, strict=True)])
    return rounded(df.withColumn("loss", st.fusion_loss(F.col("y"), fc.predicted(), fc.LEVELS, 2.0, 0.5, 0.1, 0.2)).drop("y"))


@query(f"""WITH {BARS_SQL}, b AS (SELECT symbol, day, unnest([{{'i': 1, 'v': [close, open, high, low, close]}}]) AS u FROM bars), s AS (SELECT symbol, day, list_sort(u.v) AS z FROM b), p AS (SELECT symbol, day, list_transform(range(1, 6), lambda i: list_max(list_transform(range(1, i + 1), lambda j: z[j] - (j - 1) * 0.5)) + (i - 1) * 0.5) AS z FROM s)
SELECT symbol, day, {', '.join(f'round(z[{i}], 6) AS z{i}' for i in range(1, 6))} FROM p""")
def increasing_quantiles(spark: SparkSession, d: str) -> DataFrame:
    z = st.strictly_increasing([F.col(c) for c in ("close", "open", "high", "low", "close")], 0.5)
    df = bars(spark, d).select("symbol", "day", z.alias("z"))
    return rounded(df.select("symbol", "day", *[F.col("z")[i].alias(f"z{i + 1}") for i in range(5)]))


_LEADS, _LEAST, _WIN = (7, 30, 60), 120, 365


def _corr_sql(k: int) -> str:
    return f"CASE WHEN count(y{k}) {frame(_WIN)} >= {_LEAST} AND stddev_pop(x{k}) {frame(_WIN)} * stddev_pop(y{k}) {frame(_WIN)} > 1e-14 THEN covar_pop(x{k}, y{k}) {frame(_WIN)} / (stddev_pop(x{k}) {frame(_WIN)} * stddev_pop(y{k}) {frame(_WIN)}) END"


@query(f"""WITH {BARS_SQL}, a AS (SELECT symbol, day, volume AS x, {', '.join(f'ln(lead(close, {k}) {W}) - ln(close) AS y{k}' for k in _LEADS)} FROM bars), b AS (SELECT *, {', '.join(f'CASE WHEN y{k} IS NOT NULL THEN x END AS x{k}' for k in _LEADS)} FROM a), c AS (SELECT *, {', '.join(f'{_corr_sql(k)} AS c{k}' for k in _LEADS)} FROM b),
r AS (SELECT *, {', '.join(f'lag(c{k}, {k + 1}) {W} AS r{k}, lag(x, {k}) {W} AS s{k}' for k in _LEADS)} FROM c), p AS (SELECT *, {' + '.join(f'coalesce(pow(greatest(r{k}, 0), 2), 0)' for k in _LEADS)} AS pos FROM (SELECT * REPLACE ({', '.join(f'r{k} AS r{k}' for k in _LEADS)}) FROM r)),
w AS (SELECT *, {', '.join(f'CASE WHEN r{k} IS NOT NULL THEN CASE WHEN pos > 0 THEN pow(greatest(r{k}, 0), 2) ELSE r{k} * r{k} END END AS w{k}' for k in _LEADS)}, greatest({', '.join(f'abs(r{k})' for k in _LEADS)}) AS st FROM p), v AS (SELECT *, nullif({' + '.join(f'coalesce(w{k}, 0)' for k in _LEADS)}, 0) AS ws FROM w)
SELECT symbol, day, {', '.join(f'round(r{k}, 5) AS corr_{k}' for k in _LEADS)}, round(coalesce(({' + '.join(f'coalesce(w{k} * s{k}, 0)' for k in _LEADS)}) / ws, s30), 4) AS impact, CASE {' '.join(f'WHEN abs(r{k}) = st THEN {k}' for k in _LEADS)} ELSE 30 END AS best_lead, round(coalesce(st, 0), 5) AS strength,
round(coalesce(({' + '.join(f'coalesce(w{k} * {k}, 0)' for k in _LEADS)}) / ws, CASE {' '.join(f'WHEN abs(r{k}) = st THEN {k}' for k in _LEADS)} ELSE 30 END), 4) AS lead_days FROM v""")
def lead_impact(spark: SparkSession, d: str) -> DataFrame:
    df = st.lead_impact(bars(spark, d).select("symbol", "day", "close", F.col("volume").alias("x")), "x", _LEADS, 30, _WIN, _LEAST)
    return df.select("symbol", "day", "best_lead", *[F.round(F.col(c) + 10.0 ** -(k + 3), k).alias(c) for c, k in (*[(f"corr_{x}", 5) for x in _LEADS], ("strength", 5), ("impact", 4), ("lead_days", 4))])


@query(f"""WITH {BARS_SQL}, e AS (SELECT symbol, max(day) AS b FROM bars GROUP BY 1), g AS (SELECT symbol, arg_min(ln(close), day) AS x, arg_max(ln(close), day) AS y, date_diff('day', min(day), max(day)) AS n FROM bars JOIN e USING (symbol) WHERE day >= b - 180 GROUP BY 1) SELECT symbol, round(greatest(least((y - x) / n, 0.003), -0.003), 9) AS trend FROM g""", date=None)
def recent_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.recent_trend(bars(spark, d).select("symbol", "day", F.ln("close").alias("x")), "x"), 9)


@query("""SELECT o_orderpriority, sha256(string_agg(o_orderkey || '|' || o_orderstatus || '|' || coalesce(CASE WHEN o_custkey % 9 > 0 THEN o_custkey::VARCHAR END, 'null'), chr(10) ORDER BY o_orderkey)) AS sha256, count(*) AS n_rows FROM orders WHERE o_orderkey % 50 = 0 GROUP BY 1""", date=None)
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderkey") % 50 == 0).withColumn("c", F.when(F.col("o_custkey") % 9 > 0, F.col("o_custkey")))
    return st.content_hash(o, ["o_orderpriority"], ["o_orderkey"], ["o_orderkey", "o_orderstatus", "c"])


@query(f"""WITH {_PANEL}, s AS (SELECT symbol, horizon, day, max({_W1}) FILTER (WHERE forecaster = 'expanding') AS a, max({_W1}) FILTER (WHERE forecaster = 'random_walk') AS b FROM f WHERE y IS NOT NULL GROUP BY symbol, horizon, day)
SELECT symbol, horizon, day, round(a, 6) AS model_wis, round(b, 6) AS other_wis, round(a - b, 6) AS difference FROM s WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_losses(spark: SparkSession, d: str) -> DataFrame:
    """Both forecasters' losses of a row by one aggregate; rows that one of them lacks are left out."""
    p = _panel(spark, d).where(F.col("actual").isNotNull())
    loss = lambda f: F.max(F.when(F.col("forecaster") == f, F.col("wis")))
    both = p.groupBy("symbol", "horizon", "day").agg(loss("expanding").alias("model_wis"), loss("random_walk").alias("other_wis"))
    both = both.where(F.col("model_wis").isNotNull() & F.col("other_wis").isNotNull())
    return rounded(both.withColumn("difference", F.col("model_wis") - F.col("other_wis")))


@query(f"""WITH {BARS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM bars), t AS (SELECT symbol, 'rows' AS span, day, close FROM n WHERE k <= 100 UNION ALL SELECT symbol, 'years', day, close FROM bars b WHERE day >= (SELECT max(day) FROM bars c WHERE c.symbol = b.symbol) - INTERVAL 2 YEAR)
SELECT symbol, span, count(*) AS n, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, round(min(close), 6) AS low, round(max(close), 6) AS high, round(arg_min(close, day), 6) AS first_close FROM t GROUP BY 1, 2""", date=None)
def tails_and_extremes(spark: SparkSession, d: str) -> DataFrame:
    b, k = bars(spark, d), Window.partitionBy("symbol")
    rows = b.withColumn("_k", F.row_number().over(k.orderBy(F.desc("day")))).where(F.col("_k") <= 100).select("symbol", F.lit("rows").alias("span"), "day", "close")
    years = b.withColumn("_end", F.max("day").over(k)).where(F.col("day") >= F.add_months("_end", -24)).select("symbol", F.lit("years").alias("span"), "day", "close")
    return rounded(rows.unionByName(years).groupBy("symbol", "span").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min("close").alias("low"), F.max("close").alias("high"), F.min_by("close", "day").alias("first_close")))


@query("""WITH old AS (SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'), new AS (SELECT o_orderkey, o_orderdate, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01')
SELECT 'suffix' AS kind, o_orderkey, round(o_totalprice, 4) AS price FROM old WHERE o_orderdate < TIMESTAMP '1998-06-01' UNION ALL SELECT 'suffix', o_orderkey, round(o_totalprice, 4) FROM new
UNION ALL SELECT 'merge', o_orderkey, round(o_totalprice, 4) FROM old WHERE o_orderdate < (SELECT min(o_orderdate) FROM new) UNION ALL SELECT 'merge', o_orderkey, round(o_totalprice, 4) FROM new
UNION ALL SELECT 'skipped', NULL, NULL WHERE (SELECT max(o_orderdate) FROM old) >= (SELECT max(o_orderdate) FROM old)""", date=None)
def suffix_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Rows after a suffix is replaced from a given time, from the least incoming time, and whether an equal refresh is skipped."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_totalprice")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    old = o.where(F.col("o_orderdate") < at("1999-01-01"))
    new = o.where(F.col("o_orderdate") >= at("1998-06-01")).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    skipped = rel.is_current(old, old, "o_orderdate").where("current").select(F.lit("skipped").alias("kind"), F.lit(None).cast("long").alias("o_orderkey"), F.lit(None).cast("double").alias("price"))
    parts = [df.select(F.lit(n).alias("kind"), "o_orderkey", F.round(F.col("o_totalprice") + 1e-7, 4).alias("price")) for n, df in (("suffix", rel.replace_suffix(old, new, "o_orderdate", at("1998-06-01"))), ("merge", rel.merge_endpoint(old, new, "o_orderdate")))]
    return parts[0].unionByName(parts[1]).unionByName(skipped)
