"""Queries of the time-series engine and the DuckDB SQL that checks them.

Both sides round doubles to six places, since summation order differs.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.scalars import clip, entropy, project_price, ratio, row_mean, sigmoid, slug, weighted_mean
from tidewright.operators import forecasts as fc
from tidewright.operators import indicators as ta
from tidewright.operators import leverage as lv
from tidewright.operators import relational as rel
from tidewright.operators import splits as sp
from tidewright.operators.frames import Ordered, bucket_of_rank
from tidewright.operators.recursion import Recursion, ema, fold, fold_rows, integrate, local_level, local_trend, percentile_of_last, running_quantile, running_quantiles, smoothed, spaced, wilder
from tidewright.plans.market import BARS_SQL, MARKET_SQL, PRIORITIES, SERIES_SQL, bars, market_bars, series, table
from tidewright.plans.session import tune
from tidewright.sources import tables as src

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
O = Ordered()  # noqa: E741


def query(sql: str | None = None, date: str | None = "day"):
    """Register a query and its SQL; `date`: its column of dates, which are compared as texts."""

    def keep(f):
        @functools.wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            tune(spark)
            df = f(spark, d)
            return df.withColumns({x: F.col(x).cast("string") for x, t in df.dtypes if t == "date"})

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = f"SELECT * REPLACE (CAST({date} AS VARCHAR) AS {date}) FROM ({off_ties(sql)})" if date else off_ties(sql)
        return run

    return keep


def off_ties(sql: str) -> str:
    """round(x, n) as round(x + 10**-(n + 3), n), so that exact decimals that end in 5 round alike on both sides."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        digits = re.search(r", (\d+)\)$", sql[m.start() : i])
        if digits:
            cut = i - len(digits[0])
            out += [(cut, f" + 1e-{int(digits[1]) + 3}")]
    for cut, text in sorted(out, reverse=True):
        sql = sql[:cut] + text + sql[cut:]
    return sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    # + 0.0: no negative zeros
    return df.select(*[(F.round(F.col(x) + 10.0 ** -(digits + 3), digits) + 0.0).alias(x) if t == "double" else F.col(x) for x, t in df.dtypes])


def rounded_column(x: Column | str, digits: int) -> Column:
    return F.round((F.col(x) if isinstance(x, str) else x) + 10.0 ** -(digits + 3), digits)


def frame(n: int | None, shift: int = 0) -> str:
    low = "UNBOUNDED PRECEDING" if n is None else f"{n - 1 + shift} PRECEDING"
    return f"OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN {low} AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"


def roll(f: str, x: str, n: int | None, least: int | None = None, shift: int = 0) -> str:
    """SQL of a framed aggregate with a least number of values."""
    over = frame(n, shift)
    call = f.format(x) if "{}" in f else f"{f}({x})"
    return f"CASE WHEN count({x}) {over} >= {n if least is None else least} THEN {call} {over} END"


W = "OVER (PARTITION BY symbol ORDER BY day)"


# ---- scans and tables


@query(f"WITH {BARS_SQL} SELECT symbol, day, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, trades FROM bars")
def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bars(spark, d)).select("symbol", "day", "open", "high", "low", "close", "volume", "trades")


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'", date=None)
def filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    return src.scan(table(spark, d, "orders"), ["o_orderkey", "o_totalprice", "o_orderdate"], {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


_EVENT_BARS = """e AS (SELECT event_type AS symbol, CASE WHEN event_id % 5 = 0 THEN '1M' WHEN event_id % 5 = 1 THEN '15m' WHEN event_id % 5 = 2 THEN '4h' WHEN event_id % 5 = 3 THEN '1d' ELSE '7x' END AS "interval",
  date_trunc('hour', ts) AS open_time, value, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 2 DAY END AS available_at FROM events),
k AS (SELECT *, coalesce(available_at, CASE "interval" WHEN '1M' THEN open_time + INTERVAL 1 MONTH WHEN '15m' THEN open_time + INTERVAL 15 MINUTE WHEN '4h' THEN open_time + INTERVAL 4 HOUR WHEN '1d' THEN open_time + INTERVAL 1 DAY END - INTERVAL 1 MILLISECOND) AS known_at FROM e)"""


@query(f"""WITH {_EVENT_BARS} SELECT symbol, "interval", open_time, value, seq FROM k WHERE known_at <= TIMESTAMP '2024-01-20 00:00:00'
QUALIFY row_number() OVER (PARTITION BY symbol, "interval", open_time ORDER BY known_at DESC, seq DESC) = 1""", date=None)
def closed_bar_scan(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id") % 5
    interval = F.when(i == 0, "1M").when(i == 1, "15m").when(i == 2, "4h").when(i == 3, "1d").otherwise("7x")
    b = e.select(F.col("event_type").alias("symbol"), interval.alias("interval"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("open_time"), "value", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL 2 DAY")).alias("available_at"), F.lit(None).cast("timestamp_ntz").alias("close_time"))
    return src.closed_bars(b, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("symbol", "interval", "open_time", "value", "seq")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1", date=None)
def keep_last_by_key(spark: SparkSession, d: str) -> DataFrame:
    return src.keep_last(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""WITH incoming AS (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, o_orderstatus, 1 AS seq FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, o_totalprice * 3, o_orderstatus, 2 FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT -o_orderkey, o_totalprice, o_orderstatus, 1 FROM orders WHERE o_orderkey % 10 = 0),
latest AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) = 1)
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM latest) UNION ALL SELECT o_orderkey, round(o_totalprice, 6), o_orderstatus FROM latest""", date=None)
def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey")
    new = o.where(k % 3 == 0).withColumn("o_totalprice", F.col("o_totalprice") * 2).withColumn("seq", F.lit(1))
    new = new.unionByName(o.where(k % 6 == 0).withColumn("o_totalprice", F.col("o_totalprice") * 3).withColumn("seq", F.lit(2)))
    new = new.unionByName(o.where(k % 10 == 0).withColumn("o_orderkey", -k).withColumn("seq", F.lit(1)))
    return rounded(rel.upsert(o, new, ["o_orderkey"], ["seq"]))


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus = 'O')", date=None)
def suffix_delete(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return rel.delete_from(o, "o_orderdate", F.lit("1998-01-01").cast("timestamp"), o_orderstatus="O")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY 1 DESC LIMIT 1 OFFSET 30")
def overlap_refresh_start(spark: SparkSession, d: str) -> DataFrame:
    return rel.refresh_start(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), "day", 30)


@query(f"""WITH {SERIES_SQL}, old AS (SELECT * FROM series WHERE day < DATE '1998-01-01'), new AS (SELECT day, series_name, CASE WHEN series_name = '5-LOW' THEN value + 1 ELSE value END AS value FROM series)
SELECT CASE WHEN old.day IS NULL THEN 'new' WHEN old.value IS DISTINCT FROM new.value THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS n FROM new LEFT JOIN old USING (day, series_name) GROUP BY 1""", date=None)
def delta_upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d).select("day", "series_name", rounded_column("value", 6).alias("value"))
    old = s.where(F.col("day") < F.lit("1998-01-01").cast("date"))
    new = s.withColumn("value", F.when(F.col("series_name") == "5-LOW", F.col("value") + 1).otherwise(F.col("value")))
    return rel.delta(old, new, ["day", "series_name"], ["value"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(o_orderdate AS DATE) AS day FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 5")
def completed_days(spark: SparkSession, d: str) -> DataFrame:
    return rel.complete_keys(table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), "day", "o_orderpriority", 5)


@query(f"WITH {SERIES_SQL} SELECT day, " + ", ".join(f"round(max(value) FILTER (WHERE series_name = '{p}'), 6) AS \"{p}\"" for p in PRIORITIES) + " FROM series GROUP BY day")
def series_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(src.pivot_last(series(spark, d), "day", PRIORITIES, ["source", "series_name"]))


@query(f"WITH {SERIES_SQL} SELECT day, series_name, round(value, 6) AS value FROM series WHERE series_name IN ('1-URGENT', '5-LOW')")
def wide_melt(spark: SparkSession, d: str) -> DataFrame:
    wide = src.pivot_last(series(spark, d), "day", ["1-URGENT", "5-LOW"], ["source", "series_name"])
    return rounded(src.melt(wide, "day"))


@query(f"""WITH {BARS_SQL}, {SERIES_SQL}, a AS (SELECT day, value AS urgent FROM series WHERE series_name = '1-URGENT'), b AS (SELECT day, close FROM bars WHERE symbol = 'R'), v AS (SELECT day, volume FROM bars WHERE symbol = 'A')
SELECT day, round(urgent, 6) AS urgent, round(close, 6) AS close, round(volume, 6) AS volume FROM a FULL JOIN b USING (day) FULL JOIN v USING (day)""")
def merged_metrics(spark: SparkSession, d: str) -> DataFrame:
    b, s = bars(spark, d), series(spark, d)
    return rounded(src.merge_metrics({"urgent": s.where(F.col("series_name") == "1-URGENT").select("day", "value"), "close": b.where(F.col("symbol") == "R").select("day", ta.close().alias("value")), "volume": b.where(F.col("symbol") == "A").select("day", F.col("volume").alias("value"))}))


@query("""WITH w AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events)
SELECT event_type, count(k) AS n, count(DISTINCT k) AS kinds, sum(k)::BIGINT AS k_sum, min(k) AS k_min, max(k) AS k_max, round(avg(CASE WHEN k % 2 = 0 THEN value END), 6) AS mean_even FROM w GROUP BY 1""", date=None)
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "value", F.from_json("props", "k bigint")["k"].alias("k"))
    return rounded(e.groupBy("event_type").agg(F.count("k").alias("n"), F.countDistinct("k").alias("kinds"), F.sum("k").alias("k_sum"), F.min("k").alias("k_min"), F.max("k").alias("k_max"), F.avg(F.when(F.col("k") % 2 == 0, F.col("value"))).alias("mean_even")))


@query("""WITH p AS (SELECT page_id, regexp_extract(html, 'track\\(([0-9]+)\\)', 1) AS track, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages),
e AS (SELECT '<script>draw("plot", [{"name": "' || event_type || '", "y": [' || string_agg(value::VARCHAR, ', ' ORDER BY event_id) || ']}], {});</script>' AS html FROM events WHERE event_id % 100 = 0 GROUP BY event_type),
j AS (SELECT json_extract(regexp_extract(html, 'draw[(]"plot", (.*), [{]', 1), '$[0]') AS t FROM e), y AS (SELECT json_extract_string(t, '$.name') AS name, list_sum(CAST(json_extract(t, '$.y') AS DOUBLE[])) AS total FROM j)
SELECT 'page' AS kind, page_id::VARCHAR AS name, TRY_CAST(track AS DOUBLE) AS total, lang AS note FROM p UNION ALL SELECT 'plot', name, round(total, 4), name FROM y""", date=None)
def html_embedded_values(spark: SparkSession, d: str) -> DataFrame:
    """Values in scripts of pages, and the traces of a plot call that are found and parsed as JSON."""
    p = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("name"), F.regexp_extract("html", r"track\(([0-9]+)\)", 1).try_cast("double").alias("total"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("note"))
    points = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"].cast("string"))
    made = table(spark, d, "events").where(F.col("event_id") % 100 == 0).groupBy(F.col("event_type").alias("name")).agg(F.array_join(points, ", ").alias("y"))
    made = made.select(F.concat(F.lit('<script>draw("plot", [{"name": "'), "name", F.lit('", "y": ['), "y", F.lit("]}], {});</script>")).alias("html"))
    trace = src.embedded_json(made, "html", r'draw\("plot", (\[.*\]), \{', "array<struct<name:string,y:array<double>>>").select(F.explode("parsed").alias("t"))
    total = F.aggregate("t.y", F.lit(0.0), lambda a, x: a + x)
    return p.unionByName(trace.select(F.lit("plot").alias("kind"), F.col("t.name").alias("name"), rounded_column(total, 4).alias("total"), F.col("t.name").alias("note")))


# ---- joins and alignment


@query("""SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 4) AS balance, round(sum(c_acctbal) / nullif(count(*), 0), 6) AS mean_balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""", date=None)
def cohort_sums(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    # 25 and 5 rows by definition of the tables: aggregate first, then join the names
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("s"))
    j = per.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("r_name", "n_name", "customers", rounded_column("s", 4).alias("balance"), rounded_column(F.col("s") / F.col("customers"), 6).alias("mean_balance"))


_STEPS = "(VALUES (DATE '1995-06-01', 34.0::DOUBLE), (DATE '1997-01-15', 29.5), (DATE '1998-09-01', 21.5), (DATE '2000-03-10', 18.0)) AS s(day, step)"


@query(f"""WITH {MARKET_SQL}, s AS (SELECT * FROM {_STEPS}) SELECT b.day, round(b.close, 6) AS close, coalesce(s.step, 34.0::DOUBLE) AS step FROM bars b ASOF LEFT JOIN s ON b.day >= s.day""")
def as_of_steps(spark: SparkSession, d: str) -> DataFrame:
    steps = spark.sql("SELECT * FROM VALUES (DATE '1995-06-01', 34.0D), (DATE '1997-01-15', 29.5D), (DATE '1998-09-01', 21.5D), (DATE '2000-03-10', 18.0D) AS s(day, step)")
    return rounded(rel.as_of(market_bars(spark, d).select("symbol", "day", "close"), steps.withColumn("symbol", F.lit("ALL")), "day", "step", ["symbol"], fill_head=True).select("day", "close", "step"))


@query(f"""WITH {MARKET_SQL}, {SERIES_SQL}, j AS (SELECT b.day, s.value FROM bars b LEFT JOIN (SELECT * FROM series WHERE series_name = '3-MEDIUM') s USING (day))
SELECT day, round(last_value(value IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS value FROM j""")
def aligned_series(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d).where(F.col("series_name") == "3-MEDIUM").select(F.lit("ALL").alias("symbol"), "day", "value")
    return rounded(rel.align(market_bars(spark, d).select("symbol", "day"), s, "day", ["value"], ["symbol"]).select("day", "value"))


@query(f"""WITH {SERIES_SQL}, k AS (SELECT series_name, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM series GROUP BY 1)
SELECT series_name, day, round(last_value(value IGNORE NULLS) OVER (PARTITION BY series_name ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS value FROM k LEFT JOIN series USING (series_name, day)""")
def dense_calendar(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d).select("series_name", "day", "value")
    return rounded(rel.align(rel.calendar(s, "series_name"), s, "day", ["value"], ["series_name"]).select("series_name", "day", "value"))


@query(f"""WITH {SERIES_SQL}, {MARKET_SQL} SELECT b.day, round(s.value, 6) AS shifted FROM bars b LEFT JOIN (SELECT day + 42 AS day, value FROM series WHERE series_name = '2-HIGH') s USING (day)""")
def calendar_shift(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d).where(F.col("series_name") == "2-HIGH").select(F.date_add("day", 42).alias("day"), F.col("value").alias("shifted"))
    return rounded(market_bars(spark, d).select("day").join(s, "day", "left"))


@query(f"""WITH {BARS_SQL} SELECT symbol, (day + CAST((13 - (dayofweek(day) + 1)) % 7 AS INTEGER))::DATE AS week, round(arg_max(close, day), 6) AS close FROM bars GROUP BY 1, 2""", date="week")
def weekly_close(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rel.week_ends(bars(spark, d), "symbol", "close"))


@query(f"""WITH {BARS_SQL} SELECT day FROM bars GROUP BY day HAVING count(DISTINCT symbol) = 3""")
def common_days(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return rel.common_rows([b.where(F.col("symbol") == s) for s in ("A", "N", "R")], ["day"])


@query(f"""WITH {BARS_SQL} SELECT a.symbol, a.day, round(ln(b.close / a.close), 6) AS realised FROM bars a LEFT JOIN bars b ON a.symbol = b.symbol AND b.day = a.day + 7""")
def exact_forward_lookup(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    later = b.select("symbol", F.date_sub("day", 7).alias("day"), ta.close().alias("later"))
    return rounded(b.join(later, ["symbol", "day"], "left").select("symbol", "day", F.ln(F.col("later") / ta.close()).alias("realised")))


# ---- windows


@query(f"""WITH {BARS_SQL} SELECT symbol, day, round({roll('avg', 'close', 20)}, 6) AS mean_20, round({roll('stddev_samp', 'close', 20, 5)}, 6) AS sd_20, round({roll('stddev_pop', 'close', 20)}, 6) AS sdp_20,
round({roll('min', 'low', 10)}, 6) AS low_10, round({roll('max', 'high', 10)}, 6) AS high_10, round({roll('sum', 'volume', 30, 10)}, 6) AS volume_30, round(close - lag(close) {W}, 6) AS change, round(close / lag(close, 7) {W} - 1, 6) AS pct_7 FROM bars""")
def rolling_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bars(spark, d).select("symbol", "day", O.mean(ta.close(), 20).alias("mean_20"), O.deviation(ta.close(), 20, 5).alias("sd_20"), O.deviation(ta.close(), 20, sample=False).alias("sdp_20"), O.low(ta.low(), 10).alias("low_10"), O.high(ta.high(), 10).alias("high_10"), O.total(F.col("volume"), 30, 10).alias("volume_30"), O.diff(ta.close()).alias("change"), (ta.close() / O.lag(ta.close(), 7) - 1).alias("pct_7")))


_Q = "quantile_cont({}, %s)"


@query(f"""WITH {BARS_SQL}, m AS (SELECT *, {roll(_Q % 0.5, 'close', 90, 30)} AS med, {roll(_Q % 0.75, 'close', 90, 30)} - {roll(_Q % 0.25, 'close', 90, 30)} AS iqr FROM bars), a AS (SELECT *, abs(close - med) AS off FROM m)
SELECT symbol, day, round(med, 6) AS median, round((close - med) / nullif(iqr, 0), 6) AS iqr_z, round({roll(_Q % 0.5, 'off', 90, 30)}, 6) AS mad, round({roll(_Q % 0.95, 'close', 365, 90, 1)}, 6) AS prior_p95 FROM a""")
def rolling_robust(spark: SparkSession, d: str) -> DataFrame:
    def f(frame):
        x = frame["close"].to_numpy(float)
        q = running_quantiles(x, (0.25, 0.5, 0.75), 90, 30)
        return {"low": q[:, 0], "median": q[:, 1], "high": q[:, 2], "mad": running_quantile(abs(x - q[:, 1]), 0.5, 90, 30), "prior_p95": running_quantile(x, 0.95, 365, 90, shift=1)}

    df = fold_rows(bars(spark, d).select("symbol", "day", "close"), f, ["low", "median", "high", "mad", "prior_p95"])
    return rounded(df.select("symbol", "day", "median", ratio(ta.close() - F.col("median"), F.col("high") - F.col("low")).alias("iqr_z"), "mad", "prior_p95"))


@query(f"""WITH {BARS_SQL} SELECT symbol, day, round({roll('avg', 'close', None, 10)}, 6) AS mean, round({roll('stddev_samp', 'close', None, 10)}, 6) AS sd, round({roll(_Q % 0.5, 'close', None, 10)}, 6) AS median, round({roll(_Q % 0.05, 'close', None, 10)}, 6) AS p05 FROM bars""")
def expanding_statistics(spark: SparkSession, d: str) -> DataFrame:
    df = fold(bars(spark, d).select("symbol", "day", "close"), [Recursion("median", "close", partial(running_quantile, level=0.5, window=None, least=10)), Recursion("p05", "close", partial(running_quantile, level=0.05, window=None, least=10))])
    return rounded(df.select("symbol", "day", O.mean(ta.close(), None, 10).alias("mean"), O.deviation(ta.close(), None, 10).alias("sd"), "median", "p05"))


@query(f"""WITH RECURSIVE {MARKET_SQL}, o AS (SELECT day, close, row_number() OVER (ORDER BY day) AS n FROM bars),
r AS (SELECT day, close, n, close AS ema_20, CAST(NULL AS DOUBLE) AS rma_14 FROM o WHERE n = 1 UNION ALL
SELECT o.day, o.close, o.n, r.ema_20 + (o.close - r.ema_20) * 2.0 / 21, CASE WHEN o.n = 14 THEN (SELECT avg(close) FROM o AS p WHERE p.n <= 14) ELSE r.rma_14 + (o.close - r.rma_14) / 14 END FROM r JOIN o ON o.n = r.n + 1)
SELECT day, round(ema_20, 6) AS ema_20, round(rma_14, 6) AS rma_14 FROM r""")
def recursive_means(spark: SparkSession, d: str) -> DataFrame:
    df = fold(market_bars(spark, d).select("symbol", "day", "close"), [Recursion("ema_20", "close", partial(ema, span=20)), Recursion("rma_14", "close", partial(wilder, n=14))])
    return rounded(df.select("day", "ema_20", "rma_14"))


@query(f"""WITH RECURSIVE {BARS_SQL}, o AS (SELECT symbol, day, row_number() {W} AS n, ln(close) AS x, ln(close) - lag(ln(close)) {W} AS r, {roll('avg', 'ln(close)', 12)} AS m12 FROM bars),
f AS (SELECT symbol, day, n, CAST(NULL AS DOUBLE) AS smma, x AS lv, 1.0::DOUBLE AS p, x AS m0, 0.0::DOUBLE AS m1, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c, 0.0::DOUBLE AS integrated, 0.0::DOUBLE AS squashed FROM o WHERE n = 1
UNION ALL SELECT o.symbol, o.day, o.n, CASE WHEN o.n = 12 THEN o.m12 ELSE (f.smma * 11 + o.x) / 12 END, f.lv + (f.p + 1e-4) / (f.p + 1e-4 + 1e-2) * (o.x - f.lv), (1 - (f.p + 1e-4) / (f.p + 1e-4 + 1e-2)) * (f.p + 1e-4),
 (f.m0 + f.m1) + (f.a + 2 * f.b + f.c + 1e-4) / (f.a + 2 * f.b + f.c + 1e-4 + 1e-2) * (o.x - f.m0 - f.m1), 0.98 * f.m1 + 0.98 * (f.b + f.c) / (f.a + 2 * f.b + f.c + 1e-4 + 1e-2) * (o.x - f.m0 - f.m1),
 (f.a + 2 * f.b + f.c + 1e-4) * (1 - (f.a + 2 * f.b + f.c + 1e-4) / (f.a + 2 * f.b + f.c + 1e-4 + 1e-2)), 0.98 * (f.b + f.c) * (1 - (f.a + 2 * f.b + f.c + 1e-4) / (f.a + 2 * f.b + f.c + 1e-4 + 1e-2)), 0.98 * 0.98 * f.c + 1e-6 - pow(0.98 * (f.b + f.c), 2) / (f.a + 2 * f.b + f.c + 1e-4 + 1e-2),
 0.98 * f.integrated + o.r, tanh((0.98 * f.squashed + o.r) / 0.3) * 0.3 FROM f JOIN o ON o.symbol = f.symbol AND o.n = f.n + 1)
SELECT symbol, day, round(smma, 6) AS smma_12, round(lv, 6) AS level, round(m0, 6) AS trend_level, round(integrated, 6) AS integrated, round(squashed, 6) AS squashed FROM f""")
def recursive_filters(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).select("symbol", "day", F.ln(ta.close()).alias("x"), O.diff(F.ln(ta.close())).alias("r"))
    made = fold(df, [Recursion("smma_12", "x", partial(smoothed, n=12)), Recursion("level", "x", partial(local_level, q=1e-4, r=1e-2)), Recursion("trend_level", "x", partial(local_trend, q_level=1e-4, q_trend=1e-6, r=1e-2, phi=0.98)), Recursion("integrated", "r", partial(integrate, rho=0.98)), Recursion("squashed", "r", partial(integrate, rho=0.98, bound=0.3))])
    return rounded(made.drop("x", "r"))


def _lags(x: str, weights: list[float]) -> str:
    return "(" + " + ".join(f"{w!r} * {f'lag({x}, {i}) {W}' if i else x}" for i, w in enumerate(weights)) + f") / {sum(weights)!r}"


@query(f"""WITH {BARS_SQL}, a AS (SELECT *, {_lags('close', ta.linear_weights(10))} AS w10, {_lags('close', ta.linear_weights(20))} AS w20, row_number() {W} AS n FROM bars), b AS (SELECT *, 2 * w10 - w20 AS raw FROM a)
SELECT symbol, day, round(w10, 6) AS wma_10, round({_lags('raw', ta.linear_weights(4))}, 6) AS hma_20, round(CASE WHEN count(close) {frame(20)} >= 20 THEN regr_slope(close, n) {frame(20)} * n + regr_intercept(close, n) {frame(20)} END, 6) AS ols_end,
round(CASE WHEN count(close) {frame(90)} >= 90 THEN corr(close, volume) {frame(90)} END, 6) AS corr_90 FROM b""")
def weighted_means_and_fits(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).withColumns({"w10": ta.weighted(ta.close(), ta.linear_weights(10)), "w20": ta.weighted(ta.close(), ta.linear_weights(20)), "n": F.row_number().over(O.spec).cast("double")})
    df = df.withColumn("raw", 2 * F.col("w10") - F.col("w20"))
    w, v = O.spec.rowsBetween(-19, 0), O.spec.rowsBetween(-89, 0)
    fit = F.regr_slope(ta.close(), F.col("n")).over(w) * F.col("n") + F.regr_intercept(ta.close(), F.col("n")).over(w)
    return rounded(df.select("symbol", "day", F.col("w10").alias("wma_10"), ta.weighted(F.col("raw"), ta.linear_weights(4)).alias("hma_20"), F.when(F.count(ta.close()).over(w) >= 20, fit).alias("ols_end"), F.when(F.count(ta.close()).over(v) >= 90, F.corr("close", "volume").over(v)).alias("corr_90")))


@query(f"""WITH {BARS_SQL}, a AS (SELECT *, list(close) {frame(365, 1)} AS past FROM bars)
SELECT symbol, day, CASE WHEN len(past) >= 90 THEN round(2.0 * len(list_filter(past, lambda x: x <= close)) / len(past) - 1, 6) END AS extreme FROM a""")
def percentile_extreme(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fold(bars(spark, d).select("symbol", "day", "close"), [Recursion("extreme", "close", partial(percentile_of_last, window=365, least=90))]).drop("close"))


@query(f"""WITH {BARS_SQL}, a AS (SELECT *, floor(close / 100) AS level FROM bars), b AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) {W} THEN day END AS changed FROM a)
SELECT symbol, day, date_diff('day', last_value(changed IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), day)::INTEGER AS age,
round(pow(2, -date_diff('day', last_value(changed IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), day) / 30.0), 6) AS freshness FROM b""")
def days_since_change(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).withColumn("level", F.floor(ta.close() / 100))
    changed = F.when(~F.col("level").eqNullSafe(O.lag(F.col("level"))), F.col("day"))
    df = df.withColumn("changed", changed).withColumn("age", F.datediff("day", O.last_known(F.col("changed"))))
    return rounded(df.select("symbol", "day", "age", F.pow(F.lit(2.0), -F.col("age") / 30.0).alias("freshness")))


@query(f"""WITH {BARS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume, day) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
SELECT symbol, least((r - 1) * 3 // (n - 1), 2)::INTEGER AS tercile, count(*) AS n, round(avg(close), 6) AS mean_close FROM a GROUP BY 1, 2""", date=None)
def rank_buckets(spark: SparkSession, d: str) -> DataFrame:
    k = Window.partitionBy("symbol")
    df = bars(spark, d).withColumns({"r": F.row_number().over(k.orderBy("volume", "day")), "k": F.count(F.lit(1)).over(k)})
    return rounded(df.groupBy("symbol", bucket_of_rank(F.col("r"), F.col("k"), 3).alias("tercile")).agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close")))


@query(f"""WITH RECURSIVE {MARKET_SQL}, s AS (SELECT min(day) AS day FROM bars UNION ALL SELECT (SELECT min(b.day) FROM bars b WHERE b.day >= s.day + 7) FROM s WHERE (SELECT min(b.day) FROM bars b WHERE b.day >= s.day + 7) IS NOT NULL) SELECT day FROM s""")
def spaced_sample(spark: SparkSession, d: str) -> DataFrame:
    df = fold(market_bars(spark, d).select("symbol", "day", F.unix_date("day").cast("double").alias("k")), [Recursion("taken", "k", partial(spaced, gap=7))])
    return df.where(F.col("taken") == 1).select("day")


@query(f"""WITH {BARS_SQL}, a AS (SELECT *, close < lag(close) {W} AS down FROM bars), b AS (SELECT *, sum(CASE WHEN down IS DISTINCT FROM lagged THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(down) {W} AS lagged FROM a)),
r AS (SELECT symbol, run, count(*) AS length FROM b WHERE down GROUP BY 1, 2) SELECT symbol, length, count(*) AS runs FROM r GROUP BY 1, 2""", date=None)
def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).withColumn("down", ta.close() < O.lag(ta.close()))
    df = df.withColumn("turn", (~F.col("down").eqNullSafe(O.lag(F.col("down")))).cast("int"))
    df = df.withColumn("run", F.sum("turn").over(O.spec.rowsBetween(Window.unboundedPreceding, 0)))
    return df.where("down").groupBy("symbol", "run").agg(F.count(F.lit(1)).alias("length")).groupBy("symbol", "length").agg(F.count(F.lit(1)).alias("runs"))


@query(f"""WITH {BARS_SQL} SELECT symbol, day, round(min(close) OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 30 DAY FOLLOWING) / close - 1, 6) AS drawdown FROM bars""")
def forward_drawdown(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d)
    return rounded(df.select("symbol", "day", lv.forward_drawdown(df).alias("drawdown")))


# ---- indicators


@query(f"""WITH {BARS_SQL}, a AS (SELECT *, (high + low) / 2 AS mid, (high + low + close) / 3 AS tp FROM bars), b AS (SELECT *, abs(mid - lag(mid, 5) {W}) AS mv FROM a),
m AS (SELECT *, {roll('sum', '(mv * mid)', 5)} / nullif({roll('sum', 'mv', 5)}, 0) AS f, {roll('avg', 'tp', 20)} AS tpm, max(high) {frame(100)} AS hi, min(low) {frame(100)} AS lo FROM b),
z AS (SELECT *, (f - {roll('avg', 'f', 20)}) / CASE WHEN {roll('stddev_pop', 'f', 20)} > 1e-12 THEN {roll('stddev_pop', 'f', 20)} END AS z, abs(tp - tpm) AS off FROM m)
SELECT symbol, day, round({roll('avg', 'z', 3)}, 5) AS vz_score, round((close - (lo + (hi - lo) / 2)) / nullif((hi - lo) / 2, 0), 5) AS range_oscillator, round((tp - tpm) / nullif(0.015 * {roll('avg', 'off', 20)}, 0), 5) AS commodity_channel FROM z""")
def mean_reversion_indicators(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ta.mean_reversion(bars(spark, d)), 5)


@query(f"""WITH {BARS_SQL}, a AS (SELECT *, (high + low) / 2 AS mid, close / (max(high) {frame(55)}) * 100 - 100 AS dd, ln(close / lag(close) {W}) AS ch, greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS tr,
 high - lag(high) {W} AS up, lag(low) {W} - low AS dn, CASE WHEN close > open THEN close - open ELSE 0 END AS g, CASE WHEN close <= open THEN open - close ELSE 0 END AS ls FROM bars),
b AS (SELECT *, {roll('avg', 'mid', 19)} AS mm, {roll('stddev_pop', 'ch', 21)} * sqrt(252) * 100 AS hvi, CASE WHEN up IS NOT NULL THEN greatest(up, 0) END AS p, CASE WHEN dn IS NOT NULL THEN greatest(dn, 0) END AS q, {roll('avg', 'close', 21)} AS cm FROM a),
e AS (SELECT *, mid - lag(mm, 10) {W} AS off, 100 * {roll('sum', 'p', 14)} / nullif({roll('sum', 'tr', 14)}, 0) AS dip, 100 * {roll('sum', 'q', 14)} / nullif({roll('sum', 'tr', 14)}, 0) AS dim FROM b),
x AS (SELECT *, 100 * abs(dip - dim) / nullif(dip + dim, 0) AS dx FROM e)
SELECT symbol, day, round(dd - {roll('avg', 'dd', 1000)}, 5) AS leverage_drawdown, round({roll('avg', 'off', 19)}, 5) AS detrended, round(100 * {roll('sum', 'g', 14)} / nullif({roll('sum', 'g', 14)} + {roll('sum', 'ls', 14)}, 0), 5) AS imi,
round({roll('avg', 'dx', 14)}, 5) AS adx, round(100 * {roll('stddev_pop', 'ch', 30)}, 5) AS volatility_30, round(abs(close - cm) / nullif(cm, 0) * 100 / nullif({roll('avg', 'hvi', 21)}, 0) * 100, 5) AS ls_volatility, round(tr, 5) AS true_range FROM x""")
def trend_indicators(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ta.trend_windows(bars(spark, d)), 5)


def _ema(x: str, state: str, span: int, alpha: str | None = None) -> str:
    """SQL of one step of an exponential mean that starts at the first value."""
    return f"CASE WHEN r.{state} IS NULL THEN o.{x} WHEN o.{x} IS NULL THEN r.{state} ELSE r.{state} + {alpha or f'2.0 / {span + 1}'} * (o.{x} - r.{state}) END AS {state}"


def _rma(x: str, state: str, n: int = 14) -> str:
    return f"CASE WHEN o.n = {n} THEN o.{x}_seed WHEN o.n > {n} THEN r.{state} + (o.{x} - r.{state}) / {n} END AS {state}"


def _high_pass(state: str, period: int) -> str:
    a = f"exp(-1.414 * pi() / {period})"
    c2, c3 = f"2 * {a} * cos(1.414 * pi() / {period})", f"(-{a} * {a})"
    return f"CASE WHEN o.n <= 2 THEN 0 ELSE (1 + {c2} - {c3}) / 4 * (o.close - 2 * o.c1 + o.c2) + {c2} * r.{state} + {c3} * r.{state}_before END AS {state}, r.{state} AS {state}_before"


def _recursion(name: str, source: str, states: list[str], first: list[str]) -> str:
    """A table `name` that follows the rows of `source` by symbol and n; first: the states of the first row."""
    return f"{name} AS (SELECT o.symbol, o.day, o.n, {', '.join(first)} FROM {source} o WHERE n = 1 UNION ALL SELECT o.symbol, o.day, o.n, {', '.join(states)} FROM {name} r JOIN {source} o ON o.symbol = r.symbol AND o.n = r.n + 1)"


_STRENGTH = "CASE WHEN {d} = 0 THEN 100 WHEN {u} = 0 THEN 0 ELSE 100 - 100 / (1 + {u} / {d}) END"
_EMAS = [("sv", "e_sv", 21), ("volume", "e_v", 21), ("sc", "e_sc", 21), ("close", "e_c21", 21), ("close", "e_fast", 23), ("close", "e_slow", 50), ("close", "e5", 5), ("wl", "wls", 3), ("close", "e55", 55), ("rdiff", "rel", 3), ("span", "spread", 3)]
_CMO = (5, 10, 20)
_INDICATORS = f"""WITH RECURSIVE {BARS_SQL}, i0 AS (SELECT *, row_number() {W} AS n, close - lag(close) {W} AS ch, lag(close) {W} AS c1, lag(close, 2) {W} AS c2, (high + low + close) / 3 AS tp FROM bars),
i1 AS (SELECT *, greatest(ch, 0) + (ch * 0) AS gain, greatest(-ch, 0) + (ch * 0) AS loss, CASE WHEN close > c1 THEN volume WHEN close < c1 THEN -volume ELSE 0 END AS sv, CASE WHEN close > c1 THEN close WHEN close < c1 THEN -close ELSE 0 END AS sc, tp - lag(tp) {W} AS tpc, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr,
 {_lags('close', [max(14 - i - 14 / 3, 0.0) for i in range(15)])} AS wl, CASE WHEN tp > lag(tp) {W} THEN tp * volume ELSE 0 END AS fu, CASE WHEN tp < lag(tp) {W} THEN tp * volume ELSE 0 END AS fd, close - ({roll('max', 'high', 10)} + {roll('min', 'low', 10)}) / 2 AS rdiff, {roll('max', 'high', 10)} - {roll('min', 'low', 10)} AS span FROM i0),
i2 AS (SELECT *, {', '.join(f"coalesce(100 * ({roll('sum', 'coalesce(gain, 0)', k)} - {roll('sum', 'coalesce(loss, 0)', k)}) / nullif({roll('sum', 'coalesce(gain, 0)', k)} + {roll('sum', 'coalesce(loss, 0)', k)}, 0), 0) AS cmo{k}" for k in _CMO)}, {', '.join(f'avg({x}) {frame(None)} AS {x}_seed' for x in ('gain', 'loss', 'volume'))}, {roll('avg', 'close', 4)} AS m4, {roll('avg', 'close', 12)} AS m12 FROM i1),
{_recursion('ra', 'i2', [_ema(x, s, k) for x, s, k in _EMAS] + [_ema('tr', 'atr', 0, '1.0 / 89'), _rma('gain', 'ru'), _rma('loss', 'rd'), _rma('volume', 'rv'), _high_pass('hp250', 250), _high_pass('hp40', 40), 'CASE WHEN o.n = 4 THEN o.m4 WHEN o.n > 4 THEN (r.s4 * 3 + o.close) / 4 END AS s4', 'CASE WHEN o.n = 12 THEN o.m12 WHEN o.n > 12 THEN (r.s12 * 11 + o.close) / 12 END AS s12'] + [_ema(f'cmo{k}', f'd{k}', 3) for k in _CMO],
    [f'CAST(o.{x} AS DOUBLE) AS {s}' for x, s, _ in _EMAS] + ['o.tr AS atr', *[f'CAST(NULL AS DOUBLE) AS {x}' for x in ('ru', 'rd', 'rv')], *[f'0.0::DOUBLE AS {x}' for x in ('hp250', 'hp250_before', 'hp40', 'hp40_before')], 'CAST(NULL AS DOUBLE) AS s4', 'CAST(NULL AS DOUBLE) AS s12'] + [f'o.cmo{k} AS d{k}' for k in _CMO])},
i3 AS (SELECT i2.symbol, i2.day, i2.n, i2.open, high, low, close, volume, tpc, fu, fd, ra.* EXCLUDE (symbol, day, n), e_fast - e_slow AS macd, {', '.join(f'CASE WHEN i2.n >= 3 THEN d{k} END AS ds{k}' for k in _CMO)}, CASE WHEN i2.n >= 12 THEN rel END AS rels, CASE WHEN i2.n >= 12 THEN spread END AS spreads, CASE WHEN i2.n >= 55 THEN e55 END AS e55s, CASE WHEN i2.n >= 89 THEN atr END AS atrs,
 coalesce(least(greatest(abs(volume - lag(volume, 14) OVER z) / nullif(CASE WHEN count(dv) OVER q >= 14 THEN sum(dv) OVER q END, 0), 0), 1) + abs(volume - lag(volume, 14) OVER z) * 0 + CASE WHEN count(dv) OVER q >= 14 AND sum(dv) OVER q <> 0 THEN 0 END, 0) AS er
 FROM (SELECT *, abs(volume - lag(volume) {W}) AS dv FROM i2) i2 JOIN ra ON ra.symbol = i2.symbol AND ra.n = i2.n WINDOW z AS (PARTITION BY i2.symbol ORDER BY i2.day), q AS (PARTITION BY i2.symbol ORDER BY i2.day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
i4 AS (SELECT *, rv + pow(er * (2 / 3 - 2 / 31) + 2 / 31, 2) * (volume - rv) AS smv, CASE WHEN high >= e55s THEN high ELSE low END AS anchor, 100 * (macd - {roll('min', 'macd', 10)}) / nullif({roll('max', 'macd', 10)} - {roll('min', 'macd', 10)}, 0) AS k, CASE WHEN spreads <> 0 THEN rels / (spreads / 2) * 100 WHEN spreads = 0 THEN 0 END AS smi_raw,
 ({_STRENGTH.format(u='ru', d='rd')} + (100 - 100 / (1 + {roll('sum', 'fu', 14)} / nullif({roll('sum', 'fd', 14)}, 0)))) / 2 AS blend FROM i3),
i5 AS (SELECT *, CASE WHEN tpc IS NOT NULL THEN greatest(tpc, 0) END * smv AS vup, CASE WHEN tpc IS NOT NULL THEN greatest(-tpc, 0) END * smv AS vdown, abs(anchor - e55s) / nullif(e55s, 0) * 100 / nullif(atrs, 0) * 100 AS ls, {roll('avg', 'smi_raw', 5)} AS smi5,
 0.6 * (blend - 50) / 50 + 0.25 * CASE WHEN blend IS NOT NULL THEN greatest(least((blend - 50) / 18, 2), -2) END / 2 + 0.15 * CASE WHEN {roll('stddev_samp', 'close', 14)} > 0 AND e_c21 IS NOT NULL THEN greatest(least((e5 - e_c21) / {roll('stddev_samp', 'close', 14)}, 3), -3) END / 3 AS comp FROM i4),
i6 AS (SELECT *, avg(vup) {frame(None)} AS vup_seed, avg(vdown) {frame(None)} AS vdown_seed, count(smi5) {frame(None)} AS smi_n FROM i5),
{_recursion('rb', 'i6', [_ema('k', 'd', 3), _ema('comp', 'rmi', 3), _ema('smi5', 'smi', 10), _rma('vup', 'vru'), _rma('vdown', 'vrd'), *[_ema(f'ds{k}', f'dd{k}', 3) for k in _CMO]], ['o.k AS d', 'o.comp AS rmi', 'o.smi5 AS smi', 'CAST(NULL AS DOUBLE) AS vru', 'CAST(NULL AS DOUBLE) AS vrd', *[f'o.ds{k} AS dd{k}' for k in _CMO]])},
i7 AS (SELECT i6.*, rb.* EXCLUDE (symbol, day, n), {', '.join(f'CASE WHEN i6.n >= 5 THEN 2 * ds{k} - dd{k} END AS de{k}' for k in _CMO)}, {_STRENGTH.format(u='vru', d='vrd')} AS vrsi FROM i6 JOIN rb ON rb.symbol = i6.symbol AND rb.n = i6.n),
i8 AS (SELECT *, 100 * (d - {roll('min', 'd', 10)}) / nullif({roll('max', 'd', 10)} - {roll('min', 'd', 10)}, 0) AS kd FROM i7),
{_recursion('rc', 'i8', [_ema('kd', 'stc', 3), _ema('vrsi', 've', 14)], ['o.kd AS stc', 'o.vrsi AS ve'])}
SELECT i8.symbol, i8.day, round(CASE WHEN ru = 0 THEN 0 WHEN rd = 0 THEN 100 ELSE 100 - 100 / (1 + ru / rd) END, 5) AS rsi, round(100 * e_sv / nullif(e_v, 0), 5) AS vzo, round(100 * e_sc / nullif(e_c21, 0), 5) AS pzo, round(CASE WHEN stc IS NOT NULL THEN greatest(least(stc, 100), 0) END - 50, 5) AS schaff, round(wls - lag(wls) OVER w, 5) AS trend_sniper, round(rmi, 5) AS rmi, round(hp250 - hp40, 5) AS precision_trend,
round(ve + 2 / 15 * (vrsi - ve) - 50, 5) AS volume_rsi, round(s4 - s12, 5) AS ma_momentum, round(({' + '.join(f'sd{k} * de{k}' for k in _CMO)}) / nullif({' + '.join(f'sd{k}' for k in _CMO)}, 0), 5) AS cmo_momentum, round(CASE WHEN smi_n >= 10 THEN smi END, 5) AS slow_stochastic, round(CASE WHEN count(ls) OVER v >= 89 THEN (ls - min(ls) OVER v) * 100 / nullif(max(ls) OVER v - min(ls) OVER v, 0) END, 5) AS ls_normalized
FROM (SELECT *, {', '.join(f'{roll("stddev_pop", "close", k)} AS sd{k}' for k in _CMO)} FROM i8) i8 JOIN rc ON rc.symbol = i8.symbol AND rc.n = i8.n WINDOW w AS (PARTITION BY i8.symbol ORDER BY i8.day), v AS (PARTITION BY i8.symbol ORDER BY i8.day ROWS BETWEEN 88 PRECEDING AND CURRENT ROW)"""


@query(_INDICATORS)
def recursive_indicators(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ta.recursive(bars(spark, d)), 5)


@query(f"""WITH {BARS_SQL}, a AS (SELECT *, 2 * {_lags('close', ta.linear_weights(10))} - {_lags('close', ta.linear_weights(20))} AS raw, row_number() {W} AS n FROM bars), b AS (SELECT *, open - (({roll('max', 'high', 20)} + {roll('min', 'low', 20)}) / 2 + {_lags('raw', ta.linear_weights(4))}) / 2 AS y FROM a)
SELECT symbol, day, round(CASE WHEN count(y) {frame(20)} >= 20 THEN regr_slope(y, n) {frame(20)} * n + regr_intercept(y, n) {frame(20)} END, 5) AS squeeze_momentum FROM b""")
def squeeze_momentum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ta.squeeze_momentum(bars(spark, d)), 5)


@query(f"""WITH {BARS_SQL} SELECT symbol, day, round((volume - avg(volume) OVER s) / nullif(stddev_samp(volume) OVER s, 0), 6) AS volume, round(CASE WHEN max(close) OVER s = min(close) OVER s THEN 0 ELSE (close - min(close) OVER s) / (max(close) OVER s - min(close) OVER s) * 2 - 1 END, 6) AS close FROM bars WINDOW s AS (PARTITION BY symbol)""")
def category_scaling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ta.categories(bars(spark, d), ["volume"], ["close"]))


# ---- scalar expressions


@query("""SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-greatest(least(l_discount * 10 - 0.5, 40), -40))), 6) AS sig, round(tanh(l_tax * 5), 6) AS tanh_score,
round((l_quantity + l_discount) / 2, 6) AS mean2, round((0.6 * l_quantity + 0.4 * l_tax) / 1.0, 6) AS weighted, CASE WHEN abs(l_discount) <= 2 THEN round(l_extendedprice * exp(l_discount), 4) END AS price,
trim(regexp_replace(lower(trim(l_returnflag || ' Flag ' || l_linestatus)), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
round(-((l_quantity / (l_quantity + 25)) * ln(l_quantity / (l_quantity + 25)) + (25 / (l_quantity + 25)) * ln(25 / (l_quantity + 25))) / ln(2), 6) AS entropy FROM lineitem""", date=None)
def scalar_scores(spark: SparkSession, d: str) -> DataFrame:
    q, dis, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rounded_column(sigmoid(dis * 10 - 0.5), 6).alias("sig"), rounded_column(F.tanh(tax * 5), 6).alias("tanh_score"), rounded_column(row_mean([q, dis]), 6).alias("mean2"), rounded_column(weighted_mean([q, tax], [0.6, 0.4]), 6).alias("weighted"), rounded_column(project_price(F.col("l_extendedprice"), dis), 4).alias("price"), slug(F.concat_ws(" ", F.col("l_returnflag"), F.lit("Flag"), F.col("l_linestatus"))).alias("slug"), rounded_column(entropy([q, F.lit(25.0)]), 6).alias("entropy"))


# ---- valuation


@query(f"""WITH {MARKET_SQL}, n AS (SELECT day, close, sum(trades) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS n FROM bars), k AS (SELECT quantile_cont(close / (n * n), 0.5) AS k FROM n) SELECT day, round(k * n * n, 6) AS value, round(ln(close / (k * n * n)), 6) AS gap FROM n, k""")
def network_value(spark: SparkSession, d: str) -> DataFrame:
    df = market_bars(spark, d).withColumn("n", F.sum("trades").over(O.spec.rowsBetween(Window.unboundedPreceding, 0)))
    k = F.percentile(ta.close() / (F.col("n") * F.col("n")), 0.5).over(O.whole())
    df = df.withColumn("value", k * F.col("n") * F.col("n"))
    return rounded(df.select("day", "value", F.ln(ta.close() / F.col("value")).alias("gap")))


@query(f"""WITH {MARKET_SQL}, s AS (SELECT * FROM {_STEPS}), a AS (SELECT b.symbol, b.day, b.close, b.volume, coalesce(s.step, 34.0::DOUBLE) AS step FROM bars b ASOF LEFT JOIN s ON b.day >= s.day)
SELECT day, round(least(greatest({roll('avg', 'step', 365, 1)}, 10), 800) * volume * 24 * (0.04 + 0.001 * (year(day) - 1995)) / 1000, 6) AS energy_value FROM a""")
def energy_value(spark: SparkSession, d: str) -> DataFrame:
    steps = spark.sql("SELECT 'ALL' AS symbol, * FROM VALUES (DATE '1995-06-01', 34.0D), (DATE '1997-01-15', 29.5D), (DATE '1998-09-01', 21.5D), (DATE '2000-03-10', 18.0D) AS s(day, step)")
    df = rel.as_of(market_bars(spark, d), steps, "day", "step", ["symbol"], fill_head=True)
    return rounded(df.select("day", (clip(O.mean(F.col("step"), 365, 1), 10, 800) * F.col("volume") * 24 * (0.04 + 0.001 * (F.year("day") - 1995)) / 1000).alias("energy_value")))


@query(f"""WITH {BARS_SQL}, a AS (SELECT *, ln(close) AS x FROM bars) SELECT symbol, day, round(CASE WHEN (x - {roll('avg', 'x', None, 30)}) / nullif({roll('stddev_samp', 'x', None, 30)}, 0) IS NOT NULL THEN greatest(least((x - {roll('avg', 'x', None, 30)}) / nullif({roll('stddev_samp', 'x', None, 30)}, 0), 3), -3) END, 6) AS causal_z,
round((close - {roll(_Q % 0.05, 'close', None, 30)}) / nullif({roll(_Q % 0.95, 'close', None, 30)} - {roll(_Q % 0.05, 'close', None, 30)}, 0) * 2 - 1, 6) AS equalised FROM a""")
def causal_transforms(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).withColumn("x", F.ln(ta.close()))
    x = F.col("x")
    df = fold(df.select("symbol", "day", "close", "x"), [Recursion(n, "close", partial(running_quantile, level=q, window=None, least=30)) for n, q in (("low", 0.05), ("high", 0.95))])
    low, high = F.col("low"), F.col("high")
    return rounded(df.select("symbol", "day", clip(ratio(x - O.mean(x, None, 30), O.deviation(x, None, 30)), -3, 3).alias("causal_z"), (ratio(ta.close() - low, high - low) * 2 - 1).alias("equalised")))


@query()
def principal_components(spark: SparkSession, d: str) -> DataFrame:
    columns = ["open", "high", "low", "close", "volume"]
    df = market_bars(spark, d)
    mean, load, _ = sp.principal(df, columns)
    return rounded(df.select("day", *[sp.scores(df, columns, mean, load[i]).alias(f"pc{i + 1}") for i in range(2)]), 4)


# ---- leverage


_LEV = f"""{BARS_SQL}, a AS (SELECT symbol, day, close, ln(close / lag(close) {W}) AS r, volume - lag(volume, 7) {W} AS oi FROM bars), b AS (SELECT *, {roll('stddev_samp', 'r', 30, 20)} AS sigma FROM a),
h AS (SELECT *, quantile_cont(oi, 0.9) OVER p AS high_reference, count(oi) OVER p AS known FROM b WINDOW p AS (PARTITION BY symbol, oi > 0 ORDER BY day ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CASE WHEN oi <= 0 THEN 0 WHEN oi IS NULL OR known < 60 THEN NULL WHEN high_reference <= 0 THEN 0 ELSE least(greatest(100 * oi / high_reference, 0), 100) END AS fuel FROM h)"""


@query(f"""WITH {_LEV} SELECT symbol, day, round(fuel, 6) AS fuel, round(CASE WHEN r IS NOT NULL AND sigma IS NOT NULL THEN least(greatest((abs(r) / greatest(sigma, 0.005) - 0.75) / 1.75 * 100, 0), 100) END, 6) AS trigger, round(least(greatest(2 * coalesce(nullif(sigma, 0), 0.005) * sqrt(7) * 10000, 150), 1200), 6) AS band,
CASE WHEN fuel IS NULL THEN '' WHEN fuel >= 65 THEN 'cascade-ready' WHEN fuel >= 35 THEN 'watch' WHEN fuel > 0 THEN 'building' ELSE 'none' END AS state FROM f""")
def leverage_scores(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).withColumns({"r": F.ln(ta.close() / O.lag(ta.close())), "oi": O.diff(F.col("volume"), 7)})
    df = lv.with_amount_scores(df.withColumn("sigma", O.deviation(F.col("r"), 30, 20)), {"fuel": "oi"})
    return rounded(df.select("symbol", "day", "fuel", lv.trigger(F.col("r"), F.col("sigma")).alias("trigger"), lv.cascade_band(F.col("sigma")).alias("band"), lv.threshold_state(F.col("fuel")).alias("state")))


def _robust(x: str, name: str, source: str) -> str:
    """SQL of the robust score of `x`, as a chain of common tables that ends in `name`."""
    return f"""{name}_p AS (SELECT *, quantile_cont({x}, 0.5) {frame(365, 1)} AS m, stddev_pop({x}) {frame(365, 1)} AS s, list({x}) {frame(365, 1)} AS past FROM {source}),
{name}_q AS (SELECT *, 1.4826 * list_aggregate(list_transform(past, lambda v: abs(v - m)), 'median') AS mad FROM {name}_p), {name}_z AS (SELECT *, CASE WHEN mad > 1e-12 THEN mad WHEN s > 1e-12 THEN s END AS scale FROM {name}_q),
{name} AS (SELECT * EXCLUDE (m, s, past, mad, scale), CASE WHEN {x} IS NOT NULL AND len(past) >= 60 THEN CASE WHEN scale IS NULL THEN 0 ELSE 100 * tanh(greatest(least(({x} - m) / scale, 4), -4) / 2) END END AS {name}_score FROM {name}_z)"""


@query(f"WITH {BARS_SQL}, {_robust('volume', 'v', 'bars')} SELECT symbol, day, round(v_score, 6) AS score FROM v")
def robust_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lv.with_robust_score(bars(spark, d), "volume", "score").select("symbol", "day", "score"))


@query(f"""WITH {BARS_SQL}, {_robust('volume', 'f', 'bars')}, t AS (SELECT * FROM f WHERE trades % 3 > 0), {_robust('trades', 'p', 't')},
j AS (SELECT f.symbol, f.day, f.f_score AS a, p.p_score AS b, f.close FROM f LEFT JOIN p ON p.symbol = f.symbol AND p.day = f.day)
SELECT symbol, day, round(-CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (0.6 * a + 0.4 * b) / (0.6 + 0.4) END, 6) AS crowding, round(greatest(least(-(close / 100 - 5) / 20 * 100, 100), -100), 6) AS impulse FROM j""")
def crowding_scores(spark: SparkSession, d: str) -> DataFrame:
    """Funding (volume here) and predicted funding (trades, not there on every day) against their own past."""
    b = lv.with_robust_score(bars(spark, d), "volume", "funding")
    predicted = lv.with_robust_score(bars(spark, d).where(F.col("trades") % 3 > 0), "trades", "predicted").select("symbol", "day", "predicted")
    df = b.join(predicted, ["symbol", "day"], "left")
    return rounded(df.select("symbol", "day", lv.crowding(F.col("funding"), F.col("predicted")).alias("crowding"), lv.impulse(ta.close() / 100 - 5).alias("impulse")))


@query("""WITH w AS (SELECT CAST(ts AS DATE) AS day, event_type, event_id, value * 10 AS dist, value AS notional, CASE WHEN user_id % 2 = 0 THEN 'up' ELSE 'down' END AS side FROM events),
s AS (SELECT *, notional * 100 * exp(-0.5 * pow(dist / 300.0, 2)) AS score FROM w), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY day, event_type, side ORDER BY score DESC, abs(dist)) = 1)
SELECT day, event_type, side, round(dist, 6) AS distance_bps, round(notional, 6) AS notional, round(score, 6) AS score FROM b""")
def best_walls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type", (F.col("value") * 10).alias("distance_bps"), F.col("value").alias("notional"), F.lit(300.0).alias("band"), F.when(F.col("user_id") % 2 == 0, "up").otherwise("down").alias("side"))
    return rounded(lv.best_walls(e, ["day", "event_type"]))


_JUMP = ", ".join(f"CASE WHEN count(close) OVER w{x} = {x} AND date_diff('day', day, lead(day, {x}) {W}) = {x} THEN CASE WHEN abs(max(close) OVER w{x} / close - 1) >= abs(min(close) OVER w{x} / close - 1) THEN max(close) OVER w{x} / close - 1 ELSE min(close) OVER w{x} / close - 1 END END AS j{x}" for x in (1, 3, 7))


@query(f"""WITH {BARS_SQL}, j AS (SELECT symbol, day, {_JUMP} FROM bars WINDOW {', '.join(f'w{x} AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {x} FOLLOWING)' for x in (1, 3, 7))})
SELECT symbol, day, {', '.join(f"round(j{x}, 6) AS jump_{x}, CASE WHEN j{x} >= 0.01 THEN 1 WHEN j{x} <= -0.01 THEN -1 WHEN j{x} IS NOT NULL THEN 0 END AS direction_{x}" for x in (1, 3, 7))} FROM j""")
def jump_labels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lv.jump_labels(bars(spark, d)).select("symbol", "day", *[x for n in (1, 3, 7) for x in (f"jump_{n}", f"direction_{n}")]))


# ---- forecasts


_PIN = "greatest({q} * (y - {n}), ({q} - 1) * (y - {n}))"
_PB = "(" + " + ".join(_PIN.format(q=q, n=n) for q, n in zip(fc.LEVELS, fc.NAMES, strict=True)) + ") / 5"
_I = "(({b}) - ({a}) + {k} * greatest(({a}) - y, 0) + {k} * greatest(y - ({b}), 0))"
_W1 = "0.5 * abs(y - q50) + 0.25 * " + _I.format(a="q25", b="q75", k=4) + " + 0.25 * " + _I.format(a="q05", b="q95", k=20)
_W2 = "(0.5 * abs(y - q50) + 0.05 * " + _I.format(a="q05", b="q95", k=20) + " + 0.25 * " + _I.format(a="q25", b="q75", k=4) + ") / 2.5"
_TARGETS = f"{BARS_SQL}, hz AS (SELECT unnest([1, 3, 7, 15]) AS horizon), t AS (SELECT symbol, day, horizon, " + "ln(close / lag(close, horizon) OVER (PARTITION BY symbol, horizon ORDER BY day)) AS past, ln(lead(close, horizon) OVER (PARTITION BY symbol, horizon ORDER BY day) / close) AS y FROM bars, hz)"


def _cone_sql(n: int | None) -> str:
    f = f"OVER (PARTITION BY symbol, horizon ORDER BY day ROWS BETWEEN {'UNBOUNDED' if n is None else n - 1} PRECEDING AND CURRENT ROW)"
    return f"SELECT symbol, day, horizon, y, q[1] AS q05, q[2] AS q25, q[3] AS q50, q[4] AS q75, q[5] AS q95 FROM (SELECT *, count(past) {f} AS k, quantile_cont(past, [0.05, 0.25, 0.5, 0.75, 0.95]) {f} AS q FROM t) WHERE k >= 180"


_SUMMARY = f"""count(*) AS observations, round(avg({_PB}), 6) AS avg_pinball, round(avg({_W1}), 6) AS wis, round(avg({_W2}), 6) AS wis_c, round(2 * avg({_PB}), 6) AS crps, round(avg((y >= q25 AND y <= q75)::INT), 6) AS coverage_50, round(avg((y >= q05 AND y <= q95)::INT), 6) AS coverage_90,
round(avg(q75 - q25), 6) AS width_50, round(avg(q95 - q05), 6) AS width_90, round(avg((y < q05)::INT), 6) AS q05_miss_rate, round(avg((y > q95)::INT), 6) AS q95_miss_rate, round(avg(CASE WHEN y <> 0 AND q50 <> 0 THEN (sign(y) = sign(q50))::INT END), 6) AS hit_rate,
round(avg(CASE WHEN abs(q50) > 1e-12 THEN sign(q50) ELSE 0 END * (exp(y) - 1) - CASE WHEN abs(q50) > 1e-12 THEN 1 ELSE 0 END * 0.003), 6) AS mean_net_return, round(corr(q50, y), 6) AS corr"""


@query(f"WITH {_TARGETS}, f AS ({_cone_sql(None)}) SELECT symbol, horizon, {_SUMMARY} FROM f WHERE y IS NOT NULL GROUP BY symbol, horizon", date=None)
def forecast_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.summarise(fc.with_losses(fc.cone(fc.forward_targets(bars(spark, d)))), ["symbol", "horizon"]))


def _panel(spark: SparkSession, d: str) -> DataFrame:
    t = fc.forward_targets(bars(spark, d))
    # the random walk has a row wherever the window does
    window = F.struct(F.lit("window_365").alias("forecaster"), *fc.NAMES)
    zeros = F.struct(F.lit("random_walk").alias("forecaster"), *[F.lit(0.0).alias(n) for n in fc.NAMES])
    both = fc.window_cone(t).select("symbol", "day", "horizon", "close", "actual", F.explode(F.array(window, zeros)).alias("f")).select("symbol", "day", "horizon", "close", "actual", "f.*")
    return fc.with_losses(fc.cone(t).withColumn("forecaster", F.lit("expanding")).unionByName(both))


_PANEL = f"""{_TARGETS}, e AS ({_cone_sql(None)}), v AS ({_cone_sql(365)}), f AS (SELECT 'expanding' AS forecaster, * FROM e UNION ALL SELECT 'window_365', * FROM v UNION ALL SELECT 'random_walk', symbol, day, horizon, y, 0, 0, 0, 0, 0 FROM v)"""


@query(f"WITH {_PANEL} SELECT forecaster, symbol, horizon, {_SUMMARY} FROM f WHERE y IS NOT NULL GROUP BY forecaster, symbol, horizon".replace("round(corr(q50, y), 6) AS corr", "round(CASE WHEN stddev_pop(q50) > 0 THEN corr(q50, y) END, 6) AS corr"), date=None)
def forecaster_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.summarise(_panel(spark, d), ["forecaster", "symbol", "horizon"]))


@query(f"""WITH {_PANEL}, s AS (SELECT *, {_W1} AS wis, {_PB} AS pb FROM f), w AS (""" + " UNION ALL ".join(f"SELECT symbol, day, horizon, forecaster, avg(wis) OVER x AS mw, avg(pb) OVER x AS mp, count(wis) OVER x AS n FROM s WHERE horizon = {x} WINDOW x AS (PARTITION BY symbol, horizon, forecaster ORDER BY day ROWS BETWEEN {364 + x} PRECEDING AND {x} PRECEDING)" for x in fc.HORIZONS) + """), k AS (SELECT *, min(CASE WHEN forecaster = 'expanding' THEN mw END) OVER (PARTITION BY symbol, horizon, day) AS base FROM w WHERE n >= 120)
SELECT symbol, horizon, selected, count(*) AS days FROM (SELECT symbol, horizon, day, arg_min(forecaster, (round(mw, 12), round(mp, 12), forecaster)) AS selected FROM k WHERE forecaster = 'expanding' OR mw < base * 0.99 GROUP BY ALL) GROUP BY ALL""", date=None)
def walk_forward_selection(spark: SparkSession, d: str) -> DataFrame:
    return fc.realised_selection(_panel(spark, d), "expanding").groupBy("symbol", "horizon", "selected").agg(F.count(F.lit(1)).alias("days"))


_AT = ", ".join(f"arg_max(v, mid) FILTER (WHERE mid <= {q}) AS a{i}, max(mid) FILTER (WHERE mid <= {q}) AS ma{i}, arg_min(v, mid) FILTER (WHERE mid >= {q}) AS b{i}, min(mid) FILTER (WHERE mid >= {q}) AS mb{i}" for i, q in enumerate(fc.LEVELS))


@query(f"""WITH {_TARGETS.replace(BARS_SQL, MARKET_SQL)}, n AS (SELECT *, count(past) OVER (PARTITION BY horizon ORDER BY day ROWS UNBOUNDED PRECEDING) AS kc FROM t), j AS (SELECT i.horizon, i.day, i.kc, k.past AS v, k.kc AS p, pow(0.5, (i.kc - k.kc) / 180.0) AS w FROM n i JOIN n k ON k.horizon = i.horizon AND k.past IS NOT NULL AND k.kc <= i.kc AND k.day <= i.day WHERE i.kc >= 180),
c AS (SELECT horizon, day, v, (sum(w) OVER (PARTITION BY horizon, day ORDER BY v, p ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY horizon, day) AS mid FROM j), q AS (SELECT horizon, day, {_AT} FROM c GROUP BY 1, 2)
SELECT n.symbol, n.day, n.horizon, round(n.y, 6) AS actual, {', '.join(f'round(coalesce(a{i} + (b{i} - a{i}) * ({q} - ma{i}) / nullif(mb{i} - ma{i}, 0), a{i}, b{i}), 6) AS {x}' for i, (q, x) in enumerate(zip(fc.LEVELS, fc.NAMES, strict=True)))} FROM q JOIN n ON n.horizon = q.horizon AND n.day = q.day""")
def decayed_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.decayed_cone(fc.forward_targets(market_bars(spark, d))).drop("close"))


_VOL = "OVER (PARTITION BY e.symbol ORDER BY e.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""WITH RECURSIVE {BARS_SQL}, o AS (SELECT symbol, day, row_number() {W} AS n, ln(close / lag(close) {W}) AS r FROM bars), e AS (SELECT symbol, day, n, r, r AS m, 0.0::DOUBLE AS v, 1.0::DOUBLE AS s FROM o WHERE n = 2
UNION ALL SELECT o.symbol, o.day, o.n, o.r, e.m + 2.0 / 31 * (o.r - e.m), 29.0 / 31 * (e.v + 2.0 / 31 * (o.r - e.m) * (o.r - e.m)), pow(29.0 / 31, 2) * e.s + pow(2.0 / 31, 2) FROM e JOIN o ON o.symbol = e.symbol AND o.n = e.n + 1),
g AS (SELECT *, CASE WHEN n > 2 THEN sqrt(v / (1 - s)) END AS sigma FROM e), z AS (SELECT *, r / nullif(lag(sigma) {W}, 0) AS z FROM g), q AS (SELECT *, CASE WHEN count(z) {_VOL} >= 90 THEN quantile_cont(z, [0.05, 0.25, 0.5, 0.75, 0.95]) {_VOL} END AS q FROM z e)
SELECT symbol, day, horizon, {', '.join(f'round(q[{i}] * sigma * sqrt(horizon), 6) AS {x}' for i, x in enumerate(fc.NAMES, 1))} FROM q, (SELECT unnest([1, 3, 7, 15]) AS horizon) WHERE q IS NOT NULL""")
def volatility_cone(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.volatility_cone(bars(spark, d)))


@query(f"""WITH {BARS_SQL}, a AS (SELECT *, ln(close / lag(close) {W}) AS r FROM bars), b AS (SELECT *, abs(r) AS ar, {roll('stddev_samp', 'r', 30, 20)} AS vol, close / {roll('avg', 'close', 90, 45)} - 1 AS trend FROM a), e AS (SELECT *, {roll(_Q % 0.95, 'ar', 365, 90, 1)} AS tail, {roll(_Q % 0.5, 'vol', None, 180, 1)} AS th FROM b),
g AS (SELECT *, coalesce(ar / nullif(tail, 0) >= 1, false) AS flare FROM e), k AS (SELECT symbol, day, vol, trend, CASE WHEN flare AND vol IS NOT NULL THEN 'high_vol' WHEN th IS NULL OR vol IS NULL THEN 'unknown_vol' WHEN vol > th THEN 'high_vol' ELSE 'low_vol' END AS v, CASE WHEN trend IS NULL THEN 'unknown_trend' WHEN trend >= 0 THEN 'uptrend' ELSE 'downtrend' END AS t FROM g)
SELECT symbol, day, round(vol, 6) AS realized_vol, round(trend, 6) AS trend_90, v AS vol_regime, t AS trend_regime, v || '|' || t AS regime FROM k""")
def regime_labels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.regimes(bars(spark, d)))


@query(f"""WITH {_TARGETS}, f AS ({_cone_sql(None)}), s AS (SELECT *, {_W1} AS wis, row_number() OVER (PARTITION BY symbol, horizon ORDER BY q95 - q05, day) AS r, count(*) OVER (PARTITION BY symbol, horizon) AS n FROM f WHERE y IS NOT NULL)
SELECT symbol, horizon, least((r - 1) * 3 // (n - 1), 2)::INTEGER AS bucket, count(*) AS observations, round(avg(wis), 6) AS wis, round(avg((sign(q50) = sign(y))::INT), 6) AS hit_rate FROM s GROUP BY 1, 2, 3""", date=None)
def confidence_terciles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.terciles(fc.with_losses(fc.cone(fc.forward_targets(bars(spark, d))))))


@query(f"""WITH {_TARGETS}, f AS ({_cone_sql(None)}), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon ORDER BY day) / count(*) OVER (PARTITION BY symbol, horizon) AS part FROM f),
s AS (SELECT symbol, horizon, {', '.join(f'quantile_cont(y - {n}, {q}) AS s_{n}' for n, q in zip(fc.NAMES, fc.LEVELS, strict=True))} FROM k WHERE part <= 0.65 AND y IS NOT NULL GROUP BY 1, 2),
z AS (SELECT k.symbol, k.horizon, day, y, list_sort([{', '.join(f'{n} + s_{n}' for n in fc.NAMES)}]) AS q FROM k JOIN s USING (symbol, horizon) WHERE part > 0.65)
SELECT symbol, horizon, day, round(y, 6) AS actual, {', '.join(f'round(q[{i}], 6) AS {n}' for i, n in enumerate(fc.NAMES, 1))} FROM z""")
def conformal_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Additive quantile calibration; the name stays because its SQL is registered under it."""
    return rounded(fc.additive_quantile(fc.with_losses(fc.cone(fc.forward_targets(bars(spark, d))))))


def _widened_sql(shifts: list[str]) -> str:
    return f"""WITH {_TARGETS}, f AS ({_cone_sql(None)}), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon ORDER BY day) / count(*) OVER (PARTITION BY symbol, horizon) AS part FROM f),
s AS (SELECT symbol, horizon, {', '.join(f'{x} AS s_{n}' for x, n in zip(shifts, fc.NAMES, strict=True))} FROM k WHERE part <= 0.65 AND y IS NOT NULL GROUP BY 1, 2),
z AS (SELECT k.symbol, k.horizon, day, y, list_sort([{', '.join(f'{n} + coalesce(s_{n}, 0)' for n in fc.NAMES)}]) AS q FROM k LEFT JOIN s USING (symbol, horizon) WHERE part > 0.65)
SELECT symbol, horizon, day, round(y, 6) AS actual, {', '.join(f'round(q[{i}], 6) AS {n}' for i, n in enumerate(fc.NAMES, 1))} FROM z"""


def _out(n: str, level: float, sign: int, weight: float = 1.0) -> str:
    side = f"y - {n}" if sign > 0 else f"{n} - y"
    return f"{weight * sign} * greatest(quantile_cont({side}, {level}), 0)"


@query(_widened_sql([_out("q05", 0.9, -1), _out("q25", 0.5, -1), "quantile_cont(y - q50, 0.5)", _out("q75", 0.5, 1), _out("q95", 0.9, 1)]))
def conformal_widening(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.widened(fc.with_losses(fc.cone(fc.forward_targets(bars(spark, d)))), "conformal"))


@query(_widened_sql([_out("q05", 0.9, -1), _out("q25", 0.75, -1, 0.65), "0.25 * quantile_cont(y - q50, 0.5)", _out("q75", 0.35, 1, 0.25), _out("q95", 0.5, 1, 0.1)]))
def asymmetric_lower_tail(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.widened(fc.with_losses(fc.cone(fc.forward_targets(bars(spark, d)))), "asymmetric_lower_tail"))


@query()
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d).select("symbol", "horizon", "day", "forecaster", "wis")
    a = p.where(F.col("forecaster") == "expanding").withColumnRenamed("wis", "a").drop("forecaster")
    b = p.where(F.col("forecaster") == "random_walk").withColumnRenamed("wis", "b").drop("forecaster")
    return rounded(fc.block_bootstrap(a.join(b, ["symbol", "horizon", "day"]).select("symbol", "horizon", "day", (F.col("a") - F.col("b")).alias("difference"))))


@query(f"""WITH {_PANEL}, s AS (SELECT forecaster, symbol, horizon, avg({_W2}) AS w, avg((y < q05)::INT) AS m FROM f WHERE y IS NOT NULL GROUP BY ALL), a AS (SELECT * FROM s WHERE forecaster = 'window_365'), b AS (SELECT * FROM s WHERE forecaster = 'random_walk')
SELECT a.symbol, bool_and(a.w < b.w) AS beats_baseline, bool_and(a.m <= 0.1) AS tail_ok, round(avg(100 * (b.w - a.w) / b.w), 6) AS mean_gain_pct FROM a JOIN b USING (symbol, horizon) GROUP BY 1""", date=None)
def promotion_gates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.promotion(fc.summarise(_panel(spark, d), ["forecaster", "symbol", "horizon"]), "window_365", "random_walk"))


@query(f"""WITH {_TARGETS}, f AS ({_cone_sql(None)}), g AS (SELECT * FROM f WHERE y IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY symbol, horizon ORDER BY q50) + (count(*) OVER (PARTITION BY symbol, horizon, q50) - 1) / 2 AS a, rank() OVER (PARTITION BY symbol, horizon ORDER BY y) + (count(*) OVER (PARTITION BY symbol, horizon, y) - 1) / 2 AS b FROM g)
SELECT symbol, horizon, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1, 2""", date=None)
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.spearman(fc.cone(fc.forward_targets(bars(spark, d))), ["symbol", "horizon"], "q50", "actual"))


# ---- splits and audits


@query(f"""WITH {BARS_SQL}, a AS (SELECT symbol, row_number() {W} AS r, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, CASE WHEN r <= floor(n * 0.65) - 15 THEN 'train' WHEN r <= floor(n * 0.65) THEN 'purged' WHEN r <= floor(n * 0.82) - 15 THEN 'select' WHEN r <= floor(n * 0.82) THEN 'purged' ELSE 'test' END AS part, count(*) AS n FROM a GROUP BY 1, 2""", date=None)
def purged_split(spark: SparkSession, d: str) -> DataFrame:
    return sp.purged_split(bars(spark, d), "day", 0.65, 0.82, 15, ["symbol"]).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, round(avg(({x} IS NULL)::INT), 6) AS missing, count(DISTINCT {x}) AS distinct_values, round(coalesce(stddev_pop({x}), 0), 4) AS sd, count(DISTINCT {x}) <= 1 AS constant FROM lineitem" for x in ("l_quantity", "l_discount", "l_tax")) + ")", date=None)
def feature_sanitation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sp.sanitation(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), 4).withColumn("missing", rounded_column("missing", 6))


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem", date=None)
def feature_correlations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sp.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))


def _load() -> None:
    """Register the queries of the other modules of this folder."""
    from tidewright.plans import blends, cycles, evaluation, fits, interactions, lookups, positions, readers, semantics, signals, states, synthesis, valuation  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
