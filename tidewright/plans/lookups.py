"""Queries of the small lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import forecasts as fc
from tidewright.operators import lookups as lk
from tidewright.plans.market import BARS_SQL, SERIES_SQL, bars, series, table
from tidewright.plans.registry import _SQL, _panel, query, rounded

_CHOSEN = _SQL["walk_forward_selection"].split("SELECT symbol, horizon, selected, count(*) AS days FROM ")


@query(f"{_CHOSEN[0]} SELECT symbol, horizon, arg_max(selected, day) AS selected, max(day) AS as_of FROM {_CHOSEN[1]}".replace("GROUP BY ALL) GROUP BY ALL", "GROUP BY ALL) GROUP BY symbol, horizon"), date="as_of")
def live_candidates(spark: SparkSession, d: str) -> DataFrame:
    return lk.latest_choice(fc.realised_selection(_panel(spark, d), "expanding"), ["symbol", "horizon"], "selected")


@query(f"WITH {BARS_SQL}, {SERIES_SQL}, t AS (SELECT DISTINCT symbol, day FROM bars WHERE trades % 9 > 0) SELECT symbol, max(t.day) AS day FROM t JOIN (SELECT DISTINCT day FROM series WHERE series_name = '1-URGENT') USING (day) JOIN (SELECT DISTINCT day FROM series WHERE series_name = '5-LOW') USING (day) GROUP BY symbol")
def latest_common_day(spark: SparkSession, d: str) -> DataFrame:
    b, s = bars(spark, d).where(F.col("trades") % 9 > 0), series(spark, d)
    traces = {"price": b.select("symbol", "day")}
    for name in ("1-URGENT", "5-LOW"):
        traces[name] = traces["price"].join(s.where(F.col("series_name") == name).select("day"), "day", "left_semi").select("symbol", "day")
    return lk.latest_common(traces, keys=["symbol"])


_MAP = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "5-LOW": 1}


@query("SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 1 ELSE 0 END AS urgency, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 3) AS total FROM orders GROUP BY 1, 2", date=None)
def mapped_urgency(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return rounded(o.groupBy(lk.mapped(F.col("o_orderpriority"), _MAP, 0).alias("urgency"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 3)


@query("SELECT event_id, a, b FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS a, CASE WHEN event_id % 5 = 0 THEN user_id END AS b FROM events) WHERE a IS NOT NULL OR b IS NOT NULL", date=None)
def rows_without_gaps(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    df = e.select("event_id", F.when(i % 3 == 0, F.col("value")).alias("a"), F.when(i % 5 == 0, F.col("user_id")).alias("b"), F.lit(None).cast("double").alias("c"))
    return lk.without_empty(df, ["a", "b", "c"])
