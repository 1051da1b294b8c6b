"""Queries of paged and range-split sources and of resumed builds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import resume as rs
from tidewright.plans.market import BARS_SQL, bars, table
from tidewright.plans.registry import W, _ema, _high_pass, _recursion, _rma, frame, query, rounded
from tidewright.sources import rest
from tidewright.sources import tables as src

HOUR = 3_600_000


def _hours(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of each event type: name, time (ms), and the values of a bar in their order."""
    e = table(spark, d, "events").withColumn("time", F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))))
    b = e.groupBy(F.col("event_type").alias("name"), "time").agg(F.min_by("value", "event_id").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", "event_id").alias("c"), F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    text = [F.col(c).cast("string") for c in "ohlcv"]
    return b.select("name", "time", F.array(*text, (F.col("time") + HOUR - 1).cast("string"), F.lit("0"), F.col("n").cast("string")).alias("values"))


def _recorded(spark: SparkSession, d: str) -> tuple[str, dict]:
    """A recording of the hourly bars, and the span and names to ask for."""
    rest.register(spark)
    hours = _hours(spark, d)
    path = rest.record(hours, rest.shared_path(spark, "recording"))
    span = spark.read.parquet(path).agg(F.min("time").alias("a"), F.max("time").alias("b"), F.collect_set("name").alias("names")).first()
    return path, {"names": ",".join(sorted(map(str, span["names"]))), "start": str(span["a"]), "end": str(span["b"] + 1), "pause": "0.01", "transport": "tidewright.sources.rest:Recorded"}


_HOURS = "h AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS open_time, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, sum(value) AS volume, count(*) AS trades FROM events GROUP BY 1, 2)"


@query(f"WITH {_HOURS} SELECT symbol, open_time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, trades FROM h", date=None)
def paged_klines(spark: SparkSession, d: str) -> DataFrame:
    """Every bar by pages of 40, in partitions of a week, with a blocked host before one that is busy at first."""
    path, options = _recorded(spark, d)
    options |= {"interval": "1h", "limit": "40", "split": str(7 * 24 * HOUR), "hosts": "first,second", "blocked": "first", "busy": "yes", "recording": path}
    raw = spark.read.format("klines").options(**options).load().withColumnRenamed("raw", "kline")
    made = src.klines(raw, F.lit("2100-01-01").cast("timestamp"))
    return rounded(made.select("symbol", F.col("open_time").cast("timestamp_ntz").alias("open_time"), "open", "high", "low", "close", "volume", "trades"))


@query(f"WITH {_HOURS} SELECT symbol AS endpoint, epoch_ms(open_time) AS time, round(close, 6) AS value FROM h", date=None)
def ranged_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Hourly closes from a service that refuses more than 60 records at once, so that ranges are halved."""
    path, options = _recorded(spark, d)
    options |= {"step": str(HOUR), "most": "60", "recording": path}
    raw = spark.read.format("metrics").options(**options).load()
    value = F.from_json("record", "values array<string>")["values"][3].try_cast("double")
    return rounded(raw.select("endpoint", "time", value.alias("value")))


_MADE = [rs.ema("ema_20", "close", 20), rs.ema("volume_ema", "volume", 21), rs.wilder("rma_14", "close", 14), rs.high_pass("cycle", "close", 40)]
_UNTIL = "1999-01-01"
_STATES = [_ema("close", "ema_20", 20), _ema("volume", "volume_ema", 21), _rma("close", "rma_14"), _high_pass("cycle", 40)]


@query(f"""WITH RECURSIVE {BARS_SQL}, i AS (SELECT symbol, day, close, volume, row_number() {W} AS n, lag(close) {W} AS c1, lag(close, 2) {W} AS c2, avg(close) {frame(None)} AS close_seed FROM bars),
{_recursion('f', 'i', _STATES, ['o.close AS ema_20', 'o.volume AS volume_ema', 'CAST(NULL AS DOUBLE) AS rma_14', '0.0::DOUBLE AS cycle', '0.0::DOUBLE AS cycle_before'])}
SELECT symbol, day, round(ema_20, 5) AS ema_20, round(volume_ema, 5) AS volume_ema, round(rma_14, 5) AS rma_14, round(cycle, 5) AS cycle FROM f""")
def resumed_indicators(spark: SparkSession, d: str) -> DataFrame:
    """A build of the rows up to a day, its states, and a refresh from them; the SQL is one full build."""
    df = bars(spark, d).select("symbol", "day", "close", "volume")
    stored, states = rs.build(df.where(F.col("day") < F.lit(_UNTIL).cast("date")), _MADE)
    fresh, _ = rs.refresh(df, states, _MADE)
    return rounded(rs.rewritten(stored, fresh).drop("close", "volume"), 5)
