"""Market entities on the given tables: bars from lineitem, series from orders, bars in a stream from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each return flag; one partial aggregation, then one shuffle of a row a symbol and day."""
    li = table(spark, sf_dir, "lineitem")
    price, seq = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return li.groupBy(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("day")).agg(
        F.min_by(price, seq).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, seq).alias("close"),
        F.sum("l_quantity").alias("volume"), F.count(F.lit(1)).alias("trades"),
    )


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of all rows as one symbol."""
    li = table(spark, sf_dir, "lineitem")
    price, seq = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return li.groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.lit("ALL").alias("symbol"), F.min_by(price, seq).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, seq).alias("close"),
        F.sum("l_quantity").alias("volume"), F.count(F.lit(1)).alias("trades"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long series: day, source, series_name, value."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("series_name")).agg(F.avg("o_totalprice").alias("value")).withColumn("source", F.lit("orders"))


BARS_SQL = """bars AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS day,
  arg_min(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS open, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS close,
  sum(l_quantity) AS volume, count(*) AS trades FROM lineitem GROUP BY 1, 2)"""
MARKET_SQL = """bars AS (SELECT 'ALL' AS symbol, CAST(l_shipdate AS DATE) AS day,
  arg_min(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS open, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS close,
  sum(l_quantity) AS volume, count(*) AS trades FROM lineitem GROUP BY 2)"""
SERIES_SQL = """series AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS series_name, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"""
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
