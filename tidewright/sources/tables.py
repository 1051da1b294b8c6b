"""Scans and parsers: filtered tables, closed bars, wide and embedded series."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_NAMES = ("time", "date", "timestamp", "datetime")


def scan(df: DataFrame, columns: list[str] | None = None, filters: Mapping[str, object] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Projection and equality filters, pushed to the source; a filter on null matches nothing."""
    for name, value in (filters or {}).items():
        df = df.where(F.col(name) == F.lit(value))
    df = df.select(*columns) if columns else df
    return df.orderBy(*order_by) if order_by else df


def time_column(df: DataFrame) -> str | None:
    """The preferred time column: time, date, timestamp or datetime, in that order."""
    by_lower = {c.lower(): c for c in df.columns}
    return next((by_lower[n] for n in TIME_NAMES if n in by_lower), None)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def keep_last(df: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """The last row of each key by the sequence columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in sequence])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def close_time(start: Column, interval: Column) -> Column:
    """Last millisecond of a bar from its interval; case tells minutes (m) from months (M); null if unknown."""
    n = F.regexp_extract(interval, r"^(\d+)", 1).try_cast("int")
    unit = F.regexp_extract(interval, r"^\d+([smhdwM])$", 1)
    seconds = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)
    end = F.when(unit == "M", start + F.make_ym_interval(F.lit(0), n)).when(seconds.isNotNull(), start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n * seconds).cast("decimal(18,6)")))
    return F.when(n > 0, end - F.expr("INTERVAL '0.001' SECOND"))


def closed_bars(bars: DataFrame, as_of: Column, keys: list[str] = ["symbol", "interval", "open_time"]) -> DataFrame:  # noqa: B006
    """Bars known at `as_of`: available, else closed, else inferred to be closed by then; the last version of each."""
    known = F.coalesce("available_at", "close_time", close_time(F.col("open_time"), F.col("interval")))
    return keep_last(bars.withColumn("known_at", known).where(F.col("known_at") <= as_of), keys, ["known_at", "seq"])


def klines(raw: DataFrame, observed_at: Column) -> DataFrame:
    """Typed bars from arrays [open ms, o, h, l, c, volume, close ms, quote, trades, taker base, taker quote]."""
    k = F.col("kline")
    names = ["open", "high", "low", "close", "volume"]
    out = raw.select(
        *[x for x in raw.columns if x != "kline"],
        F.timestamp_millis(k[0].try_cast("long")).alias("open_time"),
        *[k[i + 1].try_cast("double").alias(n) for i, n in enumerate(names)],
        F.timestamp_millis(k[6].try_cast("long")).alias("close_time"),
        k[7].try_cast("double").alias("quote_volume"),
        k[8].try_cast("long").alias("trades"),
    )
    return out.withColumn("is_closed", F.col("close_time") <= observed_at)


def melt(wide: DataFrame, key: str, name: str = "series_name", value: str = "value") -> DataFrame:
    """One row for each series and key; nulls go."""
    others = [c for c in wide.columns if c != key]
    return wide.unpivot([key], others, name, value).where(F.col(value).isNotNull())


def pivot_last(long: DataFrame, key: str, names: list[str], order: list[str]) -> DataFrame:
    """Wide table: the last value of each series by the order columns; names are fixed, so no extra job finds them."""
    last = F.max_by("value", F.struct(*order))
    return long.groupBy(key).pivot("series_name", names).agg(last)


def merge_metrics(frames: Mapping[str, DataFrame], key: str = "day") -> DataFrame:
    """Full outer alignment of single-metric frames (key, value) as one union and one aggregation."""
    parts = [df.select(key, F.lit(n).alias("_n"), F.col("value").cast("double").alias("value")) for n, df in frames.items()]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(key).agg(*[F.max(F.when(F.col("_n") == n, F.col("value"))).alias(n) for n in frames])


def embedded_json(pages: DataFrame, column: str, pattern: str, schema: str) -> DataFrame:
    """JSON values inside scripts: the pattern's first group, parsed."""
    found = F.regexp_extract(column, pattern, 1)
    return pages.withColumn("parsed", F.from_json(F.when(found != "", found), schema))


def chart_series(df: DataFrame, column: str) -> DataFrame:
    """Rows (name, day, value) from [{name, data: [[ms, value], ...]}] or one such object."""
    one = "struct<name:string,data:array<array<double>>>"
    text = F.when(F.ltrim(column).startswith("["), F.col(column)).otherwise(F.concat(F.lit("["), F.col(column), F.lit("]")))
    s = df.withColumn("_s", F.explode(F.from_json(text, f"array<{one}>"))).withColumn("_d", F.explode("_s.data"))
    return s.select(*df.columns, F.col("_s.name").alias("name"), F.to_date(F.timestamp_millis(F.col("_d")[0].cast("long"))).alias("day"), F.col("_d")[1].alias("value"))


def typed_array(df: DataFrame, data: str, dtype: str, out: str = "values") -> DataFrame:
    """Doubles from base64 bytes with a dtype such as f8, i2 or u4 (little endian, or big with a leading >)."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()), F.PandasUDFType.SCALAR)
    def decode(raw, kind):  # type hints are texts here, which Spark does not read
        return pd.Series([None if b is None or k is None else np.frombuffer(b, np.dtype(k if k[0] in "<>" else "<" + k)).astype(float).tolist() for b, k in zip(raw, kind, strict=True)])

    return df.withColumn(out, decode(F.unbase64(data), F.col(dtype)))


def trace_points(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """key, day, value: finite points only, the later duplicate wins."""
    points = df.select(*keys, F.posexplode(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y"))).alias("pos", "p"))
    points = points.select(*keys, "pos", F.to_date(F.col("p.x")).alias("day"), F.col("p.y").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return points.groupBy(*keys, "day").agg(F.max_by("value", "pos").alias("value"))


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """CSV with a header and a fixed schema; the required columns must be in it."""
    return require(spark.read.csv(path, header=True, schema=schema, enforceSchema=False), required)
