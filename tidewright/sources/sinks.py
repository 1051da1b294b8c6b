"""Tables, failure logs and CSV files that jobs leave, and guards of column names."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from tidewright.sources.tables import keep_last


def quoted(name: str) -> str:
    """The name as an identifier of Spark SQL."""
    return "`" + name.replace("`", "``") + "`"


def save(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write df and return its rows; an empty df leaves the table as it is."""
    if df.isEmpty():
        return 0
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count() if mode == "overwrite" else df.count()


def append_failure(spark: SparkSession, path: str, as_of: str, error: Exception) -> None:
    """One more row of a failure log."""
    row = (as_of, f"{type(error).__name__}: {error}", datetime.now(UTC).replace(tzinfo=None))
    spark.createDataFrame([row], "as_of string, error string, created_at timestamp_ntz").coalesce(1).write.mode("append").parquet(path)


def write_csv_by_day(df: DataFrame, path: str, day: str, sequence: list[str]) -> None:
    """Daily rows as one CSV part in order of the day; of one day's rows the last by the sequence stays."""
    kept = keep_last(df, [day], sequence)
    kept.coalesce(1).sortWithinPartitions(day).write.mode("overwrite").option("header", True).csv(path)


def check_names(columns: list[str], words: list[str]) -> list[str]:
    """Columns whose names hold one of the words as a part of its own."""
    pattern = re.compile(rf"(^|_)({'|'.join(map(re.escape, words))})(_|$)", re.I)
    return [c for c in columns if pattern.search(c)]


def guard_names(columns: list[str], words: list[str]) -> None:
    found = check_names(columns, words)
    if found:
        raise ValueError(f"columns that look ahead: {', '.join(found)}")
