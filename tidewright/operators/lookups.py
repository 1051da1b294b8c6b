"""Small lookups: the latest choice of each key, the latest day that all traces share, fixed maps, and empty rows and columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_choice(selected: DataFrame, keys: Sequence[str], choice: str, time: str = "day") -> DataFrame:
    """keys, `choice` and `as_of`: the last row of each key that has a choice; keys without one are left out."""
    known = selected.where(F.col(choice).isNotNull())
    return known.groupBy(*keys).agg(F.max_by(choice, time).alias(choice), F.max(time).alias("as_of"))


def latest_common(traces: Mapping[str, DataFrame], time: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    """The latest time at which every trace has a row, of each key (no row where they share none)."""
    rows = reduce(DataFrame.unionByName, [df.select(*keys, time, F.lit(name).alias("_trace")).distinct() for name, df in traces.items()])
    shared = rows.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(traces))
    # without keys an aggregate of no rows would be one empty row
    return shared.groupBy(*(keys or [F.lit(1).alias("_k")])).agg(F.max(time).alias(time)).drop("_k")


def mapped(key: Column, values: Mapping[str, object], default: object = None) -> Column:
    """The value of a fixed map; keys outside it get the default."""
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def without_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in any of the columns, without those of the columns that have none in any row; one aggregation finds them."""
    row = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    empty = [c for c in columns if not row[c]]
    kept = [F.col(c).isNotNull() for c in columns if row[c]]
    return (df.where(reduce(lambda a, b: a | b, kept)) if kept else df.where(F.lit(False))).drop(*empty)
