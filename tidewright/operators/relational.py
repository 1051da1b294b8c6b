"""Upserts, suffix deletes, refreshes and alignments as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def append_checked(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append; more columns are dropped, missing ones are an error."""
    missing = [c for c in existing.columns if c not in new.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return existing.unionByName(new.select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """Rows of `new` replace those of the same key, its last version wins. Null keys replace nothing."""
    latest = new.groupBy(*keys).agg(F.max_by(F.struct(*existing.columns), F.struct(*sequence)).alias("_v")).select("_v.*")
    return existing.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def delete_from(df: DataFrame, column: str, value: Column, **equal: object) -> DataFrame:
    """df without the rows at or after `value`, among those with the equal values."""
    gone = F.col(column) >= value
    for k, v in equal.items():
        gone = gone & (F.col(k) == F.lit(v))
    return df.where(~F.coalesce(gone, F.lit(False)))


def refresh_start(df: DataFrame, key: str, offset: int) -> DataFrame:
    """One row: the distinct key value `offset` places below the newest."""
    return df.select(key).distinct().orderBy(F.desc(key)).offset(offset).limit(1)


def delta(existing: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of `new` with `change`: new, changed or unchanged; a null that became a value counts as changed."""
    old = existing.select(*keys, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_there"))
    differs = ~F.col(values[0]).eqNullSafe(F.col(f"_{values[0]}"))
    for c in values[1:]:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    kind = F.when(F.col("_there").isNull(), "new").when(differs, "changed").otherwise("unchanged")
    return new.join(old, keys, "left").withColumn("change", kind).select(*keys, *values, "change")


def complete_keys(df: DataFrame, key: str, part: str, least: int) -> DataFrame:
    """Keys with at least so many different parts."""
    return df.groupBy(key).agg(F.countDistinct(part).alias("n")).where(F.col("n") >= least).select(key)


def as_of(left: DataFrame, right: DataFrame, time: str, value: str, keys: list[str] | None = None, fill_head: bool = False) -> DataFrame:
    """left with the latest right value at or before its time; one union and one window instead of a range join."""
    keys = keys or []
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(*keys, time, value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side")
    out = both.withColumn(value, F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if fill_head:
        out = out.withColumn(value, F.coalesce(value, F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))))
    return out.where(F.col("_side") == 1).drop("_side")


def align(spine: DataFrame, series: DataFrame, time: str, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Exact join to the spine, then the last known value. Source rows between spine times are not seen."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    joined = spine.join(series.select(*keys, time, *columns), [*keys, time], "left")
    return joined.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def calendar(df: DataFrame, key: str, time: str = "day") -> DataFrame:
    """Every day between the first and the last of each key."""
    ends = df.groupBy(key).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    return ends.select(key, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias(time))


def week_ends(df: DataFrame, key: str, value: str, time: str = "day") -> DataFrame:
    """Last value of each week that ends on a Friday."""
    friday = F.date_add(F.col(time), F.pmod(F.lit(13) - F.dayofweek(time), F.lit(7)))
    return df.groupBy(key, friday.alias("week")).agg(F.max_by(value, time).alias(value))


def common_rows(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that all frames have."""
    every = None
    for i, df in enumerate(frames):
        part = df.select(*keys, F.lit(i).alias("_i"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(*keys).agg(F.countDistinct("_i").alias("_n")).where(F.col("_n") == len(frames)).select(*keys)


def replace_suffix(existing: DataFrame, new: DataFrame, time: str, start: Column | None = None) -> DataFrame:
    """existing with its rows from `start` on (all, without one) replaced by `new`."""
    kept = existing.limit(0) if start is None else existing.where(F.col(time) < start)
    return kept.unionByName(new.select(*existing.columns))


def merge_endpoint(existing: DataFrame, new: DataFrame, time: str) -> DataFrame:
    """existing with its rows from the least time of `new` on replaced by `new`; without that column, `new` alone."""
    if time not in existing.columns:
        return new
    first = new.agg(F.min(time).alias("_first"))  # one row
    kept = existing.join(F.broadcast(first)).where(F.col("_first").isNull() | (F.col(time) < F.col("_first"))).drop("_first")
    return kept.unionByName(new.select(*existing.columns))


def is_current(stored: DataFrame, source: DataFrame, time: str) -> DataFrame:
    """One row: whether the newest stored time is not before the source's newest one."""
    a, b = stored.agg(F.max(time).alias("_a")), source.agg(F.max(time).alias("_b"))
    return a.join(F.broadcast(b)).select(F.coalesce(F.col("_a") >= F.col("_b"), F.col("_b").isNull()).alias("current"))
