"""Structured Streaming forms: windowed aggregates with late data, and revisions by keyed upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.operators.relational import upsert


def tumbling(events: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Count, sum and extremes of each window and key; rows later than the watermark are dropped by the engine."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def upsert_stream(stream: DataFrame, path: str, keys: list[str], sequence: list[str], checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """Each micro-batch replaces rows of the same keys in the table under `path`, which may hold rows already.

    The table is partitioned by a hash of the keys, and only the buckets that a batch touches are read and written
    again. An upsert of the same batch changes nothing, so a repeated batch does no harm.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    schema = spark.createDataFrame([], stream.schema).withColumn("_bucket", F.lit(0)).schema
    spark.createDataFrame([], schema).write.mode("append").partitionBy("_bucket").parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("_bucket", bucket)
        touched = new.select("_bucket").distinct()  # `buckets` rows at most
        existing = batch.sparkSession.read.schema(schema).parquet(path).join(F.broadcast(touched), "_bucket", "left_semi").select(*schema.names)
        upsert(existing, new, keys, sequence).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def position_state(events: DataFrame, late: str, gap_days: int = 7) -> DataFrame:
    """A running greedy sample of each symbol's stream: an event is emitted if its day is at least `gap_days` after the last one emitted.

    events: symbol, ts, value. The state of a symbol is the day of its last emitted event; events of one micro-batch
    are taken in time order, and later ones that come before that day are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        frame = pd.concat(list(frames)).sort_values("ts")
        taken = []
        for row in frame.itertuples(index=False):
            day = row.ts.toordinal()
            if last is None or day >= last + gap_days:
                taken.append((key[0], row.ts, row.value))
                last = day
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(taken, columns=["symbol", "ts", "value"])

    rows = events.withWatermark("ts", late).select("symbol", "ts", "value").groupBy("symbol")
    return rows.applyInPandasWithState(step, "symbol string, ts timestamp, value double", "last int", "append", GroupStateTimeout.NoTimeout)


def rejected_as_stale(df: DataFrame, time: str, now: Column, most: str) -> DataFrame:
    """Rows whose time lies in the future, or more than `most` (an interval) before now, with the reason."""
    t = F.col(time)
    reason = F.when(t > now, "future").when(t < now - F.expr(f"INTERVAL {most}"), "stale")
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())
