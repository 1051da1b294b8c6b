"""Weighted rendezvous sharding of records by a stable key.

Each record goes to the shard with the least -ln(u)/weight, where u in (0,1)
is a hash of (key, shard). The key and the set of weighted shards decide
alone, so one more shard takes rows only into itself, and its share follows
its weight. Native column functions only.

Slots number the rows of a shard without gaps. One window per shard would put
1/shards of all rows into one task, so rows are numbered inside (shard,
bucket) and offset by the counts of the buckets before; the counts are
shards * `SLOT_BUCKETS` rows at most.

Nulls: a null key is hashed like any other value (all such rows share a shard),
a null text counts 0 bytes. Repeated rows each get their own slot. Extra
columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_BUCKETS = 1024


def _score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u)/weight; u from the top 52 bits of the hash, never 0 or 1."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard).cast("long")), 12).cast("double")
    u = (bits + 0.5) / F.lit(float(1 << 52))
    return -F.ln(u) / F.lit(float(weight))


def _least(scores: list[Column]) -> Column:
    """Index of the least score; the lower index on a tie."""
    best = F.array_min(F.array(*[F.struct(s.alias("s"), F.lit(i).alias("i")) for i, s in enumerate(scores)]))
    return best["i"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], name: str = "shard") -> DataFrame:
    """Add the shard of each record; shards are 0 .. len(weights)-1."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return df.withColumn(name, _least([_score(k, i, w) for i, w in enumerate(weights)]))


def assign_and_grow(df: DataFrame, key: str, weights: Sequence[float], new_weight: float = 1.0) -> DataFrame:
    """Shard now, and shard after one more shard of `new_weight` is added."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    scores = F.array(*[F.struct(_score(k, i, w).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)])
    best = df.withColumn("_best", F.array_min(scores)).withColumn("_new", _score(k, len(weights), new_weight))
    return best.withColumn("shard", F.col("_best")["i"]).withColumn("grown_shard", F.when(F.col("_new") < F.col("_best")["s"], F.lit(len(weights))).otherwise(F.col("_best")["i"])).drop("_best", "_new")


def number_slots(df: DataFrame, order: Sequence[str], shard: str = "shard", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Add `slot`, gapless from 0 in each shard. `order` are the columns that fix a row's place."""
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)).cast("int"))
    counts = b.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard).alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order)
    numbered = b.withColumn("_rank", F.row_number().over(inside) - 1)
    # offsets has shards * buckets rows at most, whatever the input
    joined = numbered.join(F.broadcast(offsets), (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("slot", (F.col("_before") + F.col("_rank")).cast("long")).drop("_bucket", "_rank", "_s", "_b", "_before")


def shard_documents(docs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Rows of `docs` (doc_id, text) with size, checksum, shard, slot and the shard after growth."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = assign_and_grow(rows, "doc_id", weights).withColumn("law", F.lit("key"))
    slots = number_slots(placed, ["doc_id", "text_crc32", "size"])
    return slots.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"))
