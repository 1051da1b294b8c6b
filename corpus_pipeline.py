"""Corpus pipeline: toxicity, language, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
each stage's result to the shared folder and reads it back for the next one.
Null texts and texts without a letter go in the second stage. Rows with one
doc_id and different texts are documents of their own in the third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, decontaminate, language, ngramjoin, toxicity
from tidewright.llm.storage import materialise, new_path, prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The tokens are made by a Python tokenizer and the classifiers are fitted, so no SQL gives run()'s rows.
ORACLE_SQL = None


def _without(docs: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the keys; the keys are broadcast if they are few, and joined by shuffle otherwise."""
    few = keys.count() <= ngramjoin.BROADCAST_ROWS
    return docs.join(F.broadcast(keys) if few else keys, key, "left_anti")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    model = toxicity.fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.tag(docs, model, COLUMNS).where(F.col("score") < 0.5).select(*COLUMNS)


def reject_no_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; texts in several languages have one too, whatever the shares."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    found = language.identify(docs, language.fit_documents(docs), COLUMNS)
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the least doc_id, and then the least hash of its text.

    Rows with one doc_id and different texts are documents of their own. Texts without words are in no group.
    """
    prepare(spark)
    docs = docs.select(*COLUMNS)
    rows = materialise(ngramjoin.groups(docs).where(F.col("component").isNotNull()).select("component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").alias("row")), "groups")
    first = rows.groupBy("component").agg(F.min("row").alias("first"))
    others = materialise(rows.join(first, "component").where(F.col("row") != F.col("first")).select("row").distinct(), "others")
    repeated = materialise(rows.groupBy("row").count().where(F.col("count") > 1).select("row"), "repeated")
    keyed = docs.withColumn("row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text_hash")))
    kept = _without(keyed, others, "row")
    if repeated.isEmpty():
        return kept.drop("row")
    once = kept.join(repeated, "row", "left_semi").dropDuplicates(["row"])
    return _without(kept, repeated, "row").unionByName(once).drop("row")


def reject_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's template."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    pairs = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, materialise(pairs.select("doc_id").distinct(), "leaks"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), their number and checksums of ids and decoded bytes."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # encoding and decoding in one task would hold two Python workers each
    decoded = bpe.decode(materialise(bpe.encode(docs, path), "encoded"), path)
    return decoded.select("doc_id", "ids", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", reject_toxic), ("language", reject_no_language), ("near_copies", keep_one_of_near_copies), ("decontamination", reject_benchmark), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
