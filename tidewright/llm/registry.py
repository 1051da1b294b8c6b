"""Queries opN_<name> over the document tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.storage import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), [1.0] * 40)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewright.llm.bpe import decode, digests, encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(decode(encode(_table(spark, sf_dir, "documents"), path), path))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewright.llm.tokenfiles import token_table

    return token_table(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.ngramjoin import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidewright.llm.htmltext import extract

    return extract(_table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.toxicity import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.pitmanyor import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.language import identify_documents

    return identify_documents(_table(spark, sf_dir, "documents"))


def op10_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.media import read_back, store_payload

    return read_back(store_payload(_table(spark, sf_dir, "documents")))


def op11_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.vectorlinks import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.vectorcodes import code_table

    return code_table(_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewright.llm.tokenalign import alignment_table

    return alignment_table(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_ngram_join, op2_main_text, op3_toxicity, op4_decontamination, op5_rendezvous_sharding, op6_pitman_yor, op7_language, op8_byte_bpe, op9_token_files, op10_progressive_jpeg, op11_projection_passes, op12_delta_lloyd, op13_token_alignment)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from tidewright.llm import decontaminate, vectorcodes, vectorlinks

    return {"op4_decontamination": decontaminate.ORACLE_SQL, "op11_projection_passes": vectorlinks.ORACLE_SQL, "op12_delta_lloyd": vectorcodes.ORACLE_SQL}
