"""Token ids as Parquet list columns with controlled layout.

Texts are ranged by key, so that the files hold ascending keys; each task then
sorts, encodes and writes its range. The list column is dictionary encoded
(vocabulary ids repeat), the key and length columns are delta encoded
(Parquet v2 pages), row groups and pages have set sizes, and the writer leaves
page indexes and statistics, so that a reader of a key range or of the lengths
alone reads only their pages.

A document's `start` counts the ids of all documents before it: its place in
its part is written, and the totals of the parts (a row a file) are summed.

Nulls and empty texts get the end id only. Rows with equal keys are ordered
by a hash of the text; repeated rows are each written. An empty table writes
no rows. Other columns are not carried.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.pretoken import PieceCache, split_batch
from tidewright.llm.storage import new_path
from tidewright.llm.textkernel import slices

END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
SCHEMA = "part int, row long, doc_id long, local_start long, n_tokens int, ids array<int>"


@dataclass
class Pieces:
    """A tokenizer file's own encoder, and the cache of its pre-tokens' ids where it is plain byte-level BPE."""

    tokenizer: object
    cache: PieceCache | None
    special: list[str]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


_loaded: dict[str, Pieces] = {}


def byte_alphabet() -> dict[int, int]:
    """The code point that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


def load(path: str) -> Pieces:
    """Pre-tokens are encoded by the tokenizers library's model, each different one once."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        spec = json.loads(tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        plain = spec["model"]["type"] == "BPE" and spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        model, letters = tokenizer.model, byte_alphabet()

        def encode(pieces: list[str]) -> list[list[int]]:
            return [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(letters))] for p in pieces]

        _loaded[path] = Pieces(tokenizer, PieceCache(encode) if plain else None, [t["content"] for t in spec["added_tokens"]])
    return _loaded[path]


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row with END_ID after each text, and each text's number of ids.

    A text that holds one of the tokenizer's added tokens, and any text of another kind of tokenizer, is encoded whole.
    """
    own = load(path)
    odd = [i for i, t in enumerate(texts) if own.cache is None or any(x in t for x in own.special)]
    plain = list(texts)
    for i in odd:
        plain[i] = ""
    if own.cache is None:
        ids, at = np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    else:
        joined, c, starts, ends, first = split_batch(plain)
        ids, sizes = own.cache.lookup(c, starts, ends, joined)
        at = np.append(0, np.cumsum(sizes))[first]
    if odd:
        parts = np.split(ids, at[1:-1])
        for i in odd:
            parts[i] = np.array(own.whole(texts[i]), np.uint32)
        ids, at = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
    return np.insert(ids, at[1:], END_ID).astype(np.int32), np.diff(at) + 1


def _encode_part(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    start = row = 0
    for batch in batches:
        for part, texts in slices(batch):
            ids, sizes = encode_texts(texts, path)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [part.column("part"), pa.array(np.arange(row, row + len(texts))), part.column("doc_id"), pa.array(start + ends - sizes), pa.array(sizes.astype(np.int32)), lists],
                names=["part", "row", "doc_id", "local_start", "n_tokens", "ids"],
            )
            start += int(ends[-1])
            row += len(texts)


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, parts: int | None = None) -> None:
    """Encode docs(doc_id, text) and write them to `out` in ascending doc_id order."""
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    ranged = rows.repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    encoded = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(lambda it: _encode_part(it, tokenizer_path), SCHEMA)
    (
        encoded.write.mode("overwrite")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.write-checksum.enabled", "true")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#local_start", "false")
        .option("compression", "zstd")
        .parquet(out)
    )


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Documents of a key range with the columns asked for; page indexes let the reader skip the rest."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    if last is not None:
        df = df.where(F.col("doc_id") <= last)
    return df.select(*columns) if columns else df


def starts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, row and start of each document, from the metadata columns alone."""
    meta = read_tokens(spark, path, columns=["part", "row", "doc_id", "local_start", "n_tokens"])
    totals = meta.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    # one row a file
    before = totals.select("part", F.coalesce(F.sum("_total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return meta.join(before, "part").select("part", "row", "doc_id", (F.col("_before") + F.col("local_start")).cast("long").alias("start"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids, all read back from the files."""
    totals = read_tokens(spark, path, columns=["part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    before = totals.select("part", F.coalesce(F.sum("_total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            raw = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            at = np.append(0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("part", "doc_id", "local_start")), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    read = read_tokens(spark, path, columns=["part", "doc_id", "local_start", "ids"]).mapInArrow(f, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return read.join(before, "part").select("doc_id", (F.col("_before") + F.col("local_start")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the ids of docs to the shared folder, read them back and check them."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, tokenizer_path, path)
    return checksums(spark, path)
