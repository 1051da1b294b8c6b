"""Language identification of code-switched text with a linear-chain CRF.

Every word gets a label by forward-backward over affix, character n-gram and
lexicon (whole word) features and learned transitions. A text's language is
the label with the greatest share of its letters; `score` is that share.

Every language that a row names is learned, from at most SAMPLE_DOCS texts of each, chosen by a
hash of the key. The texts are learned whole: each is cut into segments, and two segments of a
step in random order are joined, so that the transitions learn to switch. Prediction reads whole
texts.

Texts that are null or have no letter get `und` with score 0. Repeated rows get
equal results. Without any labelled row every text is `und`. Extra columns are
not carried; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.crf import Crf, Words, letter_words, new_crf, train
from tidewright.llm.textkernel import SLICE_CHARS, slices

UNKNOWN = "und"
SAMPLE_DOCS = 160
#: Words of a segment of a training text.
SEGMENT_WORDS = 200
#: The chosen keys are broadcast up to so many, and joined by shuffle otherwise.
BROADCAST_ROWS = 1_000_000
#: Slices are smaller by the square of the number of labels above this one.
WIDE_LABELS = 32
BITS = 16


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus)) == remainder


def sample(labelled: DataFrame, key: str, label: str, size: int) -> list[tuple[str, str]]:
    """At most `size` texts of each label, by a hash of the key."""
    rows = labelled.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    order = F.xxhash64(F.col(key).cast("string"))
    # the smallest hashes of each label meet, not all rows: keys first, then their texts
    keys = rows.select(F.col(label).alias("_l"), order.alias("_h"), F.col(key).alias("_k"))
    salted = keys.withColumn("_salt", F.spark_partition_id())
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_l", "_salt").orderBy("_h", "_k"))).where(F.col("_r") <= size)
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_k"))).where(F.col("_r") <= size).select("_l", "_h", "_k").distinct()
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    got = rows.join(few, (F.col(key) == F.col("_k")) & (F.col(label) == F.col("_l"))).select(label, F.col("text"), "_h", "_k")
    # a repeated key brings all its rows
    got = got.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_h", "_k"))).where(F.col("_r") <= size)
    return [(r[0], r[1]) for r in got.orderBy("_h", "_k").collect()]


def fit(rows: list[tuple[str, str]], words: int = SEGMENT_WORDS, bits: int = BITS, seed: int = 11) -> Crf | None:
    """A CRF from (language, text) rows."""
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    segments: list[tuple[int, str]] = []
    for lang, text in rows:
        w = letter_words([text])
        for a in range(0, w.count, words):
            b = min(w.count, a + words)
            segments.append((labels.index(lang), text[w.starts[a] : w.ends[b - 1]]))
    rng.shuffle(segments)

    def batches() -> Iterator[tuple[Words, np.ndarray]]:
        for i in range(0, len(segments), 32):
            texts, marks = [], []
            part = segments[i : i + 32]
            for j in range(0, len(part), 2):  # two segments in a row are one code-switched text
                two = part[j : j + 2]
                texts.append(" ".join(s for _, s in two))
                marks.append(np.concatenate([np.full(letter_words([s]).count, y, np.int32) for y, s in two]))
            yield letter_words(texts), np.concatenate(marks)

    return train(new_crf(bits, labels), batches(), epochs=3)


def predict(texts: list[str], crf: Crf | None) -> tuple[list[str], list[float], list[list[float]]]:
    """Language, score and share of each label, of each text."""
    if crf is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    w = letter_words(texts)
    share = np.zeros((len(texts), len(crf.labels)))
    if w.count:
        letters = (w.ends - w.starts).astype(float)
        total = np.append(np.zeros((1, share.shape[1])), np.cumsum(crf.marginals(w) * letters[:, None], 0), 0)
        share = total[w.first[1:]] - total[w.first[:-1]]
    size = share.sum(1)
    share = share / np.maximum(size, 1e-12)[:, None]
    best = share.argmax(1)
    langs = [crf.labels[b] if s > 0 else UNKNOWN for b, s in zip(best, size, strict=True)]
    return langs, np.where(size > 0, np.clip(share.max(1), 0, 1), 0).tolist(), share.tolist()


def identify(docs: DataFrame, crf: Crf | None, carry: list[str] | None = None) -> DataFrame:
    """Columns `carry` (doc_id if not given), lang_pred and score of every row."""
    carry = carry or ["doc_id"]
    model = docs.sparkSession.sparkContext.broadcast(crf)  # 2**BITS weights a label
    limit = int(SLICE_CHARS / max(1.0, len(crf.labels) / WIDE_LABELS) ** 2) if crf else SLICE_CHARS

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, limit=limit):
                langs, scores, _ = predict(texts, model.value)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(langs), pa.array(scores, pa.float64())], names=[*carry, "lang_pred", "score"])

    columns = list(dict.fromkeys([*carry, "text"]))
    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in carry)
    return docs.select(*columns).mapInArrow(f, f"{schema}, lang_pred string, score double")


def fit_documents(docs: DataFrame) -> Crf | None:
    """Learn from documents(doc_id, text, lang) that are not held out."""
    return fit(sample(docs.where(~held_out(F.col("doc_id"), 3, 1)), "doc_id", "lang", SAMPLE_DOCS))


def identify_documents(docs: DataFrame) -> DataFrame:
    return identify(docs, fit_documents(docs)).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
