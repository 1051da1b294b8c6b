"""Alignment of two tokenizers' tokens over the same bytes.

A document is a space and its text in UTF-8. A's and B's tokens each tile these
bytes. B's starts and ends are a static interval index: two bisections for
each A token give the B tokens that it overlaps, and thus the gaps between
B tokens that it spans. A gap that no A token spans is a group boundary; A's and
B's tokens both end there. The last tokens of a group end together: they are
linked, one link a group.

Corpus counts of linked id pairs are summed in each task before they are
shuffled. Documents keep their distinct pairs with counts in a step table; the
counts of all pairs, or of the most frequent ones if there are more than
HOT_PAIRS, are broadcast as sorted arrays, and the other pairs meet their counts
in a join by pair. A pair outside the broadcast is rarer than every pair in it,
so no key of the join is hot.

Null and empty texts, and texts whose tokens' bytes differ from the document's
(a tokenizer that normalises, U+2581 in B), have no tokens: zeros, and an empty
string for the groups. Special tokens' strings are plain text. Rows with one
doc_id, repeated rows and rows without doc_id are each aligned, and each counts
in the corpus. Texts are read whole; a text costs some 200 bytes of memory a
character while it is in hand. Other columns are not carried; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.pretoken import split_batch
from tidewright.llm.storage import discard, materialise, most_frequent
from tidewright.llm.textkernel import slices
from tidewright.llm.tokenfiles import byte_alphabet, load

#: Pairs whose counts are broadcast at most, 17 bytes each.
HOT_PAIRS = 1 << 20
#: Pairs that a task holds before it passes on their counts.
HELD_PAIRS = 1 << 20
SPACE_MARK = "▁"


@dataclass
class Vocabulary:
    """A tokenizer's ids as bytes, and its encoder of several texts: all ids in a row, and each text's number."""

    token: np.ndarray
    length: np.ndarray
    comma: np.ndarray
    encode: object


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary(token: list[bytes], encode: object) -> Vocabulary:
    held = np.empty(len(token), dtype=object)
    held[:] = token
    return Vocabulary(held, np.array([len(t) for t in token], np.int64), np.array([f"{i}," for i in range(len(token))], dtype=object), encode)


def byte_level(path: str) -> Vocabulary:
    """A tokenizer file with a byte-level vocabulary; special tokens' strings are plain text."""
    if path not in _vocabularies:
        own = load(path)
        plain = type(own.tokenizer).from_file(path)  # one of its own, as the setting is the tokenizer's
        plain.encode_special_tokens = True
        byte_of = {chr(c): b for b, c in byte_alphabet().items()}
        size = own.tokenizer.get_vocab_size()
        names = [own.tokenizer.id_to_token(i) or "" for i in range(size)]
        token = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in names]

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if own.cache is None:
                found = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
                return np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64)
            joined, c, starts, ends, first = split_batch(texts)
            ids, sizes = own.cache.lookup(c, starts, ends, joined)
            return ids.astype(np.int64), np.diff(np.append(0, np.cumsum(sizes))[first])

        _vocabularies[path] = _vocabulary(token, encode)
    return _vocabularies[path]


def pieces(path: str) -> Vocabulary:
    """A piece model with byte fallback that puts a space before a text."""
    if path not in _vocabularies:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        token = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i in range(model.get_piece_size()) for p in (model.id_to_piece(i),)]

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = model.encode([t[1:] for t in texts], num_threads=1)
            return np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64)

        _vocabularies[path] = _vocabulary(token, encode)
    return _vocabularies[path]


def _fitting(v: Vocabulary, ids: np.ndarray, sizes: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Which texts the joined bytes of their tokens equal."""
    at = np.append(0, np.cumsum(sizes)).tolist()
    ok = np.zeros(len(raw), bool)
    for k, r in enumerate(raw):
        own = ids[at[k] : at[k + 1]]
        ok[k] = len(r) > 1 and int(v.length[own].sum()) == len(r) and b"".join(v.token[own].tolist()) == r
    return ok


@dataclass
class Aligned:
    """Tokens of several documents: ids, first token of each document, overlaps and group ends."""

    a: np.ndarray
    b: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    #: The B tokens low to high - 1 that each A token overlaps.
    low: np.ndarray
    high: np.ndarray
    #: A's and B's last tokens of each group, and the first group of each document.
    a_last: np.ndarray
    b_last: np.ndarray
    first: np.ndarray


def align(texts: list[str], va: Vocabulary, vb: Vocabulary) -> Aligned:
    """Align the two tokenizers' tokens of each text (with a space before it); texts that don't fit have none."""
    spaced = [" " + t for t in texts]
    raw = [t.encode() for t in spaced]
    (a, na), (b, nb) = va.encode(spaced), vb.encode(spaced)
    ok = _fitting(va, a, na, raw) & _fitting(vb, b, nb, raw)
    a, b = a[np.repeat(ok, na)], b[np.repeat(ok, nb)]
    na, nb = na * ok, nb * ok
    a_end, b_end = np.cumsum(va.length[a]), np.cumsum(vb.length[b])
    a_start, b_start = a_end - va.length[a], b_end - vb.length[b]
    # the stabbing queries: documents lie one after the other, so no token overlaps another document's
    low = np.searchsorted(b_end, a_start, "right")
    high = np.searchsorted(b_start, a_end, "left")
    spanned = np.cumsum(np.bincount(low, minlength=len(b)) - np.bincount(high - 1, minlength=len(b)))
    b_last = np.flatnonzero(spanned == 0)
    a_last = np.searchsorted(a_end, b_end[b_last])
    a_first, b_first = np.append(0, np.cumsum(na)), np.append(0, np.cumsum(nb))
    return Aligned(a, b, a_first, b_first, low, high, a_last, b_last, np.searchsorted(b_last, b_first))


def group_texts(x: Aligned, va: Vocabulary, vb: Vocabulary) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each document: decimal ids in order."""
    a_words, b_words = va.comma[x.a], vb.comma[x.b]
    a_words[x.a_last] = np.array([f"{i}|" for i in x.a[x.a_last].tolist()], dtype=object)
    b_words[x.b_last] = np.array([f"{i};" for i in x.b[x.b_last].tolist()], dtype=object)
    # a group's A tokens stand before its B tokens
    a_group = np.searchsorted(x.a_last, np.arange(len(x.a)))
    b_group = np.searchsorted(x.b_last, np.arange(len(x.b)))
    b_before = np.append(0, x.b_last + 1)[a_group]
    a_before = (x.a_last + 1)[b_group]
    words = np.empty(len(x.a) + len(x.b), dtype=object)
    words[np.arange(len(x.a)) + b_before] = a_words
    words[np.arange(len(x.b)) + a_before] = b_words
    at = (x.a_first + x.b_first).tolist()
    return ["".join(words[p:q].tolist())[:-1] for p, q in zip(at[:-1], at[1:], strict=True)]


ROW_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary"


def _rows(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """Digests of each document, its distinct linked pairs (a * |B| + b, ascending) and how often it has them."""
    va, vb = byte_level(a_path), pieces(b_path)
    for batch in batches:
        for part, texts in slices(batch):
            x = align(texts, va, vb)
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in group_texts(x, va, vb)]
            code = x.a[x.a_last] * len(vb.token) + x.b[x.b_last]
            first = x.first.tolist()
            found = [np.unique(code[p:q], return_counts=True) for p, q in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(np.diff(x.a_first)), pa.array(np.diff(x.b_first)), pa.array(np.diff(x.first), pa.int64()), pa.array(digests),
                    pa.array([p.astype("<i8").tobytes() for p, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary()),
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"],
            )


def _joined(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    p, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
    return p, np.bincount(inverse, weights=np.concatenate(times), minlength=len(p)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair counts of a task, before the shuffle; passed on early where they are many."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(times[0])], names=["pair", "n"])

    pairs: list[np.ndarray] = []
    times: list[np.ndarray] = []
    held = 0
    for batch in batches:
        pairs.append(_joined(batch.column("pairs"), "<i8"))
        times.append(_joined(batch.column("times"), "<u4").astype(np.int64))
        held += len(pairs[-1])
        if held > 2 * HELD_PAIRS:
            p, n = _summed(pairs, times)
            pairs, times, held = [p], [n], len(p)
            if held > HELD_PAIRS:
                yield out()
                pairs, times, held = [], [], 0
    if pairs:
        p, n = _summed(pairs, times)
        pairs, times = [p], [n]
        yield out()


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """pair, n (links in the corpus) and best (whether no pair with the same B id has more)."""
    counts = materialise(rows.select("pairs", "times").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = (F.col("pair") % b_size).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    # a row for each id of B's vocabulary at most
    out = materialise(counts.join(F.broadcast(most), counts["pair"] % b_size == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")
    discard(counts)
    return out


def _scored(batches: Iterator[pa.RecordBatch], hot: object) -> Iterator[pa.RecordBatch]:
    """Sums over the pairs whose counts are at hand; the others are listed."""
    keys, n, best = hot.value
    for batch in batches:
        pairs, times = _joined(batch.column("pairs"), "<i8"), _joined(batch.column("times"), "<u4").astype(np.int64)
        sizes = np.array([len(p) // 8 for p in batch.column("pairs").to_pylist()], np.int64)
        ends = np.append(0, np.cumsum(sizes))
        at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        total, top = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        total[known], top[known] = times[known] * n[at[known]], times[known] * best[at[known]]
        total, top, rest = (np.append(0, np.cumsum(v))[ends] for v in (total, top, ~known))
        cold = pa.ListArray.from_arrays(pa.array(rest.astype(np.int32)), pa.StructArray.from_arrays([pa.array(pairs[~known], pa.int64()), pa.array(times[~known], pa.int64())], names=["pair", "times"]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups")), pa.array(np.diff(top)), pa.array(np.diff(total)), batch.column("groups_sha256"), cold], names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups_sha256", "cold"])


SCORED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string, cold array<struct<pair:long,times:long>>"


def alignment_table(docs: DataFrame, a_path: str, b_path: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    aligned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _rows(it, a_path, b_path), ROW_SCHEMA)
    rows = materialise(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned", compression="zstd")
    counts = pair_counts(rows, len(pieces(b_path).token))
    every = counts.count() <= hot_pairs
    top = (counts if every else most_frequent(counts, "n", hot_pairs)).toPandas().sort_values("pair")
    hot = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))
    scored = rows.mapInArrow(lambda it: _scored(it, hot), SCORED)
    result = ["doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"]
    if every:
        return scored.select(*result)
    scored = materialise(scored, "scored", compression="zstd")
    rare = counts.where(F.col("n") < int(top["n"].min())) if len(top) else counts
    cold = scored.select("row", F.inline("cold")).join(rare, "pair")
    more = cold.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("_best"))
    both = scored.drop("cold").join(more, "row", "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).select(*result)


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids, low and high (the B tokens low to high - 1 that each A token overlaps), a_last and b_last (each group's last tokens)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = byte_level(a_path), pieces(b_path)
        for batch in batches:
            for part, texts in slices(batch):
                x = align(texts, va, vb)
                a0, b0 = x.a_first, x.b_first
                lists = []
                for values, at, shift in ((x.a, a0, None), (x.b, b0, None), (x.low, a0, b0), (x.high, a0, b0), (x.a_last, x.first, a0), (x.b_last, x.first, b0)):
                    own = values if shift is None else values - np.repeat(shift[:-1], np.diff(at))
                    lists.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(own.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], names=["doc_id", "a_ids", "b_ids", "low", "high", "a_last", "b_last"])

    lists = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "low", "high", "a_last", "b_last"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(f, f"doc_id long, {lists}")
