"""Similarity self-join of documents on word n-grams, by prefixes under several token orders.

A document is the set of its 5-word shingles (64-bit hashes). Two sets with
Jaccard similarity of at least 0.8 share a token among the first
n - ceil(0.8 n) + 1 under any global order, and at least l tokens among the
first n - ceil(0.8 n) + l. So:

1. Shingle frequencies are counted over all documents; the most frequent ones
   (at most HOT_TOKENS, a bound on the broadcast) come last in every order.
   Any order is exact; this one keeps common passages out of prefixes.
2. Equal sets become one class. Each class emits its prefix under the first
   order; classes that share a token are candidates.
3. Candidates meet the second and third orders (a hash alone in the third):
   their longer prefixes must share l = ceil(n / 10) tokens under each. What is
   left is verified on whole sets, 100 * intersection >= 80 * union.
4. Token groups are not expanded into pairs. First every class is compared
   with three classes that share a token with it: the least one, the one that
   has a token earliest in its order, and that of its most common token, all
   plain aggregates; links become components. Then only pairs of different components are
   compared: in each token group the classes outside the group's largest
   component meet all others, if the tokens from the shared one on suffice in
   both (the first shared token always passes). No link between components is lost, and no pair
   inside one is needed.

Tables: documents(doc_id, text). Null texts and texts without words have the
empty set and stay alone; a text of fewer words than a shingle is one shingle.
Repeated rows are copies. Ties of doc_id are allowed. Rows with a null doc_id
take part in links; a component of such rows alone has a null component_id.
Whole texts of any length are read. Extra columns are not carried; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.graph import components
from tidewright.llm.storage import discard, input_bytes, materialise, most_frequent
from tidewright.llm.textkernel import mix, slices, words

N = 5
PERCENT = 80
#: Shingles that are put last at most; 16 bytes each are broadcast.
HOT_TOKENS = 1 << 17
#: Documents that share a shingle before it counts as frequent.
HOT_LEAST = 8
#: Shingles that a task sorts at once.
SORTED_TOKENS = 1 << 18
#: Keys up to this many are broadcast to pick documents; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000
_SALTS = tuple(np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0))
_FACTORS = tuple(np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, 64))


def shingle_sets(texts: list[str], n: int = N) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    _, _, _, h, first = words(texts)
    total = len(h)
    if total >= n:
        s = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            s += h[k : total - n + 1 + k] * _FACTORS[k]
        s = mix(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(s[a : b - n + 1]))
        elif b > a:
            x = np.full(1, b - a, np.uint64) * np.uint64(0x452821E638D01377)
            for k in range(a, b):
                x += h[k : k + 1] * _FACTORS[k - a]
            out.append(mix(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit key of the set."""
    return int(mix(np.add.reduce(mix(tokens), keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])


def needed(n: int, percent: int = PERCENT) -> int:
    """Least intersection with any set of at least the similarity."""
    return -(-percent * n // 100)


def ordered(tokens: np.ndarray, salt: int, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ranks of the tokens in one global order: frequency class, then a hash."""
    rank = mix(tokens ^ _SALTS[salt]) >> np.uint64(6)
    keys, level = hot
    if len(keys):
        short = tokens >> np.uint64(24)
        at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
        rank |= np.where(keys[at] == short, level[at], 0).astype(np.uint64) << np.uint64(58)
    return rank


def prefix(tokens: np.ndarray, rank: np.ndarray, size: int) -> np.ndarray:
    if size >= len(tokens):
        return tokens
    return tokens[np.argpartition(rank, size)[:size]]


def _pack(values: np.ndarray) -> bytes:
    """Ascending 32-bit values as gaps of three or four bytes."""
    gaps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    raw = gaps.view(np.uint8).reshape(-1, 4)
    wide = bool(len(raw) and raw[:, 3].any())
    return bytes([wide]) + (raw if wide else raw[:, :3]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = 4 if data[0] else 3
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, wide)
    full = np.zeros((len(raw), 4), np.uint8)
    full[:, :wide] = raw
    return full.view("<u4").ravel().cumsum(dtype=np.uint32)


def _packed(parts: list[np.ndarray], low: np.uint64) -> pa.RecordBatch:
    """Buckets and the packed low bits of the top 40 bits of their tokens."""
    short = np.sort(np.concatenate(parts) >> np.uint64(24))
    bucket = (short >> low).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (short & np.uint64((1 << int(low)) - 1)).astype(np.uint32)
    packed = [_pack(x) for x in np.split(rest, at[1:])] if len(at) else []
    return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "packed"])


def frequent_tokens(docs: DataFrame, limit: int = HOT_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens (their top 40 bits, ascending) and a class 1 to 63 by frequency."""
    bits = int(np.clip(np.ceil(np.log2(max(input_bytes(docs), 1) / 2e6)), 8, 30))
    low = np.uint64(40 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, texts in slices(batch):
                for s in shingle_sets(texts):
                    parts.append(s)
                    held += len(s)
                    if held >= SORTED_TOKENS:
                        yield _packed(parts, low)
                        parts, held = [], 0
        if held:
            yield _packed(parts, low)

    def total(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        value, n = np.unique(np.concatenate([_unpack(x) for x in frame["packed"]]), return_counts=True)
        keep = n >= HOT_LEAST
        return pd.DataFrame({"token": (np.uint64(key[0]) << low | value[keep].astype(np.uint64)).astype(np.int64), "n": n[keep].astype(np.int64)})

    counted = docs.select("text").mapInArrow(count, "bucket long, packed binary").groupBy("bucket").applyInPandas(total, "token long, n long")
    counted = materialise(counted, "frequent")
    top = most_frequent(counted, "n", limit).toPandas()
    discard(counted)
    if not len(top):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    top = top.sort_values("token")
    return top["token"].to_numpy().astype(np.uint64), np.minimum(np.floor(2 * np.log2(top["n"].to_numpy())), 63).astype(np.uint64)


def sketch(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, text_hash, n, key (of the set), prefix (first order, in it) and further (second order, 32 bits a token) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                rows: list[tuple] = []
                for s in shingle_sets(texts):
                    n = len(s)
                    if not n:
                        rows.append((0, 0, [], b""))
                        continue
                    key = set_key(s)
                    rank = ordered(s, 0, shared.value)
                    first = s[np.argsort(rank)[: n - needed(n) + 1]]
                    more = np.sort((prefix(s, ordered(s, 1, shared.value), long_prefix(n)) >> np.uint64(32)).astype("<u4"))
                    rows.append((n, key, first.view(np.int64), more.tobytes()))
                n, key, first, more = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int32()), pa.array(key, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(more, pa.binary())], names=["doc_id", "text_hash", "n", "key", "prefix", "further"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(f, "doc_id long, text_hash long, n int, key long, prefix array<long>, further binary")


def long_prefix(n: int) -> int:
    """Tokens in which similar sets share ceil(n / 10) at least."""
    return n - needed(n) + -(-n // 10)


def _share(a: bytes, b: bytes, need: int) -> bool:
    """Whether the second order's prefixes have `need` tokens in common, but for those that equal 32-bit parts hide.

    Common tokens with equal parts count once; there are no more of them than repeated parts in either prefix.
    """
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    u, v = np.unique(x), np.unique(y)
    return len(np.intersect1d(u, v, assume_unique=True)) >= max(1, need - min(len(x) - len(u), len(y) - len(v)))


def _filter_pairs(pairs: DataFrame, further: DataFrame) -> DataFrame:
    """Pairs (a, na, b, nb) that pass the second order."""
    left = further.select(F.col("key").alias("a"), F.col("further").alias("fa"))
    right = further.select(F.col("key").alias("b"), F.col("further").alias("fb"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, fa, fb = (batch.column(c).to_pylist() for c in ("na", "nb", "fa", "fb"))
            ok = [_share(x, y, min(-(-p // 10), -(-q // 10))) for p, q, x, y in zip(na, nb, fa, fb, strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "fa", "fb").mapInArrow(f, "a long, b long")


def _known(column: str) -> Column:
    """The key as a join column in which a null equals a null."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def _sets(docs: DataFrame, keys: DataFrame, classes: DataFrame) -> DataFrame:
    """key and whole set of the classes named by keys(key); read again from the documents with the id of one of each."""
    wanted = materialise(classes.join(keys.distinct(), "key", "left_semi").select("key", "rep"), "wanted")
    few = wanted.select(_known("rep").alias("_id")).distinct()
    chosen = docs.select("text", _known("doc_id").alias("_id")).join(_small(few, wanted), "_id", "left_semi").select("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch):
                sets = [s for s in shingle_sets(texts) if len(s)]
                if sets:
                    keys = [set_key(s) for s in sets]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "tokens"])

    # rows that share an id with a wanted one go before the sets are shuffled
    named = chosen.mapInArrow(f, "key long, tokens binary").join(_small(wanted.select("key"), wanted), "key", "left_semi")
    out = materialise(named.dropDuplicates(["key"]), "sets")
    discard(wanted)
    return out


def _small(df: DataFrame, of: DataFrame) -> DataFrame:
    """df, broadcast if the step that it comes from has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if of.count() <= BROADCAST_ROWS else df


def _verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs that pass the third order, then whole sets."""
    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x3, y3 = (z[np.argsort(mix(z ^ _SALTS[2]))[: long_prefix(len(z))]] for z in (u, v))
                if len(np.intersect1d(x3, y3, assume_unique=True)) < min(-(-len(u) // 10), -(-len(v) // 10)):
                    ok.append(False)
                    continue
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(f, "a long, b long")


def _alike(x: str, y: str) -> Column:
    """Sizes that the similarity allows."""
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def _in_place(n: str, pos: str, n2: str, pos2: str) -> Column:
    """Whether the tokens from the shared one on suffice; true for the first token that similar sets share."""
    return (100 + PERCENT) * F.least(F.col(n) - F.col(pos), F.col(n2) - F.col(pos2)) >= PERCENT * (F.col(n) + F.col(n2))


def _band(n: str) -> Column:
    """Sizes within the similarity are in one band or in two that follow each other."""
    return F.floor(F.ln(F.col(n).cast("double")) / F.lit(float(np.log(100 / PERCENT)))).cast("int")


def _links(docs: DataFrame, candidates: DataFrame, further: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    left = materialise(_filter_pairs(candidates, further), f"{name}-pairs")
    keys = left.select(F.col("a").alias("key")).union(left.select(F.col("b").alias("key")))
    sets = _sets(docs, keys, classes)
    links = materialise(_verify(left, sets), f"{name}-links")
    discard(left, sets)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every row."""
    return groups(docs).select("doc_id", "n_shingles", "component_id")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (a key of its own for each component, null without words) and component_id of every row."""
    wide = materialise(sketch(docs, frequent_tokens(docs)), "sketch")
    sketched = materialise(wide.select("doc_id", "text_hash", "n", "key"), "keys")
    full = sketched.where(F.col("n") > 0)
    classes = materialise(wide.where(F.col("n") > 0).groupBy("key", "n").agg(F.min("doc_id").alias("rep"), F.any_value("prefix").alias("prefix"), F.any_value("further").alias("further")), "classes")
    discard(wide)
    further = classes.select("key", "further")
    # tokens that two classes share, with the least class, the one that has the token earliest, and the group's size
    rows = classes.select("key", "n", F.posexplode("prefix").alias("pos", "token"))
    group = Window.partitionBy("token")
    low, first = F.min(F.struct("n", "key")).over(group), F.min(F.struct("pos", "n", "key")).over(group)
    ends = rows.withColumns({"low": low, "first": first, "size": F.count(F.lit(1)).over(group)})
    common = materialise(ends.where(F.col("size") > 1), "common")  # a class has a token once
    leads = common.groupBy("key", "n").agg(F.min("low").alias("x"), F.min("first").alias("y"), F.max_by("first", F.struct("size", "token")).alias("z"))
    one = lambda c: F.struct(F.col(f"{c}.key").alias("key"), F.col(f"{c}.n").alias("n"))
    pairs = leads.select("key", "n", F.explode(F.array(one("x"), one("y"), one("z"))).alias("e")).select("key", "n", F.col("e.key").alias("k2"), F.col("e.n").alias("n2")).where((F.col("key") != F.col("k2")) & _alike("n", "n2"))

    def as_pairs(df: DataFrame) -> DataFrame:
        swap = F.col("key") > F.col("k2")
        return df.select(F.least("key", "k2").alias("a"), F.greatest("key", "k2").alias("b"), F.when(swap, F.col("n2")).otherwise(F.col("n")).alias("na"), F.when(swap, F.col("n")).otherwise(F.col("n2")).alias("nb")).distinct()

    first = materialise(as_pairs(pairs), "first-pairs")
    links = _links(docs, first, further, classes, "first")
    labels = components(links)
    # pairs of different components in one token group
    placed = common.select("token", "key", "n", "pos").join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    placed = materialise(placed, "placed")
    discard(common, labels)
    counts = placed.groupBy("token", "label").count()
    largest = counts.groupBy("token").agg(F.max(F.struct("count", "label"))["label"].alias("largest"), F.count(F.lit(1)).alias("labels")).where(F.col("labels") > 1).select("token", "largest")
    split = materialise(placed.join(largest, "token").withColumn("band", _band("n")), "split")
    discard(placed)
    outside = split.where(F.col("label") != F.col("largest")).select("token", "band", "key", "n", "pos", "label")
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    every = split.select("token", near.alias("band"), F.col("key").alias("k2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("label").alias("label2"), (F.col("label") == F.col("largest")).alias("main"))
    cross = outside.join(every, ["token", "band"]).where((F.col("label") != F.col("label2")) & (F.col("main") | (F.col("key") < F.col("k2"))) & _alike("n", "n2") & _in_place("n", "pos", "n2", "pos2"))
    second = materialise(as_pairs(cross.select("key", "n", "k2", "n2")).join(first.select("a", "b"), ["a", "b"], "left_anti"), "second-pairs")
    discard(split, first)
    more = _links(docs, second, further, classes, "second")
    final = components(links.union(more))
    discard(second, links, more)
    # least doc_id of each component, back to the rows
    named = classes.select("key", "rep").join(final.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_key = materialise(named.join(least, "label").select("key", F.col("label").alias("component"), "component_id"), "by-key")
    discard(classes, final)
    linked = full.join(by_key, "key").select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), "component", "component_id")
    alone = sketched.where(F.col("n") == 0).select("doc_id", "text_hash", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
