"""Toxicity of documents from toxic spans that a linear-chain CRF tags.

Learning, from at most SAMPLE_DOCS labelled texts by a hash of the key:
1. Tokens get labels: words, prefixes and suffixes whose share of toxic
   documents departs from the base rate beyond chance (a binomial bound with
   the number of candidates in it) mark their tokens toxic in toxic documents.
2. The CRF learns these tokens in the whole sampled texts.
3. Forward-backward marginals give each text an expected number of toxic
   tokens and a greatest marginal; a logistic fit on the document labels turns
   them into a score.

Scoring reads whole texts. Spans are runs of words with a marginal above one
half; their offsets count code points. Texts that are null or have no word get
the score of no evidence and no span. Without labels of both kinds every score
is the constant base rate. Repeated rows get equal results; extra columns are
not carried; an empty table gives an empty result. Labels, lang, source and
doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.crf import Crf, Words, letter_words, new_crf, train
from tidewright.llm.language import held_out
from tidewright.llm.textkernel import RunHasher, slices

SAMPLE_DOCS = 2_500
#: Code points of the texts that one gradient step reads, but for a longer text.
STEP_CHARS = 60_000
BITS = 16
MINE_PREFIXES = (3, 4, 5, 6)
MINE_SUFFIXES = (4, 5, 6)
#: Texts whose candidates are held until they are counted.
MINE_DOCS = 100
#: Chance that any candidate passes without cause.
ALPHA = 0.01


@dataclass
class Model:
    crf: Crf | None
    coefficients: np.ndarray  # of evidence(), the constant last


def candidates(w: Words) -> np.ndarray:
    """Hashes of the word, its prefixes and suffixes; 0 where it is too short. Shape: words, candidates."""
    h, length = RunHasher(w.c), w.ends - w.starts
    out = [h(w.starts, w.ends)]
    out += [np.where(length > k, h(w.starts, np.minimum(w.starts + k, w.ends)) * np.uint64(3), 0) for k in MINE_PREFIXES]
    out += [np.where(length > k, h(np.maximum(w.ends - k, w.starts), w.ends) * np.uint64(5), 0) for k in MINE_SUFFIXES]
    return np.stack(out, 1)


def _added(counts: tuple[np.ndarray, np.ndarray], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their counts, with the keys of the parts."""
    keys, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    both, which = np.unique(np.concatenate([counts[0], keys]), return_inverse=True)
    return both, np.bincount(which, np.concatenate([counts[1], n]), len(both)).astype(np.int64)


def mine(docs: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """Candidates tied to toxic documents; docs: label and different candidates of each, counted MINE_DOCS at a time."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    counts, held, number = {1: none, 0: none}, {1: [], 0: []}, {1: 0, 0: 0}
    for y, c in docs:
        number[y] += 1
        held[y].append(c)
        if len(held[y]) >= MINE_DOCS:
            counts[y], held[y] = _added(counts[y], held[y]), []
    counts = {y: _added(counts[y], held[y]) for y in (1, 0)}
    if not number[0] or not number[1]:
        return none[0]
    rate = number[1] / (number[0] + number[1])
    keys, toxic = counts[1]
    if not len(keys):
        return none[0]
    others, clean = counts[0]
    if len(others):
        at = np.minimum(np.searchsorted(others, keys), len(others) - 1)
        clean = np.where(others[at] == keys, clean[at], 0)
    else:
        clean = np.zeros(len(keys), np.int64)
    total = toxic + clean
    share = toxic / total
    q = np.clip(share, 1e-9, 1 - 1e-9)
    bound = total * (share * np.log(q / rate) + (1 - share) * np.log((1 - q) / (1 - rate)))
    return keys[(keys != 0) & (share > max(0.5, rate)) & (bound > np.log(len(keys) / ALPHA))]


def evidence(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log of the expected toxic tokens, greatest marginal and 1, of each text."""
    total = np.append(0, np.cumsum(m))
    expected = total[first[1:]] - total[first[:-1]]
    most = np.zeros(len(first) - 1)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        most[some] = np.maximum.reduceat(m, first[:-1][some])
    return np.stack([np.log(np.maximum(expected, 0) + 0.05), most, np.ones(len(most))], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 40) -> np.ndarray:
    """Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        b += np.linalg.solve(hess, x.T @ (y - p) - ridge * b)
    return b


def _steps(texts: list[str], rng: np.random.Generator) -> list[list[int]]:
    """All texts in a random order, in parts of about STEP_CHARS code points."""
    parts: list[list[int]] = []
    held = STEP_CHARS
    for i in rng.permutation(len(texts)).tolist():
        if held >= STEP_CHARS:
            parts.append([])
            held = 0
        parts[-1].append(i)
        held += len(texts[i])
    return parts


def fit(rows: list[tuple[int, str]], seed: int = 5) -> Model:
    """A model from (toxic, text) rows."""
    rate = float(np.clip(np.mean([y for y, _ in rows]) if rows else 0.0, 1e-4, 1 - 1e-4))
    constant = Model(None, np.array([0.0, 0.0, np.log(rate / (1 - rate))]))
    found = mine((y, np.unique(candidates(letter_words([t])))) for y, t in rows)
    if not len(found):
        return constant

    def mark(y: int, text: str) -> np.ndarray:
        w = letter_words([text])
        return np.isin(candidates(w), found).any(1).astype(np.int8) if y else np.zeros(w.count, np.int8)

    steps = _steps([t for _, t in rows], np.random.default_rng(seed))
    batches = ((letter_words([rows[i][1] for i in part]), np.concatenate([mark(*rows[i]) for i in part])) for part in steps)
    crf = train(new_crf(BITS, ["clean", "toxic"]), batches, epochs=3)
    x = []
    for i in range(0, len(rows), 200):
        w = letter_words([t for _, t in rows[i : i + 200]])
        x.append(evidence(crf.marginals(w)[:, 1], w.first))
    return Model(crf, logistic(np.concatenate(x), np.array([y for y, _ in rows], float)))


def score(texts: list[str], model: Model) -> tuple[np.ndarray, list[list[dict]]]:
    """Score and toxic spans of each text."""
    w = letter_words(texts)
    if model.crf is None:
        return np.full(len(texts), 1 / (1 + np.exp(-model.coefficients[-1]))), [[] for _ in texts]
    m = model.crf.marginals(w)[:, 1]
    s = 1 / (1 + np.exp(-np.clip(evidence(m, w.first) @ model.coefficients, -30, 30)))
    spans: list[list[dict]] = [[] for _ in texts]
    hot = m > 0.5
    owner = np.searchsorted(w.first, np.arange(w.count), side="right") - 1
    for i in np.flatnonzero(hot).tolist():
        d = int(owner[i])
        a, b = int(w.starts[i] - w.at[d]), int(w.ends[i] - w.at[d])
        if i and hot[i - 1] and owner[i - 1] == d and spans[d]:
            spans[d][-1]["end"] = b
            spans[d][-1]["score"] = max(spans[d][-1]["score"], float(m[i]))
        else:
            spans[d].append({"start": a, "end": b, "score": float(m[i])})
    return s, spans


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def tag(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """Columns `carry` (doc_id if not given), score and spans of every row."""
    carry = carry or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights for two labels

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                s, spans = score(texts, shared.value)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(s), pa.array(spans, SPANS)], names=[*carry, "score", "spans"])

    columns = list(dict.fromkeys([*carry, "text"]))
    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in carry)
    return docs.select(*columns).mapInArrow(f, f"{schema}, score double, spans array<struct<start: long, end: long, score: double>>")


def fit_documents(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> Model:
    """Learn from labelled documents that are not held out; at most `size` rows reach the driver."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "toxic").distinct()
    # labels of documents that are not there don't count
    met = docs.select("doc_id").join(known, "doc_id").distinct()
    few = met.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(size)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("toxic", F.coalesce("text", F.lit("")), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "text").limit(size).collect()
    return fit([(int(r[0]), r[1]) for r in rows])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    tagged = tag(docs, fit_documents(docs, labels))
    return tagged.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("spans").alias("n_spans"))
