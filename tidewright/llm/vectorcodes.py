"""Product-quantised vector codes by Lloyd rounds that move only what changed.

Components become integers floor(4096 x), a vector eight equal parts. A step
table in the shared folder persists each row's codes; the codebooks' running
sums and counts are integers. In a round every task assigns its rows anew and
adds up, for each part and entry, what rows with another code than before
bring (plus) and take away (minus); only these sums are shuffled, at most one
row a part, entry and component of a task. The codebooks (8 x 16 entries) are
the only thing that reaches the driver.

All arithmetic is exact: float64 products where every value and sum stays
below 2**53, Python integers otherwise.

Rows whose vector is null or holds a null or non-finite component are dropped.
The length of the first vector (by vec_id, nulls last, then by its
components) is the length of all: a vector of another length, or all if it is
no multiple of eight, gets a null code and error. Repeated rows each count and
are each returned. Fewer than sixteen vectors make fewer entries. An error
above the long range is given as the greatest long. Other columns are not
carried; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.storage import discard, materialise

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Rows that are compared with the codebooks at once.
SLICE = 4096
LIMBS = 4
LIMB_BITS = 40
GREATEST = (1 << 63) - 1
DELTA = "array<struct<part:int,entry:int,place:int,l0:long,l1:long,l2:long,l3:long>>"


def finite(column: str = "embedding") -> object:
    """Whether the vector is there and all its components are finite."""
    return F.col(column).isNotNull() & F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(values: np.ndarray) -> np.ndarray:
    """floor(4096 x): float64 if all results are exact below 2**53, else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if not len(scaled) or np.abs(scaled).max() < 2**53:
        return scaled
    return np.array([int(np.floor(x * SCALE)) if abs(x) < 2**40 else int(x) * SCALE for x in values.tolist()], dtype=object)


def exact_in_floats(greatest: int, width: int, rows: int) -> bool:
    """Whether squared distances of a part and sums of rows stay below 2**53."""
    return 8 * greatest * greatest * max(width, 1) < 2**53 and greatest * rows < 2**53


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the least) and the squared distance of each row of x."""
    if x.dtype == object or entries.dtype == object:
        d = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in entries] for r in x], dtype=object).reshape(len(x), len(entries))
        code = np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], np.int64)
        return code, d[np.arange(len(x)), code]
    d = (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code]


class Contributions:
    """Plus and minus sums of a task: for each part and entry the components' sums and, last, the count."""

    def __init__(self, entries: int, width: int) -> None:
        self.total = np.zeros((PARTS, entries, width + 1), dtype=object)
        self.width = width

    def add(self, part: int, code: np.ndarray, x: np.ndarray, sign: int) -> None:
        entries = self.total.shape[1]
        if x.dtype == object:
            for c, row in zip(code.tolist(), x, strict=True):
                self.total[part, c, : self.width] += sign * row
        else:
            hot = np.zeros((entries, len(code)))
            hot[code, np.arange(len(code))] = 1
            self.total[part, :, : self.width] += sign * (hot @ x).astype(np.int64).astype(object)
        self.total[part, :, self.width] += sign * np.bincount(code, minlength=entries).astype(object)

    def rows(self) -> list[dict]:
        out = []
        for part, entry, place in zip(*(a.tolist() for a in np.nonzero(self.total)), strict=True):
            v = int(self.total[part, entry, place])
            limbs = [(v >> LIMB_BITS * k) & ((1 << LIMB_BITS) - 1) for k in range(LIMBS - 1)] + [v >> LIMB_BITS * (LIMBS - 1)]
            out.append({"part": part, "entry": entry, "place": place, **{f"l{k}": x for k, x in enumerate(limbs)}})
        return out


def _assign(batches: Iterator[pa.RecordBatch], book: list[list[list[int]]], length: int) -> Iterator[pa.RecordBatch]:
    """Rows with new codes and errors, and one last row with the task's contributions."""
    width, entries = length // PARTS, len(book[0])
    most = max((abs(c) for part in book for e in part for c in e), default=0)
    floats = [np.array(part, np.float64).reshape(entries, width) for part in book] if most < 2**53 else None
    exact = [np.array(part, dtype=object).reshape(entries, width) for part in book]
    changes, schema = Contributions(entries, width), None
    for batch in batches:
        schema = batch.schema
        for first in range(0, batch.num_rows, SLICE):
            rows = batch.slice(first, SLICE)
            vectors = rows.column("embedding")
            fits = (vectors.value_lengths().to_numpy(zero_copy_only=False) == length) & (length % PARTS == 0)
            at = np.flatnonzero(fits)
            x = integers(vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(at), width * PARTS if len(at) else 0)
            bound = max(most, int(np.abs(x).max()) if x.size else 0)
            quick = floats is not None and x.dtype != object and exact_in_floats(bound, width, SLICE)
            if not quick and x.dtype != object:
                x = np.array([[int(v) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape)
            before = rows.column("codes").filter(pa.array(fits))
            old = None if before.null_count == len(before) else np.frombuffer(b"".join(before.to_pylist()), np.uint8).reshape(-1, PARTS)
            new = np.zeros((len(at), PARTS), np.uint8)
            error = np.zeros(len(at), dtype=object if not quick else np.float64)
            for part in range(PARTS if len(at) else 0):
                own = x[:, part * width : (part + 1) * width]
                code, d = nearest(own, floats[part] if quick else exact[part])
                new[:, part] = code
                error += d
                moved = np.arange(len(at)) if old is None else np.flatnonzero(old[:, part] != code)
                changes.add(part, code[moved], own[moved], 1)
                if old is not None:
                    changes.add(part, old[moved, part].astype(np.int64), own[moved], -1)
            codes: list[bytes | None] = [None] * rows.num_rows
            errors: list[int | None] = [None] * rows.num_rows
            for i, c, e in zip(at.tolist(), new, error.tolist(), strict=True):
                codes[i], errors[i] = c.tobytes(), min(int(e), GREATEST)
            yield pa.RecordBatch.from_arrays(
                [rows.column("vec_id"), rows.column("label"), vectors, pa.array(codes, pa.binary()), pa.array(errors, pa.int64()), pa.nulls(rows.num_rows, _delta_type())],
                names=["vec_id", "label", "embedding", "codes", "error", "delta"],
            )
    if schema is not None:
        nothing = [pa.nulls(1, schema.field(c).type) for c in ("vec_id", "label", "embedding")]
        yield pa.RecordBatch.from_arrays([*nothing, pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([changes.rows()], _delta_type())], names=["vec_id", "label", "embedding", "codes", "error", "delta"])


def _delta_type() -> pa.DataType:
    fields = [(c, pa.int32()) for c in ("part", "entry", "place")] + [(f"l{k}", pa.int64()) for k in range(LIMBS)]
    return pa.list_(pa.struct(fields))


def _apply(step: DataFrame, running: np.ndarray) -> None:
    """Add a round's contributions to the running sums (at most one row a part, entry and component comes to the driver)."""
    terms = step.where(F.col("delta").isNotNull()).select(F.inline("delta"))
    for r in terms.groupBy("part", "entry", "place").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).collect():
        running[r["part"], r["entry"], r["place"]] += sum(r[f"l{k}"] << LIMB_BITS * k for k in range(LIMBS))


def code_vectors(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, codes (one byte a part), error) of every kept row of vectors(vec_id, label, embedding), and the codebooks."""
    kept = vectors.select("vec_id", "label", "embedding").where(finite())
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    length = len(first[0]["embedding"]) if first else 0
    width = length // PARTS
    seeds = [integers(np.array(r["embedding"], np.float64)).tolist() for r in first if len(r["embedding"]) == length]
    book = [[[int(v) for v in s[p * width : (p + 1) * width]] for s in seeds] or [[]] for p in range(PARTS)]
    kinds = dict(kept.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, embedding {kinds['embedding']}, codes binary, error long, delta {DELTA}"
    running = np.zeros((PARTS, len(book[0]), width + 1), dtype=object)
    current, last = kept.withColumn("codes", F.lit(None).cast("binary")), None
    for k in range(rounds + 1):
        step = materialise(current.mapInArrow(lambda it, book=book: _assign(it, book, length), schema), f"codes-{k}", compression="zstd")
        if last is not None:
            discard(last)
        current, last = step.where(F.col("delta").isNull()).select("vec_id", "label", "embedding", "codes"), step
        if k < rounds:
            _apply(step, running)
            book = [[[s // int(sums[-1]) for s in map(int, sums[:-1])] if sums[-1] else old for sums, old in zip(running[p], book[p], strict=True)] for p in range(PARTS)]
    return last.where(F.col("delta").isNull()).select("vec_id", "label", "codes", "error"), book


def digest(book: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(v) for part in book for e in part for v in e).encode()).hexdigest()


def code_table(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of every kept row."""
    rows, book = code_vectors(vectors)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = rows.groupBy("label").agg(F.least(total, F.lit(GREATEST)).cast("long").alias("label_error")).withColumnRenamed("label", "_label")
    joined = rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def _oracle() -> str:
    """DuckDB SQL of the same rounds, written out; for vectors of one length."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT n, p, list_transform(embedding[p * (len(embedding) // {PARTS}) + 1:(p + 1) * (len(embedding) // {PARTS})], lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM kept, range({PARTS}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, n - 1 AS e, v FROM parts WHERE n <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        distance = "list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
        steps.append(f"best{k} AS MATERIALIZED (SELECT a.n, a.p, any_value(a.v) AS v, min({distance} * {ENTRIES} + b.e) AS m FROM parts a JOIN book{k} b ON a.p = b.p GROUP BY a.n, a.p)")
        if k < ROUNDS:
            steps.append(f"sums{k} AS (SELECT p, m % {ENTRIES} AS e, i, sum(v[i + 1]) AS s, count(*) AS c FROM best{k}, LATERAL (SELECT unnest(range(len(v))) AS i) GROUP BY ALL)")
            steps.append(f"means{k} AS (SELECT p, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS v FROM sums{k} GROUP BY p, e)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m ON m.p = b.p AND m.e = b.e)")
    last = f"best{ROUNDS}"
    steps.append(f"coded AS MATERIALIZED (SELECT n, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM {last} GROUP BY n)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS d FROM book{ROUNDS})")
    return f"WITH {', '.join(steps)} SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.d AS codebooks_sha256 FROM kept k JOIN coded c ON k.n = c.n CROSS JOIN digest d"


ORACLE_SQL = _oracle()
