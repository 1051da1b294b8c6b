"""Near-duplicate vectors by passes over sorted projections.

Two vectors link when their labels are equal and their cosine is at least 0.93.

1. Equal vectors of a label become one class with a count.
2. A pass draws random directions. A hash is the direction (with its sign) that
   a vector lies closest to; several hashes in a row are the class's key. Classes
   are sorted by (length, label, key) over the whole table, and each is compared
   with its WINDOW neighbours before it; neighbourhoods across two partitions
   are compared in a second step. The links found within a window are reduced
   to those that no chain of links inside it replaces. How many passes run follows
   from the rows of the largest label, so that a pair at the threshold is
   missed by all passes with a chance below MISS.
3. The passes' links make components. A window is bounded, so a group of near
   copies larger than it isn't compared in full by the passes; its links are
   made whole here: members within half the threshold's angle of their
   component's leader link with each other by the triangle inequality and are
   counted by one sum; every other member is compared with all members, in
   blocks of BLOCK rows by BLOCK rows dealt out over the cluster.

Rows whose label or vector is null, or whose vector is zero, empty or holds a
null or non-finite component, link with nothing. Vectors of different lengths
don't link. Repeated rows are copies of one another and link. Rows with a null
vec_id take part; a component of such rows alone has a null component_id, and
so has an unlinked one. Other columns are not carried; an empty table gives an
empty result.

The work of step 3 is a square only for members farther than half the angle
from their leader; a label whose vectors chain into one wide component costs
that square.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.graph import components
from tidewright.llm.storage import discard, materialise
from tidewright.llm.vectorcodes import finite

THRESHOLD = 0.93
#: Neighbours before it that a class is compared with in each pass.
WINDOW = 32
#: Chance that a pair at the threshold is missed by all passes.
MISS = 1e-4
#: Rows that are compared at once.
TILE = 224
BLOCK = 512
#: Random directions of a hash.
DIRECTIONS = 64
#: Angle that rounding may take from a sum of two.
SLACK = 1e-6


def unit(batch: pa.RecordBatch, width: int, column: str = "embedding") -> np.ndarray:
    """Rows of one length as unit vectors."""
    x = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def directions(turn: int, place: int, width: int) -> np.ndarray:
    """The random directions of one hash of one pass."""
    return np.random.default_rng([turn, place, width]).standard_normal((width, min(width, DIRECTIONS) if width > 1 else 1))


def keys(x: np.ndarray, turn: int, hashes: int) -> list[bytes]:
    """The concatenated hashes of unit vectors, and last a projection, as bytes in the order to sort by."""
    out = np.zeros((len(x), hashes + 1), ">u2")
    for k in range(hashes):
        p = x @ directions(turn, k, x.shape[1])
        at = np.abs(p).argmax(1)
        out[:, k] = 2 * at + (p[np.arange(len(x)), at] < 0)
    rest = x @ directions(turn, hashes, x.shape[1])[:, 0]
    out[:, hashes] = np.clip((rest + 8) * 4096, 0, 65535).astype(np.uint16)
    return [r.tobytes() for r in out]


def collision(width: int, threshold: float, pairs: int = 4000) -> float:
    """Share of pairs at the threshold whose hashes agree, by simulation."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((pairs, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((pairs, width))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = threshold * x + math.sqrt(1 - threshold * threshold) * z
    d = directions(0, 0, width)
    p, q = x @ d, y @ d
    i, j = np.abs(p).argmax(1), np.abs(q).argmax(1)
    rows = np.arange(pairs)
    return float(((i == j) & (np.sign(p[rows, i]) == np.sign(q[rows, j]))).mean())


def plan(rows: int, width: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> tuple[int, int]:
    """Passes, and hashes in a key, for `rows` classes of the largest label."""
    buckets = 2 * min(max(width, 1), DIRECTIONS)
    depth = max(1.0, math.log(max(rows / window, 1)) / math.log(max(buckets, 2)))
    met = min(max(collision(max(width, 1), threshold), 1e-3) ** depth, 0.999)
    return max(6, math.ceil(math.log(miss) / math.log(1 - met))), math.ceil(depth) + 1


def _runs(batch: pa.RecordBatch, column: str = "embedding") -> Iterator[tuple[pa.RecordBatch, int]]:
    """Slices of the batch whose vectors have one length."""
    n = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(np.diff(n, prepend=-1))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(n)], strict=True):
        yield batch.slice(a, b - a), int(n[a])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, key (null for rows that link with nothing), label, embedding."""
    for batch in batches:
        for rows, width in _runs(batch):
            digests: list[bytes | None] = [None] * rows.num_rows
            if width:
                x = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, width) + 0.0
                good = np.asarray(rows.column("fit")) & (x != 0).any(1)
                for i in np.flatnonzero(good).tolist():
                    digests[i] = hashlib.blake2b(x[i].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), pa.array(digests, pa.binary()), rows.column("embedding")], names=["vec_id", "label", "key", "embedding"])


def _signed(batches: Iterator[pa.RecordBatch], turn: int, hashes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, width in _runs(batch):
            yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("label"), pa.array(keys(unit(rows, width), turn, hashes), pa.binary()), rows.column("embedding")], names=["node", "label", "sig", "embedding"])


EDGE_SCHEMA = "a long, b long, part int, tail boolean, place int, node long, label string, embedding array<double>"


def _edges(a: np.ndarray, b: np.ndarray, border: pa.Table | None = None, part: int = 0, tail: bool = False) -> pa.RecordBatch:
    """Links, or rows at a partition's border, in one schema."""
    n = len(a) if border is None else border.num_rows
    none = border is None
    return pa.RecordBatch.from_arrays(
        [
            pa.array(a, pa.int64()) if none else pa.nulls(n, pa.int64()),
            pa.array(b, pa.int64()) if none else pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.int32()) if none else pa.array(np.full(n, part, np.int32)),
            pa.nulls(n, pa.bool_()) if none else pa.array(np.full(n, tail)),
            pa.nulls(n, pa.int32()) if none else pa.array(np.arange(n, dtype=np.int32)),
            pa.nulls(n, pa.int64()) if none else border.column("node").combine_chunks(),
            pa.nulls(n, pa.string()) if none else border.column("label").combine_chunks(),
            pa.nulls(n, pa.list_(pa.float64())) if none else border.column("embedding").combine_chunks(),
        ],
        names=["a", "b", "part", "tail", "place", "node", "label", "embedding"],
    )


class Neighbours:
    """Compares sorted rows with those before them; rows of one group and label meet within the window."""

    def __init__(self, threshold: float, window: int) -> None:
        self.threshold, self.window = threshold, window
        self.width, self.last, self.run = -1, None, 0
        self.x = self.nodes = self.runs = np.zeros(0)

    def take(self, rows: pa.RecordBatch, width: int, group: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of the next rows; group holds what rows that may link have in common."""
        if width != self.width:
            self.width, self.last = width, None
            self.x, self.nodes, self.runs = np.zeros((0, width)), np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.fromiter((g != h for g, h in zip(group, [self.last, *group[:-1]], strict=True)), bool, len(group))
        runs = self.run + np.cumsum(new)
        self.run, self.last = int(runs[-1]), group[-1]
        x, nodes = unit(rows, width), rows.column("node").to_numpy()
        for first in range(0, len(x), TILE):
            own, own_nodes, own_runs = (v[first : first + TILE] for v in (x, nodes, runs))
            every, every_nodes, every_runs = np.concatenate([self.x, own]), np.concatenate([self.nodes, own_nodes]), np.concatenate([self.runs, own_runs])
            n, before = len(every), len(self.x)
            step = np.arange(n)[:, None] - np.arange(n)[None, :]
            near = (step > 0) & (step <= self.window) & (every_runs[:, None] == every_runs[None, :])
            link = near & (every @ every.T >= self.threshold)
            # a link that two shorter ones replace adds nothing to the components
            through = (link.astype(np.float32) @ link.astype(np.float32)) > 0
            i, j = np.nonzero(link & ~through)
            fresh = i >= before
            yield every_nodes[i[fresh]], every_nodes[j[fresh]]
            self.x, self.nodes, self.runs = every[-self.window :], every_nodes[-self.window :], every_runs[-self.window :]


def _swept(batches: Iterator[pa.RecordBatch], threshold: float, window: int) -> Iterator[pa.RecordBatch]:
    """Links inside a sorted partition, and the rows at its two borders."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    scan, head, tail = Neighbours(threshold, window), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        for rows, width in _runs(batch):
            for a, b in scan.take(rows, width, rows.column("label").to_pylist()):
                if len(a):
                    yield _edges(a, b)
        table = pa.Table.from_batches([batch.select(["node", "label", "embedding"])])
        head = table if head is None else head if head.num_rows >= window else pa.concat_tables([head, table])
        head = head.slice(0, window)
        tail = table if tail is None else pa.concat_tables([tail, table])
        tail = tail.slice(max(0, tail.num_rows - window)).combine_chunks()
    if head is not None:
        yield _edges(np.zeros(0), np.zeros(0), head, part - 1, False)
        yield _edges(np.zeros(0), np.zeros(0), tail, part, True)


def _stitched(batches: Iterator[pa.RecordBatch], threshold: float, window: int) -> Iterator[pa.RecordBatch]:
    """Links of the rows at the borders between two partitions."""
    scan = Neighbours(threshold, window)
    for batch in batches:
        for rows, width in _runs(batch):
            group = list(zip(rows.column("part").to_pylist(), rows.column("label").to_pylist(), strict=True))
            for a, b in scan.take(rows, width, group):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _pass(classes: DataFrame, turn: int, hashes: int, parts: int, threshold: float, window: int) -> list[DataFrame]:
    """Links that one pass finds, as two steps."""
    order = ["width", "label", "sig", "node"]
    signed = classes.select("node", "label", "embedding").mapInArrow(lambda it: _signed(it, turn, hashes), "node long, label string, sig binary, embedding array<double>")
    ranged = signed.withColumn("width", F.size("embedding")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    swept = materialise(ranged.select("node", "label", "embedding").mapInArrow(lambda it: _swept(it, threshold, window), EDGE_SCHEMA), f"pass-{turn}")
    borders = swept.where(F.col("node").isNotNull()).select("part", F.size("embedding").alias("width"), ~F.col("tail"), "place", "node", "label", "embedding")
    borders = borders.toDF("part", "width", "head", "place", "node", "label", "embedding")
    met = borders.repartition("part").sortWithinPartitions("part", "width", "head", "place")
    return [swept, materialise(met.mapInArrow(lambda it: _stitched(it, threshold, window), "a long, b long"), f"borders-{turn}")]


def _angles(batches: Iterator[pa.RecordBatch], half: float) -> Iterator[pa.RecordBatch]:
    """Whether each member is farther than half the angle from its leader."""
    for batch in batches:
        for rows, width in _runs(batch):
            x, y = unit(rows, width), unit(rows, width, "leader")
            far = 2 * np.arcsin(np.minimum(np.sqrt(((x - y) ** 2).sum(1)) / 2, 1)) > half
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("comp", "node", "n")), pa.array(far), rows.column("embedding")], names=["comp", "node", "n", "far", "embedding"])


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each unit of work (sorted by its key): rows that members of two blocks link to."""

    def finish(parts: list[tuple]) -> pa.RecordBatch:
        node, n, asks, far, x = (np.concatenate(v) for v in zip(*parts, strict=True))
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        link = (x[q] @ x[m].T >= threshold) & (node[q][:, None] != node[m][None, :])
        near = ~far[m]  # far members ask for themselves
        got = np.concatenate([(link * n[m][None, :]).sum(1), (link[:, near] * n[q][:, None]).sum(0)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[q], node[m[near]]])), pa.array(got, pa.int64())], names=["node", "links"])

    held, key = [], None
    for batch in batches:
        for rows, width in _runs(batch):
            units = list(zip(*(rows.column(c).to_pylist() for c in ("comp", "i", "j")), strict=True))
            columns = [*(rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "asks", "far")), unit(rows, width)]
            at = [0, *(k for k in range(1, len(units)) if units[k] != units[k - 1]), len(units)]
            for a, b in zip(at[:-1], at[1:], strict=True):
                if units[a] != key and held:
                    yield finish(held)
                    held = []
                key = units[a]
                held.append(tuple(c[a:b] for c in columns))
    if held:
        yield finish(held)


def _whole_links(classes: DataFrame, labels: DataFrame, threshold: float, block: int) -> DataFrame:
    """node and the number of rows of other classes that it links with, for classes in a component."""
    spark = classes.sparkSession
    members = materialise(classes.join(labels.select("node", F.col("label").alias("comp")), "node").select("comp", "node", "n", "embedding"), "members")
    leaders = members.where(F.col("node") == F.col("comp")).select("comp", F.col("embedding").alias("leader"))
    half = math.acos(threshold) / 2 - SLACK
    placed = members.join(leaders, "comp").mapInArrow(lambda it: _angles(it, half), "comp long, node long, n long, far boolean, embedding array<double>")
    placed = materialise(placed, "placed")
    sizes = placed.groupBy("comp").agg(F.sum(F.when(~F.col("far"), F.col("n"))).alias("near_rows"), F.max("far").alias("any_far"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sizes = materialise(sizes, "sizes")
    close = placed.where(~F.col("far")).select("comp", "node", "n").join(sizes, "comp").select("node", (F.col("near_rows") - F.col("n")).alias("links"))
    wide = placed.join(sizes.where("any_far").select("comp", "blocks"), "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asking = wide.where("far").select("comp", F.col("block").alias("i"), every.alias("j"), F.lit(True).alias("asks"), "node", "n", "far", "embedding")
    asked = wide.select("comp", every.alias("i"), F.col("block").alias("j"), F.lit(False).alias("asks"), "node", "n", "far", "embedding")
    units = asking.unionByName(asked).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    found = units.mapInArrow(lambda it: _compared(it, threshold), "node long, links long")
    out = materialise(close.unionByName(found).groupBy("node").agg(F.sum("links").alias("links")), "links")
    discard(members, placed, sizes)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, block: int = BLOCK, passes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, label, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), (finite() & F.col("label").isNotNull()).alias("fit"), F.col("embedding").cast("array<double>").alias("embedding"))
    # vectors that link with nothing aren't carried
    rows = rows.withColumn("embedding", F.when(F.col("fit"), F.col("embedding")).otherwise(F.array().cast("array<double>")))
    keyed = materialise(rows.mapInArrow(_keyed, "vec_id long, label string, key binary, embedding array<double>"), "vectors", compression="zstd")
    grouped = keyed.where(F.col("key").isNotNull()).groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("embedding").alias("embedding"))
    classes = materialise(grouped.withColumn("node", F.monotonically_increasing_id()), "classes", compression="zstd")
    shape = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).agg(F.max("n").alias("n"), F.max("width").alias("width")).first()
    turns, hashes = plan(shape["n"] or 1, shape["width"] or 1, threshold, window)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [s for turn in range(passes or turns) for s in _pass(classes, turn, hashes, parts, threshold, window)]
    edges = steps[0].select("a", "b")
    for s in steps[1:]:
        edges = edges.union(s.select("a", "b"))
    labels = components(edges.where(F.col("a").isNotNull()))
    discard(*steps)
    links = _whole_links(classes, labels, threshold, block)
    named = classes.select("node", "label", "key", "rep", "n").join(labels.select("node", F.col("label").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_class = named.join(least, "comp").join(links, "node", "left").select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    by_class = materialise(by_class, "by-class")
    discard(labels, links, classes)
    linked = keyed.where(F.col("key").isNotNull()).select("vec_id", "label", "key").join(by_class, ["label", "key"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where(F.col("key").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: DuckDB SQL of the same rows, by all pairs of a label; for vectors of one length and distinct, known ids.
ORACLE_SQL = """
WITH RECURSIVE good AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(v, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r FROM reach JOIN links l ON l.a = reach.v),
least AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v = component_id AS kept FROM least LEFT JOIN degree ON a = v
"""
