"""Regime codebooks: k-means over train rows, soft assignments, novelty and causal smoothing.

All starts run side by side: a row's nearest centre under each start is one
expression, and one aggregation a round sums what every (start, centre) has
got. Only centres (starts x regimes x features) reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.recursion import Recursion, ewm, fold

Centres = list[list[float]]


@dataclass(frozen=True)
class Codebook:
    """Centres with the median and the 95th percentile of the train rows' mean squared distances to the nearest one."""

    features: tuple[str, ...]
    centres: tuple[tuple[float, ...], ...]
    distance_scale: float
    novelty_scale: float
    temperature: float
    rows: int


def distances(features: Sequence[str], centres: Centres) -> list[Column]:
    """Mean squared distances to the centres."""
    return [reduce(lambda a, b: a + b, [(F.col(f) - float(v)) * (F.col(f) - float(v)) for f, v in zip(features, c, strict=True)]) / len(features) for c in centres]


def nearest(d: list[Column]) -> Column:
    """Index of the least distance; ties to the first."""
    return F.array_position(F.array(*d), F.least(*d)).cast("int") - 1


def first_centres(df: DataFrame, features: Sequence[str], keys: Sequence[str], count: int, starts: int, seed: int) -> list[Centres]:
    """`count` rows for each start: those with the least hash of seed, start and key (a bounded top-k)."""
    out = []
    for s in range(starts):
        h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(str(s)), *[F.col(k).cast("string") for k in keys]))
        out.append([[float(r[f]) for f in features] for r in df.select(*features, h.alias("_h")).orderBy("_h").limit(count).collect()])
    return out


def fit_codebook(df: DataFrame, features: Sequence[str], keys: Sequence[str], count: int, starts: int = 4, rounds: int = 12, seed: int = 7, temperature: float = 0.35) -> Codebook:
    """k-means on rows whose features are all known and finite; the start with the least inertia wins (ties: the first).

    keys: columns that name a row. Fewer rows than regimes make fewer regimes; a centre without rows stays.
    """
    known = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) < float("inf")) for f in features])
    # read once a round: kept, and made again where an executor is lost
    rows = df.where(known).select(*keys, *features).persist()
    books = first_centres(rows, features, keys, max(count, 2), starts, seed)
    if not books or not books[0]:
        raise ValueError("no finite rows to fit regimes on")
    for _ in range(rounds):
        codes = [F.struct(F.lit(s).alias("s"), nearest(distances(features, b)).alias("c")) for s, b in enumerate(books)]
        sums = rows.select(*features, F.inline(F.array(*codes))).groupBy("s", "c").agg(*[F.avg(f).alias(f) for f in features]).collect()
        after = [[list(c) for c in b] for b in books]
        for r in sums:
            after[r["s"]][r["c"]] = [float(r[f]) for f in features]
        if after == books:
            break
        books = after
    least = [F.least(*d) if len(d) > 1 else d[0] for d in (distances(features, b) for b in books)]
    inertia = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(d).alias(f"i{s}") for s, d in enumerate(least)]).first()
    best = min(range(len(books)), key=lambda s: (inertia[f"i{s}"], s))
    near = least[best]
    scale = rows.select(near.alias("d")).where(F.col("d") > 1e-10).agg(F.percentile("d", F.array(F.lit(0.5), F.lit(0.95))).alias("q")).first()["q"] or [1.0, 1.0]
    rows.unpersist()
    return Codebook(tuple(features), tuple(map(tuple, books[best])), max(scale[0], 1e-6), max(scale[1], 1e-6), temperature, inertia["n"])


def regime_shares(df: DataFrame, book: Codebook, alpha: float = 0.25, keys: tuple[str, ...] = ("symbol",), time: str = "day") -> DataFrame:
    """df with regime_<i> (soft shares), smooth_<i> (of this and past rows only), novelty and regime (the greatest smooth share).

    Rows with a missing feature have no shares; smoothing passes over them.
    """
    d = distances(book.features, [list(c) for c in book.centres])
    df = df.withColumns({f"_d{i}": x for i, x in enumerate(d)})
    d = [F.col(f"_d{i}") for i in range(len(book.centres))]
    least = F.least(*d) if len(d) > 1 else d[0]
    whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in book.features])
    parts = [F.exp(F.greatest(-(x - least) / (book.distance_scale * book.temperature), F.lit(-60.0))) for x in d]
    total = reduce(lambda a, b: a + b, parts)
    names = [f"regime_{i}" for i in range(len(d))]
    df = df.withColumns({n: F.when(whole, p / total) for n, p in zip(names, parts, strict=True)} | {"novelty": F.when(whole, least / book.novelty_scale)}).drop(*[f"_d{i}" for i in range(len(d))])
    df = fold(df, [Recursion(f"smooth_{i}", n, partial(forward, alpha=alpha)) for i, n in enumerate(names)], keys=keys, time=time)
    smooth = [F.col(f"smooth_{i}") for i in range(len(names))]
    return df.withColumn("regime", F.array_position(F.array(*smooth), F.greatest(*smooth) if len(smooth) > 1 else smooth[0]).cast("int") - 1)


def forward(x, alpha: float):
    """Exponential mean of the rows that have a value; the others have none."""
    out, seen = x.copy(), x == x
    out[seen] = ewm(x[seen], alpha)
    return out
