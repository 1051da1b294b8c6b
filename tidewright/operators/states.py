"""States of feature groups: semantic targets, confidence, observation channels, routing and sample windows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.scalars import clip, ratio, row_mean, safe_log, sigmoid
from tidewright.operators.frames import Ordered
from tidewright.operators.recursion import Recursion, ema, fold, fold_rows, robust_z, rolling_correlation

O = Ordered()  # noqa: E741


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def row_deviation(columns: Sequence[Column]) -> Column:
    """Sample deviation of the values that are there; null below two."""
    n = total([c.isNotNull().cast("int") for c in columns])
    mean = row_mean(list(columns))
    square = total([F.coalesce(F.pow(c - mean, F.lit(2.0)), F.lit(0.0)) for c in columns])
    return F.when(n > 1, F.sqrt(square / F.nullif(n - 1, F.lit(0))))


def row_product(columns: Sequence[Column], least: int) -> Column:
    """Product of the values that are there, if there are `least`."""
    n = total([c.isNotNull().cast("int") for c in columns])
    return F.when(n >= least, reduce(lambda a, b: a * b, [F.coalesce(c, F.lit(1.0)) for c in columns]))


def with_robust_z(df: DataFrame, sources: Mapping[str, Column], window: int, least: int | None = None) -> DataFrame:
    """Columns with the median z of each source over the last rows: 0 without spread or history."""
    least = least or max(window // 4, 20)
    df = df.withColumns({f"_x_{n}": c for n, c in sources.items()})
    df = fold(df, [Recursion(n, f"_x_{n}", partial(robust_z, window=window, least=least)) for n in sources])
    return df.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in sources}).drop(*[f"_x_{n}" for n in sources])


def confidence(components: Sequence[Column], freshness: Column, missing: Column, support: Column | None = None) -> Column:
    """Agreement of the components, freshness and evidence, and further support if there is any."""
    agreement = 1 / (1 + F.coalesce(row_deviation(components), F.lit(0.0)))
    score = 0.45 * agreement + 0.35 * freshness + 0.2 * (1 - missing)
    if support is not None:
        score = 0.7 * score + 0.3 * clip(support, 0, 1)
    return clip(score, 0, 1)


def structure_targets(df: DataFrame, anchors: list[str], conviction: list[str], fragility: list[str]) -> DataFrame:
    """Over- and undervaluation against anchors, conviction, fragility, reversion pressure and confidence.

    df: symbol, day, close, freshness, missing and the named columns; an anchor of 0 is missing.
    """
    log = safe_log(F.col("close"))
    df = with_robust_z(df, {f"g_{a}": log - safe_log(F.nullif(a, F.lit(0.0))) for a in anchors}, 252)
    df = with_robust_z(df, {f"c_{c}": F.col(c) for c in conviction}, 180)
    df = with_robust_z(df, {f"f_{c}": F.col(c) for c in fragility}, 120)
    gaps, held, weak = ([F.col(f"{k}_{c}") for c in names] for k, names in (("g", anchors), ("c", conviction), ("f", fragility)))
    df = df.withColumns({"_gap": row_mean(gaps), "_weak": row_mean(weak), "_coherence": 1 / (1 + F.coalesce(row_deviation(gaps), F.lit(0.0)))})
    df = df.withColumns({"conviction": sigmoid((row_mean(held) - 0.25 * F.col("_weak")) / 1.2), "fragility": sigmoid(F.col("_weak") / 1.2)})
    gap = F.col("_gap")
    return df.select(
        "symbol", "day", F.greatest(F.tanh(gap / 1.2), F.lit(0.0)).alias("overvaluation"), F.greatest(F.tanh(-gap / 1.2), F.lit(0.0)).alias("undervaluation"), "conviction", "fragility",
        F.tanh((-gap + 0.35 * (F.col("conviction") - F.col("fragility"))) / 1.1).alias("reversion"), confidence([*gaps, *held, *weak], F.col("freshness"), F.col("missing"), F.col("_coherence")).alias("confidence"),
    )


def multiscale(df: DataFrame, scales: Mapping[str, list[str]], sure: Mapping[str, str]) -> DataFrame:
    """Tokens of each scale, their summary, disagreement, entropy, velocity, acceleration, hazard and validity.

    scales: state columns of each scale, the first one is its direction and the first scale the anchor; sure: confidence
    column of each scale. df has freshness and missing.
    """
    tokens = {}
    for name, columns in scales.items():
        c = [F.col(x) for x in columns]
        tokens |= {f"{name}_amplitude": row_mean([F.abs(x) for x in c]), f"{name}_dispersion": F.coalesce(row_deviation(c), F.lit(0.0))}
    df = df.withColumns(tokens)
    direction = [F.col(c[0]) for c in scales.values()]
    size = F.greatest(total([F.abs(d) for d in direction]), F.lit(1e-8))
    parts = [F.abs(d) / size for d in direction]
    entropy = -total([p * F.ln(F.greatest(p, F.lit(1e-8))) for p in parts]) / F.ln(F.lit(float(max(len(parts), 2))))
    df = df.withColumns({"summary_direction": row_mean(direction), "summary_amplitude": row_mean([F.col(f"{n}_amplitude") for n in scales]), "summary_confidence": row_mean([F.col(sure[n]) for n in scales]), "summary_dispersion": row_mean([F.col(f"{n}_dispersion") for n in scales]), "disagreement": F.coalesce(row_deviation(direction), F.lit(0.0)), "entropy": clip(entropy, 0, 1)})
    df = fold(df.withColumn("_step", F.abs(O.diff(F.col("summary_direction")))), [Recursion("velocity", "_step", partial(ema, span=5))]).na.fill(0.0, subset=["velocity"])
    df = fold(df.withColumn("_step", F.abs(O.diff(F.col("velocity")))), [Recursion("acceleration", "_step", partial(ema, span=5))]).na.fill(0.0, subset=["acceleration"]).drop("_step")
    anchor = F.col(sure[next(iter(scales))])
    return df.withColumns({"hazard": sigmoid(2.2 * F.col("velocity") + 1.4 * F.col("disagreement") + 0.8 * F.col("entropy") + (1 - anchor)), "validity": clip(anchor * clip(F.col("freshness"), 0, 1) * (1 - clip(F.col("missing"), 0, 1)), 0, 1)})


def meta_channels(df: DataFrame, directional: Column, sure: str, states: list[str]) -> DataFrame:
    """Add hazard and validity of a group of states from the speed of its direction, its dispersion and confidence."""
    df = df.withColumn("_d", directional)
    df = fold(df.withColumn("_step", F.coalesce(F.abs(O.diff(F.col("_d"))), F.lit(0.0))), [Recursion("_v", "_step", partial(ema, span=5))])
    spread = F.coalesce(row_deviation([F.col(s) for s in states]), F.lit(0.0))
    made = {"hazard": sigmoid(2 * F.col("_v") + 0.75 * spread + (1 - F.col(sure))), "validity": clip(F.col(sure) * F.col("freshness") * (1 - F.col("missing")), 0, 1)}
    return df.withColumns(made).drop("_d", "_step", "_v")


def variant_features(df: DataFrame, columns: list[str], differences: bool = True, rolling: bool = True) -> DataFrame:
    """The columns with their differences and the mean and spread of seven rows of each; missing values are 0."""
    made = {f"delta_{c}": O.diff(F.col(c)) for c in columns} if differences else {}
    df = df.withColumns(made)
    wide = [*columns, *made]
    if rolling:
        df = df.withColumns({x: v for c in wide for x, v in ((f"roll7_mean_{c}", O.mean(F.col(c), 7, 3)), (f"roll7_std_{c}", O.deviation(F.col(c), 7, 3)))})
        wide += [f"roll7_{k}_{c}" for c in wide for k in ("mean", "std")]
    return df.select("symbol", "day", *wide).na.fill(0.0, subset=wide)


def observation_channels(df: DataFrame, columns: list[str], cap: float = 365.0) -> DataFrame:
    """Of each column: observed, age of the observation and of the last change (log, to 1), validity, and the step between two observations."""
    n = F.row_number().over(O.spec)
    df = df.withColumn("_n", n)
    size = math.log1p(cap)
    made = {}
    for c in columns:
        x, before = F.col(c), O.lag(F.col(c))
        changed = F.when((F.col("_n") == 1) | (x.isNull() != before.isNull()) | F.coalesce(F.abs(x - before) > 1e-12 + 1e-5 * F.abs(before), F.lit(False)), F.col("_n"))
        seen = F.when(x.isNotNull(), F.col("_n"))
        made |= {f"{c}_changed": changed, f"{c}_seen": seen}
    df = df.withColumns(made)
    age = lambda a: F.ln(1 + F.least(a.cast("double"), F.lit(cap))) / size
    out = {}
    for c in columns:
        x = F.col(c)
        old = age(F.col("_n") - F.coalesce(O.last_known(F.col(f"{c}_seen")), F.lit(0)))
        out |= {f"{c}_observed": x.isNotNull().cast("double"), f"{c}_observation_age": old, f"{c}_change_age": age(F.col("_n") - O.last_known(F.col(f"{c}_changed"))), f"{c}_validity": F.when(x.isNotNull(), 1 - old).otherwise(0.0), f"{c}_velocity": x - O.lag(x)}
    return df.withColumns(out).drop("_n", *[f"{c}_{k}" for c in columns for k in ("changed", "seen")])


def embedding_fields(df: DataFrame, vector: str, order: str, key: str) -> DataFrame:
    """Norm of each vector, its change, pressures from its first entry and mean size, and an uncertainty; df has gap, pressure, flare."""
    w = Window.partitionBy(key).orderBy(order)
    v = F.transform(vector, lambda x: x.cast("double"))
    df = df.withColumn("norm", F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)))
    df = df.withColumns({"delta_norm": F.coalesce(F.abs(F.col("norm") - F.lag("norm").over(w)), F.lit(0.0)), "_lead": F.tanh(F.coalesce(F.get(v, F.lit(0)), F.lit(0.0))), "_size": F.coalesce(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x)) / F.nullif(F.size(vector), F.lit(0)), F.lit(0.0))})
    flare = clip(F.col("flare"), 0, 5) / 5
    return df.select(key, order, "norm", "delta_norm", (F.col("_lead") * F.signum("pressure")).alias("alignment"), clip(-F.tanh(F.col("gap") / 2) * (1 + 0.25 * F.abs("_lead")), -1.5, 1.5).alias("reversion_pressure"), clip(F.tanh("_size") * (1 + flare), 0, 2).alias("tail_pressure"), clip(F.col("delta_norm") + flare, 0, 3).alias("uncertainty"))


#: Positions of the target windows of each horizon after its context's end. Fixed values.
TARGET_OFFSETS = {1: (1, 2), 3: (2, 4), 7: (5, 9), 15: (10, 20)}


def target_windows(df: DataFrame, value: str, offsets: Mapping[int, tuple[int, int]] = TARGET_OFFSETS) -> DataFrame:
    """Mean of the value over each horizon's window ahead, where the whole window is there."""
    parts = []
    for h, (a, b) in offsets.items():
        w = O.spec.rowsBetween(a, b)
        parts.append(F.struct(F.lit(h).alias("horizon"), F.when(F.count(value).over(w) == b - a + 1, F.avg(value).over(w)).alias("target"), O.lead(F.col("day"), a).alias("first_day"), O.lead(F.col("day"), b).alias("last_day")))
    made = df.withColumns({f"_t{i}": p for i, p in enumerate(parts)})
    return made.select("symbol", "day", F.explode(F.array(*[F.col(f"_t{i}") for i in range(len(parts))])).alias("t")).select("symbol", "day", "t.*").where(F.col("target").isNotNull())


def label_codes(df: DataFrame, key: str, label: str) -> DataFrame:
    """Dense codes from 1 by the label's text order in each key; 0 for none."""
    codes = df.where(F.col(label).isNotNull()).select(key, label).distinct()
    # as many rows as labels
    codes = codes.withColumn("code", F.dense_rank().over(Window.partitionBy(key).orderBy(F.col(label).cast("string"))))
    return df.join(codes, [key, label], "left").withColumn("code", F.coalesce("code", F.lit(0)))


def interpolate_array(values: Column, points: Sequence[float], at: float) -> Column:
    """Value at `at` of an array that holds the values at the ascending points; flat beyond the ends."""
    if at <= points[0]:
        return F.get(values, F.lit(0))
    if at >= points[-1]:
        return F.get(values, F.lit(len(points) - 1))
    j = next(i for i, p in enumerate(points) if p >= at)
    share = (at - points[j - 1]) / (points[j] - points[j - 1])
    return (1 - share) * F.get(values, F.lit(j - 1)) + share * F.get(values, F.lit(j))


def reliability_gate(freshness: Column, uncertainty: Column, validity: Column, missing: Column, decay: float = 1.0, doubt: float = 1.0) -> Column:
    return F.exp(-decay * freshness) * F.exp(-doubt * uncertainty) * validity * (1 - missing)


def softmax(logits: Sequence[Column], open_: Sequence[Column]) -> list[Column]:
    """Shares of the open entries, 0 for the others; all 0 if none is open."""
    best = F.greatest(*[F.when(o, x) for x, o in zip(logits, open_, strict=True)])
    parts = [F.coalesce(F.when(o, F.exp(x - best)), F.lit(0.0)) for x, o in zip(logits, open_, strict=True)]
    return [F.coalesce(ratio(p, total(parts)), F.lit(0.0)) for p in parts]


def sparsemax(logits: Sequence[Column]) -> list[Column]:
    """Projection of the logits on the simplex."""
    ordered = F.sort_array(F.array(*logits), asc=False)
    n = len(logits)
    sums = [total([F.get(ordered, F.lit(j)) for j in range(i + 1)]) for i in range(n)]
    inside = [(1 + (i + 1) * F.get(ordered, F.lit(i)) > sums[i]) for i in range(n)]
    tau = F.coalesce(*[F.when(inside[i], (sums[i] - 1) / (i + 1)) for i in range(n - 1, -1, -1)])
    return [F.greatest(x - tau, F.lit(0.0)) for x in logits]


def top_k(logits: Sequence[Column], k: int) -> list[Column]:
    """Whether each entry is among the k greatest; the first entries win ties."""
    return [total([((other > x) | ((other == x) & F.lit(j < i))).cast("int") for j, other in enumerate(logits) if j != i]) < k for i, x in enumerate(logits)]


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def structured_quantiles(center: Column, half: Column, lower: Column, upper: Column) -> list[Column]:
    """Ordered q05 to q95 from a centre and three raw widths."""
    q25, q75 = center - softplus(half), center + softplus(half)
    return [q25 - softplus(lower), q25, center, q75, q75 + softplus(upper)]


def strictly_increasing(values: Sequence[Column], gap: float = 1e-6) -> Column:
    """The values in order, each at least `gap` above the one before."""
    ordered = F.array_sort(F.array(*values))
    down = F.transform(ordered, lambda x, i: x - i * gap)
    return F.transform(down, lambda x, i: F.array_max(F.slice(down, F.lit(1), i + 1)) + i * gap)


def fusion_loss(y: Column, q: Sequence[Column], levels: Sequence[float], lower_weight: float = 1.0, order_penalty: float = 0.0, slack_penalty: float = 0.0, floor_penalty: float = 0.0) -> Column:
    """Weighted mean pinball of a row with penalties of crossing, of moves beyond half the width, and of no width."""
    pins = [F.greatest(t * (y - x), (t - 1) * (y - x)) * (lower_weight if t == min(levels) else 1.0) for x, t in zip(q, levels, strict=True)]
    relu = lambda x: F.greatest(x, F.lit(0.0))
    crossing = total([relu(a - b) for a, b in zip(q, q[1:], strict=False)]) / (len(q) - 1)
    width = q[-1] - q[0]
    return total(pins) / len(pins) + order_penalty * crossing + slack_penalty * relu(F.abs(y - q[len(q) // 2]) - 0.5 * width) + floor_penalty * relu(0.01 - width)


def lead_impact(df: DataFrame, signal: str, leads: Sequence[int], default: int, window: int, least: int) -> DataFrame:
    """Past correlations of a signal with later changes of the log close, known when they are over, and the lead they suggest.

    Leads weigh by their squared positive correlations, or by all squared ones where none is positive.
    """
    x = F.col(signal)
    df = df.withColumn("_log", safe_log(F.col("close")))

    def f(frame: pd.DataFrame) -> dict[str, np.ndarray]:
        v, c = (frame[k].to_numpy(float, na_value=np.nan) for k in (signal, "_log"))
        ahead = {k: np.concatenate([c[k:], np.full(min(k, len(c)), np.nan)])[: len(c)] - c for k in leads}
        return {f"_c{k}": rolling_correlation(v, y, window, least) for k, y in ahead.items()}

    df = fold_rows(df, f, [f"_c{k}" for k in leads])
    df = df.withColumns({f"corr_{k}": O.lag(F.col(f"_c{k}"), k + 1) for k in leads} | {f"_x{k}": O.lag(x, k) for k in {*leads, default}})
    r = {k: F.col(f"corr_{k}") for k in leads}
    positive = total([F.coalesce(F.pow(F.greatest(v, F.lit(0.0)), F.lit(2.0)), F.lit(0.0)) for v in r.values()])
    weight = {k: F.when(v.isNotNull(), F.when(positive > 0, F.pow(F.greatest(v, F.lit(0.0)), F.lit(2.0))).otherwise(v * v)) for k, v in r.items()}
    whole = F.nullif(total([F.coalesce(v, F.lit(0.0)) for v in weight.values()]), F.lit(0.0))
    impact = total([F.coalesce(weight[k] * F.col(f"_x{k}"), F.lit(0.0)) for k in leads]) / whole
    strength = F.greatest(*[F.abs(v) for v in r.values()])
    best = F.coalesce(*[F.when(F.abs(r[k]) == strength, F.lit(k)) for k in leads], F.lit(default))
    df = df.withColumns({"impact": F.coalesce(impact, F.col(f"_x{default}")), "best_lead": best, "strength": F.coalesce(strength, F.lit(0.0))})
    df = df.withColumn("lead_days", F.coalesce(total([F.coalesce(v, F.lit(0.0)) * k for k, v in weight.items()]) / whole, F.col("best_lead").cast("double")))
    return df.select("symbol", "day", *[f"corr_{k}" for k in leads], "impact", "best_lead", "strength", "lead_days")


def recent_trend(df: DataFrame, value: str, days: int = 180, cap: float = 0.003) -> DataFrame:
    """Mean daily change of a log series over its last days, within the cap; one row a symbol, 0 below two rows."""
    last = Window.partitionBy("symbol")
    d = df.where(F.col(value).isNotNull())
    d = d.withColumn("_end", F.max("day").over(last)).where(F.col("day") >= F.date_sub("_end", days))
    g = d.groupBy("symbol").agg(F.min_by(value, "day").alias("a"), F.max_by(value, "day").alias("b"), F.datediff(F.max("day"), F.min("day")).alias("n"))
    return g.select("symbol", F.when(F.col("n") > 0, clip((F.col("b") - F.col("a")) / F.nullif("n", F.lit(0)), -cap, cap)).otherwise(0.0).alias("trend"))


def content_hash(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """sha256 of each key's rows in order, with nulls as such; for keys whose rows fit one task."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["_line"]), "\n"), 256).alias("sha256"), F.count(F.lit(1)).alias("n_rows"))
