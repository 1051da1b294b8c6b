"""Tables that judge forecasts: trailing windows, subsets, events, regimes, corrections and choices."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.scalars import clip, ratio
from tidewright.operators.forecasts import HORIZONS, LEVELS, NAMES, actual, average_rank, predicted, summarise
from tidewright.operators.frames import Ordered, bucket_of_rank
from tidewright.operators.recursion import Recursion, Trailing, ema, fold, fold_rows, running_quantile

O = Ordered()  # noqa: E741


def realised(rows: DataFrame) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, [c.isNotNull() for c in (actual(), *predicted())]))


def grouped_calibration(losses: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """Summary of every group with at least `least` rows."""
    kept = ["observations", "avg_pinball", "wis", "q05_miss_rate", "q95_miss_rate", "coverage_50", "coverage_90", "width_90"]
    return summarise(realised(losses), keys).where(F.col("observations") >= least).select(*keys, *kept)


def trailing_windows(rows: DataFrame, keys: list[str], sizes: tuple[int, ...] = (30, 90, 180, 365)) -> DataFrame:
    """Errors, coverages and widths of the last rows of each key and of all rows."""
    w = Window.partitionBy(*keys).orderBy(F.desc("day"))
    parts = [F.when(F.col("_r") <= n, F.lit(f"last_{n}")) for n in sizes] + [F.lit("all")]
    df = realised(rows).withColumn("_r", F.row_number().over(w)).withColumn("window", F.explode(F.array_compact(F.array(*parts))))
    error, y = F.col("q50") - actual(), actual()
    inside = lambda a, b: F.avg(((y >= F.col(a)) & (y <= F.col(b))).cast("double"))
    return df.groupBy(*keys, "window").agg(
        F.count(F.lit(1)).alias("observations"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.when((y != 0) & (F.col("q50") != 0), (F.signum(y) == F.signum("q50")).cast("double"))).alias("hit_rate"),
        inside("q25", "q75").alias("coverage_50"), inside("q05", "q95").alias("coverage_90"),
        F.avg((y < F.col("q05")).cast("double")).alias("q05_miss_rate"), F.avg((y > F.col("q95")).cast("double")).alias("q95_miss_rate"),
        F.avg(F.col("q75") - F.col("q25")).alias("width_50"), F.avg(F.col("q95") - F.col("q05")).alias("width_90"),
    )


def subset_losses(losses: DataFrame, keys: list[str], masks: Mapping[str, Column]) -> DataFrame:
    """Rows, mean losses and median error of each subset; a mask that is null does not hold."""
    aggs = []
    for name, mask in masks.items():
        on = F.coalesce(mask, F.lit(False))
        aggs.append(F.count_if(on).alias(f"{name}_n"))
        aggs += [F.avg(F.when(on, x)).alias(f"{name}_{n}") for n, x in (("wis", F.col("wis")), ("pinball", F.col("pinball")), ("error", F.abs(F.col("q50") - actual())))]
    return losses.groupBy(*keys).agg(*aggs)


def gap_report(df: DataFrame, key: str, columns: list[str], time: str = "day") -> DataFrame:
    """One row a key: rows, range, share of missing values, the most frequent gap in days (the smallest of equals) and its share, gaps above a day."""
    w = Window.partitionBy(key).orderBy(time)
    gaps = df.withColumn("_g", F.datediff(time, F.lag(time).over(w)))
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("double") for c in columns]) / len(columns)
    whole = gaps.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first_day"), F.max(time).alias("last_day"), F.avg(missing).alias("missing_ratio"), F.count_if(F.col("_g") > 1).alias("large_gaps"), F.count("_g").alias("_total"))
    counts = gaps.where(F.col("_g").isNotNull()).groupBy(key, "_g").agg(F.count(F.lit(1)).alias("_c"))
    mode = counts.groupBy(key).agg(F.max(F.struct(F.col("_c").alias("c"), (-F.col("_g")).alias("g"))).alias("_m"))
    return whole.join(mode, key, "left").select(key, "n_rows", "first_day", "last_day", "missing_ratio", "large_gaps", (-F.col("_m.g")).alias("mode_days"), ratio(F.col("_m.c").cast("double"), F.col("_total")).alias("mode_share"))


def event_metrics(df: DataFrame, keys: list[str], true: str, pred: str, threshold: float) -> DataFrame:
    """Errors, direction, and how well large predicted sizes find large moves: ROC-AUC, average precision, Brier score.

    Rows without a value on either side are left out. AUC, precision and Brier need ten rows and both kinds.
    """
    y, p = F.col(true), F.col(pred)
    d = df.where(y.isNotNull() & p.isNotNull()).withColumns({"_e": (F.abs(y) >= threshold).cast("double"), "_s": 1 / (1 + F.exp(-clip((F.abs(p) - threshold) / threshold, -40, 40)))})
    d = d.withColumn("_rank", average_rank(F.col("_s"), keys))
    plain = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_e").alias("events"), F.avg(F.abs(p - y)).alias("mae"), F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"),
        F.avg(F.when(F.abs(y) >= 1e-9, (F.signum(p) == F.signum(y)).cast("double"))).alias("direction"), F.sum(F.col("_rank") * F.col("_e")).alias("_r"), F.avg((F.col("_s") - F.col("_e")) * (F.col("_s") - F.col("_e"))).alias("_b"),
    )
    by_score = d.groupBy(*keys, "_s").agg(F.sum("_e").alias("_t"), F.count(F.lit(1)).alias("_c"))
    down = Window.partitionBy(*keys).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    steps = by_score.withColumn("_p", F.sum("_t").over(down) / F.sum("_c").over(down)).groupBy(*keys).agg(F.sum(F.col("_p") * F.col("_t")).alias("_a"))
    both = plain.join(steps, keys)
    ok = (F.col("n") >= 10) & (F.col("events") > 0) & (F.col("events") < F.col("n"))
    a = F.col("events")
    return both.select(*keys, "n", F.col("events").cast("long").alias("events"), "mae", "rmse", "direction", F.when(ok, (F.col("_r") - a * (a + 1) / 2) / F.nullif(a * (F.col("n") - a), F.lit(0.0))).alias("auc"), F.when(ok, F.col("_a") / F.nullif(a, F.lit(0.0))).alias("average_precision"), F.when(ok, F.col("_b")).alias("brier"))


def regression_block(df: DataFrame, key: str, pairs: Mapping[str, str], confidence: str, time: str = "day") -> DataFrame:
    """mae, mse, smoothness of the predictions, utility of the confidence (-corr with the error) and the score; pairs: true -> predicted."""
    w = Window.partitionBy(key).orderBy(time)
    n = len(pairs)
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    df = df.withColumns({"_abs": total([F.abs(F.col(b) - F.col(a)) for a, b in pairs.items()]) / n, "_sq": total([F.pow(F.col(b) - F.col(a), F.lit(2.0)) for a, b in pairs.items()]) / n, "_move": total([F.abs(F.col(b) - F.lag(b).over(w)) for b in pairs.values()]) / n})
    c = F.col(confidence)
    out = df.groupBy(key).agg(F.avg("_abs").alias("mae"), F.avg("_sq").alias("mse"), F.avg("_move").alias("smoothness"), F.coalesce(-F.covar_pop("_abs", c) / F.nullif(F.stddev_pop("_abs") * F.stddev_pop(c), F.lit(0.0)), F.lit(0.0)).alias("confidence_utility"))
    return out.withColumn("selection_score", F.col("mse") + 0.2 * F.col("smoothness") - 0.1 * F.col("confidence_utility"))


def regime_usage(df: DataFrame, key: str, weights: list[str], time: str = "day") -> DataFrame:
    """Effective number of regimes, mean confidence, greatest share and transitions of soft assignments."""
    w = Window.partitionBy(key).orderBy(time)
    total = F.greatest(reduce(lambda a, b: a + b, [F.col(c) for c in weights]), F.lit(1e-12))
    df = df.withColumns({c: F.col(c) / total for c in weights})
    top = F.greatest(*[F.col(c) for c in weights])
    first = reduce(lambda rest, i: F.when(F.col(weights[i]) == top, i).otherwise(rest), range(len(weights) - 2, -1, -1), F.lit(len(weights) - 1))
    df = df.withColumns({"_top": top, "_d": first}).withColumn("_turn", (F.col("_d") != F.lag("_d").over(w)).cast("int"))
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("_top").alias("confidence"), F.coalesce(F.sum("_turn"), F.lit(0)).alias("transitions"), *[F.avg(c).alias(c) for c in weights])
    entropy = -reduce(lambda a, b: a + b, [F.col(c) * F.ln(F.greatest(F.col(c), F.lit(1e-12))) for c in weights])
    return out.select(key, "n_rows", F.exp(entropy).alias("effective_regimes"), "confidence", F.greatest(*[F.col(c) for c in weights]).alias("greatest_share"), "transitions", (100 * F.col("transitions") / F.greatest(F.col("n_rows") - 1, F.lit(1))).alias("transitions_per_100"))


def leaderboard(scores: DataFrame, candidate: str = "forecaster", fold_column: str = "fold", score: str = "score", penalty: float = 0.5) -> DataFrame:
    """Mean and spread over folds, folds won (ties to the first name) and the place by mean + penalty * spread."""
    best = scores.groupBy(fold_column).agg(F.min_by(candidate, F.struct(score, candidate)).alias("_best"))
    out = scores.join(best, fold_column).groupBy(candidate).agg(F.count(F.lit(1)).alias("folds"), F.avg(score).alias("mean_score"), F.coalesce(F.stddev_pop(score), F.lit(0.0)).alias("spread"), F.count_if(F.col(candidate) == F.col("_best")).alias("wins"))
    out = out.withColumn("total", F.col("mean_score") + penalty * F.col("spread"))
    # one row a candidate
    return out.withColumn("place", F.row_number().over(Window.orderBy("total", candidate)))


def strongest(summary: DataFrame, keys: list[str], candidates: list[str]) -> DataFrame:
    """The candidate with the least score of each key, then the first name."""
    return summary.where(F.col("forecaster").isin(candidates)).groupBy(*keys).agg(F.min_by(F.struct("forecaster", "wis", "avg_pinball"), F.struct("wis", "forecaster")).alias("s")).select(*keys, "s.*")


def selection_table(summary: DataFrame, keys: list[str], model: str, selected: str) -> DataFrame:
    """The best candidate (by wis, then pinball) against the model and the selected one."""
    pick = lambda x: F.max(F.when(F.col("forecaster") == x, F.col("wis")))
    others = F.when(F.col("forecaster") != selected, F.struct("wis", "avg_pinball", "forecaster"))
    t = summary.groupBy(*keys).agg(pick(model).alias("model_wis"), F.min(others).alias("_b"), pick(selected).alias("selected_wis"))
    return t.select(*keys, "model_wis", F.col("_b.forecaster").alias("best_forecaster"), F.col("_b.wis").alias("best_wis"), (F.col("_b.wis") - F.col("model_wis")).alias("best_minus_model"), "selected_wis", (F.col("selected_wis") - F.col("model_wis")).alias("selected_minus_model"))


def deployment_score(wis: Column, calibration_gap: Column, lower_miss: Column, upper_miss: Column, width_gap: Column, uncertainty_corr: Column) -> Column:
    tail = 0.5 * (F.abs(lower_miss - 0.05) + F.abs(upper_miss - 0.05))
    return wis + calibration_gap + 0.5 * tail + 0.15 * width_gap + 0.1 * F.greatest(-uncertainty_corr, F.lit(0.0))


def deployed_calibrator(scores: DataFrame, keys: list[str], default: str, threshold: float = 0.02) -> DataFrame:
    """The default method, unless the best one's score is better by more than the threshold; scores: method, score."""
    t = scores.groupBy(*keys).agg(F.max(F.when(F.col("method") == default, F.col("score"))).alias("default_score"), F.min(F.struct("score", "method")).alias("_b"))
    better = (F.col("_b.method") != default) & (F.col("default_score") - F.col("_b.score") > threshold)
    return t.select(*keys, "default_score", F.col("_b.method").alias("best_method"), F.col("_b.score").alias("best_score"), F.when(better, F.col("_b.method")).otherwise(F.lit(default)).alias("deployed_method"))


def pathological() -> Column:
    """Whether a row's quantiles are missing, unordered, too wide or too large."""
    q = predicted()
    bad = reduce(lambda a, b: a | b, [c.isNull() | F.isnan(c) | (F.abs(c) > 1.25) for c in q])
    unordered = reduce(lambda a, b: a | b, [a > b for a, b in zip(q, q[1:], strict=False)])
    return F.coalesce(bad, F.lit(True)) | F.coalesce(unordered | (F.col("q95") - F.col("q05") > 1.5), F.lit(True))


def _known(x: Column) -> Column:
    """x as it stood when the row's horizon began: its row `horizon` rows before."""
    w = Window.partitionBy("symbol", "horizon").orderBy("day")
    return F.coalesce(*[F.when(F.col("horizon") == h, F.lag(x, h).over(w)) for h in HORIZONS])


def lower_tail_corrected(rows: DataFrame, least: int = 60, regime: str | None = None) -> DataFrame:
    """q05 and q25 moved by the residual quantiles of the forecasts that have come true, kept below the one above.

    With a regime column the forecasts made in the row's own regime count, where there are `least` of them.
    """
    df = rows.withColumns({"_e05": actual() - F.col("q05"), "_e25": actual() - F.col("q25")})
    df = df.withColumns({"_k05": _known(F.col("_e05")), "_k25": _known(F.col("_e25"))}).drop("_e05", "_e25")
    shifts = (("_s05", "_k05", 0.05), ("_s25", "_k25", 0.25))
    if regime is None:
        df = fold(df, [Recursion(s, k, partial(running_quantile, level=q, window=None, least=least)) for s, k, q in shifts], keys=("symbol", "horizon"))
    else:
        df = df.withColumn("_from", _known(F.col(regime)))

        def f(frame: pd.DataFrame) -> dict[str, np.ndarray]:
            now, start = (frame[c].tolist() for c in (regime, "_from"))
            return {s: _by_regime(frame[k].to_numpy(float, na_value=np.nan), start, now, q, least) for s, k, q in shifts}

        df = fold_rows(df, f, ["_s05", "_s25"], keys=("symbol", "horizon")).drop("_from")
    df = df.withColumn("q25", F.least(F.col("q25") + F.coalesce("_s25", F.lit(0.0)), F.col("q50") - 1e-9))
    df = df.withColumn("q05", F.least(F.col("q05") + F.coalesce("_s05", F.lit(0.0)), F.col("q25") - 1e-9))
    return df.drop("_s05", "_s25", "_k05", "_k25")


def _by_regime(x: np.ndarray, start: list, now: list, level: float, least: int) -> np.ndarray:
    """Running quantile of the values that began in the row's regime if there are enough, else of all."""
    every, own, out = Trailing(len(x) + 1, least), {}, np.full(len(x), np.nan)
    for i, v in enumerate(x.tolist()):
        every.add(v)
        own.setdefault(start[i], Trailing(len(x) + 1, least)).add(v)
        same = own.get(now[i])
        held = same if same is not None and len(same) >= least else every
        if len(held) >= least:
            out[i] = held.quantile(level)
    return out


def conditional_reference(targets: DataFrame, least: int = 180, regime_least: int = 60) -> DataFrame:
    """Quantiles of the returns known at each row: those that began in the row's regime if there are enough, else all.

    targets: symbol, day, horizon, past, regime; a known return began `horizon` rows before it was known.
    """
    df = targets.withColumn("_from", _known(F.col("regime")))

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        from bisect import insort

        frame = frame.sort_values("day").reset_index(drop=True)
        every: list[float] = []
        own: dict[str, list[float]] = {}
        used, counts, found = [], [], np.full((len(frame), len(LEVELS)), np.nan)
        for i, (x, start, now) in enumerate(zip(frame["past"], frame["_from"], frame["regime"], strict=True)):
            if x == x and x is not None:
                insort(every, x)
                insort(own.setdefault(start, []), x)
            same = own.get(now, [])
            pick = now in ("high_vol", "low_vol") and len(every) >= least and len(same) >= regime_least
            held = same if pick else every
            used.append(now if pick else "all")
            counts.append(len(held))
            if len(held) >= regime_least:
                at = np.array(LEVELS) * (len(held) - 1)
                k = at.astype(int)
                low = np.array([held[j] for j in k])
                found[i] = low + (np.array([held[min(j + 1, len(held) - 1)] for j in k]) - low) * (at - k)
        out = frame[["symbol", "day", "horizon"]].assign(reference=used, n=counts)
        for j, name in enumerate(NAMES):
            out[name] = found[:, j]
        return out

    made = df.groupBy("symbol", "horizon").applyInPandas(f, "symbol string, day date, horizon int, reference string, n long, " + ", ".join(f"{n} double" for n in NAMES))
    return made.replace(float("nan"), None, subset=list(NAMES))


def horizon_calibrated(fit: DataFrame, rows: DataFrame) -> DataFrame:
    """Residual quantiles of each horizon in `fit`, interpolated over the horizons of `rows`, and sorted again."""
    shift = realised(fit).groupBy("symbol", "horizon").agg(*[F.percentile(actual() - q, x).alias(n) for q, x, n in zip(predicted(), LEVELS, NAMES, strict=True)])
    points = shift.groupBy("symbol").agg(*[F.array_sort(F.collect_list(F.struct("horizon", F.col(n).alias("value")))).alias(f"_{n}") for n in NAMES])
    df = rows.join(F.broadcast(points), "symbol")  # a row a symbol, with a point a horizon
    ordered = F.array_sort(F.array(*[F.col(n) + interpolated(F.col("horizon"), F.col(f"_{n}")) for n in NAMES]))
    return df.select("symbol", "horizon", "day", *[ordered[i].alias(n) for i, n in enumerate(NAMES)])


def interpolated(horizon: Column, fitted: Column) -> Column:
    """Value at the horizon between fitted points [(horizon, value)] in order, flat beyond the ends."""
    before = F.filter(fitted, lambda p: p["horizon"] <= horizon)
    after = F.filter(fitted, lambda p: p["horizon"] >= horizon)
    a, b = F.get(before, F.size(before) - 1), F.get(after, F.lit(0))
    span = F.nullif(b["horizon"] - a["horizon"], F.lit(0))
    return F.coalesce(a["value"] + (b["value"] - a["value"]) * (horizon - a["horizon"]) / span, a["value"], b["value"])


def inner_asymmetry(rows: DataFrame, horizons: tuple[int, ...] = HORIZONS, bound: float = 5.0, span: int = 30, window: int = 180, least: int = 45, forward: tuple[int, ...] = (30, 60)) -> DataFrame:
    """Mean log ratio of the upper and lower half widths over the horizons, smoothed, standardised, and forward returns."""
    up, down = F.greatest(F.col("q75") - F.col("q50"), F.lit(1e-6)), F.greatest(F.col("q50") - F.col("q25"), F.lit(1e-6))
    one = F.when(F.col("horizon").isin(*horizons), clip(F.ln(up / down), -bound, bound))
    df = rows.groupBy("symbol", "day").agg(F.avg(one).alias("raw"), F.max("close").alias("close"))
    df = fold(df, [Recursion("edge", "raw", partial(ema, span=span))])
    e = F.col("edge")
    df = df.withColumn("edge_z", ratio(e - O.mean(e, window, least), O.deviation(e, window, least)))
    return df.withColumns({f"forward_{x}": F.ln(O.lead(F.col("close"), x) / F.col("close")) for x in forward})


def quintile_spread(df: DataFrame, signal: str, outcome: str) -> DataFrame:
    """Mean outcome of the top and bottom fifth of the signal, their difference, hit rates and rank correlation."""
    k = Window.partitionBy("symbol")
    d = df.where(F.col(signal).isNotNull() & F.col(outcome).isNotNull())
    d = d.withColumns({"_r": F.row_number().over(k.orderBy(signal, "day")), "_n": F.count(F.lit(1)).over(k), "_a": average_rank(F.col(signal), ["symbol"]), "_b": average_rank(F.col(outcome), ["symbol"])})
    d = d.withColumn("_q", bucket_of_rank(F.col("_r"), F.col("_n"), 5))
    top, bottom = F.when(F.col("_q") == 4, F.col(outcome)), F.when(F.col("_q") == 0, F.col(outcome))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("observations"), F.corr("_a", "_b").alias("spearman"), F.avg(top).alias("top"), F.avg(bottom).alias("bottom"), (F.avg(top) - F.avg(bottom)).alias("spread"), F.avg((top > 0).cast("double")).alias("top_hit"), F.avg((bottom > 0).cast("double")).alias("bottom_hit"))


def tail_signals(losses: DataFrame, keys: list[str], cost: float = 0.0015) -> DataFrame:
    """Net return of going long on the top decile of q95 and short on the bottom decile of q05."""
    d = realised(losses)
    cut = d.groupBy(*keys).agg(F.percentile("q95", 0.9).alias("_hi"), F.percentile("q05", 0.1).alias("_lo"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 50)
    j = d.join(cut, keys)
    signal = F.explode(F.array_compact(F.array(F.when(F.col("q95") >= F.col("_hi"), F.struct(F.lit("top_decile_long").alias("signal"), F.lit(1.0).alias("side"))), F.when(F.col("q05") <= F.col("_lo"), F.struct(F.lit("bottom_decile_short").alias("signal"), F.lit(-1.0).alias("side"))))))
    j = j.withColumn("_s", signal).withColumn("_net", F.col("_s.side") * (F.exp(actual()) - 1) - 2 * cost)
    return j.groupBy(*keys, F.col("_s.signal").alias("signal")).agg(F.count(F.lit(1)).alias("observations"), F.avg("_net").alias("mean_net_return"), F.avg((F.col("_net") > 0).cast("double")).alias("hit_rate"), F.avg(actual()).alias("mean_actual"))


def robust_scaled(fit: DataFrame, df: DataFrame, columns: list[str], key: str = "symbol") -> DataFrame:
    """Columns less the median and over the interquartile range (0: 1) of `fit`; missing values are 0."""
    params = fit.groupBy(key).agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_{c}") for c in columns])
    j = df.join(F.broadcast(params), key, "left")  # a row a symbol
    spread = lambda c: F.coalesce(F.nullif(F.col(f"_{c}")[2] - F.col(f"_{c}")[0], F.lit(0.0)), F.lit(1.0))
    return j.withColumns({c: F.coalesce((F.col(c) - F.coalesce(F.col(f"_{c}")[1], F.lit(0.0))) / spread(c), F.lit(0.0)) for c in columns}).drop(*[f"_{c}" for c in columns])


def miss_clusters(losses: DataFrame, drawdown: DataFrame, keys: tuple[str, ...] = ("forecaster", "symbol", "horizon"), least: int = 20) -> DataFrame:
    """How misses below the lowest quantile cluster in time, and the drawdowns ahead after a miss and without one.

    losses: keys, day, the outcome, q05 and q05_miss; drawdown: symbol, day, drawdown. A cluster is a run of misses in
    the rows' order. The autocorrelation is that of neighbours, where there are five of them and both kinds occur.
    """
    w = Window.partitionBy(*keys).orderBy("day")
    df = losses.where(actual().isNotNull() & F.col("q05").isNotNull()).select(*keys, "day", F.col("q05_miss").cast("double").alias("miss")).join(drawdown, ["symbol", "day"], "left")
    df = df.withColumn("before", F.lag("miss").over(w))
    starts = (F.col("miss") == 1) & (F.coalesce("before", F.lit(0.0)) == 0)
    df = df.withColumn("cluster", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = df.where(F.col("miss") == 1).groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("size"))
    longest = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"), F.max("size").alias("longest"))
    both = F.col("before").isNotNull()
    x, y = F.when(both, F.col("miss")), F.col("before")
    varied = (F.count("before") >= 5) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    after = lambda miss: F.avg(F.when(F.col("miss") == miss, F.col("drawdown")))
    table = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.avg("miss").alias("miss_rate"), F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias("autocorrelation"), after(1).alias("drawdown_after_miss"), after(0).alias("drawdown_without"))
    table = table.where(F.col("observations") >= least).join(longest, list(keys), "left")
    return table.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("clusters", "longest")})
