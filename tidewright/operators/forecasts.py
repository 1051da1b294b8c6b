"""Forward targets, causal quantile baselines, losses, selection and calibration."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.scalars import pinball, ratio, wis_canonical, wis_sum
from tidewright.operators.frames import Ordered, bucket_of_rank
from tidewright.operators.recursion import Recursion, fold, running_quantile, running_quantiles

LEVELS = (0.05, 0.25, 0.5, 0.75, 0.95)
NAMES = ("q05", "q25", "q50", "q75", "q95")
HORIZONS = (1, 3, 7, 15)
O = Ordered()  # noqa: E741


def predicted() -> list[Column]:
    return [F.col(n) for n in NAMES]


def actual() -> Column:
    return F.col("actual")


def forward_targets(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """One row for each bar and horizon: past return over the horizon (known now) and the one ahead (null at the end)."""
    c = F.col("close")
    made = {f"_p{x}": F.ln(c / O.lag(c, x)) for x in horizons} | {f"_a{x}": F.ln(O.lead(c, x) / c) for x in horizons}
    parts = [F.struct(F.lit(x).alias("horizon"), F.col(f"_p{x}").alias("past"), F.col(f"_a{x}").alias("actual")) for x in horizons]
    return bars.withColumns(made).select("symbol", "day", "close", F.explode(F.array(*parts)).alias("t")).select("symbol", "day", "close", "t.*")


def _cone(targets: DataFrame, window: int | None, least: int) -> DataFrame:
    def f(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("day").reset_index(drop=True)
        q = running_quantiles(frame["past"].to_numpy(float, na_value=np.nan), LEVELS, window, least)
        out = frame[["symbol", "day", "horizon", "close", "actual"]].copy()
        for j, n in enumerate(NAMES):
            out[n] = q[:, j]
        return out[~np.isnan(q[:, 0])]

    made = targets.groupBy("symbol", "horizon").applyInPandas(f, "symbol string, day date, horizon int, close double, actual double, " + ", ".join(f"{n} double" for n in NAMES))
    return made.replace(float("nan"), None, subset=["actual"])


def cone(targets: DataFrame, least: int = 180) -> DataFrame:
    """Historical quantiles of what is known at each day: past returns up to it."""
    return _cone(targets, None, least)


def window_cone(targets: DataFrame, n: int = 365, least: int = 180) -> DataFrame:
    """The same over the last n rows."""
    return _cone(targets, n, least)


def weighted_quantiles(values: np.ndarray, weights: np.ndarray, levels: tuple[float, ...]) -> np.ndarray:
    """Interpolated at mid cumulative weights, flat at the ends."""
    ok = np.isfinite(values) & (weights > 0)
    if not ok.any():
        return np.full(len(levels), np.nan)
    order = np.argsort(values[ok], kind="stable")
    v, w = values[ok][order], weights[ok][order]
    return np.interp(levels, (np.cumsum(w) - w / 2) / w.sum(), v)


def decayed_cone(targets: DataFrame, half_life: int = 180, least: int = 180) -> DataFrame:
    """Quantiles of known returns with weights that halve every `half_life` rows; a grouped kernel."""

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("day").reset_index(drop=True)
        past = frame["past"].to_numpy(float)
        rows = []
        known = np.flatnonzero(np.isfinite(past))
        for i in range(len(frame)):
            k = known[: np.searchsorted(known, i, side="right")]
            if len(k) >= least:
                rows.append((i, *weighted_quantiles(past[k], 0.5 ** ((len(k) - 1 - np.arange(len(k))) / half_life), LEVELS)))
        got = frame.loc[[r[0] for r in rows], ["symbol", "day", "horizon", "close", "actual"]].reset_index(drop=True)
        for j, n in enumerate(NAMES, 1):
            got[n] = [r[j] for r in rows]
        return got

    made = targets.groupBy("symbol", "horizon").applyInPandas(f, "symbol string, day date, horizon int, close double, actual double, " + ", ".join(f"{n} double" for n in NAMES))
    return made.replace(float("nan"), None, subset=["actual"])


def ewm_std(x: np.ndarray, span: int) -> np.ndarray:
    return pd.Series(x).ewm(span=span, adjust=False).std().to_numpy()


def volatility_cone(bars: DataFrame, span: int = 30, least: int = 90, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Standardised residual quantiles times the current volatility and the root of the horizon."""
    c = F.col("close")
    df = fold(bars.select("symbol", "day", "close", F.ln(c / O.lag(c)).alias("r")), [Recursion("sigma", "r", partial(ewm_std, span=span))])
    df = df.withColumn("z", ratio(F.col("r"), O.lag(F.col("sigma"))))
    df = fold(df, [Recursion(f"_{n}", "z", partial(running_quantile, level=q, window=None, least=least, shift=1)) for n, q in zip(NAMES, LEVELS, strict=True)])
    df = df.where(F.col("_q50").isNotNull()).withColumn("horizon", F.explode(F.array(*[F.lit(x) for x in horizons])))
    return df.select("symbol", "day", "horizon", *[(F.col(f"_{n}") * F.col("sigma") * F.sqrt(F.col("horizon").cast("double"))).alias(n) for n in NAMES])


def regimes(bars: DataFrame) -> DataFrame:
    """Volatility and trend regimes from thresholds known the day before."""
    c = F.col("close")
    df = bars.select("symbol", "day", "close", F.ln(c / O.lag(c)).alias("r"))
    df = df.withColumns({"vol": O.deviation(F.col("r"), 30, 20), "trend": c / O.mean(c, 90, 45) - 1, "size": F.abs("r")})
    df = fold(df, [Recursion("tail", "size", partial(running_quantile, level=0.95, window=365, least=90, shift=1)), Recursion("threshold", "vol", partial(running_quantile, level=0.5, window=None, least=180, shift=1))])
    flare = F.coalesce(F.abs("r") / F.nullif("tail", F.lit(0.0)) >= 1, F.lit(False))
    vol = F.when(flare & F.col("vol").isNotNull(), "high_vol").when(F.col("threshold").isNull() | F.col("vol").isNull(), "unknown_vol").when(F.col("vol") > F.col("threshold"), "high_vol").otherwise("low_vol")
    trend = F.when(F.col("trend").isNull(), "unknown_trend").when(F.col("trend") >= 0, "uptrend").otherwise("downtrend")
    return df.select("symbol", "day", F.col("vol").alias("realized_vol"), F.col("trend").alias("trend_90"), vol.alias("vol_regime"), trend.alias("trend_regime"), F.concat_ws("|", vol, trend).alias("regime"))


def with_losses(rows: DataFrame, cost_bps: float = 15.0) -> DataFrame:
    """Pinballs and their mean, both interval scores, widths, misses, position and net return."""
    pins = [pinball(actual(), q, x) for q, x in zip(predicted(), LEVELS, strict=True)]
    position = F.when(F.abs("q50") > 1e-12, F.signum("q50")).otherwise(0.0)
    return rows.withColumns({
        **{f"{n}_pinball": p for n, p in zip(NAMES, pins, strict=True)}, "pinball": reduce(lambda a, b: a + b, pins) / 5,
        "wis": wis_sum(actual(), *predicted()), "wis_c": wis_canonical(actual(), *predicted()), "width_50": F.col("q75") - F.col("q25"), "width_90": F.col("q95") - F.col("q05"),
        "q05_miss": F.coalesce(F.col("q05") > actual(), F.lit(False)), "q95_miss": F.coalesce(F.col("q95") < actual(), F.lit(False)),
        "position": position, "net_return": position * (F.exp(actual()) - 1) - F.abs(position) * 2 * cost_bps / 10000,
    })


def summarise(losses: DataFrame, keys: list[str]) -> DataFrame:
    """Mean losses, coverages, misses, widths, hit rate and correlation of the rows that came true."""
    done = losses.where(actual().isNotNull())
    signed = (actual() != 0) & (F.col("q50") != 0)
    inside = lambda a, b: F.avg(((actual() >= F.col(a)) & (actual() <= F.col(b))).cast("double"))
    return done.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"), F.avg("pinball").alias("avg_pinball"), F.avg("wis").alias("wis"), F.avg("wis_c").alias("wis_c"), (2 * F.avg("pinball")).alias("crps"),
        inside("q25", "q75").alias("coverage_50"), inside("q05", "q95").alias("coverage_90"), F.avg("width_50").alias("width_50"), F.avg("width_90").alias("width_90"),
        F.avg(F.col("q05_miss").cast("double")).alias("q05_miss_rate"), F.avg(F.col("q95_miss").cast("double")).alias("q95_miss_rate"),
        F.avg(F.when(signed, (F.signum(actual()) == F.signum("q50")).cast("double"))).alias("hit_rate"), F.avg("net_return").alias("mean_net_return"), ratio(F.covar_pop("q50", actual()), F.stddev_pop("q50") * F.stddev_pop(actual())).alias("corr"),
    )


def average_rank(x: Column, keys: list[str]) -> Column:
    """Rank with the mean of ties."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = d.withColumns({"_a": average_rank(F.col(a), keys), "_b": average_rank(F.col(b), keys)})
    return d.groupBy(*keys).agg(F.corr("_a", "_b").alias("spearman"))


def realised_selection(losses: DataFrame, default: str, window: int = 365, least: int = 120, gain: float = 0.01) -> DataFrame:
    """For each day and horizon the forecaster with the best mean loss over its last `window` realised rows.

    A row is realised `horizon` rows after its day, so the frame ends there. Another than the default must be better
    by `gain`; ties go to the smaller pinball, then the name.
    """
    w = Window.partitionBy("symbol", "horizon", "forecaster").orderBy("day")
    own = w.rowsBetween(-(window - 1), 0)
    means = losses.withColumns({"_w": F.avg("wis").over(own), "_p": F.avg("pinball").over(own), "_n": F.count("wis").over(own)})

    def known(x: str) -> Column:
        """x as it was `horizon` rows before."""
        return F.coalesce(*[F.when(F.col("horizon") == h, F.lag(x, h).over(w)) for h in HORIZONS])

    seen = means.withColumns({"mean_wis": known("_w"), "mean_pinball": known("_p"), "n": known("_n")}).where(F.col("n") >= least)
    base = F.min(F.when(F.col("forecaster") == default, F.col("mean_wis"))).over(Window.partitionBy("symbol", "horizon", "day"))
    ok = seen.withColumn("base", base).where((F.col("forecaster") == default) | (F.col("mean_wis") < F.col("base") * (1 - gain)))
    return ok.groupBy("symbol", "horizon", "day").agg(F.min_by("forecaster", F.struct("mean_wis", "mean_pinball", "forecaster")).alias("selected"))


def terciles(losses: DataFrame) -> DataFrame:
    """Mean loss and hit rate by tercile of interval width (narrow first)."""
    done = losses.where(actual().isNotNull())
    k = Window.partitionBy("symbol", "horizon")
    ranked = done.withColumns({"r": F.row_number().over(k.orderBy("width_90", "day")), "n": F.count(F.lit(1)).over(k)})
    return ranked.withColumn("bucket", bucket_of_rank(F.col("r"), F.col("n"), 3)).groupBy("symbol", "horizon", "bucket").agg(F.count(F.lit(1)).alias("observations"), F.avg("wis").alias("wis"), F.avg((F.signum("q50") == F.signum(actual())).cast("double")).alias("hit_rate"))


def _residual(name: str, level: float, sign: int, weight: float = 1.0) -> Column:
    """Quantile of the residual on one side (sign -1: below the forecast), which only widens."""
    return weight * sign * F.greatest(F.percentile(sign * (actual() - F.col(name)), level), F.lit(0.0))


#: Adjustments of each quantile by method, over the rows to fit.
WIDENING = {
    "conformal": lambda: [_residual("q05", 0.9, -1), _residual("q25", 0.5, -1), F.median(actual() - F.col("q50")), _residual("q75", 0.5, 1), _residual("q95", 0.9, 1)],
    "asymmetric_lower_tail": lambda: [_residual("q05", 0.9, -1), _residual("q25", 0.75, -1, 0.65), 0.25 * F.median(actual() - F.col("q50")), _residual("q75", 0.35, 1, 0.25), _residual("q95", 0.5, 1, 0.1)],
}


def widened(losses: DataFrame, method: str, fit_share: float = 0.65) -> DataFrame:
    """One-sided calibration: the outer quantiles of the later rows move outwards or stay; rows without a fit keep theirs."""
    k = Window.partitionBy("symbol", "horizon")
    df = losses.withColumn("_f", F.row_number().over(k.orderBy("day")) / F.count(F.lit(1)).over(k))
    whole = reduce(lambda a, b: a & b, [x.isNotNull() for x in (actual(), *predicted())])
    shift = df.where((F.col("_f") <= fit_share) & whole).groupBy("symbol", "horizon").agg(*[x.alias(f"s_{n}") for x, n in zip(WIDENING[method](), NAMES, strict=True)])
    later = df.where(F.col("_f") > fit_share).join(F.broadcast(shift), ["symbol", "horizon"], "left")  # a row a symbol and horizon
    ordered = F.array_sort(F.array(*[q + F.coalesce(f"s_{n}", F.lit(0.0)) for q, n in zip(predicted(), NAMES, strict=True)]))
    return later.select("symbol", "horizon", "day", "actual", *[ordered[i].alias(n) for i, n in enumerate(NAMES)])


def additive_quantile(losses: DataFrame, fit_share: float = 0.65) -> DataFrame:
    """Additive quantile calibration: residual quantiles of the first rows move the quantiles of the later ones, which are sorted again."""
    k = Window.partitionBy("symbol", "horizon")
    df = losses.withColumn("_f", F.row_number().over(k.orderBy("day")) / F.count(F.lit(1)).over(k))
    shift = df.where((F.col("_f") <= fit_share) & actual().isNotNull()).groupBy("symbol", "horizon").agg(*[F.percentile(actual() - q, x).alias(f"s_{n}") for q, x, n in zip(predicted(), LEVELS, NAMES, strict=True)])
    later = df.where(F.col("_f") > fit_share).join(F.broadcast(shift), ["symbol", "horizon"])  # a row a symbol and horizon
    ordered = F.array_sort(F.array(*[q + F.col(f"s_{n}") for q, n in zip(predicted(), NAMES, strict=True)]))
    return later.select("symbol", "horizon", "day", "actual", *[ordered[i].alias(n) for i, n in enumerate(NAMES)])


def block_bootstrap(pairs: DataFrame, samples: int = 1000, block: int = 15, seed: int = 7, circular: bool = False) -> DataFrame:
    """Mean difference of two losses and its 95 % interval by moving blocks; pairs: symbol, horizon, day, difference."""

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        d = frame.sort_values("day")["difference"].to_numpy(float)
        d = d[np.isfinite(d)]
        n, rng = len(d), np.random.default_rng(seed)
        means = np.full(samples, np.nan)
        if n:
            b = min(block, n)
            starts = rng.integers(0, n if circular else n - b + 1, (samples, -(-n // b)))
            means = d[((starts[:, :, None] + np.arange(b)) % n).reshape(samples, -1)[:, :n]].mean(1)
        low, high = np.quantile(means, (0.025, 0.975))
        return pd.DataFrame({"symbol": [frame["symbol"].iloc[0]], "horizon": [frame["horizon"].iloc[0]], "mean_difference": [d.mean() if n else np.nan], "low": [low], "high": [high], "n": [n]})

    return pairs.groupBy("symbol", "horizon").applyInPandas(f, "symbol string, horizon int, mean_difference double, low double, high double, n long")


def promotion(summary: DataFrame, candidate: str, baseline: str, tail_limit: float = 0.1) -> DataFrame:
    """Gates over all horizons: better loss than the baseline everywhere, and tail misses within the limit."""
    c = summary.where(F.col("forecaster") == candidate).select("symbol", "horizon", F.col("wis_c").alias("a"), "q05_miss_rate")
    b = summary.where(F.col("forecaster") == baseline).select("symbol", "horizon", F.col("wis_c").alias("b"))
    return c.join(b, ["symbol", "horizon"]).groupBy("symbol").agg(F.bool_and(F.col("a") < F.col("b")).alias("beats_baseline"), F.bool_and(F.col("q05_miss_rate") <= tail_limit).alias("tail_ok"), F.avg(100 * (F.col("b") - F.col("a")) / F.col("b")).alias("mean_gain_pct"))
