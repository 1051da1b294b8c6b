"""Ensembles of levels, projections, disagreement calibrators, folds and horizon bins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.scalars import clip, ratio, safe_log
from tidewright.operators.forecasts import NAMES, WIDENING, actual, predicted
from tidewright.operators.frames import Ordered

O = Ordered()  # noqa: E741


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def capped_weights(weights: Sequence[Column], caps: Sequence[float], rounds: int = 8) -> Column:
    """Array of weights (null: not there) that sum to one, each within its cap: what is over goes to the others by their room.

    Caps of the sources that are there are raised to a sum of one where they are below it.
    """
    there = [w.isNotNull() for w in weights]
    raw = [F.greatest(w, F.lit(0.0)) for w in weights]
    raw = [F.when(t, w).otherwise(0.0) for t, w in zip(there, raw, strict=True)]
    n = total([t.cast("int") for t in there])
    whole = total(raw)
    start = F.array(*[F.when(whole > 0, w / F.nullif(whole, F.lit(0.0))).when(t, 1 / F.nullif(n, F.lit(0))).otherwise(0.0) for w, t in zip(raw, there, strict=True)])
    cap = [F.when(t, F.lit(c)).otherwise(0.0) for t, c in zip(there, caps, strict=True)]
    room = total(cap)
    cap_array = F.array(*[F.when(room < 1, c / F.greatest(room, F.lit(1e-12))).otherwise(c) for c in cap])
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    def one(state: Column) -> Column:
        """A round; its sums are fields of one value, which later expressions name instead of repeating them."""
        parts = F.zip_with(state["v"], cap_array, lambda x, c: F.struct(F.greatest(x - c, F.lit(0.0)).alias("over"), F.greatest(c - x, F.lit(0.0)).alias("room"), F.least(x, c).alias("cut")))
        sums = let(F.struct(state["v"].alias("v"), state["done"].alias("done"), parts.alias("p")), lambda t: F.struct(t["v"].alias("v"), t["done"].alias("done"), t["p"].alias("p"), add(t["p"]["over"]).alias("excess"), add(t["p"]["room"]).alias("size")))
        return let(sums, lambda t: F.when(t["done"] | (t["excess"] <= 0), F.struct(t["v"].alias("v"), F.lit(True).alias("done"))).otherwise(
            F.struct(F.transform(t["p"], lambda p: p["cut"] + F.when(t["size"] > 0, t["excess"] * p["room"] / F.greatest(t["size"], F.lit(1e-300))).otherwise(0.0)).alias("v"), (t["size"] <= 0).alias("done"))
        ))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(start.alias("v"), F.lit(False).alias("done")), lambda s, _: one(s))["v"]
    return let(end, lambda e: F.transform(e, lambda x: x / F.greatest(add(e), F.lit(1e-12))))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def level_ensemble(df: DataFrame, sources: Sequence[str], caps: Sequence[float], clip_log: float = 0.5) -> DataFrame:
    """Mean of the log levels that are there, near their median, with capped equal weights; a quarter of it the median itself."""
    x = [F.col(s) for s in sources]
    df = df.withColumn("_s", F.array_sort(F.array_compact(F.array(*x))))
    n = F.size("_s")
    median = (F.get("_s", F.floor((n - 1) / 2).cast("int")) + F.get("_s", F.floor(n / 2).cast("int"))) / 2
    df = df.withColumns({"_n": n, "_m": F.when(n > 0, median)})
    df = df.withColumn("_w", capped_weights([F.when(c.isNotNull(), 1 / F.nullif(F.col("_n"), F.lit(0))) for c in x], caps))
    df = df.withColumns({f"weight_{s}": F.get("_w", F.lit(i)) for i, s in enumerate(sources)}).drop("_w")
    df = df.withColumns({f"weight_{s}": F.when(F.col("_n") == 1, F.col(s).isNotNull().cast("double")).otherwise(F.col(f"weight_{s}")) for s in sources})
    near = [F.coalesce(F.when(c.isNotNull(), F.least(F.greatest(c, F.col("_m") - clip_log), F.col("_m") + clip_log)) * F.col(f"weight_{s}"), F.lit(0.0)) for s, c in zip(sources, x, strict=True)]
    df = df.withColumn("_e", F.when(F.col("_n") > 0, total(near)))
    level = F.when(F.col("_n") > 1, 0.75 * F.col("_e") + 0.25 * F.col("_m")).otherwise(F.col("_e"))
    return df.withColumns({"level": level, "source_count": F.col("_n")}).drop("_s", "_m", "_e", "_n")


def projection_overlay(df: DataFrame, phi: float, drift_weight: float, reversion_weight: float, scope: tuple[float, float] = (7.0, 240.0), bound: float = 0.45) -> DataFrame:
    """Projected return by parts: drift over the scope, pull towards the fair value, and bounded pressure of two sources.

    df: close, drift, gap, scope (null: the horizon), horizon, pressure, macro, onchain. Both sources are scaled so that
    their sum is the bounded pressure; without a sum they stay as they are.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    df = df.withColumns({"scope_days": clip(F.coalesce(F.col("scope"), F.col("horizon").cast("double")), *scope), "_p": clip(zero("pressure"), -bound, bound)})
    both = zero("macro") + zero("onchain")
    scale = F.when(F.abs(both) > 1e-12, F.col("_p") / F.nullif(both, F.lit(0.0))).otherwise(1.0)
    df = df.withColumns({"drift_part": drift_weight * zero("drift") * F.col("scope_days"), "reversion_part": -reversion_weight * (1 - F.pow(F.lit(phi), F.col("scope_days"))) * zero("gap"), "macro_part": zero("macro") * scale, "onchain_part": zero("onchain") * scale})
    df = df.withColumn("projected_return", total([F.col(f"{x}_part") for x in ("drift", "reversion", "macro", "onchain")]))
    return df.withColumns({"projected_price": F.when(F.abs("projected_return") <= 2, F.col("close") * F.exp("projected_return")), "target_day": F.date_add("day", F.rint("scope_days").cast("int"))}).drop("_p")


def disagreement_calibrated(losses: DataFrame, score: str, method: str, fit_share: float = 0.65) -> DataFrame:
    """Calibration with one fit below and one above the median context score; method: disagreement_width or disagreement_conformal."""
    k = Window.partitionBy("symbol", "horizon")
    df = losses.withColumn("_f", F.row_number().over(k.orderBy("day")) / F.count(F.lit(1)).over(k))
    cut = df.where(F.col("_f") <= fit_share).groupBy("symbol", "horizon").agg(F.percentile(score, 0.5).alias("_cut"))
    df = df.join(F.broadcast(cut), ["symbol", "horizon"]).withColumn("_high", F.col(score) > F.col("_cut"))  # a row a symbol and horizon
    whole = reduce(lambda a, b: a & b, [x.isNotNull() for x in (actual(), *predicted())])
    extra = F.percentile(F.greatest(F.col("q05") - actual(), actual() - F.col("q95"), F.lit(0.0)), 0.9)
    width = [-extra, -0.5 * extra, F.median(actual() - F.col("q50")), 0.5 * extra, extra]
    shifts = width if method == "disagreement_width" else WIDENING["conformal"]()
    fitted = df.where((F.col("_f") <= fit_share) & whole).groupBy("symbol", "horizon", "_high").agg(*[x.alias(f"s_{n}") for x, n in zip(shifts, NAMES, strict=True)])
    later = df.where(F.col("_f") > fit_share).join(F.broadcast(fitted), ["symbol", "horizon", "_high"], "left")
    ordered = F.array_sort(F.array(*[q + F.coalesce(f"s_{n}", F.lit(0.0)) for q, n in zip(predicted(), NAMES, strict=True)]))
    return later.select("symbol", "horizon", "day", *[ordered[i].alias(n) for i, n in enumerate(NAMES)])


def fold_rows(df: DataFrame, test: int, step: int, count: int, least: int) -> DataFrame:
    """symbol, fold and the first and last days of train and test; folds end at the latest row and step back, oldest first."""
    w = Window.partitionBy("symbol")
    d = df.select("symbol", "day", F.row_number().over(w.orderBy("day")).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"))
    d = d.withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("_end", F.col("_n") - F.col("_back") * step).where(F.col("_end") - test >= least)
    part = F.when(F.col("_r") <= F.col("_end") - test, "train").when(F.col("_r") <= F.col("_end"), "test")
    g = d.withColumn("_p", part).where(F.col("_p").isNotNull()).groupBy("symbol", "_back").agg(*[f(F.when(F.col("_p") == p, F.col("day"))).alias(f"{p}_{n}") for p in ("train", "test") for f, n in ((F.min, "start"), (F.max, "end"))], F.count_if(F.col("_p") == "train").alias("train_rows"))
    return g.withColumn("fold", F.row_number().over(w.orderBy(F.desc("_back"))) - 1).drop("_back")


def selection_segments(df: DataFrame, validation: int, calibration: int, purge: int) -> DataFrame:
    """segment: validation, embargo or calibration, by rows; symbols with an embargo below `purge` rows have none."""
    w = Window.partitionBy("symbol")
    d = df.withColumns({"_r": F.row_number().over(w.orderBy("day")), "_n": F.count(F.lit(1)).over(w)}).where(F.col("_n") - validation - calibration >= purge)
    return d.withColumn("segment", F.when(F.col("_r") <= validation, "validation").when(F.col("_r") > F.col("_n") - calibration, "calibration").otherwise("embargo")).drop("_r", "_n")


def horizon_bins(horizons: Sequence[int], length: int) -> dict[int, list[int]]:
    """Offsets that each horizon owns since the one before, the last `length` of them."""
    out, before = {}, 0
    for h in sorted(horizons):
        out[h] = list(range(before + 1, h + 1))[-length:]
        before = h
    return out


def bin_means(df: DataFrame, value: str, bins: dict[int, list[int]]) -> DataFrame:
    """Mean of the value over each horizon's own offsets ahead; null unless all are there."""
    made = {f"bin_{h}": F.when(F.count(value).over(O.spec.rowsBetween(x[0], x[-1])) == len(x), F.avg(value).over(O.spec.rowsBetween(x[0], x[-1]))) for h, x in bins.items()}
    return df.withColumns(made).select("symbol", "day", *made)


def market_state(df: DataFrame, train_end: str) -> DataFrame:
    """Returns, volatilities and trends of the log close, scaled by median and interquartile range up to `train_end`, within 10; missing ones are 0."""
    x = safe_log(F.col("close"))
    df = df.select("symbol", "day", x.alias("_x")).withColumn("_r", O.diff(F.col("_x")))
    v, r = F.col("_x"), F.col("_r")
    made = {f"return_{k}": O.diff(v, k) for k in (1, 3, 7, 15)} | {"vol_7": O.deviation(r, 7, 3), "vol_30": O.deviation(r, 30, 10), "trend_7": v - O.mean(v, 7, 3), "trend_30": v - O.mean(v, 30, 10)}
    df = df.withColumns(made)
    train = df.where(F.col("day") <= F.lit(train_end).cast("date")).groupBy("symbol").agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{c}") for c in made])
    df = df.join(F.broadcast(train), "symbol", "left")  # a row a symbol
    scaled = lambda c: F.coalesce(clip((F.col(c) - F.coalesce(F.col(f"_q_{c}")[1], F.lit(0.0))) / F.coalesce(F.nullif(F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0], F.lit(0.0)), F.lit(1.0)), -10, 10), F.lit(0.0))
    return df.select("symbol", "day", *[scaled(c).alias(c) for c in made])


def single_utility(df: DataFrame, features: Sequence[str], target: str, train: Column, penalty: float = 1.0) -> DataFrame:
    """For each feature the test error of a one-feature ridge fit on the train rows, relative to the train mean's error."""
    parts = []
    for f in features:
        d = df.where(F.col(f).isNotNull() & F.col(target).isNotNull()).select("symbol", F.col(f).alias("x"), F.col(target).alias("y"), train.alias("_t"))
        fit = d.where("_t").groupBy("symbol").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("n"))
        fit = fit.withColumn("slope", ratio(F.col("c") * F.col("n"), F.col("v") * (F.col("n") + penalty)))
        j = d.where("not _t").join(F.broadcast(fit), "symbol")  # a row a symbol
        e = F.col("y") - F.col("my") - F.coalesce("slope", F.lit(0.0)) * (F.col("x") - F.col("mx"))
        base = F.col("y") - F.col("my")
        parts.append(j.groupBy("symbol").agg(F.lit(f).alias("feature"), F.count(F.lit(1)).alias("n"), F.max("slope").alias("slope"), ratio(F.avg(e * e), F.avg(base * base)).alias("relative_mse")))
    return reduce(DataFrame.unionByName, parts)


def soft_codes(df: DataFrame, features: Sequence[str], centres: Sequence[Sequence[float]], temperature: float = 1.0) -> DataFrame:
    """Shares of fixed regimes by the distance to their centres, and the distance to the nearest one."""
    d = [F.sqrt(total([F.pow(F.col(f) - float(c), F.lit(2.0)) for f, c in zip(features, centre, strict=True)])) for centre in centres]
    df = df.withColumns({f"_d{i}": x for i, x in enumerate(d)})
    d = [F.col(f"_d{i}") for i in range(len(centres))]
    least = F.least(*d)
    parts = [F.exp(-(x - least) / temperature) for x in d]
    return df.withColumns({f"regime_{i}": p / total(parts) for i, p in enumerate(parts)} | {"novelty": least}).drop(*[f"_d{i}" for i in range(len(centres))])


def sequences(df: DataFrame, columns: Sequence[str], length: int) -> DataFrame:
    """symbol, day and `window`: the last `length` rows of the columns as an array of arrays, where all rows are there."""
    w = O.spec.rowsBetween(-(length - 1), 0)
    rows = F.collect_list(F.array(*[F.coalesce(c, F.lit(0.0)) for c in columns])).over(w)
    return df.select("symbol", "day", rows.alias("window")).where(F.size("window") == length)


def adjacent(df: DataFrame, key: str, position: str, columns: Sequence[str]) -> DataFrame:
    """Pairs of rows at positions p and p + 1 of a key."""
    later = df.select(key, (F.col(position) - 1).alias(position), *[F.col(c).alias(f"{c}_next") for c in columns])
    return df.select(key, position, *columns).join(later, [key, position])
