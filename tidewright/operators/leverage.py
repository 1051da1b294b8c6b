"""Scores of crowding, fuel, walls and jumps against each symbol's own past."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.scalars import clip, weighted_mean
from tidewright.operators.frames import Ordered
from tidewright.operators.recursion import Recursion, fold, fold_rows, robust_scores, robust_z, running_quantile, share_of_amounts, share_of_high

O = Ordered()  # noqa: E741


def with_robust_score(df: DataFrame, column: str, out: str, n: int = 365, least: int = 60) -> DataFrame:
    """100 tanh(z / 2) against the median and 1.4826 median deviations of the values before; z within 4; 0 without spread.

    The median deviation is that of each prior frame about its own median. Values that are missing are no history.
    """
    return fold(df, [Recursion(out, column, partial(robust_scores, window=n, least=least))])


def with_amount_scores(df: DataFrame, scores: dict[str, str], n: int = 365, least: int = 60) -> DataFrame:
    """Columns {name: source}: share of the 90th percentile of the source's last n positive values before, in percent, 0 to 100; 0 for values up to 0."""
    return fold(df, [Recursion(name, c, partial(share_of_amounts, window=n, least=least)) for name, c in scores.items()])


def crowding(funding: Column, predicted: Column) -> Column:
    """Negative weighted mean of the two robust scores; the weights shift when one is missing."""
    return -weighted_mean([funding, predicted], [0.6, 0.4])


def impulse(dominance: Column) -> Column:
    return clip(-dominance / 20 * 100, -100, 100)


def trigger(change: Column, sigma: Column) -> Column:
    """Moves beyond 0.75 deviations, in percent of 1.75 more; deviations count as 0.005 at least."""
    return F.when(sigma.isNotNull(), clip((F.abs(change) / F.greatest(sigma, F.lit(0.005)) - 0.75) / 1.75 * 100, 0, 100))


def cascade_band(sigma: Column) -> Column:
    """Two weekly deviations in basis points, within 150 and 1200; without one, those of 0.005."""
    return clip(2 * F.coalesce(F.nullif(sigma, F.lit(0.0)), F.lit(0.005)) * (7**0.5) * 10000, 150, 1200)


def closeness(distance: Column, band: Column) -> Column:
    """100 at no distance, falling off as a bell curve of the band's width."""
    return 100 * F.exp(-0.5 * F.pow(distance / band, F.lit(2.0)))


def best_walls(walls: DataFrame, keys: list[str]) -> DataFrame:
    """The wall with the greatest notional times closeness on each side, then the nearest; walls: distance_bps, notional, band, side."""
    score = F.col("notional") * closeness(F.col("distance_bps"), F.col("band"))
    return walls.groupBy(*keys, "side").agg(F.max_by(F.struct("distance_bps", "notional"), F.struct(score, -F.abs("distance_bps"))).alias("w"), F.max(score).alias("score")).select(*keys, "side", "w.*", "score")


def threshold_state(score: Column) -> Column:
    """State of a cascade score; empty without one."""
    return F.when(score >= 65, "cascade-ready").when(score >= 35, "watch").when(score > 0, "building").when(score.isNotNull(), "none").otherwise("")


def direction_label(score: Column, least: float = 12) -> Column:
    return F.when(score >= least, "upside").when(score <= -least, "downside").otherwise("neutral")


def potential_label(score: Column) -> Column:
    return F.when(score >= 65, "high").when(score >= 35, "elevated").otherwise("low")


def regime_text(direction: Column, potential: Column, fuel: Column) -> Column:
    side = F.concat(potential, F.lit(" "), direction)
    neutral = F.when(fuel >= 65, "high-fuel neutral").otherwise("neutral")
    return F.when(direction == "neutral", neutral).when(potential == "low", F.concat(side, F.lit(" pressure"))).otherwise(F.concat(side, F.lit(" volatility potential")))


def agreement(a: Column, b: Column) -> Column:
    """1 or 0 for two scores of at least 10 on one side or on both; 0.5 for one of them; 0.25 for none."""
    x, y = (F.coalesce(F.abs(c) >= 10, F.lit(False)) for c in (a, b))
    return F.when(x & y, F.when(a * b > 0, 1.0).otherwise(0.0)).when(x | y, 0.5).otherwise(0.25)


def zone_proximity(price: Column, anchor: Column, band: Column) -> Column:
    """Bell curve of the log distance from the anchor; 0 without a positive price, anchor and band."""
    return F.when((price > 0) & (anchor > 0) & (band > 0), F.exp(-0.5 * F.pow(F.ln(price / anchor) / band, F.lit(2.0)))).otherwise(0.0)


#: Daily decay of a tranche, the share that a full depletion takes in a week, and the least weight that is kept.
DECAY, DEPLETION, LEAST_WEIGHT = 0.5 ** (1 / 60), 0.35, 0.001


def tranche_inventory(df: DataFrame) -> DataFrame:
    """Open positions by the price at which they were built, as known at the end of each day.

    df: symbol, day, price, added (0 to 100), vulnerable (-100 to 100), depletion (0 to 1), band. A day's positive
    addition is one tranche; tranches halve in 60 days, faster when positions are closed, and go below LEAST_WEIGHT.
    Adds total, active (near today's price), directional and anchor_log sums. One symbol's days are sequential.
    """

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("day").reset_index(drop=True)
        logs, sides, weights = np.zeros(0), np.zeros(0), np.zeros(0)
        out = np.zeros((len(frame), 4))
        rows = zip(*(frame[c].to_numpy(float, na_value=np.nan) for c in ("price", "added", "vulnerable", "depletion", "band")), strict=True)
        for i, (price, added, side, gone, band) in enumerate(rows):
            weights = weights * DECAY * (1 - DEPLETION * (gone if gone == gone else 0.0) / 7)
            keep = weights >= LEAST_WEIGHT
            logs, sides, weights = logs[keep], sides[keep], weights[keep]
            if not price > 0:
                continue
            now = np.log(price)
            if added > 0:
                logs, sides, weights = np.append(logs, now), np.append(sides, np.clip(side if side == side else 0.0, -100, 100) / 100), np.append(weights, added / 700)
            active = weights * np.exp(-0.5 * ((now - logs) / band) ** 2)
            out[i] = weights.sum(), active.sum(), (active * sides).sum(), (active * logs).sum()
        return frame.assign(total=out[:, 0], active=out[:, 1], directional=out[:, 2], anchor_log=out[:, 3])

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)
    return df.groupBy("symbol").applyInPandas(f, f"{schema}, total double, active double, directional double, anchor_log double")


def daily_scores(bars: DataFrame) -> DataFrame:
    """Direction, potential and labels of each day from its own past.

    bars: symbol, day, price, oi (change of open interest), funding and liquidation (scores, -100 to 100, may be null).
    """
    w30 = O.spec.rowsBetween(-30, -1)
    df = bars.withColumn("r", F.ln(F.col("price") / O.lag(F.col("price"))))
    df = df.withColumns({"baseline": F.when(F.count("r").over(w30) >= 15, F.stddev_pop("r").over(w30)), "realised": F.sqrt(F.avg(F.col("r") * F.col("r")).over(O.spec.rowsBetween(-6, 0))), "closing": -F.col("oi")})
    df = with_amount_scores(df, {"added": "oi", "regime_score": "realised", "gone": "closing"})
    df = df.withColumns({"trigger": trigger(F.col("r"), F.col("baseline")), "depletion": F.coalesce(F.col("gone") / 100, F.lit(0.0))}).drop("gone")
    df = df.withColumns({"vulnerable": F.col("funding"), "band": F.coalesce(clip(2 * F.col("baseline") * 7**0.5, 0.04, 0.18), F.lit(0.04))})
    df = tranche_inventory(df.drop("closing"))
    df = fold(df, [Recursion("_high", "active", partial(running_quantile, level=0.9, window=365, least=60, shift=1))])
    high = F.col("_high")
    fuel = F.when(high.isNotNull(), F.when(high > 0, clip(100 * F.col("active") / high, 0, 100)).otherwise(F.coalesce("added", F.lit(0.0))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    df = df.withColumns({"fuel": fuel, "reactivation": F.when(F.col("total") > 0, clip(100 * F.col("active") / F.col("total"), 0, 100)).otherwise(0.0), "side": F.when(F.col("active") > 0, clip(100 * F.col("directional") / F.col("active"), -100, 100)).otherwise(0.0), "anchor": F.when(F.col("active") > 0, F.exp(F.col("anchor_log") / F.col("active")))})
    pressure = F.col("side") * F.col("reactivation") / 100
    jump = F.coalesce(F.signum("r"), F.lit(0.0))
    cascade = jump * zero("trigger") * zero("fuel") / 100 * F.greatest(jump * F.col("side") / 100, F.lit(0.0))
    df = df.withColumns({"pressure": pressure, "cascade": cascade})
    df = df.withColumn("direction_score", clip(0.45 * F.col("cascade") + 0.2 * zero("liquidation") + 0.2 * F.col("pressure") + 0.15 * zero("funding"), -100, 100))
    df = df.withColumn("potential_score", clip(0.55 * zero("regime_score") + 0.2 * zero("trigger") + 0.15 * zero("fuel") + 0.1 * F.abs("direction_score"), 0, 100))
    df = df.withColumns({"direction": direction_label(F.col("direction_score")), "potential": potential_label(F.col("potential_score"))})
    return df.withColumns({"regime": regime_text(F.col("direction"), F.col("potential"), zero("fuel")), "agreement": agreement(F.col("liquidation"), F.col("pressure")), "signed_potential": F.when(F.abs("direction_score") >= 12, F.signum("direction_score") * F.col("potential_score")).otherwise(0.0)})


def space_days(walls: DataFrame) -> DataFrame:
    """One row a symbol and day with the best wall of each kind and side, and the greatest amount of each kind.

    walls: symbol, day, kind (wall or area), side (up or down), distance_bps, notional, band.
    """
    score = F.col("notional") * closeness(F.col("distance_bps"), F.col("band"))
    usable = walls.where(F.col("notional") > 0)
    best = {f"{k}_{s}": F.max(F.when((F.col("kind") == k) & (F.col("side") == s), F.struct(score.alias("score"), (-F.abs("distance_bps")).alias("near"), "notional", "distance_bps"))) for k in ("wall", "area") for s in ("up", "down")}
    most = {f"{k}_most": F.max(F.when(F.col("kind") == k, F.col("notional"))) for k in ("wall", "area")}
    return usable.groupBy("symbol", "day").agg(F.max("band").alias("band"), *[x.alias(n) for n, x in (best | most).items()])


def space_scores(days: DataFrame, pressure: DataFrame) -> DataFrame:
    """Cascade score and direction of each day; pressure: symbol, day, down, up. Every day has both kinds of walls."""
    df = days.join(pressure, ["symbol", "day"])
    kinds = [(k, s) for k in ("wall", "area") for s in ("up", "down")]
    df = df.withColumns({f"_{k}_{s}": F.col(f"{k}_{s}.notional") for k, s in kinds})

    def shares(frame: pd.DataFrame) -> dict[str, np.ndarray]:
        x = {c: frame[c].to_numpy(float, na_value=np.nan) for c in ("down", "up", "wall_most", "area_most", *(f"_{k}_{s}" for k, s in kinds))}
        return {f"p_{s}": share_of_amounts(x[s], 365, 60) for s in ("down", "up")} | {f"_a_{k}_{s}": share_of_high(x[f"_{k}_{s}"], x[f"{k}_most"], 365, 60) for k, s in kinds}

    df = fold_rows(df, shares, ["p_down", "p_up", *(f"_a_{k}_{s}" for k, s in kinds)])
    df = df.withColumns({f"{k}_{s}_score": F.sqrt(F.col(f"_a_{k}_{s}") * closeness(F.col(f"{k}_{s}.distance_bps"), F.col("band"))) for k, s in kinds}).drop(*[f"{x}_{k}_{s}" for x in ("_a", "") for k, s in kinds])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    top = {s: F.greatest(f"wall_{s}_score", f"area_{s}_score", f"p_{s}") for s in ("up", "down")}
    df = df.withColumns({"top_up": top["up"], "top_down": top["down"], "net": F.when(F.col("p_up").isNotNull() | F.col("p_down").isNotNull(), clip(zero(F.col("p_up")) - zero(F.col("p_down")), -100, 100))})
    some = F.col("top_up").isNotNull() | F.col("top_down").isNotNull()
    raw = F.when(some, clip(zero(F.col("top_up")) - zero(F.col("top_down")), -100, 100))
    df = df.withColumns({"cascade": F.when(some, F.greatest(zero(F.col("top_up")), zero(F.col("top_down")))), "raw": raw})
    return df.withColumns({"direction": F.when(F.col("raw").isNotNull() & F.col("net").isNotNull(), clip(0.75 * F.col("raw") + 0.25 * F.col("net"), -100, 100)).otherwise(F.col("raw")), "state": threshold_state(F.col("cascade"))})


def one_hot(df: DataFrame, column: str, vocabulary: list[str]) -> dict[str, Column]:
    """A 0/1 column for each word of a fixed vocabulary; a null counts as the empty word."""
    return {f"{column}_{v}": (F.coalesce(column, F.lit("")) == v).cast("double") for v in vocabulary}


def missing_flags(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """0/1 columns for those of the columns that miss any value; one aggregation finds them."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return {f"{c}_missing": F.col(c).isNull().cast("double") for c in columns if row[c]}


def enriched(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column filled forward, with its spread over 7 and 30 rows and a bounded robust score over 180."""
    df = df.withColumns({c: F.coalesce(O.last_known(F.col(c)), F.lit(0.0)) for c in columns})
    df = fold(df, [Recursion(f"_z_{c}", c, partial(robust_z, window=180, least=30)) for c in columns])
    made = {}
    for c in columns:
        made |= {f"{c}_roll7_std": F.coalesce(O.deviation(F.col(c), 7, 3), F.lit(0.0)), f"{c}_roll30_std": F.coalesce(O.deviation(F.col(c), 30, 10), F.lit(0.0)), f"{c}_signalboost": F.tanh(F.coalesce(f"_z_{c}", F.lit(0.0)) / 2)}
    return df.withColumns(made).drop(*[f"_z_{c}" for c in columns])


def semantic_targets(df: DataFrame) -> DataFrame:
    """Six targets in [-1, 1] or [0, 1] from scores in percent: pressure, direction, fuel, instability, asymmetry, confidence."""
    part = lambda c: F.coalesce(clip(F.col(c) / 100, -1, 1), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    positive = lambda c: F.greatest(part(c), F.lit(0.0))
    direction = F.tanh((0.45 * part("direction") + 0.25 * part("space_direction") + 0.15 * part("pressure_net") + 0.15 * part("impulse")) * 1.4)
    area = part("area_up") - part("area_down")
    lean = 0.45 * direction + 0.25 * (0.6 * (part("wall_up") - part("wall_down")) + 0.4 * area) + 0.15 * part("funding") + 0.15 * part("anchor_direction")
    made = {
        "cascade_pressure": clip(0.45 * positive("cascade") + 0.35 * positive("potential") + 0.2 * F.abs(part("activation")), 0, 1),
        "directional_pressure": direction,
        "leverage_fuel": clip(0.35 * positive("fuel") + 0.25 * positive("added") + 0.2 * positive("reactivation") + 0.1 * (positive("area_down") + positive("area_up")), 0, 1),
        "instability": clip(0.4 * positive("volatility") + 0.3 * positive("trigger") + 0.3 * positive("potential"), 0, 1),
        "cascade_asymmetry": F.tanh(lean * 1.2),
        "confidence": positive("confidence"),
    }
    return df.select("symbol", "day", *[x.alias(n) for n, x in made.items()])


def jump_labels(bars: DataFrame, horizons: tuple[int, ...] = (1, 3, 7), least: float = 0.01) -> DataFrame:
    """The larger extreme of the next days against today's close, where every day is there, and its direction."""
    out = bars
    c = F.col("close")
    for x in horizons:
        w = O.spec.rowsBetween(1, x)
        up, down = F.max("close").over(w) / c - 1, F.min("close").over(w) / c - 1
        whole = (F.count("close").over(w) == x) & (F.datediff(O.lead(F.col("day"), x), F.col("day")) == x)
        jump = F.when(whole, F.when(F.abs(up) >= F.abs(down), up).otherwise(down))
        out = out.withColumn(f"jump_{x}", jump).withColumn(f"direction_{x}", F.when(F.col(f"jump_{x}") >= least, 1).when(F.col(f"jump_{x}") <= -least, -1).when(F.col(f"jump_{x}").isNotNull(), 0))
    return out


def forward_drawdown(bars: DataFrame, days: int = 30) -> Column:
    """Least close of the next days against today's, by calendar days."""
    d = F.unix_date("day")
    w = Window.partitionBy("symbol").orderBy(d).rangeBetween(1, days)
    return F.min("close").over(w) / F.col("close") - 1
