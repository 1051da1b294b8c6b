"""The whole daily scorer of leveraged positions: crowding, fuel, walls, direction, potential and confidence.

Each score stands against its own trailing history of known values, so a day
without a price adds no return and no inventory to any history and the next
return is taken against the last known price. A symbol's daily rows are one
group; trailing percentiles keep their values in order, so a day costs one
insertion. Walls are joined between the two passes, as their closeness follows
from the day's volatility.
"""

from __future__ import annotations

from collections import deque
from math import copysign, exp, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.leverage import DECAY, DEPLETION, LEAST_WEIGHT, direction_label, potential_label, regime_text, space_days, threshold_state
from tidewright.operators.recursion import Trailing, clamp, fold_rows

# Lengths of histories, and the venues that quote funding and predicted funding.
LEAST, RETURNS, LEAST_RETURNS, WEEK = 60, 30, 15, 7
FUNDING_VENUES, PREDICTED_VENUES = 13, 12
NAN = float("nan")


def price_days(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    """Return against the last known price, usual and present volatility, and the width of the cascade's band."""
    out = np.full((4, len(frame)), NAN)
    past: deque[float] = deque(maxlen=RETURNS)
    before = NAN
    for i, price in enumerate(frame["price"].to_numpy(float, na_value=NAN).tolist()):
        price = price if 0 < price < float("inf") else NAN
        r = log(price / before) if price == price and before == before else NAN
        usual = float(np.std(past)) if len(past) >= LEAST_RETURNS else NAN
        recent = [*list(past)[-(WEEK - 1) :], *([r] if r == r else [])]
        present = sqrt(sum(x * x for x in recent) / len(recent)) if recent else NAN
        width = next((v for v in (usual, present) if v == v and v), 0.005)
        out[:, i] = r, usual, present, clamp(2 * width * sqrt(WEEK) * 10_000, 150, 1200)
        if r == r:
            past.append(r)
        before = price if price == price else before
    return dict(zip(("r", "usual", "present", "band"), out, strict=True))


def wide_sum(parts: list[tuple[float, float]]) -> float:
    known = [(v, w) for v, w in parts if v == v]
    return sum(v * w for v, w in known) / sum(w for _, w in known) if known else NAN


def wall(amount: float, distance: float, history: Trailing, band: float) -> float:
    share = history.share(amount)
    return sqrt(share * 100 * exp(-0.5 * (distance / band) ** 2)) if share == share else NAN


def agreed(a: float, b: float) -> float:
    x, y = abs(a) >= 10, abs(b) >= 10
    return (1.0 if a * b > 0 else 0.0) if x and y else 0.5 if x or y else 0.25


SCORES = ["liquidation", "funding_score", "added", "fuel", "reactivation", "side", "anchor", "trigger", "regime_score", "activation", "space_cascade", "space_direction", "direction_score", "potential_score", "signed_potential", "confidence"]
KINDS = [(k, s) for k in ("wall", "area") for s in ("up", "down")]


def scored_days(frame: pd.DataFrame, with_space: bool) -> dict[str, np.ndarray]:
    names = ("funding", "predicted", "added_past", "closed_past", "active_past", "present", "down", "up", "wall", "area")
    h = {n: Trailing() for n in names}
    returns = 0
    logs, sides, weights = np.zeros(0), np.zeros(0), np.zeros(0)
    out = np.full((len(SCORES), len(frame)), NAN)
    nan0 = lambda v: v if v == v else 0.0
    columns = {c: frame[c].to_numpy(float, na_value=NAN).tolist() for c in frame.columns if c not in ("symbol", "day")}
    for i in range(len(frame)):
        x = {c: v[i] for c, v in columns.items()}
        price = x["price"] if 0 < x["price"] < float("inf") else NAN
        impulses = [clamp(-x[c] / 20 * 100, -100, 100) if x[c] == x[c] else NAN for c in ("dominance", "heat_dominance")]
        liquidation = wide_sum([(impulses[0], 0.65), (impulses[1], 0.35)])
        crowded = wide_sum([(h["funding"].robust(x["funding"]), 0.6), (h["predicted"].robust(x["predicted"]), 0.4)])
        crowded = -crowded
        added, r, usual = h["added_past"].share(x["oi"]), x["r"], x["usual"]
        regime = h["present"].share(x["present"])
        trigger = clamp((abs(r) / max(usual, 0.005) - 0.75) / 1.75 * 100, 0, 100) if r == r and usual == usual else NAN
        gone = nan0(h["closed_past"].share(-x["oi"])) / 100 if x["oi"] < 0 else 0.0
        weights = weights * DECAY * (1 - DEPLETION * gone / WEEK)
        keep = weights >= LEAST_WEIGHT
        logs, sides, weights = logs[keep], sides[keep], weights[keep]
        total = active = directional = anchored = 0.0
        if price == price:
            now = log(price)
            if added > 0:
                logs, sides, weights = np.append(logs, now), np.append(sides, clamp(nan0(crowded), -100, 100) / 100), np.append(weights, added / 100 / WEEK)
            band = clamp(2 * usual * sqrt(WEEK), 0.04, 0.18) if usual == usual else 0.04
            near = weights * np.exp(-0.5 * ((now - logs) / band) ** 2)
            total, active, directional, anchored = float(weights.sum()), float(near.sum()), float((near * sides).sum()), float((near * logs).sum())
        fuel = NAN
        if len(h["active_past"]) >= LEAST:
            high = h["active_past"].quantile(0.9)
            fuel = clamp(100 * active / high, 0, 100) if high > 0 else nan0(added)
        again = clamp(100 * active / total, 0, 100) if total > 0 else 0.0
        side = clamp(100 * directional / active, -100, 100) if active > 0 else 0.0
        pressure = side * again / 100
        jump = 0.0 if r != r or r == 0 else copysign(1.0, r)
        activation = jump * nan0(trigger) * nan0(fuel) / 100 * max(0.0, jump * side / 100)
        cascade = toward = NAN
        if x["space"] == 1:
            p = {s: h[s].share(x[f"p_{s}"]) for s in ("down", "up")}
            net = clamp(nan0(p["up"]) - nan0(p["down"]), -100, 100) if p["up"] == p["up"] or p["down"] == p["down"] else NAN
            top = {s: max([v for v in (p[s], *(wall(x[f"{k}_{s}"], x[f"{k}_{s}_bps"], h[k], x["band"]) for k in ("wall", "area"))) if v == v], default=NAN) for s in ("up", "down")}
            if top["up"] == top["up"] or top["down"] == top["down"]:
                cascade, toward = max(nan0(top["up"]), nan0(top["down"])), clamp(nan0(top["up"]) - nan0(top["down"]), -100, 100)
                toward = clamp(0.75 * toward + 0.25 * net, -100, 100) if net == net else toward
        direction = clamp(0.45 * activation + 0.2 * nan0(liquidation) + 0.2 * pressure + 0.15 * nan0(crowded), -100, 100)
        direction = clamp(0.72 * direction + 0.28 * toward, -100, 100) if toward == toward else direction
        potential = clamp(0.55 * nan0(regime) + 0.2 * nan0(trigger) + 0.15 * nan0(fuel) + 0.1 * abs(direction), 0, 100)
        potential = clamp(0.78 * potential + 0.22 * cascade, 0, 100) if cascade == cascade else potential
        known = sum(v == v for v in (x["funding"], x["predicted"], x["oi"], x["dominance"], price))
        whole = (known + (x["space"] == 1 and any(x[c] == x[c] for c in ("p_down", "p_up", "heat_dominance")))) / 6 if with_space else known / 5
        venues = (clamp(nan0(x["funding_venues"]) / FUNDING_VENUES, 0, 1) + clamp(nan0(x["predicted_venues"]) / PREDICTED_VENUES, 0, 1)) / 2
        peer = toward if toward == toward else pressure if price == price else crowded
        ready = [len(h[n]) / LEAST for n in ("funding", "added_past", "active_past")] + [min(returns, RETURNS) / LEAST_RETURNS, len(h["wall"]) / LEAST if with_space else 1.0]
        confidence = 100 * (0.30 * whole + 0.20 * venues + 0.25 * agreed(liquidation, peer) + 0.25 * sum(min(v, 1.0) for v in ready) / 5)
        signed = copysign(potential, direction) if abs(direction) >= 12 else 0.0
        out[:, i] = liquidation, crowded, added, fuel, again, side, exp(anchored / active) if active > 0 else NAN, trigger, regime, activation, cascade, toward, direction, potential, signed, confidence
        h["funding"].add(x["funding"])
        h["predicted"].add(x["predicted"])
        if x["oi"] > 0:
            h["added_past"].add(x["oi"])
        elif x["oi"] < 0:
            h["closed_past"].add(-x["oi"])
        if price == price:
            h["active_past"].add(active)
        returns += r == r
        h["present"].add(x["present"])
        if x["space"] == 1:
            for s in ("down", "up"):
                if x[f"p_{s}"] > 0:
                    h[s].add(x[f"p_{s}"])
            h["wall"].add(x["wall_most"])
            h["area"].add(x["area_most"])
    return dict(zip(SCORES, out, strict=True))


def daily_signals(days: DataFrame, walls: DataFrame | None = None, space: DataFrame | None = None) -> DataFrame:
    """symbol, day, SCORES and the labels of each day.

    days: symbol, day, price, funding, predicted, oi (change of open interest), dominance, funding_venues and
    predicted_venues, any of which may be null. walls: symbol, day, kind (wall or area), side (up or down),
    distance_bps, notional. space: symbol, day, p_down, p_up, heat_dominance; a day is in the space if either has it.
    """
    inputs = ["price", "funding", "predicted", "oi", "dominance", "funding_venues", "predicted_venues"]
    df = days.select("symbol", "day", *[F.col(c).cast("double").alias(c) for c in inputs])
    df = fold_rows(df, price_days, ["r", "usual", "present", "band"])
    flat = [f"{k}_{s}{u}" for k, s in KINDS for u in ("", "_bps")] + ["wall_most", "area_most"]
    if walls is not None:
        near = space_days(walls.join(df.select("symbol", "day", "band"), ["symbol", "day"]))
        best = {f"{k}_{s}{u}": F.col(f"{k}_{s}.{'distance_bps' if u else 'notional'}") for k, s in KINDS for u in ("", "_bps")}
        df = df.join(near.select("symbol", "day", *[x.cast("double").alias(n) for n, x in best.items()], "wall_most", "area_most", F.lit(1.0).alias("_w")), ["symbol", "day"], "left")
    else:
        df = df.withColumns({c: F.lit(None).cast("double") for c in [*flat, "_w"]})
    if space is not None:
        df = df.join(space.select("symbol", "day", *[F.col(c).cast("double").alias(c) for c in ("p_down", "p_up", "heat_dominance")], F.lit(1.0).alias("_s")), ["symbol", "day"], "left")
    else:
        df = df.withColumns({c: F.lit(None).cast("double") for c in ("p_down", "p_up", "heat_dominance", "_s")})
    df = df.withColumn("space", F.coalesce("_w", "_s", F.lit(0.0))).drop("_w", "_s")
    with_space = walls is not None or space is not None
    df = fold_rows(df, lambda frame: scored_days(frame, with_space), SCORES)
    df = df.withColumns({"direction": direction_label(F.col("direction_score")), "potential": potential_label(F.col("potential_score")), "state": threshold_state(F.col("space_cascade"))})
    return df.select("symbol", "day", *SCORES, "direction", "potential", regime_text(F.col("direction"), F.col("potential"), F.coalesce("fuel", F.lit(0.0))).alias("regime"), "state")
