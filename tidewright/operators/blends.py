"""Filtered price states by profile, and forecasts blended with each state's projection.

Five profiles of a state and nine ways to blend it with a forecast give 45
forecasters. States are one grouped pass a symbol for all profiles; the blends
are one row of fixed values each, dealt to the rows by an array, so that all
forecasters come from one scan as plain expressions.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.forecasts import NAMES
from tidewright.operators.recursion import ewm

LEAST_HISTORY = 240
SCOPE = (7.0, 240.0)
PREFIX = "blend"


@dataclass(frozen=True)
class Profile:
    state: str
    phi: float
    level_noise: float
    deviation_noise: float
    observation_noise: float
    drift_span: int
    drift_weight: float
    reversion_weight: float
    anchor_weight: float = 0.0
    slow: bool = False


@dataclass(frozen=True)
class Blend:
    blend: str
    center: float
    disagreement: float
    uncertainty: float
    tail: float
    clip_widths: float
    mode: str = "scale"
    sigma: float = 1.0
    dampen: float = 0.0
    sigma_boost: float = 0.0
    tail_boost: float = 0.0
    empirical: float = 0.0
    safety: float = 0.0
    safety_boost: float = 0.0


# The profiles and blends.
PROFILES = (
    Profile("local_sticky", 0.85, 0.002, 0.35, 0.20, 90, 0.60, 0.35),
    Profile("local_balanced", 0.70, 0.008, 0.55, 0.15, 60, 0.75, 0.55),
    Profile("local_responsive", 0.55, 0.025, 0.80, 0.12, 30, 0.90, 0.75),
    Profile("liquidity_anchor", 0.78, 0.004, 0.45, 0.18, 90, 0.65, 0.50, 0.35),
    Profile("fundamental_slow", 0.98, 0.002, 0.25, 5.50, 90, 0.45, 0.80, slow=True),
)
BLENDS = (
    Blend("light", 0.15, 0.10, 0.05, 0.10, 0.75),
    Blend("balanced", 0.30, 0.20, 0.10, 0.20, 1.00),
    Blend("assertive", 0.45, 0.35, 0.18, 0.35, 1.25),
    Blend("sigma_cap", 0.20, 0.05, 0.05, 0.15, 0.85, "cap", 1.10),
    Blend("sigma_cap_wide", 0.25, 0.05, 0.08, 0.25, 1.00, "cap", 1.35),
    Blend("sigma_replace", 0.35, 0.00, 0.00, 0.20, 1.00, "replace", 1.20),
    Blend("directional_anchor", 0.55, 0.08, 0.05, 0.22, 1.15, "cap", 1.20, 0.10, 0.30, 0.45, 0.30, 1.60, 0.35),
    Blend("directional_high_vol", 0.50, 0.10, 0.08, 0.35, 1.10, "cap", 1.35, 0.18, 0.55, 0.85, 0.55, 1.85, 0.55),
    Blend("directional_guarded", 0.42, 0.06, 0.05, 0.30, 0.95, "cap", 1.25, 0.22, 0.45, 0.70, 0.50, 1.70, 0.50),
)
# The order in which one forecaster is picked for a row.
PREFERRED = tuple(f"{PREFIX}_{x}" for x in ("fundamental_slow_directional_anchor", "fundamental_slow_directional_guarded", "fundamental_slow_directional_high_vol", "local_responsive_directional_anchor", "local_responsive_directional_guarded", "local_responsive_directional_high_vol", "local_responsive_sigma_cap"))
STATE = ["log_close", "level", "gap", "drift", "residual_sigma", "gap_z", "innovation_z", "uncertainty", "tail_flare", "high_vol"]


def local_states(y: np.ndarray, variance: np.ndarray, p: Profile) -> tuple[np.ndarray, ...]:
    """Level, its and the deviation's variance, innovation and its variance; noise follows the variance of returns."""
    out = np.empty((5, len(y)))
    f, d, a, c, e = y[0], 0.0, 0.02, 0.0, 0.02
    for i, (v, s2) in enumerate(zip(y.tolist(), variance.tolist(), strict=True)):
        d, a = p.phi * d, a + max(s2 * p.level_noise, 1e-9)
        c, e = p.phi * c, p.phi**2 * e + max(s2 * p.deviation_noise, 1e-9)
        ka, ke = a + c, c + e
        s, miss = ka + ke + max(s2 * p.observation_noise, 1e-8), v - f - d
        f, d = f + ka / s * miss, d + ke / s * miss
        a, c, e = a - ka / s * ka, c - ka / s * ke, e - ke / s * ke
        out[:, i] = f, max(a, 0), max(e, 0), miss, s
    return tuple(out)


def slow_states(y: np.ndarray, variance: np.ndarray, anchor: np.ndarray, score: np.ndarray, p: Profile) -> tuple[np.ndarray, ...]:
    """The same of one slow level that an anchor pulls; a price moves it by 4 % of its surprise at most."""
    out = np.zeros((5, len(y)))
    known = anchor[np.isfinite(anchor)]
    m, v = known[0] if len(known) else y[0], 0.05
    for i, s2 in enumerate(variance.tolist()):
        to = anchor[i] if np.isfinite(anchor[i]) else m
        pull = 0.012 + 0.012 * min(abs(score[i]) if np.isfinite(score[i]) else 0.0, 4.0) + 0.020 * min(abs(to - m), 0.5)
        pull = min(max(pull, 0.008), 0.075)
        m, v = (1 - pull) * m + pull * to, v + max(s2 * p.level_noise, 1e-10)
        s = v + max(s2 * p.observation_noise, 1e-5)
        gain, miss = min(max(v / s, 0.0), 0.040), y[i] - m
        m, v = m + gain * miss, max((1 - gain) * v, 1e-8)
        out[:, i] = m, v, 0.0, miss, s
    return tuple(out)


def before(x: pd.Series, window: int | None, least: int, f: str) -> pd.Series:
    """A rolling (or expanding) statistic that was known the row before."""
    r = x.rolling(window, min_periods=least) if window else x.expanding(min_periods=least)
    return (r.quantile(0.95) if f == "p95" else getattr(r, f)()).shift(1)


def causal_z(x: pd.Series, window: int, least: int) -> np.ndarray:
    sd = before(x, window, least, "std")
    return ((x - before(x, window, least, "mean")) / sd.where(sd != 0)).fillna(0.0).to_numpy()


def states_of(frame: pd.DataFrame) -> pd.DataFrame:
    """All profiles' states of one symbol's rows in time order."""
    y = pd.Series(np.log(frame["close"].to_numpy(float)))
    r = y.diff()
    size = r.abs()
    cut, usual = before(size, 365, 90, "p95"), before(r.rolling(30, min_periods=20).std(), None, 180, "median")
    tail = (size / cut.where(cut != 0)).fillna(0.0).to_numpy()
    volatile = (r.rolling(30, min_periods=20).std() / usual.where(usual != 0)).fillna(0.0).to_numpy() > 1
    tail_z = causal_z(size, 365, 90)
    parts = []
    for p in PROFILES:
        window, least = (365, 120) if p.slow else (180, 60)
        variance = before(r, window, least, "var").combine_first(before(r, None, least, "var")).fillna(1e-4).clip(lower=1e-8)
        if p.slow:
            level, v1, v2, miss, s = slow_states(y.to_numpy(), variance.to_numpy(), frame["anchor"].to_numpy(float), frame["reversion"].to_numpy(float), p)
        else:
            level, v1, v2, miss, s = local_states(y.to_numpy(), variance.to_numpy(), p)
            pulled = frame["liquidity"].to_numpy(float)
            if p.anchor_weight:
                level = np.where(np.isfinite(pulled), (1 - p.anchor_weight) * level + p.anchor_weight * np.nan_to_num(pulled), level)
        gap, z = y - level, miss / np.sqrt(np.maximum(s, 1e-8))
        sigma = before(gap, window, least, "std").combine_first(before(r, 180, 60, "std")).fillna(np.sqrt(variance)).clip(lower=1e-6)
        flare = np.maximum(tail - 1, 0) + 0.25 * np.maximum(tail_z - 2, 0) + (0 if p.slow else 0.35) * np.maximum(np.abs(z) - 2, 0)
        odd = volatile | (tail >= 1) | (tail_z >= 2.5 if p.slow else np.abs(z) >= 2)
        drift = ewm(np.diff(level, prepend=np.nan), 2 / (p.drift_span + 1), max(min(p.drift_span // 4, 30 if p.slow else 20), 2))
        gap_z = causal_z(gap, 730, 180) if p.slow else causal_z(gap, 365, 90)
        values = [y, level, gap, drift, sigma, gap_z, z, np.sqrt(np.maximum(v1 + v2, 0)), np.clip(flare, 0, 5), np.clip(ewm(odd.astype(float), 2 / 11), 0, 1)]
        parts.append(pd.DataFrame(dict(zip(STATE, map(np.asarray, values), strict=True))).assign(symbol=frame["symbol"].to_numpy(), day=frame["day"].to_numpy(), state=p.state, history=np.arange(1, len(y) + 1)))
    return pd.concat(parts)


def level_states(df: DataFrame) -> DataFrame:
    """symbol, day, state, history and STATE for each profile, from df(symbol, day, close, liquidity, anchor, reversion).

    liquidity and anchor are logarithms of price anchors (null: none); rows without a positive close are left out.
    """

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        made = states_of(frame.sort_values("day").reset_index(drop=True))
        return made[["symbol", "day", "state", "history", *STATE]]

    schema = "symbol string, day date, state string, history long, " + ", ".join(f"{c} double" for c in STATE)
    rows = df.where(F.col("close") > 0).select("symbol", "day", "close", *[F.col(c).cast("double").alias(c) for c in ("liquidity", "anchor", "reversion")])
    return rows.groupBy("symbol").applyInPandas(f, schema).replace(float("nan"), None, subset=STATE)


def literals(row: object) -> list:
    return [F.lit(v).alias(f.name) for f, v in zip(fields(row), astuple(row), strict=True)]


def _clip(x: str, low: str | float, high: str | float) -> str:
    return f"least(greatest({x}, {low}), {high})"


_Z50, _Z90 = 0.6744897501960817, 1.6448536269514722
#: Each step's columns, as expressions of the ones before it.
STEPS: tuple[dict[str, str], ...] = (
    {
        "half": "greatest((q75 - q25) / 2, 1e-6)", "low_part": "greatest(q25 - q05, 1e-6)", "up_part": "greatest(q95 - q75, 1e-6)",
        "known": "e05 IS NOT NULL AND e25 IS NOT NULL AND e75 IS NOT NULL AND e95 IS NOT NULL",
        "scope": _clip("coalesce(scope_days, horizon)", *SCOPE), "push": _clip("coalesce(pressure, 0.0)", -0.45, 0.45),
        "spread": "greatest(coalesce(residual_sigma, 1e-6), 1e-6)", "flare": _clip("coalesce(tail_flare, 0.0) / 2", 0, 1.5), "hot": _clip("coalesce(high_vol, 0.0)", 0, 1), "iz": "coalesce(innovation_z, 0.0)", "gz": "coalesce(gap_z, 0.0)",
    },
    {
        "wide": "greatest(q95 - q05, 2 * half, 1e-6)", "e_half": "CASE WHEN known THEN greatest((e75 - e25) / 2, 1e-6) END", "e_low": "CASE WHEN known THEN greatest(e25 - e05, 1e-6) END", "e_up": "CASE WHEN known THEN greatest(e95 - e75, 1e-6) END",
        "projected": "drift_weight * coalesce(drift, 0.0) * scope - reversion_weight * (1 - pow(phi, scope)) * coalesce(gap, 0.0) + push",
        "projected_sigma": f"spread * sqrt(scope) * {_clip('1 + sigma_boost * hot + 0.5 * sigma_boost * flare', 0.5, 3.5)}",
        "reliability": _clip("exp(-0.2 * abs(iz)) / (1 + 0.08 * greatest(coalesce(uncertainty, 0.0) / spread, 0))", 0.2, 1),
        "pull": _clip(f"{_clip(f'center * {_clip('sqrt(scope / 7)', 0.35, 1.35)}', 0, 0.9)} * (1 - dampen * hot)", 0, 0.9),
        "share": f"CASE WHEN known THEN {_clip('empirical * (0.6 + 0.4 * hot)', 0, 0.95)} ELSE 0.0 END",
        "boost": f"1 + tail_boost * {_clip('0.5 * hot + flare', 0, 2)}",
    },
    {"most": "greatest(wide, projected_sigma, 1e-6)", "off": "projected - q50", "s_half": f"{_Z50} * projected_sigma * sigma", "s_tail": f"{_Z90 - _Z50!r} * projected_sigma * sigma"},
    {
        "middle": f"q50 + pull * reliability * {_clip('off', '-clip_widths * most', 'clip_widths * most')}",
        "widen": _clip("1 + disagreement * reliability * least(abs(off) / most, 3) + uncertainty_weight * least(projected_sigma / greatest(wide, 1e-6), 3)", 0.75, 2.5),
        "b_half": "(1 - share) * half + share * coalesce(e_half, half)", "b_low": "(1 - share) * low_part + share * coalesce(e_low, low_part)", "b_up": "(1 - share) * up_part + share * coalesce(e_up, up_part)",
        "c_half": "greatest(s_half, coalesce(e_half, 0.0), 1e-6)", "c_low": "greatest(s_tail, coalesce(e_low, 0.0), 1e-6)", "c_up": "greatest(s_tail, coalesce(e_up, 0.0), 1e-6)",
        "m_low": _clip("(1 + tail * least(greatest(gz, 0) + 0.35 * greatest(-iz, 0), 3) / 3) * boost", 0.75, 4), "m_up": _clip("(1 + tail * least(greatest(-gz, 0) + 0.35 * greatest(iz, 0), 3) / 3) * boost", 0.75, 4),
    },
    {
        "n_half": "CASE mode WHEN 'replace' THEN c_half WHEN 'cap' THEN least(b_half * widen, c_half) ELSE b_half * widen END",
        **{f"n_{x}": f"m_{x} * CASE mode WHEN 'replace' THEN c_{x} WHEN 'cap' THEN least(b_{x} * (1 + 0.5 * (widen - 1)), c_{x}) ELSE b_{x} * (1 + 0.5 * (widen - 1)) END" for x in ("low", "up")},
        "safe": f"greatest({2 * _Z90!r} * projected_sigma * sigma, coalesce(greatest(e95 - e05, 1e-6), 0.0)) * safety * (1 + safety_boost * hot)",
    },
    {"shrink": "CASE WHEN safety > 0 AND safe > 0 AND greatest(2 * n_half + n_low + n_up, 1e-9) > safe THEN safe / greatest(2 * n_half + n_low + n_up, 1e-9) ELSE 1.0 END"},
    {"n05": "middle - (n_half + n_low) * shrink", "n25": "middle - n_half * shrink", "n75": "middle + n_half * shrink", "n95": "middle + (n_half + n_up) * shrink", "usable": f"q05 IS NOT NULL AND q25 IS NOT NULL AND q50 IS NOT NULL AND q75 IS NOT NULL AND q95 IS NOT NULL AND history >= {LEAST_HISTORY} AND drift IS NOT NULL AND gap IS NOT NULL"},
)


def blended(rows: DataFrame, states: DataFrame, reference: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """forecaster, state, blend, symbol, day, horizon, five sorted quantiles, projected return and sigma: a row for each profile and blend.

    rows: symbol, day, horizon and the forecast; reference: symbol, day, horizon and empirical quantiles (or null).
    states may hold scope_days and pressure; without them the horizon is the scope and nothing pushes. A row whose
    state is younger than LEAST_HISTORY days, or that lacks one, keeps its forecast.
    """
    empirical = reference.select("symbol", "day", "horizon", *[F.col(n).alias(f"e{n[1:]}") for n in NAMES if n != "q50"])
    weights = F.array(*[F.struct(*[c for c, f in zip(literals(p), fields(p), strict=True) if f.name in ("state", "phi", "drift_weight", "reversion_weight")]) for p in PROFILES])
    optional = [F.lit(None).cast("double").alias(c) for c in ("scope_days", "pressure") if c not in states.columns]
    held = states.select("*", *optional).drop("log_close", "level")
    df = rows.join(empirical, ["symbol", "day", "horizon"], "left").select("*", F.inline(weights)).join(held, ["symbol", "day", "state"], "left")
    df = df.select("*", F.inline(F.array(*[F.struct(*[F.lit(v).alias("uncertainty_weight" if f.name == "uncertainty" else f.name) for f, v in zip(fields(b), astuple(b), strict=True)]) for b in BLENDS])))
    df = reduce(lambda d, step: d.withColumns({n: F.expr(x).cast("boolean" if n in ("known", "usable") else "double") for n, x in step.items()}), STEPS, df)
    made = F.sort_array(F.array("n05", "n25", "middle", "n75", "n95"))
    df = df.withColumn("made", made)
    quantiles = [F.when(F.col("usable"), F.col("made")[i]).otherwise(F.col(n)).alias(n) for i, n in enumerate(NAMES)]
    name = F.concat_ws("_", F.lit(PREFIX), "state", "blend").alias("forecaster")
    return df.select(name, "state", "blend", "symbol", "day", "horizon", *[c for c in extra or []], *quantiles, *[F.when(F.col("usable"), F.col(c)).alias(c) for c in ("projected", "projected_sigma", "reliability")])


def picked(candidates: DataFrame) -> DataFrame:
    """The first forecaster of PREFERRED that a row has, as forecaster `blend_selected`."""
    place = F.array_position(F.array(*[F.lit(x) for x in PREFERRED]), F.col("forecaster"))
    first = candidates.where(place > 0).groupBy("symbol", "day", "horizon").agg(F.min_by(F.struct(*[c for c in candidates.columns if c not in ("symbol", "day", "horizon")]), place).alias("p"))
    return first.select("symbol", "day", "horizon", F.lit(f"{PREFIX}_selected").alias("forecaster"), F.col("p.forecaster").alias("variant"), *[F.col(f"p.{n}").alias(n) for n in NAMES])
