"""How the buckets' states bear on each other: alignments, conflicts and the dynamics of the fast buckets.

Columns come in steps, each a set of expressions of the ones before; two
recursions (what a bucket was exposed to before, and how fast the balance
turns) run between the steps.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.recursion import Recursion, ema, fold

#: Inputs by bucket: the columns of the semantic targets that interactions read.
INPUTS = {
    "structure": ("overvaluation", "conviction", "fragility", "reversion", "confidence"),
    "environment": ("liquidity_tailwind", "liquidity_headwind", "macro_risk_on", "macro_risk_off", "environment_confidence"),
    "edges": ("upside_stretch", "downside_stretch", "mean_reversion_pressure", "edge_asymmetry", "edge_confidence"),
    "movement": ("trend_pressure_up", "trend_pressure_down", "trend_persistence", "chop_risk", "trend_strategy_influence", "momentum_strategy_influence", "mean_reversion_strategy_influence", "movement_confidence"),
    "liquidation": ("cascade_pressure", "directional_pressure", "leverage_fuel", "instability", "cascade_asymmetry", "liquidation_confidence"),
}


def _clip(x: str, low: float = 0, high: float = 1) -> str:
    return f"least(greatest({x}, {low}), {high})"


def _sd(*x: str) -> str:
    m = f"(({' + '.join(x)}) / {len(x)})"
    return f"sqrt(({' + '.join(f'pow({v} - {m}, 2)' for v in x)}) / {len(x) - 1})"


_D = ("d_structure", "d_environment", "d_edges", "d_movement", "d_liquidation")
_C = ("confidence", "environment_confidence", "edge_confidence", "movement_confidence", "liquidation_confidence")
_AGREE, _TRUST = f"(({' + '.join(_D)}) / 5)", f"(({' + '.join(_C)}) / 5)"
FIRST = {"d_structure": "reversion", "d_environment": "liquidity_tailwind - liquidity_headwind + macro_risk_on - macro_risk_off", "d_edges": "upside_stretch - downside_stretch", "d_movement": "trend_pressure_up - trend_pressure_down", "d_liquidation": "directional_pressure + 0.5 * cascade_asymmetry"}
SECOND = {
    "slow_direction": "(d_structure + d_environment) / 2", "fast_direction": "(d_edges + d_movement) / 2", "slow_confidence": "(confidence + environment_confidence) / 2", "fast_confidence": "(edge_confidence + movement_confidence) / 2",
    "e_dir": _clip("d_edges", -1), "m_dir": _clip("d_movement", -1), "calm": _clip("1 - chop_risk"),
    "strength": f"(trend_strategy_influence + trend_persistence + {_clip('abs(d_movement)')}) / 3",
    "width_pressure": f"cascade_pressure * (0.5 + 0.5 * {_clip('liquidation_confidence')}) * (0.5 + 0.25 * {_clip('leverage_fuel')} + 0.25 * {_clip('instability')})",
}
THIRD = {
    "fast_trending_state": _clip("strength * (0.5 + 0.5 * calm)"),
    "fast_trend_exhaustion_pressure": _clip("calm * trend_persistence * greatest(trend_strategy_influence, abs(m_dir))"),
    "setup": _clip("0.5 * mean_reversion_strategy_influence + 0.3 * mean_reversion_pressure + 0.2 * chop_risk"),
}
FOURTH = {"fast_stationary_state": _clip(f"setup * (0.5 + 0.5 * {_clip('chop_risk + fast_trend_exhaustion_pressure')}) * (0.75 + 0.25 * abs(e_dir))")}
FIFTH = {
    "edges_chop_relevance": _clip(f"{_clip('0.55 * fast_trend_exhaustion_pressure + 0.85 * fast_stationary_state')} * (0.5 + 0.5 * edge_confidence)"),
    "movement_chop_relevance": _clip("(0.7 * fast_trending_state + 0.3 * momentum_strategy_influence) * (0.5 + 0.5 * movement_confidence)"),
    "stationary_trending_balance": _clip(f"{_clip('fast_stationary_state + fast_trend_exhaustion_pressure')} - fast_trending_state", -1),
}
#: After the exposures.
SIXTH = {
    "movement_to_edges_rotation_pressure": _clip("movement_recurrent_exposure * (0.7 + 0.3 * fast_trend_exhaustion_pressure)"),
    "edges_to_movement_rotation_pressure": _clip("edges_recurrent_exposure * (0.7 + 0.3 * fast_trending_state)"),
}
SEVENTH = {"e_raw": "greatest(edges_chop_relevance + 0.45 * movement_to_edges_rotation_pressure, 0)", "m_raw": "greatest(movement_chop_relevance + 0.45 * edges_to_movement_rotation_pressure, 0)"}
EIGHTH = {"edges_dynamic_relevance": "coalesce(e_raw / nullif(e_raw + m_raw, 0), 0.5)", "movement_dynamic_relevance": "coalesce(m_raw / nullif(e_raw + m_raw, 0), 0.5)"}
LAST = {
    "movement_trend_vs_edges_stretch": "d_movement * d_edges", "movement_persistence_vs_edges_asymmetry": "trend_persistence * edge_asymmetry", "structure_overvaluation_vs_environment_tailwind": "overvaluation * liquidity_tailwind",
    "conviction_environment_alignment": "conviction * d_environment", "structure_fragility_vs_movement_continuation": "fragility * trend_persistence", "macro_risk_on_vs_fragility": "macro_risk_on * fragility", "edges_downside_vs_movement_trend": "downside_stretch * d_movement",
    "slow_fast_alignment": "slow_direction * fast_direction", "slow_fast_conflict": "abs(slow_direction - fast_direction)", "slow_specialist_agreement": _sd("d_structure", "d_environment"), "fast_specialist_disagreement": _sd("d_edges", "d_movement"),
    "confidence_weighted_agreement": f"{_AGREE} * {_TRUST}", "confidence_weighted_disagreement": f"{_sd(*_D)} * (1 - {_TRUST})", "slow_fast_direction_gap": "slow_direction - fast_direction",
    "edge_movement_relevance_spread": "edges_dynamic_relevance - movement_dynamic_relevance", "fast_regime_weighted_direction": "e_dir * edge_confidence * edges_dynamic_relevance + m_dir * movement_confidence * movement_dynamic_relevance",
    "fast_regime_relevance_disagreement": f"abs(e_dir - m_dir) * {_clip('fast_confidence')}", "fast_regime_rotation_intensity": _clip("movement_to_edges_rotation_pressure + edges_to_movement_rotation_pressure"),
    "liquidation_quartile_width_pressure": _clip("width_pressure", 0, 1.5), "liquidation_edges_jump_alignment": "d_liquidation * d_edges", "liquidation_movement_jump_alignment": "d_liquidation * d_movement", "liquidation_ta_directional_alignment": "d_liquidation * fast_direction",
    "liquidation_ta_confidence_weighted_alignment": "d_liquidation * fast_direction * liquidation_confidence * fast_confidence", "liquidation_ta_conflict": "abs(d_liquidation - fast_direction)", "liquidation_short_quartile_bias": f"d_liquidation * {_clip('width_pressure', 0, 1.5)}",
}
BEFORE, AFTER = (FIRST, SECOND, THIRD, FOURTH, FIFTH), (SIXTH, SEVENTH, EIGHTH, LAST)
OUT = [
    "slow_direction", "fast_direction", "slow_confidence", "fast_confidence", *THIRD, *FOURTH, *FIFTH, "edges_recurrent_exposure", "movement_recurrent_exposure", *SIXTH, *EIGHTH, *LAST, "stationary_trending_transition_risk", "d_liquidation",
]
OUT.remove("setup")


def exposed(x: np.ndarray, span: int = 14) -> np.ndarray:
    """Exponential mean of what came before the row; 0 on the first row."""
    return np.clip(np.concatenate([[0.0], ema(np.clip(x, 0, 1), span)[:-1]]), 0, 1)[: len(x)]


def turning(x: np.ndarray, span: int = 7) -> np.ndarray:
    """Exponential mean of the daily steps' sizes."""
    return np.clip(np.nan_to_num(ema(np.abs(np.diff(x, prepend=np.nan)), span)), 0, 1)


def interactions(df: DataFrame) -> DataFrame:
    """symbol, day and OUT from df with the columns of INPUTS; a missing value counts as 0, as a missing trend influence or chop risk does as 0.5."""
    default = {"chop_risk": 0.5, "trend_strategy_influence": 0.5}
    names = [c for group in INPUTS.values() for c in group]
    df = df.select("symbol", "day", *[F.coalesce(F.col(c).cast("double"), F.lit(default.get(c, 0.0))).alias(c) for c in names])
    steps = lambda d, group: reduce(lambda d, s: d.withColumns({n: F.expr(x) for n, x in s.items()}), group, d)
    df = steps(df, BEFORE)
    df = fold(df, [Recursion("edges_recurrent_exposure", "edges_chop_relevance", exposed), Recursion("movement_recurrent_exposure", "movement_chop_relevance", exposed), Recursion("stationary_trending_transition_risk", "stationary_trending_balance", partial(turning))])
    return steps(df, AFTER).select("symbol", "day", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in OUT])
