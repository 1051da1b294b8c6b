"""The query of the buckets' interactions: the five groups of semantic targets, joined by symbol and day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import interactions as ia
from tidewright.plans import positions, semantics, states  # noqa: F401
from tidewright.plans.registry import _QUERIES, _SQL, W, _ema, _recursion, query, rounded

_GROUPS = {"structure": "structure_targets", "environment": "environment_targets", "edges": "edges_targets", "movement": "movement_targets", "liquidation": "leverage_targets"}
_NAMED = {"liquidation": {"confidence": "liquidation_confidence"}}


def _inputs() -> str:
    parts = []
    for g, name in _GROUPS.items():
        own = {v: k for k, v in _NAMED.get(g, {}).items()}
        # rounded as it stands: in capitals it isn't taken for a rounding of this query
        inner = _SQL[name].replace("round(", "ROUND(")
        shown = ", ".join(f"{own.get(c, c)} AS {c}" for c in ia.INPUTS[g])
        parts.append(f"in_{g} AS MATERIALIZED (SELECT symbol, CAST(day AS DATE) AS day, {shown} FROM ({inner}))")
    columns = ", ".join(c for g in ia.INPUTS.values() for c in g)
    joined = " ".join(f"JOIN in_{g} USING (symbol, day)" for g in list(_GROUPS)[1:])
    return f"{', '.join(parts)}, base AS (SELECT symbol, day, row_number() {W} AS n, {columns} FROM in_structure {joined})"


def _steps(source: str, steps: tuple, name: str) -> str:
    out = []
    for k, s in enumerate(steps):
        out.append(f"{name}{k} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in s.items())} FROM {source})")
        source = f"{name}{k}"
    return ", ".join(out)


_SOURCE = f"u{len(ia.BEFORE) - 1}"
_RUN = [_ema("edges_chop_relevance", "ee", 14), _ema("movement_chop_relevance", "me", 14), _ema("moved", "turn", 7)]
_FIRST = ["o.edges_chop_relevance AS ee", "o.movement_chop_relevance AS me", "CAST(NULL AS DOUBLE) AS turn"]


@query(f"""WITH RECURSIVE {_inputs()}, {_steps('base', ia.BEFORE, 'u')}, mv AS MATERIALIZED (SELECT *, abs(stationary_trending_balance - lag(stationary_trending_balance) {W}) AS moved FROM {_SOURCE}), {_recursion('rr', 'mv', _RUN, _FIRST)},
x0 AS (SELECT mv.*, coalesce(b.ee, 0) AS edges_recurrent_exposure, coalesce(b.me, 0) AS movement_recurrent_exposure, coalesce(a.turn, 0) AS stationary_trending_transition_risk FROM mv JOIN rr a ON a.symbol = mv.symbol AND a.n = mv.n LEFT JOIN rr b ON b.symbol = mv.symbol AND b.n = mv.n - 1),
{_steps('x0', ia.AFTER, 'y')} SELECT symbol, day, {', '.join(f'round(coalesce({c}, 0), 6) AS {c}' for c in ia.OUT)} FROM y{len(ia.AFTER) - 1}""")
def bucket_interactions(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for g, name in _GROUPS.items():
        own = {v: k for k, v in _NAMED.get(g, {}).items()}
        made = _QUERIES[name](spark, d)
        parts.append(made.select("symbol", F.to_date("day").alias("day"), *[F.col(own.get(c, c)).alias(c) for c in ia.INPUTS[g]]))
    return rounded(ia.interactions(reduce(lambda a, b: a.join(b, ["symbol", "day"]), parts)), 6)
