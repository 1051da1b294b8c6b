"""Recursions that can be stopped and taken up again: their states are saved by symbol.

A build gives each row its values and, for the row that a refresh goes back
to, the states after the row before it. A refresh reads the saved states and
the rows from there on, and its values equal those of a full build.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import cos, exp, pi

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")
#: A state, and what a value makes of it: the next state and the row's output.
State = list[float]


@dataclass(frozen=True)
class Resumable:
    name: str
    source: str
    start: State
    step: Callable[[State, float], tuple[State, float]]


def ema(name: str, source: str, span: int) -> Resumable:
    """Exponential mean that starts at the first value; a gap lets the old weight decay."""
    alpha = 2 / (span + 1)

    def step(s: State, v: float) -> tuple[State, float]:
        y, w = s
        if v != v:
            return [y, w * (1 - alpha)], y
        y = v if y != y else (w * (1 - alpha) * y + alpha * v) / (w * (1 - alpha) + alpha)
        return [y, 1.0], y

    return Resumable(name, source, [NAN, 1.0], step)


def wilder(name: str, source: str, n: int) -> Resumable:
    """Wilder's mean: its seed is the mean of what is there in the first n rows."""

    def step(s: State, v: float) -> tuple[State, float]:
        rows, count, total, y = s
        rows += 1
        if rows < n:
            return [rows, count + (v == v), total + (v if v == v else 0.0), NAN], NAN
        if rows == n:
            count, total = count + (v == v), total + (v if v == v else 0.0)
            y = total / count if count else NAN
        else:
            y += (v - y) / n
        return [rows, count, total, y], y

    return Resumable(name, source, [0.0, 0.0, 0.0, NAN], step)


def high_pass(name: str, source: str, period: float) -> Resumable:
    """Two-pole high-pass filter; the first two rows are 0."""
    a = exp(-1.414 * pi / period)
    c2, c3 = 2 * a * cos(1.414 * pi / period), -a * a
    c1 = (1 + c2 - c3) / 4

    def step(s: State, v: float) -> tuple[State, float]:
        x1, x2, y1, y2 = s
        y = 0.0 if x2 != x2 else c1 * (v - 2 * x1 + x2) + c2 * y1 + c3 * y2
        return [v, x1, y, y1], y

    return Resumable(name, source, [NAN, NAN, 0.0, 0.0], step)


def run(frame: pd.DataFrame, made: Sequence[Resumable], states: list[State], mark: int) -> tuple[pd.DataFrame, list[State]]:
    """Outputs of the rows in order, and the states before row `mark`."""
    saved: list[State] = []
    for r, state in zip(made, states, strict=True):
        out, kept = [], state
        for i, v in enumerate(frame[r.source].to_numpy(float, na_value=NAN).tolist()):
            if i == mark:
                kept = state
            state, y = r.step(state, v)
            out.append(y)
        saved.append(state if mark >= len(frame) else kept)
        frame = frame.assign(**{r.name: out})
    return frame, saved


def _schema(df: DataFrame, made: Sequence[Resumable]) -> str:
    return ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema) + "".join(f", `{r.name}` double" for r in made) + ", _from boolean, _states array<array<double>>"


def _emitted(frame: pd.DataFrame, saved: list[State], mark: int) -> pd.DataFrame:
    at = min(mark, len(frame) - 1)
    marked = [i == at for i in range(len(frame))]
    return frame.assign(_from=marked, _states=[saved if m else None for m in marked])


def build(df: DataFrame, made: Sequence[Resumable], overlap: int = 8, keys: tuple[str, ...] = ("symbol",), time: str = "day") -> tuple[DataFrame, DataFrame]:
    """Rows with all values, and (keys, start, states): the row that a refresh starts from, `overlap` rows before the last, and the states before it."""

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(time).reset_index(drop=True)
        mark = max(len(frame) - 1 - overlap, 0)
        out, saved = run(frame, made, [r.start for r in made], mark)
        return _emitted(out, saved, mark)

    return _parts(df.groupBy(*keys).applyInPandas(f, _schema(df, made)), made, keys, time)


def refresh(df: DataFrame, states: DataFrame, made: Sequence[Resumable], overlap: int = 8, keys: tuple[str, ...] = ("symbol",), time: str = "day") -> tuple[DataFrame, DataFrame]:
    """The same for the rows from each key's start on; a key without saved states is built whole.

    Only rows from the start on are shuffled: earlier ones are left out before the groups are made.
    """
    late = df.join(states.select(*keys, F.col("start").alias("_start")), list(keys), "left").where(F.col("_start").isNull() | (F.col(time) >= F.col("_start"))).drop("_start")

    def f(frame: pd.DataFrame, saved: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=[*frame.columns, *(r.name for r in made), "_from", "_states"])
        frame = frame.sort_values(time).reset_index(drop=True)
        held = [[NAN if v is None else float(v) for v in s] for s in saved["states"].iat[0]] if len(saved) else [r.start for r in made]
        mark = max(len(frame) - 1 - overlap, 0)
        out, kept = run(frame, made, held, mark)
        return _emitted(out, kept, mark)

    both = late.groupBy(*keys).cogroup(states.select(*keys, "states").groupBy(*keys)).applyInPandas(f, _schema(df, made))
    return _parts(both, made, keys, time)


def _parts(df: DataFrame, made: Sequence[Resumable], keys: tuple[str, ...], time: str) -> tuple[DataFrame, DataFrame]:
    rows = df.drop("_from", "_states").replace(NAN, None, subset=[r.name for r in made])
    return rows, df.where("_from").select(*keys, F.col(time).alias("start"), F.col("_states").alias("states"))


def rewritten(stored: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("symbol",), time: str = "day") -> DataFrame:
    """Stored rows before each key's first fresh row, and the fresh rows."""
    start = fresh.groupBy(*keys).agg(F.min(time).alias("_start"))
    kept = stored.join(start, list(keys), "left").where(F.col("_start").isNull() | (F.col(time) < F.col("_start"))).drop("_start")
    return kept.unionByName(fresh)


def context(df: DataFrame, latest: DataFrame, rows: int = 1500, overlap: int = 8, keys: tuple[str, ...] = ("symbol",), time: str = "day") -> DataFrame:
    """Rows that a refresh without saved states reads: `rows` before the write start and all from it on, with `write` marking the latter.

    latest: keys and the last stored day, from which the write start lies `overlap` rows back.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(time))
    numbered = df.join(latest.withColumnRenamed(time, "_last"), list(keys)).withColumn("_row", place)
    at = F.max(F.when(F.col(time) <= F.col("_last"), F.col("_row"))).over(Window.partitionBy(*keys))
    start = F.greatest(F.coalesce(at, F.lit(0)) - overlap, F.lit(1))
    marked = numbered.withColumns({"_start": start}).where(F.col("_row") >= F.col("_start") - rows)
    return marked.withColumn("write", F.col("_row") >= F.col("_start")).drop("_row", "_start", "_last")
