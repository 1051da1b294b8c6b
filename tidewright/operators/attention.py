"""Attention to an average when a boost signal is strong against its own past."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.frames import Ordered
from tidewright.operators.recursion import ewm, fold_rows, percentile_of_last, running_quantiles

O = Ordered()  # noqa: E741
OUT = ["average_position", "attention_gate", "attention_score", "boost_extreme", "average_available", "boost_event"]


def extreme(x: np.ndarray, window: int, least: int) -> np.ndarray:
    """How far into the outer quarters of the rows before a value lies: -1 to 1, 0 between the quartiles."""
    share = (percentile_of_last(x, window, least) + 1) / 2
    return np.where(np.isnan(share), np.nan, np.clip(np.where(share >= 0.75, (share - 0.75) * 4, np.where(share <= 0.25, (share - 0.25) * 4, 0.0)), -1, 1))


def quartile_z(x: np.ndarray, window: int, least: int) -> np.ndarray:
    """(x - median) / (third - first quartile) of the rows before."""
    q = np.vstack([np.full((1, 3), np.nan), running_quantiles(x, (0.25, 0.5, 0.75), window, least)[:-1]])[: len(x)]
    wide = q[:, 2] - q[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(wide != 0, (x - q[:, 1]) / wide, np.nan)


def blend(parts: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Weighted mean of what is there."""
    top = sum(np.where(np.isnan(v), 0.0, v * w) for v, w in parts)
    below = sum(np.where(np.isnan(v), 0.0, w) for v, w in parts)
    return np.where(below > 0, top / np.where(below > 0, below, 1), np.nan)


def attention(df: DataFrame, average: str, boost: str, average_window: tuple[int, int], boost_window: tuple[int, int], span: int) -> DataFrame:
    """symbol, day and OUT; windows are (rows, least known rows). Gaps in both inputs are filled forward."""
    filled = df.select("symbol", "day", O.last_known(F.col(average)).cast("double").alias("_a"), O.last_known(F.col(boost)).cast("double").alias("_b"))

    def f(frame: pd.DataFrame) -> dict[str, np.ndarray]:
        a, b = (frame[c].to_numpy(float, na_value=np.nan) for c in ("_a", "_b"))
        there = ~np.isnan(a)
        position = np.clip(blend([(extreme(a, *average_window), 0.7), (np.tanh(np.clip(quartile_z(a, *average_window), -4, 4) / 2), 0.3)]), -1, 1)
        position = np.where(np.isnan(position), np.clip(np.tanh(a), -1, 1), position)
        size = np.where(there & ~np.isnan(b), np.abs(b), np.nan)
        event = np.nan_to_num(size) > 1e-9
        far = np.where(event, np.maximum(extreme(size, *boost_window), 0), 0.0)
        odd = np.clip(quartile_z(size, *boost_window), 0, 4)
        raw = np.where(event, np.clip(blend([(far, 0.65), (np.maximum(np.tanh(odd / 2), 0), 0.35)]), 0, 1), 0.0)
        raw = np.nan_to_num(np.where(np.isnan(raw) & event, np.clip(np.tanh(size / 0.05), 0, 1), raw))
        gate = np.clip(ewm(raw, 2 / (max(span, 2) + 1), min(max(span // 4, 3), max(span, 2))), 0, 1)
        score = np.clip(ewm(position * gate, 2 / (max(span // 3, 5) + 1), 3), -1.5, 1.5)
        return dict(zip(OUT, (position, gate, score, far, there.astype(float), event.astype(float)), strict=True))

    return fold_rows(filled, f, OUT).drop("_a", "_b")
