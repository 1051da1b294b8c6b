"""Ordered frames. Every aggregate carries a least number of non-null values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ordered:
    """Rows of each key in time order; all row offsets are positions in it."""

    keys: tuple[str, ...] = ("symbol",)
    time: str = "day"

    @property
    def spec(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.time)

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.spec)

    def lead(self, x: Column, n: int = 1) -> Column:
        return F.lead(x, n).over(self.spec)

    def diff(self, x: Column, n: int = 1) -> Column:
        return x - self.lag(x, n)

    def roll(self, f: Callable[[Column], Column], x: Column, n: int | None, least: int | None = None, shift: int = 0) -> Column:
        """f over the last n rows (None: all so far), ended `shift` rows before this one."""
        low = Window.unboundedPreceding if n is None else -(n - 1) - shift
        w = self.spec.rowsBetween(low, -shift)
        enough = n if least is None and n is not None else (1 if least is None else least)
        return F.when(F.count(x).over(w) >= enough, f(x).over(w))

    def mean(self, x: Column, n: int | None, least: int | None = None, shift: int = 0) -> Column:
        return self.roll(F.avg, x, n, least, shift)

    def total(self, x: Column, n: int, least: int | None = None) -> Column:
        return self.roll(F.sum, x, n, least)

    def low(self, x: Column, n: int, least: int | None = None) -> Column:
        return self.roll(F.min, x, n, least)

    def high(self, x: Column, n: int, least: int | None = None) -> Column:
        return self.roll(F.max, x, n, least)

    def deviation(self, x: Column, n: int | None, least: int | None = None, shift: int = 0, sample: bool = True) -> Column:
        return self.roll(F.stddev_samp if sample else F.stddev_pop, x, n, least, shift)

    def quantile(self, x: Column, q: float, n: int | None, least: int | None = None, shift: int = 0) -> Column:
        """Exact, with linear interpolation."""
        return self.roll(lambda c: F.percentile(c, q), x, n, least, shift)

    def last_known(self, x: Column) -> Column:
        return F.last(x, ignorenulls=True).over(self.spec.rowsBetween(Window.unboundedPreceding, 0))

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def zscore(self, x: Column) -> Column:
        """Over the whole history of the key: looks ahead by design."""
        w = self.whole()
        return (x - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))

    def minmax(self, x: Column) -> Column:
        """To [-1, 1] over the whole history of the key, 0 if constant: looks ahead by design."""
        low, high = F.min(x).over(self.whole()), F.max(x).over(self.whole())
        return F.when(high == low, F.lit(0.0)).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)) * 2 - 1)


def bucket_of_rank(rank: Column, n: Column, k: int) -> Column:
    """0-based quantile bucket of a 1-based rank, for three or five buckets, as right-closed quantile cuts give it."""
    if k == 3:
        return F.least(F.floor((rank - 1) * 3 / (n - 1)), F.lit(2)).cast("int")
    if k == 5:
        return F.greatest(F.ceil((rank - 1) * 5 / (n - 1)) - 1, F.lit(0)).cast("int")
    raise ValueError("three or five buckets")
