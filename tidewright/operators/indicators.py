"""Technical indicators of daily bars (symbol, day, open, high, low, close, volume)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scalars import clip, ratio, safe_log
from tidewright.operators.frames import Ordered
from tidewright.operators.recursion import Recursion, ema, ewm, fold, high_pass, smoothed, wilder

O = Ordered()  # noqa: E741


def opened() -> Column:
    return F.col("open")


def high() -> Column:
    return F.col("high")


def low() -> Column:
    return F.col("low")


def close() -> Column:
    return F.col("close")


def volume() -> Column:
    return F.col("volume")


def _add(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def stochastic(x: str, n: int) -> Column:
    bottom, top = O.low(F.col(x), n), O.high(F.col(x), n)
    return ratio(100 * (F.col(x) - bottom), top - bottom)


def true_range() -> Column:
    before = O.lag(close())
    return F.greatest(high() - low(), F.abs(high() - before), F.abs(low() - before))


def weighted(x: Column, weights: list[float]) -> Column:
    """Weighted mean of the last rows, the newest first; null if one is missing."""
    return sum((O.lag(x, i) * w for i, w in enumerate(weights) if i), x * weights[0]) / sum(weights)


def linear_weights(n: int) -> list[float]:
    return [float(n - i) for i in range(n)]


def mean_reversion(bars: DataFrame) -> DataFrame:
    """vz_score, range_oscillator, commodity_channel."""
    df = _add(bars, mid=(high() + low()) / 2, typical=(high() + low() + close()) / 3)
    df = _add(df, move=F.abs(O.diff(F.col("mid"), 5)))
    df = _add(df, weighted_mid=ratio(O.total(F.col("move") * F.col("mid"), 5), O.total(F.col("move"), 5)), tp_mean=O.mean(F.col("typical"), 20))
    f = F.col("weighted_mid")
    sd = O.deviation(f, 20, sample=False)
    df = _add(df, z=ratio(f - O.mean(f, 20), F.when(sd > 1e-12, sd)), tp_off=F.abs(F.col("typical") - F.col("tp_mean")))
    top, bottom = O.high(high(), 100, 1), O.low(low(), 100, 1)
    return df.select("symbol", "day", O.mean(F.col("z"), 3).alias("vz_score"), ratio(close() - (bottom + (top - bottom) / 2), (top - bottom) / 2).alias("range_oscillator"), ratio(F.col("typical") - F.col("tp_mean"), 0.015 * O.mean(F.col("tp_off"), 20)).alias("commodity_channel"))


def trend_windows(bars: DataFrame) -> DataFrame:
    """leverage_drawdown, detrended, imi, adx, volatility_30, ls_volatility, true_range."""
    df = _add(bars, mid=(high() + low()) / 2, peak=O.high(high(), 55, 1), change=safe_log(ratio(close(), O.lag(close()))), tr=true_range(), up=O.diff(high()), down=-O.diff(low()), gain=F.when(close() > opened(), close() - opened()).otherwise(0.0), loss=F.when(close() <= opened(), opened() - close()).otherwise(0.0))
    df = _add(df, drawdown=ratio(close(), F.col("peak")) * 100 - 100, mid_mean=O.mean(F.col("mid"), 19), hvi=O.deviation(F.col("change"), 21, sample=False) * (252**0.5) * 100, plus=clip(F.col("up"), 0), minus=clip(F.col("down"), 0), close_mean=O.mean(close(), 21))
    # the true range of the first bar is its own range
    width = O.total(F.col("tr"), 14)
    df = _add(df, off=F.col("mid") - O.lag(F.col("mid_mean"), 10), dip=100 * ratio(O.total(F.col("plus"), 14), width), dim=100 * ratio(O.total(F.col("minus"), 14), width))
    df = _add(df, dx=100 * ratio(F.abs(F.col("dip") - F.col("dim")), F.col("dip") + F.col("dim")))
    gain, loss = O.total(F.col("gain"), 14), O.total(F.col("loss"), 14)
    return df.select(
        "symbol", "day",
        (F.col("drawdown") - O.mean(F.col("drawdown"), 1000)).alias("leverage_drawdown"),
        O.mean(F.col("off"), 19).alias("detrended"),
        ratio(100 * gain, gain + loss).alias("imi"),
        O.mean(F.col("dx"), 14).alias("adx"),
        (100 * O.deviation(F.col("change"), 30, sample=False)).alias("volatility_30"),
        ratio(ratio(F.abs(close() - F.col("close_mean")), F.col("close_mean")) * 100, O.mean(F.col("hvi"), 21)).__mul__(100).alias("ls_volatility"),
        F.col("tr").alias("true_range"),
    )


def strength(up: str, down: str, both_zero: float) -> Column:
    """Relative strength from smoothed gains and losses."""
    u, d = F.col(up), F.col(down)
    rs = 100 - 100 / (1 + ratio(u, d))
    if both_zero == 0:
        return F.when(u == 0, 0.0).when(d == 0, 100.0).otherwise(rs)
    return F.when(d == 0, 100.0).when(u == 0, 0.0).otherwise(rs)


def recursive(bars: DataFrame) -> DataFrame:
    """Indicators with recursions: rsi, vzo, pzo, schaff, trend_sniper, rmi, precision_trend, volume_rsi, momentum, ls_normalized and more."""
    df = _add(bars, hl3=(high() + low() + close()) / 3, change=O.diff(close()))
    tp = F.col("hl3")
    sign = F.when(close() > O.lag(close()), 1.0).when(close() < O.lag(close()), -1.0).otherwise(0.0)
    df = _add(df, gain=clip(F.col("change"), 0), loss=clip(-F.col("change"), 0), signed_volume=sign * volume(), signed_close=sign * close(), tp_change=O.diff(tp), tr=true_range(), wl=weighted(close(), [max(14 - i - 14 / 3, 0.0) for i in range(15)]), flow_up=F.when(tp > O.lag(tp), tp * volume()).otherwise(0.0), flow_down=F.when(tp < O.lag(tp), tp * volume()).otherwise(0.0), rdiff=close() - (O.high(high(), 10) + O.low(low(), 10)) / 2, span=O.high(high(), 10) - O.low(low(), 10))
    for n in (5, 10, 20):
        # the first bar moved by 0
        up, down = O.total(F.coalesce("gain", F.lit(0.0)), n), O.total(F.coalesce("loss", F.lit(0.0)), n)
        df = df.withColumn(f"cmo{n}", F.coalesce(100 * ratio(up - down, up + down), F.lit(0.0)))
    e = lambda n, strict=False: partial(ema, span=n, strict=strict)
    df = fold(df, [
        Recursion("rma_up", "gain", partial(wilder, n=14)), Recursion("rma_down", "loss", partial(wilder, n=14)),
        Recursion("e_sv", "signed_volume", e(21)), Recursion("e_v", "volume", e(21)), Recursion("e_sc", "signed_close", e(21)), Recursion("e_c21", "close", e(21)),
        Recursion("e_fast", "close", e(23)), Recursion("e_slow", "close", e(50)), Recursion("e5", "close", e(5)),
        Recursion("wl_smooth", "wl", e(3)), Recursion("hp250", "close", partial(high_pass, period=250)), Recursion("hp40", "close", partial(high_pass, period=40)),
        Recursion("rma_volume", "volume", partial(wilder, n=14)), Recursion("s4", "close", partial(smoothed, n=4)), Recursion("s12", "close", partial(smoothed, n=12)),
        Recursion("e55", "close", e(55, True)), Recursion("atr89", "tr", partial(ewm, alpha=1 / 89, least=89)),
        Recursion("rel", "rdiff", e(3, True)), Recursion("spread", "span", e(3, True)),
        *[r for n in (5, 10, 20) for r in (Recursion(f"d{n}", f"cmo{n}", e(3, True)), Recursion(f"dd{n}", f"d{n}", e(3, True)))],
    ])
    er = F.coalesce(clip(ratio(F.abs(volume() - O.lag(volume(), 14)), O.total(F.abs(O.diff(volume())), 14)), 0, 1), F.lit(0.0))
    factor = F.pow(er * (2 / 3 - 2 / 31) + 2 / 31, F.lit(2.0))
    df = _add(df, macd=F.col("e_fast") - F.col("e_slow"), smooth_volume=F.col("rma_volume") + factor * (volume() - F.col("rma_volume")), anchor=F.when(high() >= F.col("e55"), high()).otherwise(low()))
    df = _add(df, k=stochastic("macd", 10), vup=clip(F.col("tp_change"), 0) * F.col("smooth_volume"), vdown=clip(-F.col("tp_change"), 0) * F.col("smooth_volume"), ls=ratio(ratio(F.abs(F.col("anchor") - F.col("e55")), F.col("e55")) * 100, F.col("atr89")) * 100, smi_raw=F.when(F.col("spread") != 0, F.col("rel") / (F.col("spread") / 2) * 100).when(F.col("spread") == 0, 0.0))
    blend = (strength("rma_up", "rma_down", 100) + (100 - 100 / (1 + ratio(O.total(F.col("flow_up"), 14), O.total(F.col("flow_down"), 14))))) / 2
    df = _add(df, blend=blend, smi5=O.mean(F.col("smi_raw"), 5))
    df = _add(df, component=0.6 * (F.col("blend") - 50) / 50 + 0.25 * clip((F.col("blend") - 50) / 18, -2, 2) / 2 + 0.15 * clip(ratio(F.col("e5") - F.col("e_c21"), O.deviation(close(), 14)), -3, 3) / 3)
    df = fold(df, [Recursion("d", "k", e(3)), Recursion("vr_up", "vup", partial(wilder, n=14)), Recursion("vr_down", "vdown", partial(wilder, n=14)), Recursion("rmi", "component", e(3)), Recursion("smi", "smi5", e(10, True))])
    df = _add(df, kd=stochastic("d", 10), vrsi=strength("vr_up", "vr_down", 100))
    df = fold(df, [Recursion("stc", "kd", e(3)), Recursion("vrsi_ema", "vrsi", e(14))])
    sd = {n: O.deviation(close(), n, sample=False) for n in (5, 10, 20)}
    dema = {n: 2 * F.col(f"d{n}") - F.col(f"dd{n}") for n in (5, 10, 20)}
    bottom, top = O.low(F.col("ls"), 89), O.high(F.col("ls"), 89)
    return df.select(
        "symbol", "day",
        strength("rma_up", "rma_down", 0).alias("rsi"),
        (100 * ratio(F.col("e_sv"), F.col("e_v"))).alias("vzo"),
        (100 * ratio(F.col("e_sc"), F.col("e_c21"))).alias("pzo"),
        (clip(F.col("stc"), 0, 100) - 50).alias("schaff"),
        O.diff(F.col("wl_smooth")).alias("trend_sniper"),
        F.col("rmi"),
        (F.col("hp250") - F.col("hp40")).alias("precision_trend"),
        (F.col("vrsi_ema") + 2 / 15 * (F.col("vrsi") - F.col("vrsi_ema")) - 50).alias("volume_rsi"),
        (F.col("s4") - F.col("s12")).alias("ma_momentum"),
        ratio(sum(sd[n] * dema[n] for n in sd), sum(sd.values())).alias("cmo_momentum"),
        F.col("smi").alias("slow_stochastic"),
        ratio((F.col("ls") - bottom) * 100, top - bottom).alias("ls_normalized"),
    )


def squeeze_momentum(bars: DataFrame, n: int = 20) -> DataFrame:
    """Fitted end of a regression line of open less the centre of range and Hull mean."""
    half, root = n // 2, round(n**0.5)
    df = _add(bars, raw=2 * weighted(close(), linear_weights(half)) - weighted(close(), linear_weights(n)), pos=F.row_number().over(O.spec).cast("double"))
    df = _add(df, hull=weighted(F.col("raw"), linear_weights(root)))
    df = _add(df, y=opened() - ((O.high(high(), n) + O.low(low(), n)) / 2 + F.col("hull")) / 2)
    w = O.spec.rowsBetween(-(n - 1), 0)
    y, x = F.col("y"), F.col("pos")
    fit = F.regr_slope(y, x).over(w) * x + F.regr_intercept(y, x).over(w)
    return df.select("symbol", "day", F.when(F.count(y).over(w) >= n, fit).alias("squeeze_momentum"))


def categories(df: DataFrame, standard: list[str], ranged: list[str]) -> DataFrame:
    """z scores and min-max values over each symbol's whole history."""
    return df.select("symbol", "day", *[O.zscore(F.col(x)).alias(x) for x in standard], *[O.minmax(F.col(x)).alias(x) for x in ranged])
