"""Hand-made fixtures: nulls, ties, gaps, short histories, causality."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import forecasts, recursion, relational, splits
from tidewright.operators.frames import Ordered
from tidewright.sources import tables

DAY = date(2020, 1, 1)


def bars(spark, closes, symbol="X"):
    rows = [(symbol, DAY + timedelta(days=i), c, c, c, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, day date, open double, high double, low double, close double, volume double")


def test_least_counts_only_values(spark):
    df = bars(spark, [1.0, None, 3.0, 4.0])
    got = [r[0] for r in df.select(Ordered().mean(F.col("close"), 3, 2).alias("m"), "day").orderBy("day").collect()]
    assert got == [None, None, 2.0, 3.5]


def test_ewm_gap_decays_the_old_weight():
    got = recursion.ewm(np.array([1.0, np.nan, 2.0]), 0.5)
    assert got[1] == 1.0 and got[2] == pytest.approx((0.25 * 1 + 0.5 * 2) / 0.75)


def test_wilder_seed_and_gap():
    got = recursion.wilder(np.array([np.nan, 1.0, 3.0, 4.0, np.nan, 5.0]), 3)
    assert np.isnan(got[:2]).all() and got[2] == 2.0 and got[3] == pytest.approx(2 + 2 / 3) and np.isnan(got[4:]).all()


def test_smoothed_skips_gaps():
    got = recursion.smoothed(np.array([1.0, 3.0, np.nan, 4.0]), 2)
    assert np.isnan(got[0]) and got[1] == 2.0 and np.isnan(got[2]) and got[3] == 3.0


def test_running_quantiles_match_sorting():
    x = np.random.default_rng(0).normal(size=200)
    x[[3, 50]] = np.nan
    got = forecasts.running_quantiles(x, (0.05, 0.5), 40, 10)
    for i in (30, 60, 199):
        past = x[max(0, i - 39) : i + 1]
        assert got[i] == pytest.approx(np.nanquantile(past, (0.05, 0.5)))


def test_weighted_quantiles_flat_ends():
    got = forecasts.weighted_quantiles(np.array([1.0, 2.0, np.nan]), np.array([1.0, 1.0, 5.0]), (0.0, 0.5, 1.0))
    assert got.tolist() == [1.0, 1.5, 2.0]


def test_cone_is_causal(spark):
    closes = np.exp(np.random.default_rng(1).normal(size=260).cumsum() / 50).tolist()
    whole = forecasts.cone(forecasts.forward_targets(bars(spark, closes), (1, 7)), 50).select("day", "horizon", *forecasts.NAMES)
    part = forecasts.cone(forecasts.forward_targets(bars(spark, closes[:200]), (1, 7)), 50).select("day", "horizon", *forecasts.NAMES)
    assert part.exceptAll(whole).isEmpty() and part.count() > 0


def test_upsert_keeps_last_and_null_keys_replace_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (None, "m", 1)], "k int, v string, seq int")
    got = sorted(map(tuple, relational.upsert(old, new, ["k"], ["seq"]).collect()), key=str)
    assert got == sorted([(1, "a"), (2, "d"), (3, "e"), (None, "n"), (None, "m")], key=str)


def test_append_needs_all_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    with pytest.raises(ValueError):
        relational.append_checked(a, a.select("x"))
    assert relational.append_checked(a, a.withColumn("z", F.lit(1))).columns == ["x", "y"]


def test_as_of_ties_and_head(spark):
    left = spark.createDataFrame([(1,), (5,), (6,)], "t int")
    right = spark.createDataFrame([(5, 50.0), (6, None)], "t int, v double")
    got = [r.v for r in relational.as_of(left, right, "t", "v", fill_head=True).orderBy("t").collect()]
    assert got == [50.0, 50.0, 50.0]


def test_close_time_units(spark):
    rows = [("1m",), ("1M",), ("4h",), ("7x",), (None,)]
    df = spark.createDataFrame(rows, "i string").select("i", tables.close_time(F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), F.col("i")).alias("e"))
    got = {r.i: str(r.e) for r in df.collect()}
    assert got["1m"].startswith("2024-01-31 00:00:59.999") and got["1M"].startswith("2024-02-28 23:59:59.999") and got["4h"].startswith("2024-01-31 03:59:59.999")
    assert got["7x"] == "None" and got[None] == "None"


def test_chart_series_and_typed_arrays(spark):
    df = spark.createDataFrame([('[{"name":"a","data":[[0,1.5],[86400000,2]]}]',), ('{"name":"b","data":[[0,null]]}',)], "j string")
    got = sorted((r.name, str(r.day), r.value) for r in tables.chart_series(df, "j").select("name", "day", "value").collect() if r.value is not None)
    assert got == [("a", "1970-01-01", 1.5), ("a", "1970-01-02", 2.0)]
    import base64

    raw = base64.b64encode(np.array([1, -2], "<i2").tobytes()).decode()
    t = tables.typed_array(spark.createDataFrame([(raw, "i2"), (None, "i2")], "b string, d string"), "b", "d").collect()
    assert t[0]["values"] == [1.0, -2.0] and t[1]["values"] is None


def test_purged_parts_and_folds(spark):
    df = spark.range(100).withColumnRenamed("id", "n")
    got = dict(map(tuple, splits.purged_split(df, "n", 0.6, 0.8, 5).groupBy("part").count().collect()))
    assert got == {"train": 55, "purged": 10, "select": 15, "test": 20}
    assert splits.outer_folds(100, 20, 10, 3, 50) == [(60, 80), (70, 90), (80, 100)]


def test_losses_of_crossed_interval(spark):
    row = spark.createDataFrame([(0.0, -1.0, -0.5, 0.0, 0.5, 1.0)], "actual double, q05 double, q25 double, q50 double, q75 double, q95 double")
    got = forecasts.with_losses(row).first()
    assert got["wis"] == pytest.approx(0.75) and got["wis_c"] == pytest.approx((0.05 * 2 + 0.25 * 1) / 2.5)


def test_stream_upsert(spark, tmp_path):
    from tidewright.streaming.upserts import upsert_stream

    for i, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "c", 2)]]):
        spark.createDataFrame(rows, "k int, v string, seq int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = upsert_stream(spark.readStream.schema("k int, v string, seq int").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["k"], ["seq"], f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").drop("_bucket").collect())) == [(1, "a", 1), (2, "c", 2)]
    # a new query over a table that holds rows keeps them
    spark.createDataFrame([(9, "z", 3)], "k int, v string, seq int").coalesce(1).write.parquet(f"{tmp_path}/more")
    q = upsert_stream(spark.readStream.schema("k int, v string, seq int").parquet(f"{tmp_path}/more"), f"{tmp_path}/out", ["k"], ["seq"], f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").drop("_bucket").collect())) == [(1, "a", 1), (2, "c", 2), (9, "z", 3)]


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_windows_sessions_and_state(spark, tmp_path):
    from datetime import datetime

    from tidewright.streaming.upserts import position_state, rejected_as_stale, sessions, tumbling

    start = datetime(2024, 1, 1)
    rows = [("A", start + timedelta(days=i), float(i)) for i in (0, 1, 2, 7, 8, 15, 40)] + [("B", start + timedelta(days=3), 1.0)]
    schema = "symbol string, ts timestamp, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    _run(tumbling(stream(), "ts", "7 days", "1 day", ["symbol"], "value"), "tumble", "complete")
    got = sorted((r.symbol, r.n, r.total, r.low, r.high) for r in spark.table("tumble").collect())
    assert sum(n for _, n, *_ in got) == 8 and ("B", 1, 1.0, 1.0, 1.0) in got
    _run(sessions(stream(), "ts", "2 days", "1 day", ["symbol"]), "session", "complete")
    assert sorted(r.n for r in spark.table("session").where("symbol = 'A'").collect()) == [1, 1, 2, 3]
    _run(position_state(stream(), "60 days"), "taken")
    assert sorted((r.symbol, r.value) for r in spark.table("taken").collect()) == [("A", 0.0), ("A", 7.0), ("A", 15.0), ("A", 40.0), ("B", 1.0)]
    late = rejected_as_stale(spark.createDataFrame(rows, schema), "ts", F.lit(start + timedelta(days=20)), "10 days").collect()
    assert sorted((r.value, r.reason) for r in late) == [(0.0, "stale"), (1.0, "stale"), (1.0, "stale"), (2.0, "stale"), (7.0, "stale"), (8.0, "stale"), (40.0, "future")]


def test_klines_traces_and_csv(spark, tmp_path):
    raw = spark.createDataFrame([(["0", "1.5", "2", "1", "1.7", "10", "59999", "17", "3"],)], "kline array<string>")
    bar = tables.klines(raw, F.lit("1970-01-01 00:02:00").cast("timestamp")).first()
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume, bar.trades, bar.is_closed) == (1.5, 2.0, 1.0, 1.7, 10.0, 3, True)
    trace = spark.createDataFrame([("a", ["2024-01-01", "2024-01-01", "2024-01-02"], [1.0, 2.0, float("nan")])], "name string, x array<string>, y array<double>")
    assert [(r.name, str(r.day), r.value) for r in tables.trace_points(trace, ["name"]).collect()] == [("a", "2024-01-01", 2.0)]
    (tmp_path / "f.csv").write_text("day,close\n2024-01-01,5\n")
    assert tables.read_csv(spark, f"{tmp_path}/f.csv", "day date, close double", ["day", "close"]).first().close == 5.0
    with pytest.raises(ValueError):
        tables.read_csv(spark, f"{tmp_path}/f.csv", "day date, close double", ["open"])


def test_table_sinks(spark, tmp_path):
    from tidewright.sources import sinks

    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert sinks.save(df, f"{tmp_path}/t") == 3 and sinks.save(df.where("1 = 0"), f"{tmp_path}/t") == 0
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    sinks.append_failure(spark, f"{tmp_path}/fail", "2024-01-01", ValueError("no"))
    sinks.append_failure(spark, f"{tmp_path}/fail", "2024-01-02", KeyError("x"))
    assert sorted((r.as_of, r.error) for r in spark.read.parquet(f"{tmp_path}/fail").collect()) == [("2024-01-01", "ValueError: no"), ("2024-01-02", "KeyError: 'x'")]
    sinks.write_csv_by_day(spark.createDataFrame([("2024-01-02", 1, 1), ("2024-01-01", 2, 1), ("2024-01-02", 3, 2)], "day string, v int, seq int"), f"{tmp_path}/c", "day", ["seq"])
    assert [(str(r.day), r.v) for r in spark.read.csv(f"{tmp_path}/c", header=True, inferSchema=True).collect()] == [("2024-01-01", 2), ("2024-01-02", 3)]
    assert sinks.check_names(["close", "target_7"], ["target", "future"]) == ["target_7"]
    with pytest.raises(ValueError):
        sinks.guard_names(["future_return"], ["target", "future"])
    assert sinks.quoted("a`b") == "`a``b`"


def test_conformal_calibration_never_narrows(spark):
    rows = [("X", 1, DAY + timedelta(days=i), float(i % 5) - 2, -10.0, -5.0, 0.0, 5.0, 1.5) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, horizon int, day date, actual double, q05 double, q25 double, q50 double, q75 double, q95 double")
    y = np.array([r[3] for r in rows[:26]])
    for method, level, weight in (("conformal", 0.9, 1.0), ("asymmetric_lower_tail", 0.5, 0.1)):
        got = forecasts.widened(df, method).collect()
        up = weight * max(np.quantile(y - 1.5, level), 0)
        assert len(got) == 14 and all(r.q05 == -10.0 and r.q25 == -5.0 and r.q75 == pytest.approx(1.5 + up) and r.q95 == 5.0 for r in got)
    assert all(r.q05 > -10.0 for r in forecasts.additive_quantile(df).collect())
