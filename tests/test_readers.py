"""REST readers over made transports, resumed builds and codebooks."""

import numpy as np
import pandas as pd
import pytest

from tidewright.operators import codebook as cb
from tidewright.operators import recursion as rc
from tidewright.operators import resume as rs
from tidewright.sources import rest


def bars_service(keys, answers=None, calls=None):
    """Serves [key, value] rows by pages; `answers` overrides the first statuses of each host."""
    left = {h: list(s) for h, s in (answers or {}).items()}

    def transport(host, p):
        if calls is not None:
            calls.append((host, p["startTime"]))
        if left.get(host):
            status = left[host].pop(0)
            if status == "error":
                raise OSError("no route")
            return status, None
        return 200, [[k, k * 2] for k in keys if p["startTime"] <= k <= p["endTime"]][: p["limit"]]

    return transport


@pytest.mark.parametrize("limit", [1, 3, 7, 50])
def test_pages_give_every_row_once(limit):
    keys = [*range(0, 100, 7), 101, 102]
    got = list(rest.pages(bars_service(keys), ["a"], {}, 7, 102, limit, pause=0))
    assert [k for k, _ in got] == [k for k in keys if 7 <= k < 102]


def test_hosts_take_over_and_busy_ones_are_asked_again():
    calls = []
    transport = bars_service([1, 2, 3], {"a": [451], "b": [429, "error", 503]}, calls)
    assert len(list(rest.pages(transport, ["a", "b"], {}, 0, 10, 5, pause=0))) == 3
    assert [h for h, _ in calls] == ["a", "b", "b", "b", "b"]
    with pytest.raises(rest.SourceError, match="blocked"):
        list(rest.pages(bars_service([1], {"a": [451, 451]}), ["a"], {}, 0, 10, 5, tries=2, pause=0))
    with pytest.raises(rest.SourceError, match="404"):
        list(rest.pages(lambda h, p: (404, "gone"), ["a"], {}, 0, 10, 5, pause=0))


DAY = 86_400_000


def metric_service(times, most=None, days=None, quota=None):
    def transport(host, p):
        a, b = p["from"], p["to"]
        if days and a < b - days * DAY:
            return 403, {"allowed_days": days}
        found = [t for t in times if a <= t < b]
        if quota is not None and len(found) > quota:
            return 402, {"quota_remaining": quota}
        if most and len(found) > most:
            return 422, {}
        return 200, [{"time": t} for t in found]

    return transport


def test_ranges_split_as_the_service_asks():
    times = [k * DAY for k in range(40)]
    ask = lambda **k: [r["time"] for r in rest.ranged(metric_service(times, **k), ["a"], {}, 0, 40 * DAY, DAY, pause=0)]
    assert ask(most=3) == times and ask() == times
    # the allowed history less a day, the affordable latest records, nothing without quota
    assert ask(days=10) == times[-9:] and ask(quota=6) == times[-5:] and ask(quota=0) == []
    # more than fits in one step can't be split further
    crowded = rest.ranged(metric_service([0] * 5 + [DAY], most=3), ["a"], {}, 0, 2 * DAY, DAY, pause=0)
    assert [r["time"] for r in crowded] == [DAY]
    assert rest.ranged(lambda h, p: (400, {}), ["a"], {}, 0, 10, 1, pause=0) == [] and rest.ranged(metric_service([1]), ["a"], {}, 5, 5, 1) == []


def test_partitions_cut_the_span():
    r = rest._KlineReader({"names": "x,y", "start": "5", "end": "25", "split": "10"})
    assert [(p.name, p.start, p.end) for p in r.partitions()] == [(n, a, b) for n in "xy" for a, b in ((5, 10), (10, 20), (20, 25))]
    assert len(rest._KlineReader({"names": "x", "start": "5", "end": "25"}).partitions()) == 1


def series(n=60, seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"symbol": "A", "day": pd.date_range("2020-01-01", periods=n).date, "close": 10 + rng.standard_normal(n).cumsum()})


MADE = [rs.ema("e", "close", 5), rs.wilder("w", "close", 6), rs.high_pass("h", "close", 12)]


def test_resumable_steps_equal_whole_recursions():
    frame = series()
    frame.loc[[20, 21], "close"] = np.nan
    out, _ = rs.run(frame, MADE[:1], [MADE[0].start], 0)
    assert np.allclose(out["e"], rc.ema(frame["close"].to_numpy(), 5), equal_nan=True)
    frame = series()
    out, _ = rs.run(frame, MADE, [r.start for r in MADE], 0)
    assert np.allclose(out["w"], rc.wilder(frame["close"].to_numpy(), 6), equal_nan=True)
    assert np.allclose(out["h"], rc.high_pass(frame["close"].to_numpy(), 12))


def test_refreshes_equal_a_full_build(spark):
    both = pd.concat([series(), series(45, 2).assign(symbol="B"), series(4, 3).assign(symbol="C")])
    df = spark.createDataFrame(both)
    full, _ = rs.build(df, MADE)
    want = {(r.symbol, r.day): (r.e, r.w, r.h) for r in full.collect()}
    days = sorted(both["day"].unique())
    # B's first rows come with the second refresh; late corrections within the overlap are taken up
    first = df.where((df.symbol != "B") & (df.day < str(days[30])))
    stored, states = rs.build(first, MADE, overlap=3)
    for until, overlap in ((days[40], 3), (days[-1] + pd.Timedelta(days=1), 3)):
        fresh, states = rs.refresh(df.where(df.day < str(until)), states, MADE, overlap)
        stored = rs.rewritten(stored, fresh)
    got = {(r.symbol, r.day): (r.e, r.w, r.h) for r in stored.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert [x is None for x in got[k]] == [x is None for x in v] and np.allclose([x for x in got[k] if x is not None], [x for x in v if x is not None])


def test_context_rows(spark):
    df = spark.createDataFrame(series(50))
    last = df.where(df.day <= "2020-02-04").groupBy("symbol").agg({"day": "max"}).toDF("symbol", "day")
    got = rs.context(df, last, rows=10, overlap=4).orderBy("day").collect()
    assert str(got[0].day) == "2020-01-21" and sum(r.write for r in got) == 50 - 31 + 1 and str(next(r.day for r in got if r.write)) == "2020-01-31"


def test_codebook(spark):
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0], [5, 5], [0, 6]])
    x = np.concatenate([c + 0.3 * rng.standard_normal((40, 2)) for c in centres])
    frame = pd.DataFrame({"symbol": "A", "day": pd.date_range("2020-01-01", periods=120).date, "u": x[:, 0], "v": x[:, 1]})
    df = spark.createDataFrame(pd.concat([frame, frame.iloc[:1].assign(symbol="B", u=np.nan)]))
    book = cb.fit_codebook(df, ["u", "v"], ["symbol", "day"], 3, starts=5)
    means = sorted(tuple(x[i * 40 : i * 40 + 40].mean(0).round(6)) for i in range(3))
    assert sorted(tuple(np.round(c, 6)) for c in book.centres) == means and book.rows == 120
    d = ((x[:, None] - np.array(book.centres)[None]) ** 2).mean(2)
    near = d.min(1)
    assert book.distance_scale == pytest.approx(np.median(near)) and book.novelty_scale == pytest.approx(np.quantile(near, 0.95))
    got = cb.regime_shares(df.where("symbol = 'A'"), book, alpha=0.25).orderBy("day").toPandas()
    e = np.exp(np.maximum(-(d - near[:, None]) / (book.distance_scale * 0.35), -60))
    share = e / e.sum(1, keepdims=True)
    assert np.allclose(got[["regime_0", "regime_1", "regime_2"]], share) and np.allclose(got["novelty"], near / book.novelty_scale)
    smooth = share[0]
    for i in range(1, 120):
        smooth = 0.75 * smooth + 0.25 * share[i]
    assert np.allclose(got[["smooth_0", "smooth_1", "smooth_2"]].iloc[-1], smooth)
