"""Fitted features against plain versions on small fixtures."""

from math import ceil, log
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from tidewright.operators import blends as bl
from tidewright.operators import fairvalue as fv
from tidewright.operators import isotonic as iso
from tidewright.operators import likelihood as lk
from tidewright.operators import ridge as rg
from tidewright.operators import unitroots as ur
from tidewright.operators import volatility as vol


def walk(n=150, seed=5):
    rng = np.random.default_rng(seed)
    x = 40 + np.cumsum(rng.standard_normal(n)) + np.where(np.arange(n) > 90, 4, 0)
    return np.concatenate([x, 0.4 * x[-60:] + rng.standard_normal(60)])


def ols(y, x):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    return b, e, np.sqrt(e @ e / (len(y) - x.shape[1]) * np.diag(np.linalg.inv(x.T @ x)))


def plain_lags(w, most):
    d, best = np.diff(w), None
    y = d[most:]
    for k in range(most + 1):
        x = np.column_stack([np.ones(len(y)), w[most:-1], *[d[most - j : len(d) - j] for j in range(1, k + 1)]])
        e = ols(y, x)[1]
        score = len(y) * log(e @ e / len(y)) + 2 * x.shape[1]
        if best is None or score < best[0] - 1e-10:
            best = (score, k)
    return best[1]


def plain_adf(w):
    k, d = plain_lags(w, ceil(12 * (len(w) / 100) ** 0.25)), np.diff(w)
    y = d[k:]
    b, _, se = ols(y, np.column_stack([w[k:-1], np.ones(len(y)), *[d[k - j : len(d) - j] for j in range(1, k + 1)]]))
    return b[0] / se[0]


def plain_kpss(w):
    n, r = len(w), w - w.mean()
    dot = lambda i: float(r[i:] @ r[: n - i])
    s0, s1 = r @ r / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        s0 += dot(i) / (n / 2)
        s1 += i * dot(i) / (n / 2)
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long_run = (r @ r + sum(2 * (1 - i / (lags + 1)) * dot(i) for i in range(1, lags + 1))) / n
    return (np.cumsum(r) ** 2).sum() / n**2 / long_run


def plain_pp(w):
    y, x = w[1:], np.column_stack([w[:-1], np.ones(len(w) - 1)])
    b, u, se = ols(y, x)
    n, lags = len(y), ceil(12 * (len(w) / 100) ** 0.25)
    lam2 = (u @ u + 2 * sum((1 - i / (lags + 1)) * (u[i:] @ u[:-i]) for i in range(1, lags + 1))) / n
    s, gamma0 = np.sqrt(u @ u / (n - 2)), u @ u / n
    return np.sqrt(gamma0 / lam2) * (b[0] - 1) / se[0] - 0.5 * (lam2 - gamma0) / np.sqrt(lam2) * (n * se[0] / s)


def plain_za(w):
    n, d = len(w), np.diff(w)
    k, cut, found = plain_lags(w, ceil(12 * (n / 100) ** 0.25)), int(n * 0.15), []
    y = d[k:]
    for day in range(cut + 1, n - cut + 1):
        step = (np.arange(len(y)) >= day - (k + 1)).astype(float)
        b, _, se = ols(y, np.column_stack([w[k:-1], np.ones(len(y)), step, np.arange(len(y)), *[d[k - j : len(d) - j] for j in range(1, k + 1)]]))
        found.append(b[0] / se[0])
    return min(found)


@pytest.mark.parametrize(("fast", "plain", "n", "late"), [(ur.dickey_fuller, plain_adf, 90, 0), (ur.kpss, plain_kpss, 40, 0), (ur.phillips_perron, plain_pp, 100, 1), (ur.zivot_andrews, plain_za, 100, 1)])
def test_unit_root_statistics_equal_plain_windows(fast, plain, n, late):
    x = walk()
    got = fast(x, n)
    assert np.isnan(got[: n - 1 + late]).all() and not np.isnan(got[n - 1 + late :]).any()
    for t in range(n - 1 + late, len(x), 7):
        assert got[t] == pytest.approx(plain(x[t - n + 1 : t + 1]), rel=1e-6, abs=1e-8)


def test_unit_root_windows_with_gaps_or_without_movement():
    x = walk()
    x[120] = np.nan
    for f, n, late in ((ur.dickey_fuller, 90, 0), (ur.kpss, 40, 0), (ur.phillips_perron, 100, 1), (ur.zivot_andrews, 100, 1)):
        got = f(x, n)
        assert np.isnan(got[120 : min(120 + n, len(x))]).all() and not np.isnan(got[max(n - 1 + late, 0) : 120]).any()
        assert np.isnan(f(np.full(130, 3.0), n)).all() and np.isnan(f(x[:10], n)).all()


def test_p_values():
    assert ur.p_value(3.0) == 1 and ur.p_value(-20.0) == 0
    # published critical values of the test with a constant
    assert ur.p_value(-3.43035) == pytest.approx(0.01, abs=1e-3) and ur.p_value(-2.86154) == pytest.approx(0.05, abs=1e-3) and ur.p_value(-2.56677) == pytest.approx(0.10, abs=2e-3)
    assert NormalDist().cdf(0) == 0.5


def test_unit_root_frame(spark):
    days = pd.date_range("2020-01-01", periods=210)
    df = spark.createDataFrame([(s, d.date(), float(v)) for s in ("A", "B") for d, v in zip(days, walk(seed=ord(s)), strict=True)], "symbol string, day date, close double")
    got = ur.unit_root_statistics(df).where("symbol = 'B'").orderBy("day").collect()
    x = walk(seed=ord("B"))
    assert got[50].adf_p is None and got[99].phillips_perron is None
    assert got[150].adf_p == pytest.approx(ur.p_value(plain_adf(x[61:151])), rel=1e-6)


def slope_by_differences(f, x, step=1e-6):
    return np.array([(f(x + step * e)[0] - f(x - step * e)[0]) / (2 * step) for e in np.eye(len(x))])


def test_search_finds_bounded_minima():
    f = lambda x: (100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2, np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)]))
    free = np.full(2, 10.0)
    x, value, done = lk.minimise(f, np.array([-1.2, 1.0]), -free, free)
    assert done and np.allclose(x, 1, atol=1e-4) and value < 1e-8
    x, _, _ = lk.minimise(f, np.array([-1.2, 0.2]), np.array([-2.0, -2.0]), np.array([0.5, 2.0]))
    assert np.allclose(x, [0.5, 0.25], atol=1e-4)


def test_blocked_recursion():
    u = np.random.default_rng(0).standard_normal((203, 2))
    want, y = [], np.zeros(2)
    for row in u:
        y = 0.93 * y + row
        want.append(y)
    assert np.allclose(lk.decayed(u, 0.93), want)


def simulated_returns(n=2500, seed=2):
    rng = np.random.default_rng(seed)
    e, v = np.empty(n), 1.0
    for i in range(n):
        e[i] = np.sqrt(v) * rng.standard_normal()
        v = 0.05 + 0.1 * e[i] ** 2 + 0.85 * v
    return e


def test_garch_fit_is_a_maximum_near_the_truth():
    e = simulated_returns()
    omega, alpha, beta = vol.fit_garch(e)
    assert abs(alpha - 0.1) < 0.05 and abs(beta - 0.85) < 0.08

    def loss(o, a, b):
        v, out = vol.before_first(e), []
        v = o + (a + b) * v
        for x in e:
            out.append(v)
            v = o + a * x * x + b * v
        v = np.array(out)
        assert np.allclose(v, vol.garch_variance(e, o, a, b))
        return float((np.log(v) + e * e / v).sum())

    best = loss(omega, alpha, beta)
    assert all(best <= loss(omega * p, alpha * q, beta * r) + 1e-6 for p, q, r in ((1.05, 1, 1), (0.95, 1, 1), (1, 1.05, 1), (1, 0.95, 1), (1, 1, 1.01), (1, 1, 0.99)))


def test_egarch_slopes_and_fit():
    e = simulated_returns(600)

    def loss(t):
        h, d = vol.egarch_path(e, t)
        z2 = e * e * np.exp(-h)
        return 0.5 * float((h + z2).sum()), 0.5 * (1 - z2) @ d

    t = np.array([0.02, 0.15, -0.05, 0.9])
    assert np.allclose(loss(t)[1], slope_by_differences(loss, t), rtol=1e-4, atol=1e-3)
    best = vol.fit_egarch(e)
    assert loss(best)[0] < loss(t)[0] and np.abs(loss(best)[1]).max() < 0.05


def test_volatility_cones_by_schedule(spark):
    r = simulated_returns(140) / 100
    r[60] = 0.08
    days = pd.date_range("2021-01-01", periods=141)
    close = 100 * np.exp(np.concatenate([[0], np.cumsum(r)]))
    r = np.array([log(b / a) for a, b in zip(close[:-1].tolist(), close[1:].tolist(), strict=True)])
    df = spark.createDataFrame([("A", d.date(), float(c)) for d, c in zip(days, close, strict=True)], "symbol string, day date, close double")
    got = vol.volatility_cones(df, (1, 3), every=30, least=75, history=90).toPandas()
    assert len(got) == 141 * 4
    at = lambda k, m, h: got[(got["day"] == days[k].date()) & (got["forecaster"] == m) & (got["horizon"] == h)].iloc[0]
    assert at(40, "garch", 3)["q05"] == pytest.approx(NormalDist().inv_cdf(0.05) * r[:40].std(ddof=1) * 3**0.5)
    for day, refit in ((75, 75), (80, 75), (90, 90), (119, 90), (140, 120)):
        known = r[:refit][-90:] if refit < 90 else r[refit - 90 : refit]
        want = vol.cones(known, [1, 3], 1)
        for m in ("garch", "egarch"):
            assert [at(day, m, 3)[q] for q in vol.NAMES] == pytest.approx(want[m][1].tolist(), rel=1e-6)


def test_filter_slopes_equal_differences_and_matrix_form():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((80, 2))
    y = x @ [0.02, -0.01] + 0.03 * rng.standard_normal(80)
    f = lk.TwoStateFilter(y, x)
    theta = f.start + np.array([0.1, 0.01, -0.02, 0.3, -0.2, 0.1])
    assert np.allclose(f.loss(theta)[1], slope_by_differences(f.loss, theta), rtol=1e-4, atol=1e-4)
    p = f.fit()
    assert p["loss"] <= f.loss(f.start)[0] and 0 < p["phi"] < 0.98
    level, deviation, state = lk.two_state(y, x, p)
    m, v = np.zeros(2), np.eye(2)
    a, h, q = np.diag([1, p["phi"]]), np.ones((1, 2)), np.diag([p["q"], p["q_dev"]])
    for i in range(80):
        m, v = a @ m + [x[i] @ p["b"], 0], a @ v @ a.T + q
        k = v @ h.T / (h @ v @ h.T + p["r"])
        m, v = m + (k * (y[i] - m.sum())).ravel(), (np.eye(2) - k @ h) @ v
        assert np.allclose([level[i], deviation[i]], m)
    half = lk.two_state(y[:40], x[:40], p)
    assert np.allclose(lk.two_state(y[40:], x[40:], p, half[2])[0], level[40:]) and len(state) == 5


def test_fair_value_uses_train_rows_alone(spark):
    rng = np.random.default_rng(9)
    n = 420
    drive = rng.standard_normal((n, 3))
    price = np.exp(3 + 0.002 * np.arange(n) + np.cumsum(0.01 * drive[:, 0] + 0.01 * rng.standard_normal(n)))
    frame = pd.DataFrame({"symbol": "A", "day": pd.date_range("2020-01-01", periods=n).date, "price": price, "u": drive[:, 0], "v": drive[:, 1], "w": drive[:, 2]})
    how = fv.FairValue(("u", "v", "w"), apart=("w",), months=4.0, lag_span=20)
    made = fv.fair_value_of(frame, how)
    assert list(made["part"].unique()) == ["train", "test"] and (made["lower_2"] < made["lower_1"]).all() and (made["upper_1"] < made["upper_2"]).all()
    # later prices and features change nothing before them
    changed = frame.copy()
    changed.loc[n - 5 :, ["price", "u", "v", "w"]] *= 1.3
    again = fv.fair_value_of(changed, how)
    assert np.allclose(again["fair_value"].iloc[:-5], made["fair_value"].iloc[:-5])
    assert len(fv.fair_value_of(frame.iloc[:15], how)) == 0
    drawn = fv.fair_value_of(frame, fv.FairValue(("u",), months=4.0, lag_span=20, seed=3))
    assert (drawn["part"] == "train").sum() == int(len(drawn) * 0.8) and drawn["day"].is_monotonic_increasing
    got = fv.fair_values(spark.createDataFrame(frame), how).orderBy("day").toPandas()
    assert np.allclose(got["fair_value"], made["fair_value"])


def test_first_component_and_level():
    rng = np.random.default_rng(3)
    a = rng.standard_normal(60)
    rows = pd.DataFrame({"x": a + 0.1 * rng.standard_normal(60), "y": -a + 0.1 * rng.standard_normal(60)})
    got = fv.first_component(rows[:40], rows)
    z = (rows - rows[:40].mean()) / rows[:40].std()
    assert np.allclose(np.abs(got), np.abs((z["x"] - z["y"]) / np.sqrt(2)))
    assert np.allclose(fv.level_of(np.array([0.1, 0.0]), 0.5, None, 1.0), [0.6, 0.3])


def plain_isotonic(x, y):
    """Least squares under order by the min-max formula."""
    xs = sorted(set(x))
    own = [[b for a, b in zip(x, y, strict=True) if a == v] for v in xs]
    mean = lambda j, k: np.mean([v for g in own[j : k + 1] for v in g])
    return xs, [max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i in range(len(xs))]


def test_isotonic_curves(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.random(60), 1)
    y = x + rng.standard_normal(60)
    xs, ys = plain_isotonic(x.tolist(), y.tolist())
    blocks = pd.DataFrame({"x": x, "y": y}).groupby("x")["y"].agg(["sum", "count"])
    assert np.allclose(iso.pooled((blocks["sum"] / blocks["count"]).to_numpy(), blocks["count"].to_numpy(float)), ys)
    days = pd.date_range("2020-01-01", periods=100)
    rows = [("A", d.date(), 1, float(y[i % 60]), *[float(x[i % 60])] * 5) for i, d in enumerate(days[:60])] + [("A", d.date(), 1, 0.0, -1.0, 0.05, 0.55, 0.9, None) for d in days[60:65]]
    rows += [("B", d.date(), 1, 1.0, 0.2, 0.2, 0.2, 0.2, 0.2) for d in days[:6]]
    df = spark.createDataFrame(rows, "symbol string, day date, horizon int, y double, q05 double, q25 double, q50 double, q75 double, q95 double")
    got = iso.isotonic_calibrated(df, fit_share=60 / 65).where("symbol = 'A'").collect()
    want = sorted(np.interp([-1.0, 0.05, 0.55, 0.9], xs, ys))
    assert len(got) == 5 and np.allclose([v for v in (got[0].q05, got[0].q25, got[0].q50, got[0].q75, got[0].q95) if v is not None], want)
    few = iso.isotonic_calibrated(df.where("symbol = 'B'"), fit_share=0.65).first()
    assert few.q50 == pytest.approx(0.2)


def plain_blend(q, s, e, p, b, horizon):
    """One row's blended quantiles, a step at a time."""
    cut = lambda x, lo, hi: min(max(x, lo), hi)
    half, low, up = max((q[3] - q[1]) / 2, 1e-6), max(q[1] - q[0], 1e-6), max(q[4] - q[3], 1e-6)
    wide, scope = max(q[4] - q[0], 2 * half, 1e-6), cut(horizon, 7, 240)
    hot, flare, z, gz = cut(s["high_vol"], 0, 1), cut(s["tail_flare"] / 2, 0, 1.5), s["innovation_z"], s["gap_z"]
    sigma = s["residual_sigma"] * scope**0.5 * cut(1 + b.sigma_boost * hot + 0.5 * b.sigma_boost * flare, 0.5, 3.5)
    to = p.drift_weight * s["drift"] * scope - p.reversion_weight * (1 - p.phi**scope) * s["gap"]
    trust = cut(np.exp(-0.2 * abs(z)) / (1 + 0.08 * s["uncertainty"] / s["residual_sigma"]), 0.2, 1)
    pull = cut(cut(b.center * cut((scope / 7) ** 0.5, 0.35, 1.35), 0, 0.9) * (1 - b.dampen * hot), 0, 0.9)
    most = max(wide, sigma, 1e-6)
    mid = q[2] + pull * trust * cut(to - q[2], -b.clip_widths * most, b.clip_widths * most)
    widen = cut(1 + b.disagreement * trust * min(abs(to - q[2]) / most, 3) + b.uncertainty * min(sigma / max(wide, 1e-6), 3), 0.75, 2.5)
    own = (max((e[3] - e[1]) / 2, 1e-6), max(e[1] - e[0], 1e-6), max(e[4] - e[3], 1e-6)) if e else None
    share = cut(b.empirical * (0.6 + 0.4 * hot), 0, 0.95) if e else 0
    base = [(1 - share) * x + share * (own[i] if own else x) for i, x in enumerate((half, low, up))]
    normal = [0.6744897501960817 * sigma * b.sigma] + [(1.6448536269514722 - 0.6744897501960817) * sigma * b.sigma] * 2
    cap = [max(n, own[i] if own else 0, 1e-6) for i, n in enumerate(normal)]
    grown = [base[0] * widen] + [x * (1 + 0.5 * (widen - 1)) for x in base[1:]]
    new = cap if b.mode == "replace" else [min(x, c) for x, c in zip(grown, cap, strict=True)] if b.mode == "cap" else grown
    boost = 1 + b.tail_boost * cut(0.5 * hot + flare, 0, 2)
    for i, side in ((1, 1), (2, -1)):
        new[i] *= cut((1 + b.tail * min(max(side * gz, 0) + 0.35 * max(-side * z, 0), 3) / 3) * boost, 0.75, 4)
    full = 2 * new[0] + new[1] + new[2]
    safe = max(2 * 1.6448536269514722 * sigma * b.sigma, max(e[4] - e[0], 1e-6) if e else 0) * b.safety * (1 + b.safety_boost * hot)
    shrink = safe / full if b.safety > 0 and full > safe > 0 else 1
    return sorted([mid - (new[0] + new[1]) * shrink, mid - new[0] * shrink, mid, mid + new[0] * shrink, mid + (new[0] + new[2]) * shrink])


def test_blends_equal_plain_steps(spark):
    rng = np.random.default_rng(8)
    quantiles, empirical, states = [], [], []
    for i in range(12):
        day = pd.Timestamp("2021-01-01").date() + pd.Timedelta(days=i)
        quantiles.append(("A", day, 15, 0.0, *sorted(rng.standard_normal(5).tolist())))
        empirical.append(("A", day, 15, *(sorted((2 * rng.standard_normal(5)).tolist()) if i % 3 else [None] * 5)))
        for p in bl.PROFILES:
            states.append(("A", day, p.state, 239 if i == 5 else 300, 0.0, 0.0, *map(float, (rng.standard_normal(), 0.1 * rng.standard_normal(), abs(rng.standard_normal()) + 0.05, 2 * rng.standard_normal(), 2 * rng.standard_normal(), abs(rng.standard_normal()), 4 * rng.random(), rng.random()))))
    names = ", ".join(f"{n} double" for n in vol.NAMES)
    rows = spark.createDataFrame(quantiles, f"symbol string, day date, horizon int, actual double, {names}")
    held = spark.createDataFrame(states, "symbol string, day date, state string, history long, " + ", ".join(f"{c} double" for c in bl.STATE))
    made = bl.blended(rows, held, spark.createDataFrame(empirical, f"symbol string, day date, horizon int, {names}"), extra=["actual"])
    got = {(r.forecaster, r.day): [r[n] for n in vol.NAMES] for r in made.collect()}
    assert len(got) == 45 * 12
    for q, e in zip(quantiles, empirical, strict=True):
        for p in bl.PROFILES:
            s = dict(zip(bl.STATE, next(x for x in states if x[1] == q[1] and x[2] == p.state)[4:], strict=True))
            for b in bl.BLENDS:
                want = list(q[4:]) if q[1].day == 6 else plain_blend(q[4:], s, e[3:] if e[3] is not None else None, p, b, 15)
                assert got[f"blend_{p.state}_{b.blend}", q[1]] == pytest.approx(want, rel=1e-9)
    chosen = bl.picked(made).collect()
    assert len(chosen) == 12 and {r.variant for r in chosen} == {"blend_fundamental_slow_directional_anchor"}
    # without the slow profile the next choice follows
    assert {r.variant for r in bl.picked(made.where("state <> 'fundamental_slow'")).collect()} == {"blend_local_responsive_directional_anchor"}


def plain_ridge(x, y, x2, y2, alpha):
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1)
    z, z2 = (x - mean) / sd, (x2 - mean) / sd
    b = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    mse = ((y2 - y.mean() - z2 @ b) ** 2).mean()
    return b, 1 - mse / ((y2 - y.mean()) ** 2).mean()


def test_prefix_fits_equal_plain_ridge():
    rng = np.random.default_rng(2)
    x, x2 = rng.standard_normal((80, 4)) + 3, rng.standard_normal((40, 4)) + 2.5
    x[:, 3], x2[:, 3] = 1.0, 1.0  # a constant feature
    y, y2 = x[:, 0] - 0.5 * x[:, 2] + rng.standard_normal(80), x2[:, 0] + rng.standard_normal(40)
    moments = lambda a, b: rg.Moments(len(a), np.column_stack([a, b]).mean(0), np.column_stack([a, b]).T @ np.column_stack([a, b]) / len(a))
    order = [2, 0, 3, 1]
    for k, fit in enumerate(rg.prefix_fits(moments(x, y), moments(x2, y2), order, 1.5)):
        if k:
            b, utility = plain_ridge(x[:, order[:k]], y, x2[:, order[:k]], y2, 1.5)
            assert np.allclose(fit.coefficients, b) and fit.utility == pytest.approx(utility)


def test_feature_selection_finds_what_predicts(spark):
    rng = np.random.default_rng(6)
    n = 400
    good, slow, noise = rng.standard_normal(n), np.cumsum(rng.standard_normal(n)) * 0.1, rng.standard_normal(n)
    y = 0.8 * good + 0.3 * rng.standard_normal(n)
    days = pd.date_range("2019-01-01", periods=n)
    frame = pd.DataFrame({"symbol": "A", "day": days.date, "good": good, "slow": slow, "noise": noise, "y": y})
    frame.loc[5, "good"] = None
    got = rg.select_features(spark.createDataFrame(frame).replace(float("nan"), None), ["good", "slow", "noise"], "y", 3, how=rg.Selection(complexity_penalty=0.02)).toPandas().set_index("feature")
    assert got.loc["good", "place"] == 1 and got.loc["good", "selected"] and not got.loc["noise", "selected"] and got.loc["good", "folds"] == 3
    a, b = int(n * 0.65), int(n * 0.82)
    g = frame["good"].fillna(frame["good"][: a - 15].median()).to_numpy()
    _, utility = plain_ridge(g[: a - 15, None], y[: a - 15], g[a : b - 15, None], y[a : b - 15], 1.0)
    assert got.loc["good", "prefix_utility"] == pytest.approx(utility)
    short = rg.select_features(spark.createDataFrame(frame.iloc[:8]).replace(float("nan"), None), ["good", "slow"], "y", 3)
    assert short.count() == 0
