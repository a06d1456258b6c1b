"""Forecasting: golden Holt path, chunked Holt vs brute force, AR recovery, dispatcher checks."""
import numpy as np
import pytest
from conftest import long_df, multi_long

from pyspark.sql import functions as F

from sparkseries.operators.forecast import arima, common, css
from sparkseries.operators.forecast.dispatch import forecast
from sparkseries.operators.forecast.holt import _A, _B, holt_fit

LINEAR = [("2023-01-01", 100), ("2023-01-02", 105), ("2023-01-03", 110), ("2023-01-04", 115), ("2023-01-05", 120)]


def test_holt_linear_golden(spark):
    rows, _ = forecast(long_df(spark, LINEAR), "exponential_smoothing", [3])
    got = rows.orderBy("step").collect()
    assert [r["forecast"] for r in got] == pytest.approx([125, 130, 135])
    assert [str(r["ts"].date()) for r in got] == ["2023-01-06", "2023-01-07", "2023-01-08"]


def _holt_brute(y):
    best = None
    for a, b in zip(_A, _B):
        lv, tr, sse = y[0], y[1] - y[0], 0.0
        for v in y[1:]:
            e = v - (lv + tr)
            sse += e * e
            ln = a * v + (1 - a) * (lv + tr)
            tr = b * (ln - lv) + (1 - b) * tr
            lv = ln
        if best is None or sse < best[0] * (1 - 1e-12):
            best = (sse, a, b, lv, tr)
    return best


def test_holt_chunked_equals_bruteforce(spark):
    rng = np.random.default_rng(4)
    y = 50 + np.cumsum(rng.normal(size=90))
    prep = common.Prepared(multi_long(spark, {"a": y.tolist()}), max_chunk=11)
    fit = holt_fit(prep.clean, prep.ok, max_chunk=11).first()
    sse, a, b, lv, tr = _holt_brute(y)
    assert (fit["alpha"], fit["beta"]) == (pytest.approx(a), pytest.approx(b))
    assert fit["level"] == pytest.approx(lv) and fit["trend"] == pytest.approx(tr)
    assert fit["sse"] == pytest.approx(sse, rel=1e-9)


def test_holt_blocks_are_the_recursion():
    """A summary of blocks side by side says what the recursion does from any state."""
    from sparkseries.operators.forecast.holt import summarise
    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 101):
        y = 5 + np.cumsum(rng.normal(size=n))
        f = summarise(y)
        s0, s1, sse = np.full(_A.size, 4.0), np.full(_A.size, -0.5), np.zeros(_A.size)
        for v in y:
            e = v - (s0 + s1)
            sse += e * e
            s0, s1 = s0 + s1 + _A * e, s1 + _A * _B * e
        got = f["r0"] - 2 * (f["r1a"] * 4.0 + f["r1b"] * -0.5) + f["r2aa"] * 16 + 2 * f["r2ab"] * -2.0 + f["r2bb"] * 0.25
        assert np.allclose(got, sse) and np.allclose(f["m00"] * 4 - f["m01"] * 0.5 + f["v0"], s0)
        assert np.allclose(f["m10"] * 4 - f["m11"] * 0.5 + f["v1"], s1)


def _arma(n, seed=0, ar=0.6, ma=0.3, c=1.0):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n)
    w = np.zeros(n)
    for t in range(1, n):
        w[t] = c + ar * w[t - 1] + e[t] + ma * e[t - 1]
    return w


def _residuals(y, spec, theta):
    """The recursion as it is defined, point by point."""
    phi, b, c = spec.polys(theta)
    f = np.convolve(phi, spec.diff)
    e = []
    for t in range(spec.reach, len(y)):
        u = sum(v * y[t - lag] for lag, v in enumerate(f)) - c
        e.append(u - sum(b[lag] * e[-lag] for lag in range(1, len(b)) if lag <= len(e)))
    return np.array(e)


MODELS = [(dict(p=2, q=2, const=True), [0.3, 0.1, 0.2, -0.1, 1.0]), (dict(p=1, q=1, d=1), [0.4, 0.3]), (dict(d=1), []),
          (dict(p=1, q=1, P=1, Q=1, m=12, d=1, D=1), [0.3, 0.2, 0.1, -0.4]), (dict(q=2), [0.2, 0.1]), (dict(p=2, const=True), [0.2, 0.1, 3.0])]


@pytest.mark.parametrize("order, theta", MODELS)
def test_piece_summaries_are_exact(order, theta):
    """Sums of squares, derivatives and the end state do not depend on where a series is cut."""
    y = np.cumsum(np.random.default_rng(0).normal(size=300)) + 50
    spec = css.Spec(**order)
    e = _residuals(y, spec, theta)
    h = 1e-6
    jac = [(_residuals(y, spec, np.array(theta) + h * u) - _residuals(y, spec, np.array(theta) - h * u)) / (2 * h) for u in np.eye(len(theta))]
    jac = np.array(jac).reshape(len(theta), len(e))
    for cuts in ([300], [100, 300], [spec.reach + 1, spec.reach + 2, spec.reach + 5, 70, 71, 300]):
        lo, parts = spec.reach, []
        for hi in cuts:
            base = max(lo - spec.reach, 0)
            parts.append(css.summary(y[base:hi], lo - base, spec, theta))
            lo = hi
        sse, jte, jtj, n, tail, _ = css.compose(parts, spec)
        assert n == len(e) and sse == pytest.approx(e @ e)
        assert np.allclose(jte, jac @ e, rtol=1e-4, atol=1e-2) and np.allclose(jtj, jac @ jac.T, rtol=1e-4, atol=1e-2)
        assert np.allclose(tail, e[len(e) - spec.r:])


@pytest.mark.parametrize("order, theta", MODELS)
def test_path_jumps_to_the_same_forecasts(order, theta):
    y = np.cumsum(np.random.default_rng(1).normal(size=100)) + 50
    spec = css.Spec(**order)
    e = _residuals(y, spec, theta)[-spec.r:] if spec.r else np.zeros(0)
    whole = css.head(spec, theta, y, e, 90)
    for lo, count in ((0, 90), (1, 40), (13, 5), (60, 30)):
        assert css.path(spec, theta, y, e, lo, count) == pytest.approx(whole[lo:lo + count])


def test_css_recovers_arma():
    fit = css.fit_whole(_arma(3000), css.Spec(p=1, q=1, const=True))
    assert fit["status"] == "ok"
    assert fit["best"][0] == pytest.approx(0.6, abs=0.05) and fit["best"][1] == pytest.approx(0.3, abs=0.06)


def test_ar1_is_the_regression():
    y = _arma(500, 4, ma=0.0)
    fit = css.fit_whole(y, css.Spec(p=1, const=True))
    assert fit["best"] == pytest.approx(np.polyfit(y[:-1], y[1:], 1).tolist(), rel=1e-9)


def test_unsettled_fit_says_so(monkeypatch):
    monkeypatch.setattr(css, "MAX_EVALUATIONS", 3)
    assert css.fit_whole(_arma(200), css.Spec(p=2, q=2, const=True))["status"] == "not converged"
    assert css.fit_whole(np.arange(3.0), css.Spec(p=2, d=1))["status"].startswith("failed")


def test_random_walk_interval_grows():
    spec = css.Spec(d=1)
    y = np.cumsum(np.random.default_rng(1).normal(size=200))
    assert css.spread(spec, [], 1.0, 5) ** 2 == pytest.approx([1, 2, 3, 4, 5])
    assert css.head(spec, [], y, np.zeros(0), 5) == pytest.approx([y[-1]] * 5)


def test_arima_dispatch_runs_and_orders(spark):
    rng = np.random.default_rng(3)
    x = np.zeros(150)
    for t in range(1, 150):
        x[t] = 0.7 * x[t - 1] + rng.normal()
    rows, info = forecast(multi_long(spark, {"ar": (x + 20).tolist()}), "arima", [4, 2])
    r = rows.where("horizon = 4").orderBy("step").collect()
    widths = [x["upper"] - x["lower"] for x in r]
    assert len(r) == 4 and all(b >= a for a, b in zip(widths, widths[1:]))
    i = info.first()
    assert i["status"] == "ok" and i["d"] == 0 and i["p"] >= 1


def test_constant_and_short_series(spark):
    long = multi_long(spark, {"const": [3.0] * 8, "short": [1.0, 2.0, 3.0]})
    rows, info = forecast(long, "lstm", [2])
    assert {r["forecast"] for r in rows.collect()} == {3.0}
    st = {r["series_id"]: r["status"] for r in info.collect()}
    assert st == {"const": "ok", "short": "error"}


def test_argument_checks():
    with pytest.raises(ValueError):
        common.check_model("neural")
    with pytest.raises(ValueError):
        common.check_horizons([3, 0])
    assert common.check_horizons([90, 10, 30, 5]) == [5, 10, 30, 90]


def test_additive_recovers_trend_plus_weekly(spark):
    t = np.arange(120)
    y = 100 + 0.5 * t + 5 * np.sin(2 * np.pi * t / 7)
    rows, info = forecast(multi_long(spark, {"s": y.tolist()}), "prophet", [7])
    got = [r["forecast"] for r in rows.orderBy("step").collect()]
    tt = np.arange(120, 127)
    ref = 100 + 0.5 * tt + 5 * np.sin(2 * np.pi * tt / 7)
    assert np.max(np.abs(np.array(got) - ref)) < 2.0


def test_lag_window_on_linear_series(spark):
    y = (10 + 2 * np.arange(40)).tolist()
    rows, info = forecast(multi_long(spark, {"lin": y}), "lstm", [3])
    got = [r["forecast"] for r in rows.orderBy("step").collect()]
    assert got == pytest.approx([90, 92, 94], abs=1e-6)
    assert info.first()["rmse"] == pytest.approx(0, abs=1e-6)


def test_declined_series_get_status(spark):
    long = multi_long(spark, {"seven": [1.0, 3.0, 2.0, 5.0, 4.0, 6.0, 7.0]})
    rows, info = forecast(long, "lstm", [2])
    assert rows.count() == 0
    r = info.first()
    assert r["status"] == "error" and "lstm" in r["description"]


def _compare(spark, values, model, cut, horizons=(5,), **kw):
    """Forecasts, orders, estimates and metrics of a series cut into pieces and of the whole one."""
    long = multi_long(spark, values)
    out = []
    for chunk in (cut, None):
        rows, info = forecast(long, model, list(horizons), max_chunk=chunk, **kw)
        out.append((rows.orderBy("series_id", "step").collect(), info.orderBy("series_id").collect()))
    (r1, i1), (r2, i2) = out
    assert [r["forecast"] for r in r1] == pytest.approx([r["forecast"] for r in r2], rel=1e-6)
    assert [r["upper"] for r in r1] == pytest.approx([r["upper"] for r in r2], rel=1e-5)
    for a, b in zip(i1, i2):
        for c in ("status", "p", "d", "q"):
            assert a[c] == b[c]
        for c in ("aic", "sigma2", "mse", "mae", "rmse"):
            assert a[c] == pytest.approx(b[c], rel=1e-5)
        assert a["params"] == pytest.approx(b["params"], abs=1e-4)
    return i2


def test_arima_in_pieces_equals_the_whole(spark):
    """Two series cut into pieces (one with a last piece of one point) and a short one beside them."""
    y = np.cumsum(_arma(801, 21, 0.5, 0.4, 0.0)) + 100
    info = _compare(spark, {"a": y.tolist(), "b": _arma(640, 3).tolist(), "c": _arma(60, 5).tolist()}, "arima", 100)
    assert [i["d"] for i in info[:2]] == [1, 0] and all(i["mse"] > 0 for i in info)


def test_sarima_in_pieces_equals_the_whole(spark):
    """The seasonal state of 13 lags passes from piece to piece; n mod 90 lies in the last 1 %."""
    t = np.arange(542)
    y = 50 + 0.05 * t + 3 * np.sin(2 * np.pi * t / 12) + _arma(542, 5, 0.3, 0.2, 0.0)
    info = _compare(spark, {"s": y.tolist()}, "sarima", 90, (15,))
    assert info[0]["aic"] is not None and info[0]["mape"] is not None


def test_holdout_and_in_sample_metrics(spark):
    """Against forecasts and residuals computed point by point."""
    y = _arma(300, 8)
    long = multi_long(spark, {"s": y.tolist()})
    for chunk in (None, 50):
        prep = common.Prepared(long, max_chunk=chunk)
        facts = prep.varying()
        orders = facts.selectExpr("series_id", "1 p", "0 d", "1 q", "0 sp", "0 sd", "0 sq", "0 m")
        parts = arima.pieces(prep, facts, 3)
        spec = css.Spec(p=1, q=1, const=True)
        train = arima.fit_orders(parts, arima._plan(orders, True))
        theta = train.first()["params"]
        e = _residuals(y[:240], spec, theta)
        err = y[240:] - css.head(spec, theta, y[:240], e[-1:], 60)
        got = arima.holdout_metrics(parts, train, 3).first()
        assert got["mse"] == pytest.approx(np.mean(err ** 2), rel=1e-6) and got["mae"] == pytest.approx(np.mean(np.abs(err)), rel=1e-6)
        assert got["mape"] == pytest.approx(100 * np.mean(np.abs(err / y[240:])), rel=1e-6)
        every = arima.fit_orders(parts, arima._plan(orders, False))
        e = _residuals(y, spec, every.first()["params"])
        got = arima.in_sample_metrics(parts, every).first()
        assert got["mse"] == pytest.approx(np.mean(e[-60:] ** 2), rel=1e-6) and got["mae"] == pytest.approx(np.mean(np.abs(e[-60:])), rel=1e-6)
    _, info = forecast(long, "arima", [3], mode="in_sample")
    assert info.first()["mse"] > 0
    with pytest.raises(ValueError):
        forecast(long, "lstm", [3], mode="in_sample")


def test_intervals(spark):
    row = spark.range(1).select(*[F.round(c, 3) for c in (*common.error_interval(F.lit(10.0), F.lit(1.0)), *common.error_interval(F.lit(10.0), F.lit(None).cast("double")))]).first()
    assert list(row) == [8.04, 11.96, 9.0, 11.0]
