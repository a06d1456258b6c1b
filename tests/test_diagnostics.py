"""Diagnostics against direct NumPy definitions and published reference values."""
import numpy as np
import pytest
from conftest import multi_long

from sparkseries.operators import decompose, diagnostics, order


def test_acf_matches_numpy(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=120).cumsum()
    got = diagnostics.acf(multi_long(spark, {"a": x.tolist()}), max_chunk=29).orderBy("lag").collect()
    d = x - x.mean()
    ref = [float(d[: len(d) - k] @ d[k:] / (d @ d)) for k in range(21)]
    assert [r["acf"] for r in got] == pytest.approx(ref)


def test_pacf_matches_toeplitz(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=300)
    x = np.zeros(300)
    for t in range(1, 300):
        x[t] = 0.6 * x[t - 1] + e[t]
    rows = diagnostics.autocorrelation(multi_long(spark, {"a": x.tolist()})).orderBy("lag").collect()
    d = x - x.mean()
    n = len(d)
    r = np.array([d[: n - k] @ d[k:] / (n - k) for k in range(21)])
    r[0] = d @ d / n
    for k in (1, 2, 5, 10):
        toe = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        phi = np.linalg.solve(toe, r[1:k + 1])
        assert rows[k]["pacf"] == pytest.approx(phi[-1], rel=1e-8, abs=1e-10)
    assert rows[1]["pacf"] == pytest.approx(0.6, abs=0.1)


def test_shapiro_reference_value(spark):
    vals = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    r = diagnostics.shapiro_wilk(multi_long(spark, {"a": vals})).first()
    assert r["test_statistic"] == pytest.approx(0.7888, abs=5e-4)
    assert r["p_value"] == pytest.approx(0.0067, abs=5e-4)


def test_kpss_and_adf_direction(spark):
    rng = np.random.default_rng(2)
    walk = rng.normal(size=300).cumsum()
    noise = rng.normal(size=300)
    long = multi_long(spark, {"walk": walk.tolist(), "noise": noise.tolist()})
    k = {r["series_id"]: r for r in diagnostics.kpss_test(long).collect()}
    assert not k["walk"]["is_stationary"] and k["noise"]["is_stationary"]
    a = {r["series_id"]: r for r in diagnostics.adf_test(long).collect()}
    assert a["noise"]["is_stationary"] and not a["walk"]["is_stationary"]
    assert a["noise"]["crit_5"] == pytest.approx(-2.87, abs=0.01)
    assert diagnostics.adf_p_value(-2.86) == pytest.approx(0.05, abs=0.003)


def test_k2_against_formula(spark):
    rng = np.random.default_rng(9)
    x = rng.gamma(2.0, size=6000)
    r = diagnostics.dagostino_k2(multi_long(spark, {"a": x.tolist()})).first()
    assert r["p_value"] < 1e-6 and r["test_statistic"] > 100


def test_decompose_recovers_trend_and_season(spark):
    t = np.arange(60)
    season = np.tile([3.0, -1.0, -2.0, 0.5, -0.5, 1.0, -1.0, 2.0, -2.0, 1.5, -1.5, 0.0], 5)
    y = 10 + 0.5 * t + season
    reg = order.with_seq(multi_long(spark, {"s": y.tolist()}))
    for chunk in (13, None):
        out = decompose.seasonal_decompose(reg, 12, max_chunk=chunk).orderBy("seq").collect()
        trend = [r["trend"] for r in out]
        assert trend[:6] == [None] * 6 and trend[-6:] == [None] * 6
        assert trend[6:-6] == pytest.approx((10 + 0.5 * t[6:-6]).tolist())
        assert [r["seasonal"] for r in out[:12]] == pytest.approx((season[:12] - season[:12].mean()).tolist())


def _brute_adf(y):
    """Every regression written out: lags 0..K on the common sample, the chosen one on its own."""
    n = len(y)
    kmax = int(min(np.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    d = np.diff(y)

    def fit(first, lag):
        t = np.arange(first, n)
        x = np.column_stack([y[t - 1], *[d[t - 1 - j] for j in range(1, lag + 1)], np.ones(len(t))])
        beta = np.linalg.lstsq(x, d[t - 1], rcond=None)[0]
        res = d[t - 1] - x @ beta
        return x, beta, res @ res, len(t)

    aic = []
    for lag in range(kmax + 1):
        x, _, ssr, nobs = fit(kmax + 1, lag)
        aic.append(nobs * (np.log(2 * np.pi * ssr / nobs) + 1) + 2 * x.shape[1])
    lag = int(np.argmin(aic))
    x, beta, ssr, nobs = fit(lag + 1, lag)
    return lag, nobs, beta[0] / np.sqrt(ssr / (nobs - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])


def _brute_kpss(y):
    n = len(y)
    x = y - y.mean()
    c = lambda k: x[k:] @ x[:n - k]
    s0, s1 = c(0) / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        s0, s1 = s0 + 2 * c(i) / n, s1 + 2 * i * c(i) / n
    lags = int(min(np.floor(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1))
    s2 = (c(0) + 2 * sum(c(i) * (1 - i / (lags + 1)) for i in range(1, lags + 1))) / n
    return lags, (np.cumsum(x) ** 2).sum() / n ** 2 / s2


@pytest.mark.parametrize("chunk", [None, 400, 7])
def test_adf_kpss_acf_over_pieces(spark, chunk):
    """Series of several lengths, each with its own lag bounds, cut at any size (also below the lags)."""
    rng = np.random.default_rng(9)
    e = rng.normal(size=900)
    ar = np.zeros(900)
    for t in range(2, 900):
        ar[t] = 0.5 * ar[t - 1] + 0.3 * ar[t - 2] + e[t]
    series = {"walk": np.cumsum(e) + 1e4, "ar": ar + 50, "noise": e[:120], "short": e[:9] * 3 + 2, "trend": 0.05 * np.arange(300) + e[:300]}
    long = multi_long(spark, {k: v.tolist() for k, v in series.items()}).repartition(5)
    adf = {r["series_id"]: r for r in diagnostics.adf_test(long, max_chunk=chunk).collect()}
    kpss = {r["series_id"]: r for r in diagnostics.kpss_test(long, max_chunk=chunk).collect()}
    acf = {(r["series_id"], r["lag"]): r["acf"] for r in diagnostics.acf(long, max_chunk=chunk).collect()}
    for k, y in series.items():
        lag, nobs, tau = _brute_adf(y)
        assert (adf[k]["used_lag"], adf[k]["nobs"]) == (lag, nobs) and adf[k]["test_statistic"] == pytest.approx(tau, rel=1e-6)
        lags, stat = _brute_kpss(y)
        assert kpss[k]["lags"] == lags and kpss[k]["test_statistic"] == pytest.approx(stat, rel=1e-9)
        x = y - y.mean()
        for j in range(min(20, len(y) // 2) + 1):
            assert acf[k, j] == pytest.approx(x[j:] @ x[:len(y) - j] / (x @ x), abs=1e-10)


def test_report_sorts_the_points_once(spark):
    """Sections after the first only map over the stored pieces: no exchange of points in their plans."""
    from sparkseries.plans.reports import eda_report
    long = multi_long(spark, {"a": np.random.default_rng(0).normal(size=60).tolist(), "b": list(range(30))})
    out = eda_report(long, sections=("summary_stats", "stationarity_tests", "autocorrelation", "trend_analysis"))
    for name in ("autocorrelation", "trend_analysis"):
        plan = out[name]._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Window [lag(" not in plan and "row_number" not in plan
    last = {r["series_id"]: r for r in out["summary_stats"].collect()}
    assert last["b"]["rolling_mean_last"] == 27.0 and last["b"]["rolling_std_last"] == pytest.approx(np.std([25, 26, 27, 28, 29], ddof=1))
    trend = {r["series_id"]: r for r in out["trend_analysis"].collect()}
    assert trend["b"]["slope"] == pytest.approx(1.0)
