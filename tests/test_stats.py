"""Hand-computed goldens on the 5-row linear fixture, plus constant / missing edge cases."""
import math

import numpy as np
import pytest
from conftest import long_df, multi_long

from sparkseries.operators import anomaly, order, roles, stats

LINEAR = [("2023-01-01", 100), ("2023-01-02", 105), ("2023-01-03", 110), ("2023-01-04", 115), ("2023-01-05", 120)]


def test_describe_linear(spark):
    r = stats.describe(long_df(spark, LINEAR)).first()
    assert r["count"] == 5 and r["mean"] == 110 and r["min"] == 100 and r["max"] == 120
    assert r["std"] == pytest.approx(7.905694, abs=1e-6)
    assert (r["q25"], r["q50"], r["q75"]) == (105, 110, 115)


def test_summary_moments(spark):
    r = stats.summary_stats(long_df(spark, LINEAR)).first()
    assert r["skewness"] == pytest.approx(0.0, abs=1e-12)
    assert r["kurtosis"] == pytest.approx(-1.3, abs=1e-12)
    assert r["missing_values"] == 0 and r["status"] == "ok"


def test_missing_counted_on_raw_column(spark):
    rows = LINEAR + [("2023-01-06", None), ("2023-01-07", float("nan"))]
    r = stats.summary_stats(long_df(spark, rows)).first()
    assert r["missing_values"] == 2 and r["count"] == 5
    assert r["missing_percentage"] == pytest.approx(200 / 7)


def test_trend_linear(spark):
    r = stats.linear_trend(long_df(spark, LINEAR)).first()
    assert r["slope"] == pytest.approx(5) and r["intercept"] == pytest.approx(100)
    assert r["r_squared"] == pytest.approx(1) and r["p_value"] == 0.0
    assert r["significant_trend"] and r["direction"] == "increasing"


def test_trend_p_value_matches_t_table(spark):
    from sparkseries.functions.dist import t_sf_two_sided
    assert t_sf_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    rng = np.random.default_rng(3)
    y = 0.05 * np.arange(40) + rng.normal(size=40)
    r = stats.linear_trend(multi_long(spark, {"a": y.tolist()})).first()
    x = np.arange(40)
    slope, icpt = np.polyfit(x, y, 1)
    resid = y - (slope * x + icpt)
    se = math.sqrt(resid @ resid / 38 / ((x - x.mean()) @ (x - x.mean())))
    assert r["p_value"] == pytest.approx(t_sf_two_sided(slope / se, 38), rel=1e-6)


def test_lag1_autocorr_linear(spark):
    r = order.lag1_autocorr(long_df(spark, LINEAR)).first()
    assert r["lag1_autocorr"] == pytest.approx(1.0)


def test_no_anomalies_on_linear(spark):
    long = long_df(spark, LINEAR)
    assert anomaly.zscore_anomalies(long).count() == 0
    assert anomaly.iqr_anomalies(long).count() == 0


def test_constant_series(spark):
    long = multi_long(spark, {"c": [7.0] * 12})
    assert anomaly.zscore_anomalies(long).count() == 0
    h = stats.histogram(long).orderBy("bin").collect()
    assert len(h) == 5 and h[0]["bin_lo"] == 6.5 and h[-1]["bin_hi"] == 7.5
    assert sum(r["n"] for r in h) == 12
    assert roles.is_constant(long).first()["is_constant"]


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vals = rng.normal(size=537)
    h = stats.histogram(multi_long(spark, {"a": vals.tolist()})).orderBy("bin").collect()
    counts, edges = np.histogram(vals, bins=min(20, max(5, len(vals) // 10)))
    assert [r["n"] for r in h] == counts.tolist()
    assert [r["bin_lo"] for r in h] == pytest.approx(edges[:-1].tolist())


def test_quantiles_exact_both_paths(spark):
    rng = np.random.default_rng(1)
    vals = np.round(rng.exponential(size=301), 3)
    long = multi_long(spark, {"a": vals.tolist(), "b": vals[:17].tolist()})
    for chunk in (None, 40):
        q = stats.quantile_columns(long, {"q1": .25, "q5": .05, "q9": .95}, max_chunk=chunk)
        got = {r["series_id"]: r for r in q.collect()}
        for sid, v in (("a", vals), ("b", vals[:17])):
            for name, p in (("q1", .25), ("q5", .05), ("q9", .95)):
                assert got[sid][name] == pytest.approx(float(np.quantile(v, p)))


def test_forecast_metrics_zero_policies(spark):
    df = spark.createDataFrame([("s", 0.0, 1.0), ("s", 2.0, 1.0), ("s", 4.0, 5.0)],
                               "series_id string, actual double, forecast double")
    a = stats.forecast_metrics(df, zero_policy="null").first()
    b = stats.forecast_metrics(df, zero_policy="skip").first()
    assert a["mape"] is None
    assert b["mape"] == pytest.approx((0.5 + 0.25) / 2 * 100)
    assert a["mse"] == pytest.approx(1.0) and a["mae"] == pytest.approx(1.0)


def test_quantiles_from_counts_exact(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(8)
    vals = rng.integers(0, 12, size=257).astype(float)
    long = multi_long(spark, {"a": vals.tolist()})
    counts = long.groupBy("series_id", "value").agg(F.count(F.lit(1)).alias("cnt"))
    got = {r["q"]: r["quantile"] for r in stats.quantiles_from_counts(counts, [0.05, 0.5, 0.95, 1.0]).collect()}
    for p in (0.05, 0.5, 0.95, 1.0):
        assert got[p] == pytest.approx(float(np.quantile(vals, p)))


def test_quantiles_of_a_long_series_by_brackets(spark):
    """Brackets far narrower than the series: distinct, tied and infinite values, several prob orders."""
    rng = np.random.default_rng(6)
    values = {"distinct": rng.normal(size=20_000), "tied": rng.integers(0, 7, 9_000).astype(float),
              "hot": np.r_[np.zeros(8_000), rng.normal(size=4_000)], "inf": np.r_[[np.inf] * 3000, [-np.inf] * 10, rng.normal(size=3000)], "one": np.array([4.0])}
    long = spark.createDataFrame([(k, None, i, float(x)) for k, v in values.items() for i, x in enumerate(v)],
                                 "series_id string, ts timestamp_ntz, tiebreak long, value double").repartition(6)
    probs = [0.9, 0.001, 0.25, 0.5, 0.9999, 0.0, 1.0, 0.25]
    for chunk in (None, 40):
        got = {r["series_id"]: r["quantiles"] for r in stats.quantile_table(long, probs, max_chunk=chunk).collect()}
        for k, v in values.items():
            with np.errstate(invalid="ignore"):
                want = np.sort(v)
                for p, x in zip(probs, got[k]):
                    h = (len(v) - 1) * p
                    lo, hi = want[int(h)], want[min(int(h) + 1, len(v) - 1)]
                    assert x == (lo if h == int(h) or lo == hi else pytest.approx(lo + (hi - lo) * (h - int(h))))


def test_quantiles_when_brackets_miss(spark, monkeypatch):
    """A sketch that is off: the series is sorted whole and the answer is the same."""
    monkeypatch.setattr(stats, "MARGIN", -0.01)
    v = np.random.default_rng(2).normal(size=3000)
    long = spark.createDataFrame([("a", None, i, float(x)) for i, x in enumerate(v)], "series_id string, ts timestamp_ntz, tiebreak long, value double")
    wide = stats.quantile_table(long, [0.25, 0.75]).first()["quantiles"]
    assert wide == pytest.approx(np.quantile(v, [0.25, 0.75]).tolist())
