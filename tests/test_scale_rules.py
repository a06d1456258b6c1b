"""One path for every size, hot values, infinite values, sub-second steps, hints below explode."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import multi_long
from pyspark.sql import functions as F

from sparkseries.operators import calendar as cal
from sparkseries.operators import diagnostics, isolation, linalg, stats
from sparkseries.plans import reports

WAVE = [math.sin(i) + 0.1 * i for i in range(40)]


def test_quantiles_with_one_hot_value(spark):
    rng = np.random.default_rng(3)
    a = [7.0] * 900 + list(rng.normal(size=100))
    b = list(rng.normal(size=37))
    long = multi_long(spark, {"hot": a, "free": b})
    for chunk in (None, 16):
        got = {(r["series_id"], r["q"]): r["quantile"]
               for r in stats.quantiles(long, [0.0, 0.03, 0.25, 0.5, 1.0], max_chunk=chunk).collect()}
        for name, v in (("hot", a), ("free", b)):
            for q in (0.0, 0.03, 0.25, 0.5, 1.0):
                assert got[name, q] == pytest.approx(np.quantile(v, q), abs=1e-12)


def test_histogram_counts_infinite_values_apart(spark):
    rows = stats.histogram(multi_long(spark, {"x": [1.0, 2.0, 3.0, 4.0, math.inf, math.inf, -math.inf]})).collect()
    by = {r["bin"]: r["n"] for r in rows}
    assert by[-1] == 1 and by[5] == 2 and sum(by[i] for i in range(5)) == 4
    only = stats.histogram(multi_long(spark, {"x": [1.0, 2.0, 3.0]})).collect()
    assert sum(r["n"] for r in only) == 3 and len(only) == 5


def test_infinite_series_does_not_stop_adf(spark):
    # noise: a pure sinusoid obeys a linear recurrence, which the regression fits without error
    noisy = [w + e for w, e in zip(WAVE, np.random.default_rng(2).normal(size=len(WAVE)))]
    long = multi_long(spark, {"inf": [*noisy[:-1], math.inf], "wave": noisy})
    got = {r["series_id"]: r["test_statistic"] for r in diagnostics.adf_test(long).collect()}
    assert math.isfinite(got["wave"]) and (got["inf"] is None or math.isnan(got["inf"]))


def test_gram_sends_partial_sums_on(spark, monkeypatch):
    df = spark.range(600).selectExpr("cast(id % 50 as string) as series_id", "cast(id as double) as x", "1d as y")
    def run():
        return sorted(map(tuple, linalg.gram(df, ["x", "y"]).collect()))
    whole = run()
    monkeypatch.setattr(linalg, "PARTIAL_BYTES", 256)
    assert run() == whole


def test_sample_size_is_alike_below_and_above_the_pool(spark):
    rng = np.random.default_rng(5)
    for n in (300, 4000):
        v = list(rng.normal(size=n - 1)) + [60.0]
        out = isolation.isolation_forest_anomalies(multi_long(spark, {"s": v}), n_trees=20, flagged_only=False)
        rows = out.collect()
        assert len(rows) == n
        assert max(rows, key=lambda r: r["score"])["value"] == 60.0
        assert 0 < sum(r["is_anomaly"] for r in rows) <= 0.05 * n + 1


def test_sub_second_steps(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("ms", t0 + timedelta(milliseconds=100 * i), i, 1.0) for i in range(5)]
    rows += [("us", t0 + timedelta(microseconds=7 * i), i, 1.0) for i in range(5)]
    long = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, tiebreak long, value double")
    freq = cal.infer_frequency(long)
    assert {r["series_id"]: r["freq"] for r in freq.collect()} == {"ms": "100ms", "us": "7us"}
    last = long.groupBy("series_id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")).join(freq, "series_id")
    got = {(r["series_id"], r["step"]): r["ts"] for r in cal.future_dates(last, 2).collect()}
    assert got["ms", 2] == t0 + timedelta(milliseconds=600) and got["us", 1] == t0 + timedelta(microseconds=35)


def test_normality_status_and_no_size_switch(spark):
    rng = np.random.default_rng(8)
    long = multi_long(spark, {"flat": [5.0] * 40, "long": list(rng.normal(size=5200)), "short": WAVE[:6],
                              "inf": [*WAVE, math.inf], "wave": WAVE})
    k2 = {r["series_id"]: r for r in diagnostics.normality_test(long).collect()}
    sw = {r["series_id"]: r for r in diagnostics.normality_test(long, method="shapiro").collect()}
    assert {k: r["status"] for k, r in k2.items()} == {
        "flat": "undefined", "long": "ok", "short": "not_applicable", "inf": "undefined", "wave": "ok"}
    assert {k: r["status"] for k, r in sw.items()} == {
        "flat": "undefined", "long": "not_applicable", "short": "ok", "inf": "undefined", "wave": "ok"}
    assert all((r["test_statistic"] is None) == (r["status"] != "ok") for r in [*k2.values(), *sw.values()])


def test_every_section_lists_every_series(spark):
    long = multi_long(spark, {"flat": [5.0] * 40, "three": [1.0, 2.0, 4.0], "none": [None] * 12, "wave": WAVE})
    sections = reports.eda_report(long)
    for name, df in sections.items():
        rows = df.collect()
        assert {r["series_id"] for r in rows} == {"flat", "three", "none", "wave"}, name
        assert {r["status"] for r in rows if r["series_id"] == "wave"} <= {"ok", "undefined"}, name
        assert "ok" not in {r["status"] for r in rows if r["series_id"] in ("three", "none")}, name
    assert reports.nested(sections).count() == 4
    assert set(reports.eda_report(long, sections=["trend_analysis"])) == {"trend_analysis"}


def test_horizon_rows_carry_no_broadcast_hint(spark):
    from sparkseries.operators.forecast.common import Prepared, steps_for
    prep = Prepared(multi_long(spark, {"a": WAVE, "b": WAVE[::-1]}))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = steps_for(prep, prep.ok, [500])
        assert steps.count() == 1000
        plan = prep.clean.join(steps, "series_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "SortMergeJoin" in top, top
