"""Constant and infinite series, JSON lines under any name, all horizons."""

import math

from conftest import multi_long

from sparkseries.operators import anomaly, diagnostics
from sparkseries.operators.forecast.common import check_horizons
from sparkseries.sources.files import read_table, scratch_path, write_records

WAVE = [math.sin(i) + 0.1 * i for i in range(40)]


def test_infinite_value_flags_nothing_by_itself(spark):
    long = multi_long(spark, {"inf": [1, 2, 3, 4, math.inf], "spike": [0.0] * 30 + [50.0]})
    z = anomaly.zscore_anomalies(long, 3.0)
    assert {r["series_id"] for r in z.collect()} == {"spike"}
    rows = anomaly.iqr_anomalies(long, 3.0).collect()
    assert [r["value"] for r in rows if r["series_id"] == "inf"] in ([], [math.inf])


def test_constant_series_does_not_stop_the_others(spark):
    long = multi_long(spark, {"flat": [5.0] * 40, "wave": WAVE})
    kpss = {r["series_id"]: r["test_statistic"] for r in diagnostics.kpss_test(long).collect()}
    assert kpss["flat"] is None and kpss["wave"] > 0
    w = {r["series_id"]: r["test_statistic"] for r in diagnostics.normality_test(long, method="shapiro").collect()}
    assert w["flat"] is None and 0 < w["wave"] <= 1


def test_json_lines_under_a_json_name(spark):
    df = spark.range(24).selectExpr("id", "id * 2.5d as v")
    path = scratch_path(spark, "lines") + ".json"
    write_records(df, path)
    assert read_table(spark, path).count() == 24


def test_a_bad_json_line_does_not_lose_the_others(spark):
    lines = [f'{{"id": {i}, "v": {i * 2.5}}}' for i in range(1000)]
    for bad in (0, 3):
        path = scratch_path(spark, "bad") + ".json"
        text = [x[:9] if i == bad else x for i, x in enumerate(lines)]
        spark.createDataFrame([(x,) for x in text], "value string").coalesce(1).write.text(path)
        assert read_table(spark, path).where("v is not null").count() == 999


def test_all_horizons_are_kept():
    assert check_horizons([9, 1, 4, 2, 4]) == [1, 2, 4, 9]
