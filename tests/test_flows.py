"""End-to-end user flows on the fixture shapes: wide file -> roles -> long -> reports."""
import json
import math
import os
import tempfile

import numpy as np
import pytest
from conftest import multi_long
from pyspark.sql import functions as F

from sparkseries.functions.jsonsafe import to_json_rows
from sparkseries.operators import roles
from sparkseries.operators.forecast.dispatch import forecast
from sparkseries.plans import reports
from sparkseries.sources.files import read_table


@pytest.fixture(scope="module")
def wide_long(spark):
    rng = np.random.default_rng(7)
    days = 126
    week = np.tile([3.0, 1.0, 0.0, -1.0, -2.0, 0.5, -1.5], days // 7)
    value = 40 - 0.08 * np.arange(days) + week + rng.normal(scale=0.7, size=days)
    value2 = 200 + np.cumsum(rng.normal(scale=2.0, size=days))
    path = os.path.join(tempfile.mkdtemp(prefix="sparkseries-flow-"), "daily.csv")
    with open(path, "w") as f:
        f.write("date,value,value2\n")
        for i in range(days):
            v = "" if i in (20, 21, 60) else f"{value[i]:.6f}"
            v2 = "NaN" if i >= 120 else f"{value2[i]:.6f}"
            f.write(f"{np.datetime64('2021-03-01') + i},{v},{v2}\n")
    df = read_table(spark, path)
    df, tcol = roles.resolve_time_column(df)
    cols = roles.numeric_columns(df, exclude=[tcol])
    return roles.to_long(df, tcol, cols)


def test_eda_report_all_sections(wide_long):
    sections = reports.eda_report(wide_long)
    assert set(sections) == set(reports.EDA_SECTIONS)
    for name, df in sections.items():
        got = {r["series_id"] for r in df.select("series_id").distinct().collect()}
        assert got == {"value", "value2"}, name
    summary = {r["series_id"]: r for r in sections["summary_stats"].collect()}
    assert summary["value"]["missing_values"] == 3 and summary["value2"]["missing_values"] == 6
    assert summary["value"]["count"] == 123
    dec = sections["seasonal_decomposition"].where("series_id = 'value'").collect()
    assert {r["frequency"] for r in dec} == {"D"} and len(dec) == 126
    nested = reports.nested(sections)
    docs = [json.loads(r["json"]) for r in to_json_rows(nested).collect()]
    assert len(docs) == 2
    text = json.dumps(docs)
    assert "NaN" not in text and "Infinity" not in text


def test_forecast_flow_all_columns(wide_long):
    for model in ("exponential_smoothing", "lstm", "arima"):
        rows, info = forecast(wide_long, model, [7, 3])
        counts = {(r["series_id"], r["horizon"]): r["count"]
                  for r in rows.groupBy("series_id", "horizon").count().collect()}
        assert counts == {("value", 3): 3, ("value", 7): 7, ("value2", 3): 3, ("value2", 7): 7}
        assert {r["status"] for r in info.collect()} == {"ok"}


def test_mixed_types_roles(spark):
    from datetime import datetime
    nan, inf = float("nan"), float("inf")
    rows = [(datetime(2024, 1, d), d, d * 1.5, f"s{d}", d % 2 == 0, nan if d in (1, 5) else float(d),
             inf if d == 1 else (-inf if d == 5 else float(d))) for d in range(1, 6)]
    df = spark.createDataFrame(rows, "date timestamp_ntz, int_values long, float_values double, "
                                     "string_values string, bool_values boolean, nan_values double, inf_values double")
    df, tcol = roles.resolve_time_column(df)
    cols = roles.numeric_columns(df, exclude=[tcol])
    assert cols == ["int_values", "float_values", "nan_values", "inf_values"]
    long = roles.to_long(df, tcol, cols)
    clean = {r["series_id"]: r["count"] for r in roles.drop_missing(long).groupBy("series_id").count().collect()}
    assert clean == {"int_values": 5, "float_values": 5, "nan_values": 3, "inf_values": 5}
    s = {r["series_id"]: r for r in reports.basic_report(long).collect()}
    assert s["nan_values"]["missing_values"] == 2 and math.isnan(s["inf_values"]["mean"])


def test_report_survives_a_failing_section(spark, monkeypatch):
    """One section whose side job fails: its rows say so, the other sections are there."""
    from sparkseries.operators import diagnostics
    from sparkseries.plans.reports import eda_report, nested

    def broken(*a, **kw):
        return spark.range(1).select(F.raise_error(F.lit("no"))).collect()

    monkeypatch.setattr(diagnostics, "autocorrelation", broken)
    long = multi_long(spark, {"a": [float(i % 7) for i in range(40)], "b": [1.0, 2.0]})
    out = eda_report(long, sections=("autocorrelation", "trend_analysis"))
    assert {r["status"].split(":")[0] for r in out["autocorrelation"].collect()} == {"failed"}
    rows = {r["series_id"]: r for r in nested(out).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["trend_analysis"]["status"] == "ok"
