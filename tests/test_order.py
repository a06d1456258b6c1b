"""The skew-safe paths (range-partitioned positions, halo chunks, chunk prefix sums)
must give exactly the single-window answers; a small chunk size forces them."""
import numpy as np
import pytest
from conftest import multi_long
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkseries.operators import calendar as cal
from sparkseries.operators import order

CHUNK = 37


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    series = {"big": np.cumsum(rng.normal(size=400)).tolist(), "small": rng.normal(size=25).tolist()}
    return multi_long(spark, series)


def _plain_seq(df):
    w = Window.partitionBy("series_id").orderBy("ts", "tiebreak")
    return df.withColumn("seq_ref", F.row_number().over(w) - 1)


def test_with_seq_range_path_equals_window(data):
    got = order.with_seq(data, max_chunk=CHUNK)
    ref = _plain_seq(data)
    j = got.join(ref, ["series_id", "tiebreak"])
    assert j.where(F.col("seq") != F.col("seq_ref")).count() == 0
    assert j.count() == data.count()


def test_range_path_has_no_single_partition(data):
    got = order.lag1_autocorr(data, max_chunk=CHUNK)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_halo_lags_and_rolling_equal_plain(data):
    small, _ = order.rolling_stats(data, window=5, max_chunk=CHUNK)
    big, _ = order.rolling_stats(data, window=5, max_chunk=1 << 20)
    a = {(r["series_id"], r["seq"]): r for r in small.collect()}
    b = {(r["series_id"], r["seq"]): r for r in big.collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c in ("rolling_mean", "rolling_std"):
            if b[k][c] is None:
                assert a[k][c] is None
            else:
                assert a[k][c] == pytest.approx(b[k][c], rel=1e-9)


def test_difference_and_cumsum_chunked(data):
    d1 = order.difference(data, d=1, seasonal_d=1, m=7, max_chunk=CHUNK)
    d2 = order.difference(data, d=1, seasonal_d=1, m=7)
    a = {(r["series_id"], r["seq"]): r["value"] for r in d1.collect()}
    b = {(r["series_id"], r["seq"]): r["value"] for r in d2.collect()}
    assert a.keys() == b.keys()
    assert all((a[k] is None and b[k] is None) or a[k] == pytest.approx(b[k]) for k in a)
    c1 = order.cumulative_sum(order.with_seq(data, max_chunk=CHUNK), max_chunk=CHUNK)
    pdf = c1.toPandas().sort_values(["series_id", "seq"])
    for sid, g in pdf.groupby("series_id"):
        assert np.allclose(g["cumsum"].to_numpy(), np.cumsum(g["value"].to_numpy()))


def test_interpolation_across_chunks(spark):
    vals = [None, None, 1.0] + [None] * 50 + [52.0, 55.0] + [None] * 5
    long = multi_long(spark, {"g": vals})
    reg = order.with_seq(long)
    for chunk in (CHUNK, 1 << 20):
        out = cal.interpolate_linear(reg, max_chunk=chunk).orderBy("seq").collect()
        got = [r["value"] for r in out]
        assert got[:2] == [None, None]
        assert got[2:54] == pytest.approx(list(np.arange(1.0, 52.0 + 1e-9, 1.0)))
        assert got[-5:] == [55.0] * 5


def test_last_n_and_split(data):
    seqd = order.with_seq(data)
    assert order.last_n(seqd, 3).groupBy("series_id").count().where("count != 3").count() == 0
    s = order.chronological_split(seqd).where(F.col("series_id") == "small")
    assert s.where(F.col("split") == "train").count() == 20


def test_resample_labels(spark):
    long = multi_long(spark, {"a": list(range(40))}, start="2024-01-01")
    w = cal.resample_mean(long, "W").orderBy("ts").collect()
    assert str(w[0]["ts"].date()) == "2024-01-07"  # weeks end on Sunday
    m = cal.resample_mean(long, "M").orderBy("ts").collect()
    assert [str(r["ts"].date()) for r in m] == ["2024-01-31", "2024-02-29"]


def test_infer_frequency_codes(spark):
    daily = multi_long(spark, {"d": [1.0] * 10})
    weekly = multi_long(spark, {"w": [1.0] * 10}, start="2024-01-07", freq_days=7)
    out = {r["series_id"]: r["freq"] for r in cal.infer_frequency(daily.unionByName(weekly)).collect()}
    assert out == {"d": "D", "w": "W-SUN"}


def test_future_dates_month_end(spark):
    last = spark.createDataFrame([("m", "2001-08-31 00:00:00", "M", 80)], "series_id string, last_ts string, freq string, n long") \
        .withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))
    got = [str(r["ts"].date()) for r in cal.future_dates(last, 3).orderBy("step").collect()]
    assert got == ["2001-09-30", "2001-10-31", "2001-11-30"]


def test_range_path_stable_when_boundaries_are_sampled(spark):
    """Enough rows that the range partitioner samples (boundaries are not exact): positions
    must still be exact and consistent inside a larger downstream plan."""
    n = 60_000
    hot = spark.range(0, n, numPartitions=6).select(
        F.lit("hot").alias("series_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("tiebreak"), F.sin(F.col("id") / 100.0).alias("value"))
    small = spark.range(0, 3000, numPartitions=3).select(
        (F.col("id") % 30).cast("string").alias("series_id"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("tiebreak"), F.cos(F.col("id")).alias("value"))
    long = hot.unionByName(small)
    full, _ = order.rolling_stats(long, window=5, max_chunk=5000)
    g = {r["h"]: r for r in full.groupBy((F.col("series_id") == "hot").alias("h")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("rolling_mean").alias("nn"),
        F.countDistinct("series_id", "seq").alias("d")).collect()}
    assert (g[True]["rows"], g[True]["nn"], g[True]["d"]) == (n, n - 4, n)
    assert (g[False]["rows"], g[False]["nn"], g[False]["d"]) == (3000, 3000 - 30 * 4, 3000)


def test_business_day_month_start_and_hourly(spark):
    from datetime import datetime, timedelta

    rows = []
    d = datetime(2024, 1, 1)  # a Monday
    while len(rows) < 15:
        if d.weekday() < 5:
            rows.append(("b", d, len(rows), 1.0))
        d += timedelta(days=1)
    for i in range(6):
        rows.append(("ms", datetime(2024, 1 + i, 1), i, 1.0))
    for i in range(30):
        rows.append(("h", datetime(2024, 1, 1) + timedelta(hours=i), i, 1.0))
    long = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, tiebreak long, value double")
    freq = {r["series_id"]: r["freq"] for r in cal.infer_frequency(long).collect()}
    assert freq == {"b": "B", "ms": "MS", "h": "h"}
    last = long.groupBy("series_id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")) \
        .join(cal.infer_frequency(long), "series_id")
    fut = {}
    for r in cal.future_dates(last, 3).collect():
        fut.setdefault(r["series_id"], []).append((r["step"], r["ts"]))
    steps = {k: [t for _, t in sorted(v)] for k, v in fut.items()}
    # last business day is Friday 2024-01-19 -> Mon 22, Tue 23, Wed 24
    assert [t.date().isoformat() for t in steps["b"]] == ["2024-01-22", "2024-01-23", "2024-01-24"]
    assert [t.date().isoformat() for t in steps["ms"]] == ["2024-07-01", "2024-08-01", "2024-09-01"]
    assert [t.isoformat() for t in steps["h"]] == ["2024-01-02T06:00:00", "2024-01-02T07:00:00", "2024-01-02T08:00:00"]
