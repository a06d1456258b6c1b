import numpy as np
import pytest
from conftest import multi_long

from sparkseries.operators import anomaly


@pytest.fixture(scope="module")
def spiky(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=1000)
    v[::100] += 12.0
    return multi_long(spark, {"s": v.tolist()}), v


def test_zscore_flags_spikes(spiky):
    long, v = spiky
    got = {r["tiebreak"] for r in anomaly.zscore_anomalies(long, 3).collect()}
    assert set(range(0, 1000, 100)) <= got


def test_isolation_forest_share_and_determinism(spiky):
    long, v = spiky
    a = anomaly.detect_anomalies(long, "isolation_forest")
    rows = {r["tiebreak"] for r in a.collect()}
    assert 40 <= len(rows) <= 50
    assert set(range(0, 1000, 100)) <= rows
    again = {r["tiebreak"] for r in anomaly.detect_anomalies(long, "isolation_forest").collect()}
    assert rows == again


def test_dispatcher_validates(spiky):
    long, _ = spiky
    with pytest.raises(ValueError):
        anomaly.detect_anomalies(long, "lof")
    s = anomaly.anomaly_summary(long, anomaly.detect_anomalies(long, "zscore")).first()
    assert s["total_points"] == 1000 and s["anomalies_count"] >= 10


def test_side_table_over_byte_bound_is_not_broadcast(spark, spiky):
    long, _ = spiky
    want = {r["tiebreak"] for r in anomaly.zscore_anomalies(long, 3).collect()}
    spark.conf.set("sparkseries.broadcastMaxBytes", "10")
    try:
        df = anomaly.zscore_anomalies(long, 3)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "broadcast" not in plan.lower()
        assert {r["tiebreak"] for r in df.collect()} == want
    finally:
        spark.conf.unset("sparkseries.broadcastMaxBytes")
