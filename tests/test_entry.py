"""Driver contract: entry runs, every oracle belongs to a query, and a sample of
queries match their DuckDB oracle on the small tables."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

SAMPLE = ["zscore_anomalies_events", "describe_events", "histogram_events", "acf_events_daily",
          "kpss_events_daily", "forecast_holt_events_daily", "interpolate_orders_daily"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:4] == ["series_id", "ts", "tiebreak", "value"]
    df.collect()


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    return round(v, 4) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    want = sorted((tuple(_norm(r[ocols.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want
