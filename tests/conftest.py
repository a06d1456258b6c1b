import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="sparkseries-test-ckpt-")
    s = (SparkSession.builder.master("local[4]").appName("sparkseries-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", ckpt)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from sparkseries.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s


def long_df(spark, rows, series="s"):
    """rows: list of (ts_string_or_None, value) -> canonical long frame."""
    from datetime import datetime
    data = []
    for i, (ts, v) in enumerate(rows):
        t = datetime.fromisoformat(ts) if ts else None
        data.append((series, t, i, None if v is None else float(v)))
    return spark.createDataFrame(data, "series_id string, ts timestamp_ntz, tiebreak long, value double")


def multi_long(spark, series_values: dict, start="2020-01-01", freq_days=1):
    from datetime import datetime, timedelta
    base = datetime.fromisoformat(start)
    data = []
    for sid, vals in series_values.items():
        for i, v in enumerate(vals):
            data.append((sid, base + timedelta(days=i * freq_days), i, None if v is None else float(v)))
    return spark.createDataFrame(data, "series_id string, ts timestamp_ntz, tiebreak long, value double")
