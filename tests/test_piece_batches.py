"""Long series: bounded Python batches, and ranges that do not grow with the pieces."""

import numpy as np
import pandas as pd
from conftest import multi_long
from pyspark.sql import functions as F

from sparkseries.operators import order
from sparkseries.session import MAX_BATCH_BYTES, ensure_checkpoint_dir


def test_pieces_reach_python_in_bounded_batches(spark):
    ensure_checkpoint_dir(spark)
    rows = spark.range(0, 400, 1, 1).select("id", F.array_repeat(F.col("id").cast("double"), 16_384).alias("ys"))

    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    got = [r["n"] for r in rows.mapInPandas(sizes, "n long").collect()]
    assert sum(got) == 400 and max(got) <= MAX_BATCH_BYTES // (8 * 16_384) + 1


def test_ranges_are_not_as_many_as_pieces(spark):
    long = multi_long(spark, {"a": list(np.arange(600.0)), "b": list(np.arange(50.0)), "c": [1.0, 2.0]})
    out = order.with_seq(long, max_chunk=10)
    assert out.where("series_id = 'a'").rdd.getNumPartitions() < 60
    got = {(r["series_id"], r["seq"]): r["value"] for r in out.collect()}
    assert len(got) == 652 and all(got["a", i] == i for i in range(600)) and all(got["b", i] == i for i in range(50))
