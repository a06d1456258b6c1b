"""Inline point payloads (survey A4): ``[{"date": ..., "value": ...}, ...]``.

Each payload is one request body; ``explode_points`` turns a column of such
JSON documents into canonical long rows.  ``strict=True`` fails on any item
whose date or value does not parse (the request-level rule); ``strict=False``
keeps the good rows and reports a per-series bad-row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SERIES, TB, TS, VALUE

POINTS_SCHEMA = "array<struct<date:string,value:string>>"


def explode_points(df: DataFrame, payload: str = "payload", series: str | None = None,
                   strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """``df[payload]`` JSON text -> long rows ``(series_id, ts, tiebreak, value)`` plus
    ``(series_id, bad_points)``."""
    sid = F.col(series) if series else F.lit("value")
    items = df.select(sid.cast("string").alias(SERIES),
                      F.posexplode(F.from_json(F.col(payload), POINTS_SCHEMA)).alias("_pos", "_p"))
    ts = F.try_to_timestamp(F.col("_p.date")).cast("timestamp_ntz")
    val = F.col("_p.value").try_cast("double")
    parsed = items.select(SERIES, ts.alias(TS), F.col("_pos").cast("bigint").alias(TB), val.alias(VALUE),
                          (ts.isNull() | val.isNull()).alias("_bad"))
    bad = parsed.groupBy(SERIES).agg(F.sum(F.col("_bad").cast("int")).cast("bigint").alias("bad_points"))
    if strict:
        # raise_error aborts the job on the first malformed item, like the request-level check
        checked = parsed.withColumn(
            "_ok", F.when(F.col("_bad"), F.raise_error(F.lit("a payload item has no readable date or value"))).otherwise(F.lit(True)))
        return checked.where("_ok").drop("_bad", "_ok"), bad
    return parsed.where(~F.col("_bad")).drop("_bad"), bad


def from_points(spark: SparkSession, points: list[dict], series: str = "value") -> DataFrame:
    """A small in-memory payload (one request) as a long frame."""
    import json
    df = spark.createDataFrame([(series, json.dumps(points))], "series string, payload string")
    rows, _ = explode_points(df, "payload", "series")
    return rows
