"""Canonical long series derived from the driver's Parquet tables.

Each builder reads only the columns it needs (the scan shows a pruned
``ReadSchema``) and returns the canonical long layout.

* ``events_long``      EV   series=event_type, ts, tiebreak=event_id, value
* ``orders_long``      ORD  series=o_orderpriority, ts=o_orderdate, tiebreak=o_orderkey, value=o_totalprice
* ``lineitem_long``    LI   unpivot of quantity / extendedprice / discount / tax by l_shipdate
* ``orders_wide_daily``     one row per order day, one mean-price column per priority
                            (days without an order of a priority are missing values)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import nan_to_null
from ..operators.roles import to_long
from ..schema import SERIES, TB, TS, VALUE

# The order priorities of the TPC-H order table.
ORDER_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LINEITEM_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias(SERIES), F.col("ts").cast("timestamp_ntz").alias(TS),
                     F.col("event_id").alias(TB), nan_to_null("value").alias(VALUE))


def orders_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias(SERIES),
                    F.col("o_orderdate").cast("timestamp_ntz").alias(TS),
                    F.col("o_orderkey").alias(TB), nan_to_null("o_totalprice").alias(VALUE))


def lineitem_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    keyed = li.withColumn(
        "_tb", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return to_long(keyed, "l_shipdate", LINEITEM_MEASURES, tiebreak="_tb")


def orders_wide_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(day TIMESTAMP_NTZ, <priority>... DOUBLE)``: daily mean order price per priority."""
    o = table(spark, sf_dir, "orders")
    day = F.date_trunc("day", F.col("o_orderdate")).cast("timestamp_ntz").alias("day")
    return (o.groupBy(day).pivot("o_orderpriority", list(ORDER_PRIORITIES))
            .agg(F.avg("o_totalprice")))


def orders_daily_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide daily table back in long form: one row per (priority, order day), with
    NULL where a priority had no order that day (tiebreak = day as epoch seconds)."""
    wide = orders_wide_daily(spark, sf_dir)
    wide = wide.withColumn("_tb", F.unix_timestamp(F.col("day").cast("timestamp")))
    return to_long(wide, "day", list(ORDER_PRIORITIES), tiebreak="_tb")
