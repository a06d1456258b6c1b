"""Registered queries: reports, JSON-safe encoding, sources and sinks (survey R, A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jsonsafe import json_safe
from ..operators import order, roles
from ..schema import SERIES, TB, TS, VALUE
from ..sources import canonical as cz
from ..sources.files import json_lines_report, read_csv, read_json, read_table, scratch_path, write_records, write_result_csv
from ..sources.inline import explode_points
from . import reports
from .catalog import ORACLE, fround, register, rnd, rounded
from .catalog_core import EV, ORD_DAILY, _describe_sql, _summary_sql
from .catalog_series import ord_m
from .sql_series import ORD_M
from .sql_series import SQL as SERIES_SQL


def _r(x: str, d: int = 6) -> str:
    return rnd(x, d)


# ---------------------------------------------------------------- R2
@register("json_safe_events", f"""
SELECT series_id, tiebreak,
       {_r('CASE WHEN value < 50 THEN NULL ELSE sqrt(value - 50) END')} AS root,
       CASE WHEN value > 300 THEN NULL ELSE {_r('value')} END AS capped,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts_iso,
       (CASE WHEN value < 50 THEN 1 ELSE 0 END + CASE WHEN value > 300 THEN 1 ELSE 0 END)::INTEGER AS null_items
FROM ({EV})""")
def q_json_safe_events(spark, sf):
    """R2: NaN (sqrt of a negative) and +Inf become NULL, also inside arrays; time -> ISO text."""
    ev = cz.events_long(spark, sf)
    inf = F.lit(float("inf"))
    raw = ev.select(SERIES, TB, TS, F.sqrt(F.col(VALUE) - 50).alias("root"),
                    F.when(F.col(VALUE) > 300, inf).otherwise(F.col(VALUE)).alias("capped"),
                    F.array(F.sqrt(F.col(VALUE) - 50), F.when(F.col(VALUE) > 300, inf).otherwise(F.col(VALUE))).alias("arr"))
    safe = json_safe(raw)
    return rounded(safe.select(SERIES, TB, "root", "capped", F.col(TS).alias("ts_iso"),
                               F.size(F.filter("arr", lambda x: x.isNull())).alias("null_items")))


# ---------------------------------------------------------------- R3
@register("basic_report_events", f"""
WITH d AS ({_describe_sql(EV)}),
m AS (SELECT series_id, sum(CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END)::BIGINT AS missing_values
      FROM ({EV}) GROUP BY 1),
a AS ({SERIES_SQL['lag1_autocorr_events']}),
s AS (SELECT * FROM ({ORACLE['seasonal_variation_events']}))
SELECT * FROM m LEFT JOIN d USING (series_id) LEFT JOIN a USING (series_id) LEFT JOIN s USING (series_id)""")
def q_basic_report_events(spark, sf):
    """Describe + missing + lag-1 autocorrelation + seasonal variation on EV."""
    return rounded(reports.basic_report(cz.events_long(spark, sf)))


# ---------------------------------------------------------------- R4
BANDS = (f"SELECT 'band:' || series_id || ':' || coalesce(floor(value / 10)::BIGINT::VARCHAR, '') AS series_id, "
         f"ts, tiebreak, value FROM ({EV})")


@register("series_status_mixed", f"""
WITH src AS (SELECT * FROM ({ORD_DAILY}) UNION ALL SELECT * FROM ({BANDS})),
c AS (SELECT series_id, count(*) AS n_rows, count(CASE WHEN NOT isnan(value) THEN value END) AS n,
             min(value) AS mn, max(value) AS mx, count(ts) AS nts FROM src GROUP BY 1)
SELECT series_id, n_rows, n, n = 0 AS all_missing, coalesce(mn = mx, false) AS is_constant,
       n > 1 AS autocorrelation_ok, n >= 3 AS anomaly_ok, n >= 5 AS forecast_ok, n >= 8 AS tests_ok,
       n >= 10 AND nts > 0 AS decomposition_ok,
       CASE WHEN n = 0 THEN 'no_values' WHEN n < 5 THEN 'fewer_than_5'
            WHEN n < 8 THEN 'fewer_than_8: no tests'
            WHEN n < 10 THEN 'fewer_than_10: no decomposition'
            WHEN nts = 0 THEN 'no_time' END AS reason
FROM c""")
def q_series_status_mixed(spark, sf):
    """Qualification per analysis on the daily order table plus all events regrouped by type
    and value band (short series among them)."""
    ev = cz.events_long(spark, sf)
    band = F.floor(F.nanvl(F.col(VALUE), F.lit(None)) / 10).cast("string")
    bands = ev.withColumn(SERIES, F.concat(F.lit("band:"), SERIES, F.lit(":"), F.coalesce(band, F.lit(""))))
    return reports.series_status(cz.orders_daily_long(spark, sf).unionByName(bands))


# ---------------------------------------------------------------- R1
@register("eda_summary_events", f"""
WITH s AS ({_summary_sql(EV)}), r AS ({SERIES_SQL['rolling_last_events']})
SELECT * FROM s LEFT JOIN r USING (series_id)""")
def q_eda_summary_events(spark, sf):
    """R1 summary section: C4 + last rolling mean/std."""
    sections = reports.eda_report(cz.events_long(spark, sf), sections=["summary_stats"])
    return rounded(sections["summary_stats"])


@register("eda_report_orders_monthly")
def q_eda_report_orders_monthly(spark, sf):
    """All six EDA sections rolled up into one row per series (nested STRUCT / ARRAY)."""
    sections = reports.eda_report(ord_m(spark, sf))
    return reports.nested(sections).select(
        SERIES, *[F.to_json(c).alias(c) for c in reports.EDA_SECTIONS])


# ---------------------------------------------------------------- A1 + A5 + A7
@register("csv_roundtrip_orders", f"""
SELECT o_orderpriority AS series_id, count(*) AS n, {rnd('sum(o_totalprice)', 2)} AS total,
       min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM orders GROUP BY 1""")
def q_csv_roundtrip_orders(spark, sf):
    """A7 then A1 + B6: orders exported as '{id}_{kind}' CSV, read back and typed from text, to long form."""
    o = cz.table(spark, sf, "orders").select("o_orderdate", "o_orderkey", "o_orderpriority", "o_totalprice")
    folder = write_result_csv(o, scratch_path(spark, "csv"), "orders", "input")
    back = read_csv(spark, folder)
    back, tcol = roles.resolve_time_column(back)
    long = roles.to_long(back, tcol, ["o_totalprice"], keys=["o_orderpriority"], tiebreak="o_orderkey")
    return rounded(long.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n"), fround(F.sum(VALUE), 2).alias("total"),
                                            F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts")))


# ---------------------------------------------------------------- A2 + A6
@register("json_roundtrip_events", f"""
SELECT series_id, count(*) AS n, {rnd('sum(value)', 4)} AS total, min(ts) AS first_ts, max(ts) AS last_ts
FROM ({EV}) GROUP BY 1""")
def q_json_roundtrip_events(spark, sf):
    """A6 then A2: events written as JSON records and read back."""
    ev = cz.table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    path = write_records(ev, scratch_path(spark, "json") + ".json")
    back = read_table(spark, path)
    back, tcol = roles.resolve_time_column(back, "ts")
    long = roles.to_long(back, tcol, ["value"], keys=["event_type"], tiebreak="event_id")
    return rounded(long.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n"), fround(F.sum(VALUE), 4).alias("total"),
                                            F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts")))


@register("json_bad_lines_events", f"""
SELECT event_type AS series_id, count(*) AS n, {rnd('sum(value)', 4)} AS total,
       (SELECT count(*) FROM events WHERE event_id < 20 OR event_id % 17 = 0) AS bad_lines
FROM events WHERE event_id >= 20 AND event_id % 17 <> 0 GROUP BY 1""")
def q_json_bad_lines_events(spark, sf):
    """A2 + A5: events as JSON lines of which the first twenty and every 17th are cut short; the whole
    ones are all read, the others counted."""
    ev = cz.table(spark, sf, "events").select("event_id", "event_type", "value")
    line = F.to_json(F.struct(*ev.columns))
    bad = (F.col("event_id") < 20) | (F.col("event_id") % 17 == 0)
    path = scratch_path(spark, "badjson") + ".json"
    cut = ev.select(F.when(bad, F.substring(line, 1, 12)).otherwise(line).alias("value"), "event_id")
    cut.repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    lost = json_lines_report(spark, path).agg(F.sum("bad").alias("bad_lines"))
    back = read_table(spark, path).groupBy(F.col("event_type").alias(SERIES)).agg(
        F.count(F.lit(1)).alias("n"), fround(F.sum("value"), 4).alias("total"))
    return rounded(back.join(F.broadcast(lost)))  # one row


@register("json_columns_orders_monthly", f"""
SELECT series_id, count(*) AS n, {rnd('sum(value)', 4)} AS total FROM ({ORD_M}) GROUP BY 1""")
def q_json_columns_orders_monthly(spark, sf):
    """A2 column-oriented documents ({col: {idx: val}}), one per priority and year (bounded), read back."""
    m = order.with_seq(ord_m(spark, sf))
    entry = F.col("seq").cast("string")
    docs = m.groupBy(SERIES, F.year(TS).alias("_y")).agg(
        F.map_from_entries(F.collect_list(F.struct(entry, F.col(SERIES)))).alias("series"),
        F.map_from_entries(F.collect_list(F.struct(entry, F.date_format(TS, "yyyy-MM-dd")))).alias("date"),
        F.map_from_entries(F.collect_list(F.struct(entry, F.col(VALUE)))).alias("value"))
    path = scratch_path(spark, "jsoncols")
    docs.select(F.to_json(F.struct("series", "date", "value")).alias("v")).write.text(path)
    back = read_json(spark, path, orient="columns", lines=True)
    return rounded(back.groupBy(F.col("series").alias(SERIES)).agg(
        F.count(F.lit(1)).alias("n"), fround(F.sum(VALUE), 4).alias("total")))


# ---------------------------------------------------------------- A4
@register("inline_points_orders_daily", f"""
SELECT series_id, count(*) AS n, {rnd('sum(value)', 2)} AS total FROM ({ORD_DAILY})
WHERE value IS NOT NULL GROUP BY 1""")
def q_inline_points_orders_daily(spark, sf):
    """A4: per (priority, month) JSON point payloads exploded back into a long frame (strict)."""
    d = roles.drop_missing(cz.orders_daily_long(spark, sf))
    payloads = d.groupBy(SERIES, F.date_trunc("month", TS).alias("_m")).agg(
        F.to_json(F.collect_list(F.struct(F.date_format(TS, "yyyy-MM-dd").alias("date"),
                                          F.col(VALUE).alias("value")))).alias("payload"))
    rows, _ = explode_points(payloads, "payload", SERIES)
    return rounded(rows.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n"), fround(F.sum(VALUE), 2).alias("total")))


@register("read_table_parquet_lineitem", f"""
SELECT l_returnflag, count(*) AS n, {rnd('sum(l_quantity)', 4)} AS qty FROM lineitem GROUP BY 1""")
def q_read_table_parquet_lineitem(spark, sf):
    """A5: extension dispatch (Parquet) with column pruning reaching the scan."""
    li = read_table(spark, f"{sf.rstrip('/')}/lineitem.parquet")
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), fround(F.sum("l_quantity"), 4).alias("qty"))
