"""Registered queries: roles, statistics and anomalies (survey B, C, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, roles, stats
from ..schema import SERIES, TB, TS, VALUE
from ..sources import canonical as cz
from .catalog import fround, register, rnd, rounded

# ---------------------------------------------------------------- SQL building blocks
EV = """SELECT event_type AS series_id, ts, event_id AS tiebreak,
       CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM events"""

LI = """SELECT 'l_quantity' AS series_id, l_shipdate AS ts, l_quantity AS value FROM lineitem
UNION ALL SELECT 'l_extendedprice', l_shipdate, l_extendedprice FROM lineitem
UNION ALL SELECT 'l_discount', l_shipdate, l_discount FROM lineitem
UNION ALL SELECT 'l_tax', l_shipdate, l_tax FROM lineitem"""

# wide daily pivot (day x priority) back to long: NULL where a priority had no order that day
ORD_DAILY = """SELECT p.series_id, d.day AS ts, epoch(d.day)::BIGINT AS tiebreak, a.value
FROM (SELECT DISTINCT date_trunc('day', o_orderdate) AS day FROM orders) d
CROSS JOIN (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW']) AS series_id) p
LEFT JOIN (SELECT date_trunc('day', o_orderdate) AS day, o_orderpriority AS series_id,
                  avg(o_totalprice) AS value FROM orders GROUP BY 1, 2) a
  ON a.day = d.day AND a.series_id = p.series_id"""


def _r(x: str, d: int = 6) -> str:
    return rnd(x, d)


# ---------------------------------------------------------------- B: roles & reshape
@register("to_long_orders_daily", f"""
SELECT series_id, ts, tiebreak, {_r('value')} AS value FROM ({ORD_DAILY})""")
def q_to_long_orders_daily(spark, sf):
    """B4 + B1 + B2 + B5: wide (day x priority) table unpivoted to the long layout (values as DOUBLE), NULLs kept."""
    wide = cz.orders_wide_daily(spark, sf).withColumn(
        "_tb", F.unix_timestamp(F.col("day").cast("timestamp")))
    wide, tcol = roles.resolve_time_column(wide)
    cols = roles.numeric_columns(wide, exclude=[tcol, "_tb"])
    long = roles.to_long(wide, tcol, cols, tiebreak="_tb")
    return rounded(long.select(SERIES, TS, TB, VALUE))


@register("series_status_orders_daily", f"""
WITH c AS (SELECT series_id, count(*) AS n_rows, count(value) AS n, min(value) AS mn, max(value) AS mx
           FROM ({ORD_DAILY}) GROUP BY 1)
SELECT series_id, n_rows, n, n = 0 AS all_missing, coalesce(mn = mx, false) AS is_constant,
       n >= 5 AS forecastable, n >= 8 AS testable, n >= 10 AS decomposable FROM c""")
def q_series_status_orders_daily(spark, sf):
    """Per-series guards on a table with missing values."""
    c = roles.series_counts(cz.orders_daily_long(spark, sf))
    n = F.col("n")
    return c.select(SERIES, "n_rows", "n", (n == 0).alias("all_missing"),
                    F.coalesce(F.col("min_value") == F.col("max_value"), F.lit(False)).alias("is_constant"),
                    (n >= 5).alias("forecastable"), (n >= 8).alias("testable"),
                    (n >= 10).alias("decomposable"))


@register("drop_missing_orders_daily", f"""
SELECT series_id, count(*) AS n, {_r('sum(value)', 2)} AS total
FROM ({ORD_DAILY}) WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1""")
def q_drop_missing_orders_daily(spark, sf):
    """NULL/NaN dropped before analysis."""
    clean = roles.drop_missing(cz.orders_daily_long(spark, sf))
    return rounded(clean.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n"), fround(F.sum(VALUE), 2).alias("total")))


# ---------------------------------------------------------------- C: statistics
def _describe_sql(src: str) -> str:
    return f"""
SELECT series_id, count(value) AS count, {_r('avg(value)')} AS mean, {_r('stddev_samp(value)')} AS std,
       {_r('min(value)')} AS min, {_r('quantile_cont(value, 0.25)')} AS q25,
       {_r('quantile_cont(value, 0.5)')} AS q50, {_r('quantile_cont(value, 0.75)')} AS q75,
       {_r('max(value)')} AS max
FROM ({src}) WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY series_id"""


@register("describe_events", _describe_sql(EV))
def q_describe_events(spark, sf):
    """C1 on EV."""
    return rounded(stats.describe(roles.drop_missing(cz.events_long(spark, sf))))


@register("describe_lineitem", _describe_sql(LI))
def q_describe_lineitem(spark, sf):
    """C1 on LI (four measures unpivoted, 4 x lineitem rows)."""
    return rounded(stats.describe(roles.drop_missing(cz.lineitem_long(spark, sf))))


@register("missing_values_orders_daily", f"""
SELECT series_id, sum(CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END)::BIGINT AS missing_values,
       {_r('100.0 * avg(CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END)')} AS missing_percentage
FROM ({ORD_DAILY}) GROUP BY 1""")
def q_missing_values_orders_daily(spark, sf):
    """C2 + C3 on the raw column."""
    return rounded(stats.missing_values(cz.orders_daily_long(spark, sf)))


def _summary_sql(src: str) -> str:
    return f"""
WITH raw AS ({src}),
miss AS (SELECT series_id, sum(CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END)::BIGINT AS missing_values,
                100.0 * avg(CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END) AS missing_percentage
         FROM raw GROUP BY 1),
clean AS (SELECT * FROM raw WHERE value IS NOT NULL AND NOT isnan(value)),
mom AS (SELECT series_id, avg(value) AS m FROM clean GROUP BY 1),
agg AS (SELECT c.series_id, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std,
               min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.25) AS q25,
               quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75,
               avg(power(value - m, 2)) AS m2, avg(power(value - m, 3)) AS m3, avg(power(value - m, 4)) AS m4
        FROM clean c JOIN mom USING (series_id) GROUP BY 1)
SELECT miss.series_id, CASE WHEN coalesce(n, 0) >= 5 THEN 'ok' ELSE 'insufficient' END AS status,
       coalesce(n, 0) AS count,
       {_r('mean')} AS mean, {_r('std')} AS std, {_r('mn')} AS min, {_r('q25')} AS q25, {_r('q50')} AS q50,
       {_r('q75')} AS q75, {_r('mx')} AS max,
       {_r('m3 / nullif(power(m2, 1.5), 0)')} AS skewness, {_r('m4 / nullif(m2 * m2, 0) - 3')} AS kurtosis,
       {_r('q50')} AS median, missing_values, {_r('missing_percentage')} AS missing_percentage
FROM miss LEFT JOIN agg USING (series_id)"""


@register("summary_stats_events", _summary_sql(EV))
def q_summary_stats_events(spark, sf):
    """C4 on EV."""
    return rounded(stats.summary_stats(cz.events_long(spark, sf)))


@register("summary_stats_orders_daily", _summary_sql(ORD_DAILY))
def q_summary_stats_orders_daily(spark, sf):
    """C4 on the daily order table (missing values counted on the raw column)."""
    return rounded(stats.summary_stats(cz.orders_daily_long(spark, sf)))


def _histogram_sql(src: str) -> str:
    return f"""
WITH clean AS (SELECT * FROM ({src}) WHERE value IS NOT NULL AND NOT isnan(value)),
e0 AS (SELECT series_id, count(value) AS n, min(value) AS mn, max(value) AS mx FROM clean GROUP BY 1),
e AS (SELECT series_id, least(20, greatest(5, n // 10))::INTEGER AS bins,
             CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
             CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM e0),
i0 AS (SELECT c.series_id, c.value, e.lo, e.hi, e.bins, (e.hi - e.lo) / e.bins AS step,
              least(greatest(floor((c.value - e.lo) * (e.bins / (e.hi - e.lo)))::INTEGER, 0), e.bins - 1) AS idx
       FROM clean c JOIN e USING (series_id)),
i1 AS (SELECT *, CASE WHEN value < (CASE WHEN idx >= bins THEN hi ELSE idx * step + lo END)
                      THEN idx - 1 ELSE idx END AS idx1 FROM i0),
i2 AS (SELECT series_id, CASE WHEN value >= (CASE WHEN idx1 + 1 >= bins THEN hi ELSE (idx1 + 1) * step + lo END)
                                   AND idx1 <> bins - 1 THEN idx1 + 1 ELSE idx1 END AS bin FROM i1),
cnt AS (SELECT series_id, bin, count(*) AS n FROM i2 GROUP BY 1, 2),
spine AS (SELECT series_id, lo, hi, bins, (hi - lo) / bins AS step, unnest(range(0, bins)) AS bin FROM e)
SELECT s.series_id, s.bin::INTEGER AS bin, {_r('s.bin * s.step + s.lo')} AS bin_lo,
       {_r('CASE WHEN s.bin + 1 >= s.bins THEN s.hi ELSE (s.bin + 1) * s.step + s.lo END')} AS bin_hi,
       coalesce(c.n, 0)::BIGINT AS n
FROM spine s LEFT JOIN cnt c ON c.series_id = s.series_id AND c.bin = s.bin"""


@register("histogram_events", _histogram_sql(EV))
def q_histogram_events(spark, sf):
    """C5 on EV (20 bins per series)."""
    return rounded(stats.histogram(roles.drop_missing(cz.events_long(spark, sf))))


@register("histogram_lineitem", _histogram_sql(LI))
def q_histogram_lineitem(spark, sf):
    """C5 on LI."""
    return rounded(stats.histogram(roles.drop_missing(cz.lineitem_long(spark, sf))))


@register("seasonal_variation_events", f"""
WITH clean AS (SELECT * FROM ({EV}) WHERE value IS NOT NULL AND NOT isnan(value) AND ts IS NOT NULL),
d AS (SELECT series_id, avg(value) AS m, count(*) AS c FROM clean GROUP BY series_id, date_trunc('day', ts)),
w AS (SELECT series_id, avg(value) AS m FROM clean GROUP BY series_id, date_trunc('week', ts)),
mo AS (SELECT series_id, avg(value) AS m FROM clean GROUP BY series_id, date_trunc('month', ts)),
dd AS (SELECT series_id, sum(c) AS n, coalesce(stddev_samp(m), 0) AS v FROM d GROUP BY 1),
ww AS (SELECT series_id, coalesce(stddev_samp(m), 0) AS v FROM w GROUP BY 1),
mm AS (SELECT series_id, coalesce(stddev_samp(m), 0) AS v FROM mo GROUP BY 1)
SELECT series_id, {_r('dd.v')} AS daily_variation, {_r('ww.v')} AS weekly_variation,
       {_r('mm.v')} AS monthly_variation
FROM dd JOIN ww USING (series_id) JOIN mm USING (series_id) WHERE n >= 3""")
def q_seasonal_variation_events(spark, sf):
    """C6 on EV."""
    return rounded(stats.seasonal_variation(roles.drop_missing(cz.events_long(spark, sf))))


@register("linear_trend_events", f"""
WITH s AS (SELECT series_id, value,
                  (row_number() OVER (PARTITION BY series_id ORDER BY ts, tiebreak) - 1)::DOUBLE AS x
           FROM ({EV}) WHERE value IS NOT NULL AND NOT isnan(value))
SELECT series_id, count(value) AS n, {_r('regr_slope(value, x)')} AS slope,
       {_r('regr_intercept(value, x)')} AS intercept, {_r('regr_r2(value, x)')} AS r_squared,
       CASE WHEN regr_slope(value, x) > 0 THEN 'increasing' WHEN regr_slope(value, x) < 0 THEN 'decreasing'
            ELSE 'flat' END AS direction
FROM s GROUP BY 1 HAVING count(value) >= 5""")
def q_linear_trend_events(spark, sf):
    """C7 (coefficients) on EV, x = position after dropping missing values."""
    return rounded(stats.linear_trend(roles.drop_missing(cz.events_long(spark, sf)), with_p_value=False))


@register("trend_analysis_orders_daily")
def q_trend_analysis_orders_daily(spark, sf):
    """C7 complete (t-test p-value of the slope, significance) on the daily order series."""
    return rounded(stats.linear_trend(roles.drop_missing(cz.orders_daily_long(spark, sf))))


@register("stats_matrix_events", f"""
WITH d AS ({_describe_sql(EV)}),
t AS (UNPIVOT (SELECT series_id, count::DOUBLE AS count, mean, std, min, q25, q50, q75, max FROM d)
      ON count, mean, std, min, q25, q50, q75, max INTO NAME statistic VALUE v)
SELECT statistic, max(CASE WHEN series_id = 'click' THEN v END) AS click,
       max(CASE WHEN series_id = 'error' THEN v END) AS error,
       max(CASE WHEN series_id = 'purchase' THEN v END) AS purchase,
       max(CASE WHEN series_id = 'signup' THEN v END) AS signup,
       max(CASE WHEN series_id = 'view' THEN v END) AS "view"
FROM t GROUP BY statistic""")
def q_stats_matrix_events(spark, sf):
    """Statistic x series matrix of the EV description."""
    d = rounded(stats.describe(roles.drop_missing(cz.events_long(spark, sf))))
    series = ["click", "error", "purchase", "signup", "view"]
    return stats.stats_matrix(d, series)


# ---------------------------------------------------------------- D: anomalies
ANOM_COLS = ["series_id", "ts", "tiebreak", "value", "score", "lower_bound", "upper_bound", "method", "threshold"]


def _anom_out(df):
    return rounded(df.select(*ANOM_COLS))


@register("zscore_anomalies_events", f"""
WITH clean AS (SELECT * FROM ({EV}) WHERE value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT series_id, count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM clean GROUP BY 1),
z AS (SELECT c.*, (c.value - s.m) / nullif(s.sd, 0) AS score, s.m - 3.0 * s.sd AS lower_bound,
             s.m + 3.0 * s.sd AS upper_bound FROM clean c JOIN s USING (series_id) WHERE s.n >= 3)
SELECT series_id, ts, tiebreak, {_r('value')} AS value, {_r('score')} AS score,
       {_r('lower_bound')} AS lower_bound, {_r('upper_bound')} AS upper_bound,
       'zscore' AS method, 3.0::DOUBLE AS threshold
FROM z WHERE abs(score) > 3.0""")
def q_zscore_anomalies_events(spark, sf):
    """D1 + D4 (flagship): z-score anomalies per event type through the dispatcher, threshold 3."""
    return _anom_out(anomaly.detect_anomalies(cz.events_long(spark, sf), "zscore", 3.0))


IQR_SQL = """
WITH clean AS (SELECT * FROM ({src}) WHERE value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT series_id, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM clean GROUP BY 1),
b AS (SELECT series_id, q1, q3, q3 - q1 AS iqr, q1 - {t} * (q3 - q1) AS lower_bound,
             q3 + {t} * (q3 - q1) AS upper_bound FROM s WHERE n >= 3)
SELECT series_id, ts, tiebreak, {rv} AS value,
       {rs} AS score,
       {rl} AS lower_bound, {ru} AS upper_bound,
       'iqr' AS method, {t}::DOUBLE AS threshold
FROM clean JOIN b USING (series_id) WHERE value < lower_bound OR value > upper_bound"""


def _iqr_sql(src: str, t: str) -> str:
    return IQR_SQL.format(src=src, t=t, rv=_r("value"), rs=_r("greatest(q1 - value, value - q3, 0.0) / nullif(iqr, 0)"),
                          rl=_r("lower_bound"), ru=_r("upper_bound"))


@register("iqr_anomalies_events", _iqr_sql(EV, "3.0"))
def q_iqr_anomalies_events(spark, sf):
    """D2 on EV, default threshold 3 (not 1.5)."""
    return _anom_out(anomaly.detect_anomalies(cz.events_long(spark, sf), "iqr", 3.0))


@register("iqr_anomalies_orders_t15", _iqr_sql(
    "SELECT o_orderpriority AS series_id, o_orderdate AS ts, o_orderkey AS tiebreak, "
    "o_totalprice AS value FROM orders", "1.5"))
def q_iqr_anomalies_orders_t15(spark, sf):
    """D2 on the order prices per priority with the UI's threshold 1.5."""
    return _anom_out(anomaly.detect_anomalies(cz.orders_long(spark, sf), "iqr", 1.5))


@register("iqr_anomalies_orders_t03", _iqr_sql(
    "SELECT o_orderpriority AS series_id, o_orderdate AS ts, o_orderkey AS tiebreak, "
    "o_totalprice AS value FROM orders", "0.3"))
def q_iqr_anomalies_orders_t03(spark, sf):
    """D2 on the order prices per priority with a threshold narrow enough to flag rows."""
    return _anom_out(anomaly.detect_anomalies(cz.orders_long(spark, sf), "iqr", 0.3))


@register("anomaly_summary_events", f"""
WITH clean AS (SELECT * FROM ({EV}) WHERE value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT series_id, count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM clean GROUP BY 1),
f AS (SELECT series_id, count(*) AS k FROM clean JOIN s USING (series_id)
      WHERE s.n >= 3 AND abs((value - m) / nullif(sd, 0)) > 3.0 GROUP BY 1)
SELECT series_id, n AS total_points, coalesce(k, 0)::BIGINT AS anomalies_count,
       {_r('coalesce(k, 0) * 100.0 / n')} AS anomalies_percentage
FROM s LEFT JOIN f USING (series_id) WHERE n >= 3""")
def q_anomaly_summary_events(spark, sf):
    """Total points, anomaly count and percentage per series (z-score, t = 3)."""
    long = cz.events_long(spark, sf)
    return rounded(anomaly.anomaly_summary(long, anomaly.detect_anomalies(long, "zscore", 3.0)))


@register("isolation_forest_events")
def q_isolation_forest_events(spark, sf):
    """D3: isolation-forest anomalies (100 trees x 256 samples, top 5 % scores) per event type."""
    return _anom_out(anomaly.detect_anomalies(cz.events_long(spark, sf), "isolation_forest", 3.0))


@register("isolation_forest_summary_lineitem")
def q_isolation_forest_summary_lineitem(spark, sf):
    """D3 + D5 on LI: share of flagged points per measure (about 5 %)."""
    long = cz.lineitem_long(spark, sf)
    return rounded(anomaly.anomaly_summary(long, anomaly.detect_anomalies(long, "isolation_forest")))


@register("first_series_orders_daily", f"""
SELECT '1-URGENT' AS series_id, ts, tiebreak, {_r('value')} AS value FROM ({ORD_DAILY}) WHERE series_id = '1-URGENT'""")
def q_first_series_orders_daily(spark, sf):
    """B11 + B3: first time column and first numeric column of the wide daily table, after a
    column selection (the series endpoint's view)."""
    wide = cz.orders_wide_daily(spark, sf)
    picked = roles.select_columns(wide, list(cz.ORDER_PRIORITIES), keep=["day"])
    long = roles.first_series(picked)
    tb = F.unix_timestamp(F.col(TS).cast("timestamp"))
    return rounded(long.select(F.lit("1-URGENT").alias(SERIES), TS, tb.alias(TB), VALUE))


@register("min_points_guard_mixed", f"""
WITH src AS (SELECT series_id || ':' || floor(value / 10)::BIGINT AS series_id FROM ({EV}) WHERE value IS NOT NULL),
c AS (SELECT series_id, count(*) AS n FROM src GROUP BY 1)
SELECT 'ok' AS status, series_id, n FROM c WHERE n >= 5
UNION ALL SELECT 'insufficient', series_id, n FROM c WHERE n < 5""")
def q_min_points_guard_mixed(spark, sf):
    """All events regrouped by type and value band, so that some series are short; split
    into qualifying rows and status rows."""
    bands = roles.drop_missing(cz.events_long(spark, sf)).withColumn(
        SERIES, F.concat(SERIES, F.lit(":"), F.floor(F.col(VALUE) / 10).cast("string")))
    ok, short = roles.min_points_guard(bands, 5)
    ok_rows = ok.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n")).select(F.lit("ok").alias("status"), SERIES, "n")
    return ok_rows.unionByName(short.select("status", SERIES, "n"))
