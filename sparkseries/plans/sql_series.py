"""DuckDB oracle SQL for :mod:`sparkseries.plans.catalog_series` (written independently of
the Spark code: plain window functions and self-joins over whole tables)."""

from __future__ import annotations

from ..functions.dist import norm_ppf_sql
from .catalog import rnd

from .catalog_core import EV, ORD_DAILY


def _r(x: str, d: int = 6) -> str:
    return rnd(x, d)


CLEAN_EV = f"SELECT * FROM ({EV}) WHERE value IS NOT NULL AND NOT isnan(value)"

EVD = f"""SELECT series_id, date_trunc('day', ts) AS ts,
       datediff('day', DATE '1970-01-01', date_trunc('day', ts))::BIGINT AS tiebreak, avg(value) AS value
FROM ({CLEAN_EV}) GROUP BY 1, 2"""

ORD = """SELECT o_orderpriority AS series_id, o_orderdate AS ts, o_orderkey AS tiebreak,
       o_totalprice AS value FROM orders"""

ORD_M = """SELECT o_orderpriority AS series_id, last_day(o_orderdate)::TIMESTAMP AS ts,
       (year(o_orderdate) * 12 + month(o_orderdate) - 1)::BIGINT AS tiebreak, avg(o_totalprice) AS value
FROM orders GROUP BY 1, 2, 3"""


def seqd(src: str) -> str:
    return f"""SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY ts, tiebreak) - 1)::BIGINT AS seq,
       count(*) OVER (PARTITION BY series_id) AS n FROM ({src})"""


# regular daily ORD: daily means, spine over the whole span, linear interpolation by position
ORD_DAILY_REG = f"""
WITH r AS (SELECT series_id, date_trunc('day', ts) AS ts,
                  datediff('day', DATE '1970-01-01', date_trunc('day', ts))::BIGINT AS tiebreak,
                  avg(value) AS value FROM ({ORD}) GROUP BY 1, 2),
sp AS (SELECT series_id, unnest(generate_series(min(tiebreak), max(tiebreak))) AS tiebreak FROM r GROUP BY 1),
j AS (SELECT sp.series_id, (DATE '1970-01-01' + sp.tiebreak::INTEGER)::TIMESTAMP AS ts, sp.tiebreak,
             sp.tiebreak - min(sp.tiebreak) OVER (PARTITION BY sp.series_id) AS seq, r.value
      FROM sp LEFT JOIN r ON r.series_id = sp.series_id AND r.tiebreak = sp.tiebreak),
k AS (SELECT *, CASE WHEN value IS NOT NULL THEN seq END AS vs,
      last_value(CASE WHEN value IS NOT NULL THEN seq END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ps,
      last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
      first_value(CASE WHEN value IS NOT NULL THEN seq END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY seq
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ns,
      first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY seq
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
      FROM j)
SELECT series_id, ts, tiebreak, seq,
       CASE WHEN value IS NOT NULL THEN value WHEN ps IS NULL THEN NULL WHEN ns IS NULL THEN pv
            ELSE pv + (nv - pv) * (seq - ps) / (ns - ps) END AS value
FROM k"""


def acf_sql(src: str, nlags: int = 20) -> str:
    return f"""
WITH s AS ({seqd(src)}),
d AS (SELECT series_id, seq, n, value - avg(value) OVER (PARTITION BY series_id) AS d FROM s),
c AS (SELECT a.series_id, k.lag, sum(a.d * b.d) AS c FROM d a
      CROSS JOIN (SELECT unnest(range(0, {nlags + 1})) AS lag) k
      JOIN d b ON b.series_id = a.series_id AND b.seq = a.seq - k.lag GROUP BY 1, 2),
z AS (SELECT series_id, max(n) AS n FROM d GROUP BY 1)
SELECT c.series_id, c.lag::INTEGER AS lag, {_r('c.c / c0.c')} AS acf
FROM c JOIN c c0 ON c0.series_id = c.series_id AND c0.lag = 0 JOIN z ON z.series_id = c.series_id
WHERE z.n >= 8 AND least({nlags}, z.n // 2) >= 2 AND c.lag <= least({nlags}, z.n // 2)"""


def kpss_sql(src: str) -> str:
    return f"""
WITH s AS ({seqd(src)}),
d AS (SELECT series_id, seq, n, value - avg(value) OVER (PARTITION BY series_id) AS e FROM s WHERE n >= 8),
cs AS (SELECT series_id, sum(x * x) AS eta FROM (SELECT series_id, sum(e) OVER (PARTITION BY series_id ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM d) GROUP BY 1),
g AS (SELECT a.series_id, a.seq - b.seq AS k, sum(a.e * b.e) AS c FROM d a JOIN d b
      ON b.series_id = a.series_id AND b.seq <= a.seq GROUP BY 1, 2),
nn AS (SELECT series_id, max(n)::DOUBLE AS n FROM d GROUP BY 1),
c0 AS (SELECT series_id, c AS c0 FROM g WHERE k = 0),
p1 AS (SELECT nn.series_id, nn.n, c0.c0,
              c0.c0 / nn.n + coalesce(sum(CASE WHEN g.k >= 1 AND g.k <= floor(pow(nn.n, 2.0 / 9.0))
                                               THEN g.c * 2.0 / nn.n END), 0) AS s0,
              coalesce(sum(CASE WHEN g.k >= 1 AND g.k <= floor(pow(nn.n, 2.0 / 9.0))
                                THEN g.k * (g.c * 2.0 / nn.n) END), 0) AS s1
       FROM nn JOIN c0 USING (series_id) JOIN g USING (series_id) GROUP BY 1, 2, 3),
l AS (SELECT series_id, n, c0, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3.0) * pow(n, 1.0 / 3.0)),
                                    n - 1)::INTEGER AS lags FROM p1),
s2 AS (SELECT l.series_id, l.n, l.lags,
              (l.c0 + coalesce(sum(CASE WHEN g.k >= 1 AND g.k <= l.lags
                                       THEN 2.0 * g.c * (1.0 - g.k / (l.lags + 1.0)) END), 0)) / l.n AS s2
       FROM l JOIN g USING (series_id) GROUP BY 1, 2, 3, l.c0),
st AS (SELECT s2.series_id, s2.n::BIGINT AS n, s2.lags, (cs.eta / (s2.n * s2.n)) / s2.s2 AS stat
       FROM s2 JOIN cs USING (series_id))
SELECT series_id, n, lags, {_r('stat')} AS test_statistic,
       {_r('''CASE WHEN stat <= 0.347 THEN 0.10
            WHEN stat <= 0.463 THEN 0.10 + (stat - 0.347) * ((0.05 - 0.10) / (0.463 - 0.347))
            WHEN stat <= 0.574 THEN 0.05 + (stat - 0.463) * ((0.025 - 0.05) / (0.574 - 0.463))
            WHEN stat <= 0.739 THEN 0.025 + (stat - 0.574) * ((0.01 - 0.025) / (0.739 - 0.574))
            ELSE 0.01 END''')} AS p_value,
       0.347::DOUBLE AS crit_10, 0.463::DOUBLE AS crit_5, 0.574::DOUBLE AS crit_2_5, 0.739::DOUBLE AS crit_1,
       stat < 0.463 AS is_stationary
FROM st"""


def decompose_sql(regular: str, m: int, extra: str = "") -> str:
    """``regular`` has (series_id, ts, seq, value) without gaps."""
    half = m // 2
    if m % 2 == 1:
        trend = f"""CASE WHEN count(value) OVER w{half} = {m} THEN avg(value) OVER w{half} END"""
        windows = f"w{half} AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    else:
        lo = f"lag(value, {half}) OVER wo"
        hi = f"lead(value, {half}) OVER wo"
        trend = (f"CASE WHEN {lo} IS NOT NULL AND {hi} IS NOT NULL AND count(value) OVER wi = {m - 1} "
                 f"THEN (0.5 * {lo} + sum(value) OVER wi + 0.5 * {hi}) / {float(m)} END")
        windows = (f"wo AS (PARTITION BY series_id ORDER BY seq), "
                   f"wi AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN {half - 1} PRECEDING AND {half - 1} FOLLOWING)")
    return f"""
WITH r AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS nn FROM ({regular})),
t AS (SELECT *, {trend} AS trend FROM r WHERE nn >= {2 * m} WINDOW {windows}),
ph AS (SELECT series_id, seq % {m} AS phase, avg(value - trend) AS pm FROM t GROUP BY 1, 2),
se AS (SELECT series_id, phase, pm - avg(pm) OVER (PARTITION BY series_id) AS seasonal FROM ph)
SELECT t.series_id, t.ts, t.seq, {_r('t.value')} AS value, {_r('t.trend')} AS trend, {_r('se.seasonal')} AS seasonal,
       {_r('t.value - t.trend - se.seasonal')} AS resid{extra}
FROM t JOIN se ON se.series_id = t.series_id AND se.phase = t.seq % {m}"""


ORD_M_REG = f"SELECT series_id, ts, seq, value FROM ({seqd(ORD_M)})"
EVD_REG = f"SELECT series_id, ts, seq, value FROM ({seqd(EVD)})"

SQL: dict[str, str] = {
    "with_seq_orders": f"SELECT series_id, tiebreak, seq FROM ({seqd(ORD)})",

    "lag1_autocorr_orders_daily": f"""
SELECT series_id, {_r('corr(value, prev)')} AS lag1_autocorr FROM (
  SELECT series_id, value, lag(value) OVER (PARTITION BY series_id ORDER BY ts, tiebreak) AS prev
  FROM ({ORD_DAILY})) GROUP BY 1 HAVING count(value) > 1""",

    "lag1_autocorr_events": f"""
SELECT series_id, {_r('corr(value, prev)')} AS lag1_autocorr FROM (
  SELECT series_id, value, lag(value) OVER (PARTITION BY series_id ORDER BY ts, tiebreak) AS prev
  FROM ({EV})) GROUP BY 1 HAVING count(value) > 1""",

    "rolling_last_events": f"""
WITH s AS ({seqd(CLEAN_EV)}),
r AS (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM s
      WINDOW w AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT series_id, {_r('m')} AS rolling_mean_last, {_r('sd')} AS rolling_std_last FROM r
WHERE seq = n - 1 AND n >= 10""",

    "rolling_series_orders_monthly": f"""
WITH s AS ({seqd(ORD_M)}),
r AS (SELECT *, least(5, n // 2)::INTEGER AS window_size, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM s
      WINDOW w AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT series_id, ts, seq, window_size, CASE WHEN seq >= window_size - 1 THEN {_r('m')} END AS rolling_mean,
       CASE WHEN seq >= window_size - 1 THEN {_r('sd')} END AS rolling_std FROM r""",

    "difference_orders_monthly": f"""
SELECT series_id, ts, seq, {_r('value - lag(value, 1) OVER w - lag(value, 12) OVER w + lag(value, 13) OVER w')} AS value
FROM ({seqd(ORD_M)}) WINDOW w AS (PARTITION BY series_id ORDER BY seq)""",

    "cumulative_sum_events": f"""
SELECT series_id, tiebreak, seq, {_r('sum(value) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 4)} AS cumsum
FROM ({seqd(EV)})""",

    "lag_windows_events_daily": f"""
SELECT * FROM (
  SELECT series_id, seq, {_r('lag(value, 5) OVER w')} AS x1, {_r('lag(value, 4) OVER w')} AS x2,
         {_r('lag(value, 3) OVER w')} AS x3, {_r('lag(value, 2) OVER w')} AS x4, {_r('lag(value, 1) OVER w')} AS x5,
         {_r('value')} AS target
  FROM ({seqd(EVD)}) WINDOW w AS (PARTITION BY series_id ORDER BY seq)) WHERE seq >= 5""",

    "last_n_orders": f"""
SELECT series_id, ts, tiebreak, seq, {_r('value')} AS value FROM ({seqd(ORD)}) WHERE seq >= n - 10""",

    "sample_recent_lineitem": f"""
WITH li AS (SELECT 'l_quantity' AS series_id, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS value FROM lineitem
   UNION ALL SELECT 'l_extendedprice', l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
   UNION ALL SELECT 'l_discount', l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount FROM lineitem
   UNION ALL SELECT 'l_tax', l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax FROM lineitem),
s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS seq,
             count(*) OVER (PARTITION BY series_id) AS n FROM li)
SELECT series_id, count(*) AS n, min(ts) AS first_ts, {rnd('sum(value)', 2)} AS total FROM s
WHERE seq >= n - 5000 GROUP BY 1""",

    "chronological_split_events_daily": f"""
SELECT series_id, ts, seq, CASE WHEN seq < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split,
       floor(n * 0.8)::BIGINT AS n_train FROM ({seqd(EVD)})""",

    "min_max_scale_events": f"""
WITH s AS (SELECT *, min(value) OVER (PARTITION BY series_id) AS mn, max(value) OVER (PARTITION BY series_id) AS mx FROM ({EV})),
t AS (SELECT *, (value - mn) / nullif(mx - mn, 0) AS scaled FROM s)
SELECT series_id, tiebreak, {_r('scaled')} AS scaled, {_r('scaled * (mx - mn) + mn')} AS restored FROM t""",

    "resample_weekly_events": f"""
SELECT series_id, (date_trunc('week', ts) + INTERVAL 6 DAY)::TIMESTAMP AS ts,
       floor(datediff('day', DATE '1970-01-04', (date_trunc('week', ts) + INTERVAL 6 DAY)::DATE) / 7)::BIGINT AS tiebreak,
       {_r('avg(value)')} AS value, count(value) AS n
FROM ({CLEAN_EV}) GROUP BY 1, 2, 3""",

    "resample_monthly_orders": f"""
SELECT series_id, ts, tiebreak, {_r('value')} AS value, n FROM (
  SELECT o_orderpriority AS series_id, last_day(o_orderdate)::TIMESTAMP AS ts,
         (year(o_orderdate) * 12 + month(o_orderdate) - 1)::BIGINT AS tiebreak, avg(o_totalprice) AS value,
         count(o_totalprice) AS n FROM orders GROUP BY 1, 2, 3)""",

    "resample_quarterly_lineitem": f"""
WITH li AS (SELECT 'l_quantity' AS series_id, l_shipdate AS ts, l_quantity AS value FROM lineitem
   UNION ALL SELECT 'l_extendedprice', l_shipdate, l_extendedprice FROM lineitem
   UNION ALL SELECT 'l_discount', l_shipdate, l_discount FROM lineitem
   UNION ALL SELECT 'l_tax', l_shipdate, l_tax FROM lineitem),
q AS (SELECT series_id, (date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::TIMESTAMP AS lab, value FROM li)
SELECT series_id, lab AS ts, floor((year(lab) * 12 + month(lab) - 1) / 3)::BIGINT AS tiebreak,
       {rnd('avg(value)')} AS value, count(value) AS n, 'Q' AS freq FROM q GROUP BY 1, 2
UNION ALL
SELECT series_id, make_date(year(ts), 12, 31)::TIMESTAMP, year(ts)::BIGINT, {rnd('avg(value)')}, count(value), 'Y'
FROM li GROUP BY 1, 2, 3""",

    "calendar_spine_orders_daily": f"""
WITH r AS (SELECT series_id, date_trunc('day', ts) AS ts,
                  datediff('day', DATE '1970-01-01', date_trunc('day', ts))::BIGINT AS tiebreak,
                  avg(value) AS value, count(value) AS n FROM ({ORD}) GROUP BY 1, 2),
sp AS (SELECT series_id, unnest(generate_series(min(tiebreak), max(tiebreak))) AS tiebreak FROM r GROUP BY 1)
SELECT sp.series_id, (DATE '1970-01-01' + sp.tiebreak::INTEGER)::TIMESTAMP AS ts, sp.tiebreak,
       {_r('r.value')} AS value, r.n FROM sp LEFT JOIN r ON r.series_id = sp.series_id AND r.tiebreak = sp.tiebreak""",

    "interpolate_orders_daily": f"SELECT series_id, ts, seq, {_r('value')} AS value FROM ({ORD_DAILY_REG})",

    "acf_events_daily": acf_sql(EVD),
    "acf_orders_monthly": acf_sql(ORD_M),
    "kpss_events_daily": kpss_sql(EVD),
    "kpss_orders_monthly": kpss_sql(ORD_M),
    "kpss_events": kpss_sql(CLEAN_EV),

    "shapiro_w_mixed": f"""
WITH src AS (SELECT 'D:' || series_id AS series_id, value FROM ({EVD}) UNION ALL SELECT 'M:' || series_id, value FROM ({ORD_M})
             UNION ALL SELECT 'E:' || series_id, value FROM ({EV}) WHERE value IS NOT NULL AND NOT isnan(value)),
x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM src),
m AS (SELECT *, {norm_ppf_sql("(i - 0.375) / (n + 0.25)")} AS m FROM x WHERE n BETWEEN 6 AND 4999),
g AS (SELECT series_id, n, sum(m * m) AS mm, sum(m * value) AS s, var_pop(value) * n AS ss, 1 / sqrt(n) AS u,
             max(CASE WHEN i = n THEN m END) AS mn, max(CASE WHEN i = n - 1 THEN m END) AS mn1,
             max(CASE WHEN i = n THEN value END) - max(CASE WHEN i = 1 THEN value END) AS outer_gap,
             max(CASE WHEN i = n - 1 THEN value END) - max(CASE WHEN i = 2 THEN value END) AS inner_gap FROM m GROUP BY 1, 2),
a AS (SELECT *, mn / sqrt(mm) + 0.221157 * u - 0.147981 * u ** 2 - 2.071190 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5 AS an,
             mn1 / sqrt(mm) + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5 AS an1 FROM g),
w AS (SELECT *, (s - mn * outer_gap - mn1 * inner_gap) / sqrt((mm - 2 * mn ** 2 - 2 * mn1 ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2))
                + an * outer_gap + an1 * inner_gap AS ax FROM a)
SELECT series_id, n, {_r("least(1.0, ax * ax / ss)", 8)} AS test_statistic FROM w""",

    "normality_k2_lineitem": f"""
WITH li AS (SELECT 'l_quantity' AS series_id, l_quantity AS value FROM lineitem
   UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
   UNION ALL SELECT 'l_discount', l_discount FROM lineitem
   UNION ALL SELECT 'l_tax', l_tax FROM lineitem),
mo AS (SELECT series_id, avg(value) AS m FROM li GROUP BY 1),
a AS (SELECT series_id, count(*)::DOUBLE AS n, avg(power(value - m, 2)) AS m2, avg(power(value - m, 3)) AS m3,
             avg(power(value - m, 4)) AS m4 FROM li JOIN mo USING (series_id) GROUP BY 1),
b AS (SELECT series_id, n, m3 / power(m2, 1.5) AS g1, m4 / (m2 * m2) AS b2 FROM a),
c AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y,
             3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
             3.0 * (n - 1) / (n + 1) AS e,
             24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS var,
             6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb1
      FROM b),
d AS (SELECT *, sqrt(2.0 * (beta2 - 1)) - 1.0 AS w2, (b2 - e) / sqrt(var) AS x,
             6.0 + 8.0 / sb1 * (2.0 / sb1 + sqrt(1 + 4.0 / (sb1 * sb1))) AS aa FROM c),
f AS (SELECT *, 1.0 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2.0 / (w2 - 1)) AS alpha,
             (1 - 2.0 / aa) / (1 + x * sqrt(2.0 / (aa - 4.0))) AS ratio FROM d),
g AS (SELECT series_id, n::BIGINT AS n,
             delta * ln(y / alpha + sqrt((y / alpha) * (y / alpha) + 1)) AS z1,
             ((1 - 2.0 / (9.0 * aa)) - sign(ratio) * pow(abs(ratio), 1.0 / 3.0)) / sqrt(2.0 / (9.0 * aa)) AS z2 FROM f)
SELECT series_id, n, {rnd('z1 * z1 + z2 * z2')} AS test_statistic, {rnd('exp(-(z1 * z1 + z2 * z2) / 2.0)')} AS p_value
FROM g""",

    "decompose_orders_monthly": decompose_sql(ORD_M_REG, 12),
    "decompose_events_daily": decompose_sql(EVD_REG, 7),
    "auto_decompose_events_orders": f"""
SELECT * FROM ({decompose_sql(f"SELECT 'EVD:' || series_id AS series_id, ts, seq, value FROM ({EVD_REG})", 7,
                              ", 'D' AS frequency, 7 AS period")})
UNION ALL
SELECT * FROM ({decompose_sql(f"SELECT 'ORD:' || series_id AS series_id, ts, seq, value FROM ({ORD_DAILY_REG})", 7,
                              ", 'D' AS frequency, 7 AS period")})""",
}


# ---------------------------------------------------------------- G4 / G5 oracles
FREQ_INPUTS = f"""
SELECT 'D:' || series_id AS series_id, ts FROM ({EVD})
UNION ALL SELECT 'W:' || series_id, (date_trunc('week', ts) + INTERVAL 6 DAY)::TIMESTAMP FROM ({CLEAN_EV})
  GROUP BY 1, 2
UNION ALL SELECT 'M:' || series_id, ts FROM ({ORD_M})
UNION ALL SELECT 'Q:' || o_orderpriority, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::TIMESTAMP
  FROM orders GROUP BY 1, 2
UNION ALL SELECT 'H:' || o_orderpriority, date_trunc('hour', o_orderdate) FROM orders GROUP BY 1, 2
UNION ALL SELECT 'raw:' || series_id, ts FROM ({EV})"""

INFER_FREQ = f"""
WITH st AS (SELECT DISTINCT series_id, ts FROM ({FREQ_INPUTS}) WHERE ts IS NOT NULL),
l AS (SELECT series_id, ts, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS prev,
             floor(epoch(ts))::BIGINT - floor(epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)))::BIGINT AS secs,
             (year(ts) * 12 + month(ts)) - lag(year(ts) * 12 + month(ts)) OVER (PARTITION BY series_id ORDER BY ts) AS mstep,
             dayofweek(ts) + 1 AS dow
      FROM st),
g AS (SELECT series_id, count(*) AS n, min(secs) AS dmin, max(secs) AS dmax, min(mstep) AS mmin, max(mstep) AS mmax,
             min(CASE WHEN ts = date_trunc('day', ts) THEN 1 ELSE 0 END) AS all_midnight,
             min(CASE WHEN day(ts) = 1 THEN 1 ELSE 0 END) AS all_first,
             min(CASE WHEN ts::DATE = last_day(ts) THEN 1 ELSE 0 END) AS all_last,
             min(CASE WHEN dow IN (1, 7) THEN 0 ELSE 1 END) AS all_weekday,
             max(CASE WHEN secs = 3 * 86400 AND dow <> 2 THEN 1 ELSE 0 END) AS bad_gap3,
             min(dow) AS dow_min, max(dow) AS dow_max, min(month(ts)) AS mon_min
      FROM l GROUP BY 1),
h AS (SELECT *, dmin = dmax AS uni, mmin = mmax AND all_midnight = 1 AS monthly,
             ['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'] AS mons FROM g)
SELECT series_id, CASE
  WHEN n < 3 THEN NULL
  WHEN uni AND dmin = 7 * 86400 AND dow_min = dow_max
       THEN 'W-' || ['SUN','MON','TUE','WED','THU','FRI','SAT'][dow_min]
  WHEN uni AND dmin % 86400 = 0 THEN CASE WHEN dmin // 86400 = 1 THEN 'D' ELSE (dmin // 86400)::VARCHAR || 'D' END
  WHEN uni AND dmin % 3600 = 0 THEN CASE WHEN dmin // 3600 = 1 THEN 'h' ELSE (dmin // 3600)::VARCHAR || 'h' END
  WHEN uni AND dmin % 60 = 0 THEN CASE WHEN dmin // 60 = 1 THEN 'min' ELSE (dmin // 60)::VARCHAR || 'min' END
  WHEN uni THEN CASE WHEN dmin = 1 THEN 's' ELSE dmin::VARCHAR || 's' END
  WHEN all_weekday = 1 AND all_midnight = 1 AND dmin = 86400 AND dmax = 3 * 86400 AND bad_gap3 = 0 THEN 'B'
  WHEN monthly AND mmin = 1 AND all_first = 1 THEN 'MS'
  WHEN monthly AND mmin = 1 AND all_last = 1 THEN 'M'
  WHEN monthly AND mmin = 3 AND all_first = 1 THEN 'QS-' || mons[((mon_min - 1) % mmin) + 1]
  WHEN monthly AND mmin = 3 AND all_last = 1 THEN 'Q-' || mons[((mon_min - 1) % mmin) + 13 - mmin]
  WHEN monthly AND mmin = 12 AND all_first = 1 THEN 'YS-' || mons[((mon_min - 1) % mmin) + 1]
  WHEN monthly AND mmin = 12 AND all_last = 1 THEN 'Y-' || mons[((mon_min - 1) % mmin) + 13 - mmin]
END AS freq FROM h"""

SQL["infer_frequency_mixed"] = INFER_FREQ
SQL["future_dates_mixed"] = f"""
WITH f AS ({INFER_FREQ}),
last AS (SELECT series_id, max(ts) AS last_ts, count(*) AS n FROM ({FREQ_INPUTS}) GROUP BY 1),
s AS (SELECT last.*, coalesce(f.freq, 'D') AS fr, k.step FROM last LEFT JOIN f USING (series_id)
      CROSS JOIN (SELECT unnest(range(1, 11)) AS step) k),
u AS (SELECT *, regexp_replace(fr, '^[0-9]+', '') AS unit,
             CASE WHEN regexp_extract(fr, '^([0-9]*)', 1) = '' THEN 1
                  ELSE regexp_extract(fr, '^([0-9]*)', 1)::BIGINT END AS k FROM s)
SELECT series_id, step::INTEGER AS step, CASE
  WHEN unit = 'D' THEN last_ts + (step * k) * INTERVAL 1 DAY
  WHEN unit = 'h' THEN last_ts + (step * k) * INTERVAL 1 HOUR
  WHEN unit = 'min' THEN last_ts + (step * k) * INTERVAL 1 MINUTE
  WHEN unit = 's' THEN last_ts + (step * k) * INTERVAL 1 SECOND
  WHEN unit LIKE 'W-%' THEN last_ts + (step * 7) * INTERVAL 1 DAY
  WHEN unit = 'MS' THEN (date_trunc('month', last_ts)::DATE + step * INTERVAL 1 MONTH)::TIMESTAMP
  WHEN unit = 'M' THEN last_day(last_ts::DATE + step * INTERVAL 1 MONTH)::TIMESTAMP
  WHEN unit LIKE 'QS-%' THEN (date_trunc('month', last_ts)::DATE + (step * 3) * INTERVAL 1 MONTH)::TIMESTAMP
  WHEN unit LIKE 'Q-%' THEN last_day(last_ts::DATE + (step * 3) * INTERVAL 1 MONTH)::TIMESTAMP
  WHEN unit LIKE 'YS-%' THEN (date_trunc('month', last_ts)::DATE + (step * 12) * INTERVAL 1 MONTH)::TIMESTAMP
  WHEN unit LIKE 'Y-%' THEN last_day(last_ts::DATE + (step * 12) * INTERVAL 1 MONTH)::TIMESTAMP
  ELSE last_ts + step * INTERVAL 1 DAY END AS ts,
  (n + step - 1)::BIGINT AS seq
FROM u"""


SQL["pacf_low_lags_orders_monthly"] = f"""
WITH s AS ({seqd(ORD_M)}),
d AS (SELECT series_id, seq, n, value - avg(value) OVER (PARTITION BY series_id) AS d FROM s),
c AS (SELECT a.series_id, k.lag, sum(a.d * b.d) AS c FROM d a
      CROSS JOIN (SELECT unnest(range(0, 3)) AS lag) k
      JOIN d b ON b.series_id = a.series_id AND b.seq = a.seq - k.lag GROUP BY 1, 2),
z AS (SELECT series_id, max(n) AS n FROM d GROUP BY 1),
r AS (SELECT z.series_id, z.n,
             max(CASE WHEN lag = 0 THEN c / z.n END) AS r0,
             max(CASE WHEN lag = 1 THEN c / (z.n - 1) END) AS r1,
             max(CASE WHEN lag = 2 THEN c / (z.n - 2) END) AS r2
      FROM c JOIN z USING (series_id) GROUP BY 1, 2),
p AS (SELECT series_id, n, r1 / r0 AS p1, (r2 / r0 - (r1 / r0) * (r1 / r0)) / (1 - (r1 / r0) * (r1 / r0)) AS p2 FROM r)
SELECT series_id, 0 AS lag, 1.0::DOUBLE AS pacf FROM p WHERE n >= 8 AND least(20, n // 2) >= 2
UNION ALL SELECT series_id, 1, {rnd('p1')} FROM p WHERE n >= 8 AND least(20, n // 2) >= 2
UNION ALL SELECT series_id, 2, {rnd('p2')} FROM p WHERE n >= 8 AND least(20, n // 2) >= 2"""

# ---------------------------------------------------------------- E1 / H3 oracles
SQL["order_series_events"] = f"SELECT series_id, ts, tiebreak, {rnd('value')} AS value, true AS in_order FROM ({EV})"

SQL["adf_no_lag_orders_monthly"] = f"""
WITH y AS (SELECT series_id, value - lag(value) OVER w AS dy, lag(value) OVER w AS l FROM ({ORD_M})
           WINDOW w AS (PARTITION BY series_id ORDER BY ts, tiebreak)),
f AS (SELECT series_id, count(*) AS nobs, regr_slope(dy, l) AS b, regr_sxx(dy, l) AS sxx, regr_syy(dy, l) AS syy
      FROM y WHERE l IS NOT NULL GROUP BY 1 HAVING count(*) >= 7)
SELECT series_id, nobs, 0 AS used_lag, {rnd('b / sqrt((syy - b * b * sxx) / (nobs - 2) / sxx)', 6)} AS test_statistic
FROM f"""
