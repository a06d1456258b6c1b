"""DuckDB oracle SQL for :mod:`sparkseries.plans.catalog_forecast`.

Holt's recursion is a recursive CTE over every (alpha, beta) grid point — the
direct sequential definition, independent of the chunked Spark evaluation.
"""

from __future__ import annotations

from .catalog import rnd

from .catalog_core import EV
from .sql_series import EVD, ORD_M, seqd


def _r(x: str, d: int = 6) -> str:
    return rnd(x, d)


def holt_ctes(train: str) -> str:
    """CTEs ending in ``best(series_id, a, b, l, tr, sse, n, last_ts)``; ``train`` has
    (series_id, ts, value, seq, n) with n = number of fitting points."""
    return f"""
s AS ({train}),
g AS (SELECT round(i * 0.05, 2)::DOUBLE AS a, round(j * 0.05, 2)::DOUBLE AS b
      FROM range(1, 20) t1(i), range(1, 20) t2(j)),
st AS (SELECT series_id, max(CASE WHEN seq = 0 THEN value END) AS y0, max(CASE WHEN seq = 1 THEN value END) AS y1,
              max(n) AS n, max(ts) AS last_ts FROM s GROUP BY 1),
r(series_id, a, b, t, l, tr, sse) AS (
  SELECT st.series_id, g.a, g.b, 1, st.y0, st.y1 - st.y0, 0.0::DOUBLE FROM st, g
  UNION ALL
  SELECT r.series_id, r.a, r.b, r.t + 1,
         r.a * s.value + (1 - r.a) * (r.l + r.tr),
         r.b * ((r.a * s.value + (1 - r.a) * (r.l + r.tr)) - r.l) + (1 - r.b) * r.tr,
         r.sse + (s.value - (r.l + r.tr)) * (s.value - (r.l + r.tr))
  FROM r JOIN s ON s.series_id = r.series_id AND s.seq = r.t),
fin AS (SELECT r.*, st.n, st.last_ts FROM r JOIN st USING (series_id) WHERE r.t = st.n),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY sse, a, b) AS rk FROM fin)
         WHERE rk = 1)"""


def holt_rows(train: str, horizons: list[int], model: str = "exponential_smoothing") -> str:
    hs = ", ".join(str(h) for h in horizons)
    return f"""
WITH RECURSIVE {holt_ctes(train)},
steps AS (SELECT best.*, h.horizon, k.step FROM best
          CROSS JOIN (SELECT unnest([{hs}]) AS horizon) h
          CROSS JOIN (SELECT unnest(range(1, {max(horizons) + 1})) AS step) k WHERE k.step <= h.horizon),
v AS (SELECT *, l + step * tr AS fc,
             (sse / (n - 1)) * (1 + a * a * ((step - 1) + 2 * b * ((step - 1) * step / 2)
                                            + b * b * ((step - 1) * step * (2 * step - 1) / 6))) AS var
      FROM steps)
SELECT series_id, '{model}' AS model, horizon::INTEGER AS horizon, step::INTEGER AS step,
       last_ts + step * INTERVAL 1 DAY AS ts, (n + step - 1)::BIGINT AS seq, {_r('fc')} AS forecast,
       {_r('fc - 1.959963984540054 * sqrt(var)')} AS lower, {_r('fc + 1.959963984540054 * sqrt(var)')} AS upper
FROM v"""


EVD_SEQ = f"SELECT series_id, ts, value, seq, n FROM ({seqd(EVD)})"
ORDM_SEQ = f"SELECT series_id, ts, value, seq, n FROM ({seqd(ORD_M)})"
EVD_TRAIN = f"""SELECT series_id, ts, value, seq, floor(n * 0.8)::BIGINT AS n FROM ({seqd(EVD)})
WHERE seq < floor(n * 0.8)"""

SQL: dict[str, str] = {
    "forecast_holt_events_daily": holt_rows(EVD_SEQ, [3, 7, 14]),

    "forecast_holt_info_orders_monthly": f"""
WITH RECURSIVE {holt_ctes(ORDM_SEQ)}
SELECT series_id, {_r('a', 4)} AS alpha, {_r('b', 4)} AS beta, {_r('l', 4)} AS level, {_r('tr', 4)} AS trend FROM best""",

    "arima_ar1_lineitem": f"""
WITH li AS (
  SELECT m.series_id, row_number() OVER (PARTITION BY m.series_id ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS seq,
         count(*) OVER (PARTITION BY m.series_id) AS n,
         CASE m.series_id WHEN 'l_quantity' THEN l_quantity WHEN 'l_extendedprice' THEN l_extendedprice
              WHEN 'l_discount' THEN l_discount ELSE l_tax END AS value
  FROM lineitem CROSS JOIN (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS series_id) m),
lagged AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY seq) AS before FROM li),
fit AS (
  SELECT series_id, floor(max(n) * 0.8) AS cut, regr_slope(value, before) AS phi, regr_intercept(value, before) AS const,
         count(before) AS nobs, max_by(value, seq) AS last_value
  FROM lagged WHERE seq < floor(n * 0.8) GROUP BY 1),
noise AS (
  SELECT series_id, avg((value - const - phi * before) ** 2) AS sigma2
  FROM lagged JOIN fit USING (series_id) WHERE seq < cut AND before IS NOT NULL GROUP BY 1),
ahead AS (
  SELECT series_id, value, const / (1 - phi) + phi ** (seq - cut + 1) * (last_value - const / (1 - phi)) AS pred
  FROM li JOIN fit USING (series_id) WHERE seq >= cut),
err AS (SELECT series_id, avg((value - pred) ** 2) AS mse, avg(abs(value - pred)) AS mae FROM ahead GROUP BY 1)
SELECT series_id, {_r('phi', 5)} AS phi, {_r('const', 5)} AS const, {_r('sigma2', 5)} AS sigma2, nobs,
       {_r('mse', 5)} AS mse, {_r('sqrt(mse)', 5)} AS rmse, {_r('mae', 5)} AS mae
FROM fit JOIN noise USING (series_id) JOIN err USING (series_id)""",

    "forecast_trend_only_events_daily": f"""
WITH s AS (SELECT series_id, ts, value, seq, n, epoch(ts) AS t FROM ({seqd(EVD)})),
tr AS (SELECT series_id, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM s WHERE seq < floor(n * 0.8) GROUP BY 1),
m AS (SELECT series_id, avg((value - a - b * t) ** 2) AS mse, avg(abs(value - a - b * t)) AS mae,
             avg(CASE WHEN value <> 0 THEN abs((value - a - b * t) / value) END) * 100 AS mape
      FROM s JOIN tr USING (series_id) WHERE seq >= floor(n * 0.8) GROUP BY 1),
f AS (SELECT series_id, regr_slope(value, t) AS b, regr_intercept(value, t) AS a, max(ts) AS last_ts, max(n) AS n FROM s GROUP BY 1),
sd AS (SELECT series_id, sqrt(sum((value - a - b * t) ** 2) / (max(f.n) - 1)) AS sd FROM s JOIN f USING (series_id) GROUP BY 1),
k AS (SELECT f.*, sd, step, last_ts + step * INTERVAL 1 DAY AS ts FROM f JOIN sd USING (series_id) CROSS JOIN (SELECT unnest(range(1, 6)) AS step) z),
p AS (SELECT *, a + b * epoch(ts) AS fc FROM k)
SELECT series_id, step::INTEGER AS step, ts, {_r('fc', 4)} AS forecast, {_r('fc - 1.959963984540054 * sd', 4)} AS lower,
       {_r('fc + 1.959963984540054 * sd', 4)} AS upper, {_r('mse', 4)} AS mse, {_r('sqrt(mse)', 4)} AS rmse,
       {_r('mae', 4)} AS mae, {_r('mape', 4)} AS mape FROM p JOIN m USING (series_id)""",

    "forecast_lag2_events_daily": f"""
WITH RECURSIVE s AS (SELECT series_id, ts, value, seq, n FROM ({seqd(EVD)})),
c AS (SELECT series_id, min(value) AS mn, max(value) - min(value) AS span, max(n) AS n, max(ts) AS last_ts FROM s GROUP BY 1),
x AS (SELECT s.series_id, s.seq, (value - mn) / span AS y FROM s JOIN c USING (series_id)),
w AS (SELECT series_id, seq - 2 AS win, y, lag(y, 2) OVER o AS x1, lag(y, 1) OVER o AS x2 FROM x WINDOW o AS (PARTITION BY series_id ORDER BY seq)),
t AS (SELECT w.*, floor((c.n - 2) * 0.8) AS train FROM w JOIN c USING (series_id) WHERE win >= 0),
q AS (SELECT series_id, covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y,
             covar_pop(x2, y) AS s2y, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM t WHERE win < train GROUP BY 1),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM q),
f AS (SELECT series_id, b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM b),
e AS (SELECT t.series_id, y * span + mn AS actual, (b0 + b1 * x1 + b2 * x2) * span + mn AS fc
      FROM t JOIN f USING (series_id) JOIN c USING (series_id) WHERE win >= train),
m AS (SELECT series_id, avg((actual - fc) ** 2) AS mse, avg(abs(actual - fc)) AS mae,
             avg(CASE WHEN actual <> 0 THEN abs((actual - fc) / actual) END) * 100 AS mape FROM e GROUP BY 1),
r(series_id, step, x1, x2) AS (
  SELECT t.series_id, 0, x2, y FROM t JOIN c USING (series_id) WHERE win = n - 3
  UNION ALL SELECT r.series_id, step + 1, x2, b0 + b1 * x1 + b2 * x2 FROM r JOIN f USING (series_id) WHERE step < 5),
p AS (SELECT series_id, step, x2 * span + mn AS fc, last_ts + step * INTERVAL 1 DAY AS ts FROM r JOIN c USING (series_id) WHERE step > 0)
SELECT series_id, step::INTEGER AS step, ts, {_r('fc', 4)} AS forecast, {_r('fc - 1.959963984540054 * sqrt(mse)', 4)} AS lower,
       {_r('fc + 1.959963984540054 * sqrt(mse)', 4)} AS upper, {_r('mse', 4)} AS mse, {_r('sqrt(mse)', 4)} AS rmse,
       {_r('mae', 4)} AS mae, {_r('mape', 4)} AS mape FROM p JOIN m USING (series_id)""",

    "forecast_constant_events": f"""
WITH c AS (SELECT series_id, count(*) AS n, max(ts) AS last_ts FROM ({EV})
           WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1)
SELECT series_id, 'arima' AS model, 5 AS horizon, step::INTEGER AS step, last_ts + step * INTERVAL 1 DAY AS ts,
       (n + step - 1)::BIGINT AS seq, 1.0::DOUBLE AS forecast, 1.0::DOUBLE AS lower, 1.0::DOUBLE AS upper
FROM c CROSS JOIN (SELECT unnest(range(1, 6)) AS step) k""",

    "holdout_holt_events_daily": f"""
WITH RECURSIVE {holt_ctes(EVD_TRAIN)},
test AS (SELECT series_id, seq, value FROM ({seqd(EVD)}) WHERE seq >= floor(n * 0.8)),
p AS (SELECT test.series_id, test.value AS actual, best.l + (test.seq - best.n + 1) * best.tr AS fc
      FROM test JOIN best USING (series_id)),
m AS (SELECT series_id, count(*) AS n_eval, avg((actual - fc) * (actual - fc)) AS mse, avg(abs(actual - fc)) AS mae,
             CASE WHEN sum(CASE WHEN actual = 0 THEN 1 ELSE 0 END) > 0 THEN NULL
                  ELSE avg(abs((actual - fc) / actual)) * 100.0 END AS mape FROM p GROUP BY 1)
SELECT series_id, n_eval, {_r('mse')} AS mse, {_r('sqrt(mse)')} AS rmse, {_r('mae')} AS mae, {_r('mape')} AS mape FROM m""",

    "forecast_with_history_events_daily": f"""
SELECT series_id, ts, seq, {_r('value')} AS value, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, 'observed' AS kind
FROM ({seqd(EVD)})
UNION ALL
SELECT series_id, ts, seq, forecast, lower, upper, 'forecast' FROM ({holt_rows(EVD_SEQ, [7])})""",

    "forecast_range_events_daily": f"""
SELECT series_id, model, horizon, min(ts) AS first_date, max(ts) AS last_date, count(*) AS steps
FROM ({holt_rows(EVD_SEQ, [3, 7, 14])}) GROUP BY 1, 2, 3""",
}
