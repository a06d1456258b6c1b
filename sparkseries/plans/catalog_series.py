"""Registered queries: ordering, windows, calendar, diagnostics, decomposition
(survey E, G, H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import decompose, diagnostics, order, roles
from ..schema import SEQ, SERIES, TB, TS, VALUE
from ..sources import canonical as cz
from .catalog import fround, register, rounded
from .sql_series import SQL


def evd(spark, sf):
    """EVD: daily mean of every event type (regular, 30 days)."""
    return cal.resample_mean(roles.drop_missing(cz.events_long(spark, sf)), "D").drop("n")


def ord_m(spark, sf):
    """ORD_M: monthly mean order price per priority (month-end labels)."""
    return cal.resample_mean(roles.drop_missing(cz.orders_long(spark, sf)), "M").drop("n")


def _q(name):
    return register(name, SQL.get(name))


# ---------------------------------------------------------------- E
@_q("order_series_events")
def q_order_series_events(spark, sf):
    """Every event in (series, time, tiebreak) order, with the row's sorted predecessor in its partition
    checked (``in_order``)."""
    out = order.order_series(cz.events_long(spark, sf))
    before = F.struct(SERIES, TS, TB)
    late = out.select(SERIES, TS, TB, VALUE, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    prev = F.lag(before).over(Window.partitionBy("_p").orderBy("_i"))
    return rounded(late.select(SERIES, TS, TB, VALUE, F.coalesce(prev <= before, F.lit(True)).alias("in_order")))


@_q("with_seq_orders")
def q_with_seq_orders(spark, sf):
    """0-based position of every order inside its priority by (date, orderkey)."""
    return order.with_seq(cz.orders_long(spark, sf)).select(SERIES, TB, SEQ)


@_q("lag1_autocorr_orders_daily")
def q_lag1_autocorr_orders_daily(spark, sf):
    """E3 on the raw daily table (missing days keep their place)."""
    return rounded(order.lag1_autocorr(cz.orders_daily_long(spark, sf)))


@_q("lag1_autocorr_events")
def q_lag1_autocorr_events(spark, sf):
    """E3 on EV."""
    return rounded(order.lag1_autocorr(cz.events_long(spark, sf)))


@_q("rolling_last_events")
def q_rolling_last_events(spark, sf):
    """Last trailing mean / std (window min(5, n//2)) per series with >= 10 points."""
    _, last = order.rolling_stats(roles.drop_missing(cz.events_long(spark, sf)))
    return rounded(last)


@_q("rolling_series_orders_monthly")
def q_rolling_series_orders_monthly(spark, sf):
    """The full trailing-window series on ORD_M."""
    full, _ = order.rolling_stats(ord_m(spark, sf))
    return rounded(full.select(SERIES, TS, SEQ, "window_size", "rolling_mean", "rolling_std"))


@_q("difference_orders_monthly")
def q_difference_orders_monthly(spark, sf):
    """E5: (1-B)(1-B^12) differences of ORD_M."""
    d = order.difference(ord_m(spark, sf), d=1, seasonal_d=1, m=12)
    return rounded(d.select(SERIES, TS, SEQ, VALUE))


@_q("cumulative_sum_events")
def q_cumulative_sum_events(spark, sf):
    """Running sum per event type in time order."""
    s = order.cumulative_sum(order.with_seq(cz.events_long(spark, sf)))
    return rounded(s.select(SERIES, TB, SEQ, fround("cumsum", 4).alias("cumsum")))


@_q("lag_windows_events_daily")
def q_lag_windows_events_daily(spark, sf):
    """5-lag supervised windows of EVD."""
    w = order.lag_windows(order.with_seq(evd(spark, sf)), 5)
    return rounded(w.select(SERIES, SEQ, "x1", "x2", "x3", "x4", "x5", "target"))


@_q("last_n_orders")
def q_last_n_orders(spark, sf):
    """The last 10 orders of every priority."""
    return rounded(order.last_n(order.with_seq(cz.orders_long(spark, sf)), 10).select(SERIES, TS, TB, SEQ, VALUE))


@_q("sample_recent_lineitem")
def q_sample_recent_lineitem(spark, sf):
    """The most recent 5000 points of every lineitem measure (the sampling operator)."""
    s = order.sample_recent(cz.lineitem_long(spark, sf), 5000)
    return rounded(s.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n"), F.min(TS).alias("first_ts"),
                                         fround(F.sum(VALUE), 2).alias("total")))


@_q("chronological_split_events_daily")
def q_chronological_split_events_daily(spark, sf):
    """80/20 time split of EVD."""
    s = order.chronological_split(order.with_seq(evd(spark, sf)))
    return s.select(SERIES, TS, SEQ, "split", "n_train")


@_q("min_max_scale_events")
def q_min_max_scale_events(spark, sf):
    """Min-max scaling per event type, and its inverse."""
    scaled, scaler = order.min_max_scale(cz.events_long(spark, sf))
    back = order.inverse_scale(scaled, scaler, "scaled", "restored")
    return rounded(back.select(SERIES, TB, "scaled", "restored"))


# ---------------------------------------------------------------- G
@_q("resample_weekly_events")
def q_resample_weekly_events(spark, sf):
    """G1 'W': Monday-Sunday weeks labelled by the Sunday."""
    return rounded(cal.resample_mean(roles.drop_missing(cz.events_long(spark, sf)), "W"))


@_q("resample_monthly_orders")
def q_resample_monthly_orders(spark, sf):
    """G1 'M' (ORD_M)."""
    return rounded(cal.resample_mean(roles.drop_missing(cz.orders_long(spark, sf)), "M"))


@_q("resample_quarterly_lineitem")
def q_resample_quarterly_lineitem(spark, sf):
    """G1 'Q' and 'Y' on LI."""
    clean = roles.drop_missing(cz.lineitem_long(spark, sf))
    q = cal.resample_mean(clean, "Q").withColumn("freq", F.lit("Q"))
    y = cal.resample_mean(clean, "Y").withColumn("freq", F.lit("Y"))
    return rounded(q.unionByName(y))


@_q("calendar_spine_orders_daily")
def q_calendar_spine_orders_daily(spark, sf):
    """Daily buckets of ORD with rows for the empty days."""
    r = cal.resample_mean(roles.drop_missing(cz.orders_long(spark, sf)), "D")
    return rounded(cal.calendar_spine(r, "D"))


@_q("interpolate_orders_daily")
def q_interpolate_orders_daily(spark, sf):
    """Daily ORD made regular (resample, spine, linear interpolation)."""
    reg = cal.regularize(roles.drop_missing(cz.orders_long(spark, sf)), "D")
    return rounded(reg.select(SERIES, TS, SEQ, VALUE))


def _freq_inputs(spark, sf):
    ev = cz.events_long(spark, sf)
    clean = roles.drop_missing(ev)
    parts = [
        evd(spark, sf).withColumn(SERIES, F.concat(F.lit("D:"), SERIES)),
        cal.resample_mean(clean, "W").drop("n").withColumn(SERIES, F.concat(F.lit("W:"), SERIES)),
        ord_m(spark, sf).withColumn(SERIES, F.concat(F.lit("M:"), SERIES)),
        cal.resample_mean(roles.drop_missing(cz.orders_long(spark, sf)), "Q").drop("n")
        .withColumn(SERIES, F.concat(F.lit("Q:"), SERIES)),
        cal.resample_mean(roles.drop_missing(cz.orders_long(spark, sf)), "h").drop("n")
        .withColumn(SERIES, F.concat(F.lit("H:"), SERIES)),
        ev.select(F.concat(F.lit("raw:"), SERIES).alias(SERIES), TS, TB, VALUE),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    return out


@_q("infer_frequency_mixed")
def q_infer_frequency_mixed(spark, sf):
    """G4 on daily, weekly, month-end, quarter-end, hourly-bucketed and raw irregular series."""
    return cal.infer_frequency(_freq_inputs(spark, sf))


@_q("future_dates_mixed")
def q_future_dates_mixed(spark, sf):
    """The next 10 stamps after each series' last point by its inferred frequency ('D' if none)."""
    long = _freq_inputs(spark, sf)
    last = long.groupBy(SERIES).agg(F.max(TS).alias("last_ts"), F.count(F.lit(1)).alias("n"))
    last = last.join(cal.infer_frequency(long), SERIES, "left")
    return cal.future_dates(last, 10)


# ---------------------------------------------------------------- H
@_q("acf_events_daily")
def q_acf_events_daily(spark, sf):
    """H1 on EVD (lags 0..15)."""
    return rounded(diagnostics.acf(evd(spark, sf)).select(SERIES, "lag", "acf"))


@_q("acf_orders_monthly")
def q_acf_orders_monthly(spark, sf):
    """H1 on ORD_M (lags 0..20)."""
    return rounded(diagnostics.acf(ord_m(spark, sf)).select(SERIES, "lag", "acf"))


@_q("pacf_orders_monthly")
def q_pacf_orders_monthly(spark, sf):
    """H2: Yule-Walker (adjusted) partial autocorrelation of ORD_M."""
    return rounded(diagnostics.autocorrelation(ord_m(spark, sf)))


@_q("kpss_events_daily")
def q_kpss_events_daily(spark, sf):
    """H4 on EVD."""
    return rounded(diagnostics.kpss_test(evd(spark, sf)))


@_q("kpss_orders_monthly")
def q_kpss_orders_monthly(spark, sf):
    """H4 on ORD_M."""
    return rounded(diagnostics.kpss_test(ord_m(spark, sf)))


@_q("kpss_events")
def q_kpss_events(spark, sf):
    """H4 on the raw events (2000 points per series)."""
    return rounded(diagnostics.kpss_test(roles.drop_missing(cz.events_long(spark, sf))))


@_q("normality_k2_lineitem")
def q_normality_k2_lineitem(spark, sf):
    """H5, large-sample branch: D'Agostino K^2 on LI."""
    return rounded(diagnostics.dagostino_k2(roles.drop_missing(cz.lineitem_long(spark, sf))))


@_q("normality_events")
def q_normality_events(spark, sf):
    """H5: both tests, with a status where one does not apply, on EV and ORD_M."""
    a = roles.drop_missing(cz.events_long(spark, sf))
    b = ord_m(spark, sf).select(F.concat(F.lit("M:"), SERIES).alias(SERIES), TS, TB, VALUE)
    both = a.unionByName(b)
    return rounded(diagnostics.normality_test(both).unionByName(diagnostics.normality_test(both, method="shapiro")))


@_q("shapiro_w_mixed")
def q_shapiro_w_mixed(spark, sf):
    """H5: the Shapiro-Wilk statistic of EVD, ORD_M and whole EV series (where it applies)."""
    a = roles.drop_missing(cz.events_long(spark, sf))
    parts = [x.select(F.concat(F.lit(tag), SERIES).alias(SERIES), VALUE) for tag, x in (("D:", evd(spark, sf)), ("M:", ord_m(spark, sf)), ("E:", a))]
    w = diagnostics.shapiro_wilk(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return rounded(w.select(SERIES, "n", "test_statistic"), 8)


@_q("decompose_orders_monthly")
def q_decompose_orders_monthly(spark, sf):
    """H6: additive decomposition of ORD_M with period 12."""
    reg = cal.regularize(roles.drop_missing(cz.orders_long(spark, sf)), "M")
    return rounded(decompose.seasonal_decompose(reg, 12))


@_q("decompose_events_daily")
def q_decompose_events_daily(spark, sf):
    """H6 with an odd period: EVD, period 7."""
    return rounded(decompose.seasonal_decompose(order.with_seq(evd(spark, sf)), 7))


@_q("auto_decompose_events_orders")
def q_auto_decompose_events_orders(spark, sf):
    """H7: EVD (inferred daily) and raw orders (irregular -> first eligible calendar)."""
    a = evd(spark, sf).withColumn(SERIES, F.concat(F.lit("EVD:"), SERIES))
    b = cz.orders_long(spark, sf).withColumn(SERIES, F.concat(F.lit("ORD:"), SERIES))
    out = decompose.auto_decompose(a.unionByName(b.select(*a.columns)))
    return rounded(out.select(SERIES, TS, SEQ, VALUE, "trend", "seasonal", "resid", "frequency", "period"))


@_q("adf_orders_monthly")
def q_adf_orders_monthly(spark, sf):
    """H3: augmented Dickey-Fuller (AIC lag choice from one distributed Gram) on ORD_M."""
    return rounded(diagnostics.adf_test(ord_m(spark, sf)), 4)


@_q("adf_no_lag_orders_monthly")
def q_adf_no_lag_orders_monthly(spark, sf):
    """H3 without lagged differences (the plain Dickey-Fuller regression) on ORD_M."""
    out = diagnostics.adf_test(ord_m(spark, sf), max_lag=0)
    return rounded(out.select(SERIES, "nobs", "used_lag", "test_statistic"), 6)


@_q("stationarity_tests_events_daily")
def q_stationarity_tests_events_daily(spark, sf):
    """R1 stationarity section: ADF + KPSS side by side on EVD."""
    return rounded(diagnostics.stationarity_tests(evd(spark, sf)), 4)


@_q("pacf_low_lags_orders_monthly")
def q_pacf_low_lags_orders_monthly(spark, sf):
    """H2 lags 0-2 (closed form available for the oracle) of the Levinson-Durbin PACF on ORD_M."""
    pac = diagnostics.autocorrelation(ord_m(spark, sf)).where(F.col("lag") <= 2)
    return rounded(pac.select(SERIES, "lag", "pacf"))
