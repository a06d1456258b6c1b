"""Registered queries: forecasting (survey F1-F13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.forecast import common as fc
from ..operators.forecast.dispatch import forecast
from ..operators.forecast.holt import holt_fit
from ..operators import order, roles
from ..schema import SEQ, SERIES, TB, TS, VALUE
from ..sources import canonical as cz
from .catalog import register, rounded
from .catalog_series import evd, ord_m
from .sql_forecast import SQL

FC_COLS = [SERIES, "model", "horizon", "step", TS, SEQ, "forecast", "lower", "upper"]


def _q(name):
    return register(name, SQL.get(name))


@_q("forecast_holt_events_daily")
def q_forecast_holt_events_daily(spark, sf):
    """F1 + F3 + F9: Holt forecasts of EVD at horizons 3, 7 and 14 (fit once, sliced)."""
    rows, _ = forecast(evd(spark, sf), "exponential_smoothing", [14, 3, 7])
    return rounded(rows.select(*FC_COLS))


@_q("forecast_holt_info_orders_monthly")
def q_forecast_holt_info_orders_monthly(spark, sf):
    """chosen smoothing parameters and final state for ORD_M."""
    rows, info = forecast(ord_m(spark, sf), "exponential_smoothing", [3])
    return rounded(info.select(SERIES, "alpha", "beta", "level", "trend"), 4)


@_q("forecast_constant_events")
def q_forecast_constant_events(spark, sf):
    """a constant series (one indicator per event) gets the constant forecast."""
    long = cz.events_long(spark, sf).withColumn(VALUE, F.when(F.col(VALUE) >= 0, F.lit(1.0)))
    rows, _ = forecast(long, "arima", [5])
    return rounded(rows.select(*FC_COLS))


@_q("holdout_holt_events_daily")
def q_holdout_holt_events_daily(spark, sf):
    """F10 + C8: Holt fitted on the first 80 % of EVD, scored on the rest."""
    seqd = order.with_seq(evd(spark, sf))
    sized = order.chronological_split(seqd)
    train = sized.where(F.col("split") == "train").select(SERIES, TS, TB, VALUE, SEQ)
    test = sized.where(F.col("split") == "test").select(SERIES, SEQ, VALUE)
    facts = train.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n"))
    fit = holt_fit(train, facts)
    steps = test.join(facts, SERIES).join(fit, SERIES).withColumn("k", (F.col(SEQ) - F.col("n") + 1).cast("double"))
    pred = steps.select(SERIES, SEQ, (F.col("level") + F.col("k") * F.col("trend")).alias("forecast"))
    return rounded(fc.evaluate_forecast(pred, test, zero_policy="null"))


@_q("forecast_with_history_events_daily")
def q_forecast_with_history_events_daily(spark, sf):
    """observed EVD and its 7-step Holt forecast in one tagged frame."""
    hist = order.with_seq(evd(spark, sf))
    rows, _ = forecast(evd(spark, sf), "exponential_smoothing", [7])
    both = fc.forecast_with_history(hist, rows.select(SERIES, TS, SEQ, F.col("forecast").alias(VALUE),
                                                      "lower", "upper"))
    return rounded(both.select(SERIES, TS, SEQ, VALUE, "lower", "upper", "kind"))


@_q("forecast_range_events_daily")
def q_forecast_range_events_daily(spark, sf):
    """first and last forecast date per series and horizon."""
    rows, _ = forecast(evd(spark, sf), "exponential_smoothing", [3, 7, 14])
    return fc.forecast_range(rows)


@_q("forecast_arima_orders_monthly")
def q_forecast_arima_orders_monthly(spark, sf):
    """ARIMA (ADF -> d, AIC order search on 80 %, refit, psi intervals) on ORD_M."""
    rows, _ = forecast(ord_m(spark, sf), "arima", [6, 12])
    return rounded(rows.select(*FC_COLS), 2)


@_q("arima_ar1_lineitem")
def q_arima_ar1_lineitem(spark, sf):
    """F4 + F10: AR(1) with a constant on whole line-item series in pieces of 16,384 points (the
    regression on the point before, on the first 80 %), multi-step hold-out metrics on the rest."""
    from ..operators.forecast.arima import fit_fixed
    prep = fc.Prepared(cz.lineitem_long(spark, sf), max_chunk=16_384)
    fits = fit_fixed(prep, {"p": 1})
    return rounded(fits.select(SERIES, F.element_at("params", 1).alias("phi"), F.element_at("params", 2).alias("const"),
                               (F.col("sse") / F.col("nobs")).alias("sigma2"), "nobs", "mse", "rmse", "mae"), 5)


@_q("forecast_arima_lineitem")
def q_forecast_arima_lineitem(spark, sf):
    """F4 + F12 at length: the whole order grid on line-item series of every row, in pieces of 16,384
    points, and the winner's forecast with its order, AIC and hold-out error."""
    long = cz.lineitem_long(spark, sf).where(F.col(SERIES).isin("l_quantity", "l_extendedprice"))
    rows, info = forecast(long, "arima", [5], max_chunk=16_384)
    both = rows.join(info.select(SERIES, "status", "p", "d", "q", "aic", "rmse"), SERIES)
    return rounded(both.select(*FC_COLS, "status", "p", "d", "q", "aic", "rmse"), 2)


@_q("arima_order_grid_orders_monthly")
def q_arima_order_grid_orders_monthly(spark, sf):
    """every (p, d, q) candidate with its AIC, as rows."""
    from ..operators.forecast.arima import order_grid
    grid, _ = order_grid(fc.Prepared(ord_m(spark, sf)))
    return rounded(grid.select(SERIES, "p", "d", "q", "aic", "nobs", "status"), 3)


@_q("forecast_sarima_orders_monthly")
def q_forecast_sarima_orders_monthly(spark, sf):
    """SARIMA(1,1,1)(1,1,1,12) on ORD_M."""
    rows, _ = forecast(ord_m(spark, sf), "sarima", [12])
    return rounded(rows.select(*FC_COLS), 2)


@_q("forecast_additive_orders_daily")
def q_forecast_additive_orders_daily(spark, sf):
    """additive trend + seasonality model on daily ORD (raw orders)."""
    rows, _ = forecast(roles.drop_missing(cz.orders_daily_long(spark, sf)), "prophet", [7, 30])
    return rounded(rows.select(*FC_COLS), 2)


def _scored(rows, info):
    both = rows.join(info.select(SERIES, "mse", "rmse", "mae", "mape"), SERIES)
    return rounded(both.select(SERIES, "step", TS, "forecast", "lower", "upper", "mse", "rmse", "mae", "mape"), 4)


@_q("forecast_trend_only_events_daily")
def q_forecast_trend_only_events_daily(spark, sf):
    """F6 + F9 + F10: the additive model with its trend alone on EVD, hold-out metrics beside it."""
    from ..operators.forecast.additive import additive_forecast
    return _scored(*additive_forecast(fc.Prepared(evd(spark, sf)), [5], trend_only=True))


@_q("forecast_lag2_events_daily")
def q_forecast_lag2_events_daily(spark, sf):
    """F8 + F9 + F10: the lag-window model with two lags on EVD, hold-out metrics beside it."""
    from ..operators.forecast.lagwindow import lag_window_forecast
    return _scored(*lag_window_forecast(fc.Prepared(evd(spark, sf)), [5], length=2))


@_q("forecast_components_orders_monthly")
def q_forecast_components_orders_monthly(spark, sf):
    """per-step trend / yearly / monthly components of the additive forecast."""
    from ..operators.forecast.additive import forecast_components
    return rounded(forecast_components(fc.Prepared(ord_m(spark, sf)), [6]), 2)


@_q("forecast_lag_window_orders_monthly")
def q_forecast_lag_window_orders_monthly(spark, sf):
    """F8: lag-window autoregression (scaled, 80/20 metrics, recursive rollout) on ORD_M."""
    rows, _ = forecast(ord_m(spark, sf), "lstm", [6])
    return rounded(rows.select(*FC_COLS), 2)


@_q("forecast_metrics_lag_window_events_daily")
def q_forecast_metrics_lag_window_events_daily(spark, sf):
    """F8 + F10: hold-out metrics of the lag-window model on EVD."""
    _, info = forecast(evd(spark, sf), "lstm", [3])
    return rounded(info.select(SERIES, "sequence_length", "mse", "rmse", "mae", "mape"), 4)
