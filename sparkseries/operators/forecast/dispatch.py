"""Forecast dispatcher (survey F1): every series x every horizon, one uniform result schema for all models.

Each model is fitted once per series at the largest horizon and the shorter
horizons are slices of that path (the reference refits per horizon).
Constant series get the constant forecast whatever the model; series with
fewer than 5 points get a status row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...schema import SERIES
from .common import Prepared, check_horizons, check_model, constant_forecast

INFO_COLUMNS = (SERIES, "model", "status", "description")


def forecast(long: DataFrame, model: str = "arima", horizons: Sequence[int] | int | None = None,
             periods: int = 10, max_chunk: int | None = None, mode: str = "holdout") -> tuple[DataFrame, DataFrame]:
    """Returns ``(forecast rows, info rows)``.  Arguments are checked before any job.

    ``mode="in_sample"`` (ARIMA models) reports one-step errors of the final fit instead of the
    hold-out forecast's."""
    model = check_model(model)
    hs = check_horizons(horizons, periods)
    prep = Prepared(long, max_chunk=max_chunk)
    if model == "exponential_smoothing":
        from .holt import holt_forecast as run
    elif model == "arima":
        from .arima import arima_forecast as run
    elif model == "sarima":
        from .arima import sarima_forecast as run
    elif model == "prophet":
        from .additive import additive_forecast as run
    else:
        from .lagwindow import lag_window_forecast as run
    if mode != "holdout" and model not in ("arima", "sarima"):
        raise ValueError(f"{model} has no mode {mode!r}")
    rows, info = run(prep, hs, model, mode=mode) if model in ("arima", "sarima") else run(prep, hs, model)
    c_rows, c_info = constant_forecast(prep, hs, model)
    rows = rows.unionByName(c_rows)
    info = info.unionByName(c_info, allowMissingColumns=True)
    failed = prep.status.where(F.col("status") != "ok").select(
        SERIES, F.lit(model).alias("model"), "status", F.col("reason").alias("description"))
    # series the model itself declined (e.g. < 10 points for the lag-window model)
    declined = prep.ok.select(SERIES).join(info.select(SERIES), SERIES, "left_anti").select(
        SERIES, F.lit(model).alias("model"), F.lit("error").alias("status"),
        F.lit(f"too_short_for_{model}").alias("description"))
    info = info.unionByName(failed, allowMissingColumns=True).unionByName(declined, allowMissingColumns=True)
    return rows, info
