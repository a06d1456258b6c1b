"""Shared forecasting pieces (survey F1, F2, F9, F10, F11, F13).

Forecast rows (uniform for every model)::

    series_id, model, horizon INT, step INT, ts TIMESTAMP_NTZ, seq BIGINT,
    forecast DOUBLE, lower DOUBLE, upper DOUBLE

Info rows: ``series_id, model, status, description`` plus model columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.nulls import is_missing
from ...schema import SEQ, SERIES, TB, TS, VALUE
from ..calendar import future_dates, infer_frequency
from ..joins import bounded
from ..order import with_seq

MODELS = ("arima", "sarima", "exponential_smoothing", "prophet", "lstm")
Z95 = 1.959963984540054
MIN_POINTS = 5
FORECAST_COLUMNS = (SERIES, "model", "horizon", "step", TS, SEQ, "forecast", "lower", "upper")


def check_horizons(horizons: Sequence[int] | int | None, periods: int = 10) -> list[int]:
    """Positive integer horizons, sorted, without repeats."""
    if horizons is None:
        horizons = [periods]
    if isinstance(horizons, int):
        horizons = [horizons]
    hs = list(horizons)
    for h in hs:
        if not isinstance(h, int) or isinstance(h, bool) or h < 1:
            raise ValueError(f"forecast horizons must be positive integers, got {h!r}")
    return sorted(set(hs))


def check_model(model: str) -> str:
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}, got {model!r}")
    return model


class Prepared:
    """A cleaned, numbered series set plus its per-series facts (one row per series)."""

    def __init__(self, long: DataFrame, min_points: int = MIN_POINTS, max_chunk: int | None = None):
        raw_counts = long.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n_rows"))
        clean = long.where(~is_missing(F.col(VALUE)))
        facts = clean.groupBy(SERIES).agg(
            F.count(F.lit(1)).alias("n"), F.max(TS).alias("last_ts"),
            F.min(VALUE).alias("_mn"), F.max(VALUE).alias("_mx"),
            F.min_by(VALUE, F.struct(TS, TB)).alias("first_value"),
            F.max_by(VALUE, F.struct(TS, TB)).alias("last_value"))
        facts = facts.join(infer_frequency(clean, max_chunk), SERIES, "left")
        facts = raw_counts.join(facts, SERIES, "left").select(
            SERIES, F.coalesce(F.col("n"), F.lit(0)).alias("n"), "last_ts", "freq", "first_value",
            "last_value", (F.col("_mn") == F.col("_mx")).alias("is_constant"))
        self.facts = bounded(facts)
        self.plain = self.facts.sparkseries_plain
        ok = self.facts.where(F.col("n") >= min_points)
        self.status = self.facts.select(
            SERIES, F.when(F.col("n") == 0, "error").when(F.col("n") < min_points, "error")
            .otherwise("ok").alias("status"),
            F.when(F.col("n") == 0, "no_values")
            .when(F.col("n") < min_points, f"fewer_than_{min_points}")
            .alias("reason"))
        self.ok = ok
        self.clean = with_seq(clean.join(ok.select(SERIES), SERIES, "left_semi"),
                              sizes=ok.select(SERIES, "n"), max_chunk=max_chunk)
        self.max_chunk = max_chunk

    def varying(self) -> DataFrame:
        return self.ok.where(~F.col("is_constant"))

    def constant(self) -> DataFrame:
        return self.ok.where(F.col("is_constant"))


def steps_for(prep: Prepared, facts: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """``(series_id, horizon, step, ts, seq)`` — future stamps for every horizon."""
    hmax = max(horizons)
    # the checked size of the facts does not cover horizon times as many rows: no broadcast hint here
    rows = prep.plain.join(facts.select(SERIES), SERIES, "left_semi")
    fut = future_dates(rows.select(SERIES, "last_ts", "freq", "n"), hmax)
    hz = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")
    return fut.select("*", hz).where(F.col("step") <= F.col("horizon"))


# ---------------------------------------------------------------- F2
def constant_forecast(prep: Prepared, horizons: Sequence[int], model: str) -> tuple[DataFrame, DataFrame]:
    """Constant series: repeat the value; bounds equal the forecast."""
    const = prep.constant()
    rows = steps_for(prep, const, horizons).join(const.select(SERIES, "first_value"), SERIES).select(
        SERIES, F.lit(model).alias("model"), F.col("horizon").cast("int").alias("horizon"),
        F.col("step").cast("int").alias("step"), TS, SEQ, F.col("first_value").alias("forecast"),
        F.col("first_value").alias("lower"), F.col("first_value").alias("upper"))
    info = const.select(SERIES, F.lit(model).alias("model"), F.lit("ok").alias("status"),
                        F.lit("All values are equal: the value is repeated").alias("description"))
    return rows, info


# ---------------------------------------------------------------- F9
def symmetric_interval(point, halfwidth):
    """``(lower, upper)`` = point -+ halfwidth."""
    return point - halfwidth, point + halfwidth


def spread_interval(point, standard_error):
    """95 % interval of a model that knows its standard error."""
    return symmetric_interval(point, F.lit(Z95) * standard_error)


def error_interval(point, rmse, lo: float = 0.9, hi: float = 1.1):
    """95 % interval from a hold-out error: -+ 1.96 RMSE, or a share of the point where there is none."""
    lower, upper = symmetric_interval(point, F.lit(Z95) * rmse)
    return F.coalesce(lower, point * F.lit(lo)), F.coalesce(upper, point * F.lit(hi))


def mean_errors(sums: DataFrame) -> DataFrame:
    """``(series_id, mse, rmse, mae, mape)`` from partial sums ``(points, se, ae, ape, zeros)``; MAPE is
    NULL where an actual value is zero, and what is not finite is NULL."""
    g = sums.groupBy(SERIES).agg(*[F.sum(c).alias(c) for c in ("points", "se", "ae", "ape", "zeros")])

    def known(x):
        return F.when(F.abs(x) < F.lit(float("inf")), x)

    mse = known(F.col("se") / F.col("points"))
    return g.select(SERIES, mse.alias("mse"), F.sqrt(mse).alias("rmse"), known(F.col("ae") / F.col("points")).alias("mae"),
                    F.when(F.col("zeros") == 0, known(100 * F.col("ape") / F.col("points"))).alias("mape"))


# ---------------------------------------------------------------- F10
def evaluate_forecast(pred: DataFrame, actual: DataFrame, zero_policy: str = "null",
                      by: Sequence[str] = (SERIES,)) -> DataFrame:
    """Join predictions ``(series_id, seq, forecast)`` with held-out actuals ``(series_id, seq, value)``
    and compute MSE / RMSE / MAE / MAPE per group."""
    from ..stats import forecast_metrics
    pairs = pred.join(actual.select(SERIES, SEQ, F.col(VALUE).alias("actual")), [SERIES, SEQ])
    return forecast_metrics(pairs, "actual", "forecast", by=by, zero_policy=zero_policy)


# ---------------------------------------------------------------- F11 / F13
def forecast_with_history(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Observed points and forecasts in one frame, tagged by ``kind``."""
    obs = history.select(SERIES, TS, SEQ, VALUE).withColumn("kind", F.lit("observed"))
    fc = forecast.withColumn("kind", F.lit("forecast"))
    return obs.unionByName(fc, allowMissingColumns=True)


def forecast_range(forecast: DataFrame) -> DataFrame:
    """First and last forecast time stamp per series, model and horizon."""
    return forecast.groupBy(SERIES, "model", "horizon").agg(
        F.min(TS).alias("first_date"), F.max(TS).alias("last_date"), F.count(F.lit(1)).alias("steps"))
