"""Additive trend + seasonality forecaster (survey F6, F7; re-aim of a Bayesian
curve-fitting forecaster, not a replica of its sampler).

y / max|y| = k t + m + sum_j delta_j (t - s_j)+ + Fourier seasonalities + noise

* t is time scaled to [0, 1] over the fitting history; 25 changepoints s_j
  evenly spaced over the first 80 % of it;
* Fourier blocks on absolute days: yearly (365.25 d, order 10) if the history
  spans >= 2 years, weekly (7 d, order 3) if it spans >= 2 weeks with spacing
  < 1 week, daily (1 d, order 4) if it spans >= 2 days with spacing < 1 day,
  monthly (30.5 d, order 5) if there are >= 30 points;
* ridge penalties on changepoint slopes and Fourier terms (MAP-style shrinkage);
* 95 % interval: +-1.96 residual standard deviation.

Every feature is a Spark SQL expression of ``ts`` and a few per-series
constants; the fit is a distributed Gram matrix (:mod:`..linalg`) and a tiny
per-series ridge solve, prediction is a broadcast join of coefficients — the
model fits one arbitrarily long series as easily as many short ones.
Evaluation: fit on the first 80 %, score the rest; then refit on all points and
forecast after the last observation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...schema import SEQ, SERIES, TS, VALUE
from ..joins import bounded
from ..linalg import gram, solve
from ..order import chunk_window, lagged
from .common import Prepared, spread_interval, steps_for

N_CHANGEPOINTS = 25
# Seasonal blocks (name, period in days, Fourier order).
SEASONALITIES = (("yearly", 365.25, 10), ("weekly", 7.0, 3), ("daily", 1.0, 4), ("monthly", 30.5, 5))
RIDGE_CHANGEPOINT = 10.0
RIDGE_SEASONAL = 0.01
DAY = 86400.0


def feature_names() -> list[str]:
    names = ["_one", "_t"] + [f"_cp{j}" for j in range(1, N_CHANGEPOINTS + 1)]
    for name, _, order in SEASONALITIES:
        names += [f"_{name}_{f}{k}" for k in range(1, order + 1) for f in ("s", "c")]
    return names


def features(ts: Column) -> dict[str, Column]:
    """Feature expressions; needs per-series columns _t0, _t1, _use_<season>."""
    secs = F.unix_timestamp(ts.cast("timestamp")).cast("double")
    t = (secs - F.col("_t0")) / F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1.0))
    days = secs / DAY
    out = {"_one": F.lit(1.0), "_t": t}
    for j in range(1, N_CHANGEPOINTS + 1):
        s = 0.8 * j / N_CHANGEPOINTS
        out[f"_cp{j}"] = F.when(F.col("_use_changes"), F.greatest(t - F.lit(s), F.lit(0.0))).otherwise(0.0)
    for name, period, order in SEASONALITIES:
        use = F.col(f"_use_{name}")
        for k in range(1, order + 1):
            arg = F.lit(2 * math.pi * k / period) * days
            out[f"_{name}_s{k}"] = F.when(use, F.sin(arg)).otherwise(0.0)
            out[f"_{name}_c{k}"] = F.when(use, F.cos(arg)).otherwise(0.0)
    return out


def _penalties() -> np.ndarray:
    pen = []
    for n in feature_names():
        if n in ("_one", "_t"):
            pen.append(1e-9)
        elif n.startswith("_cp"):
            pen.append(RIDGE_CHANGEPOINT)
        else:
            pen.append(RIDGE_SEASONAL)
    return np.array(pen)


def _solve_fn(sid: str, g: np.ndarray) -> pd.DataFrame:
    k = g.shape[0] - 1
    pen = _penalties()
    active = np.diag(g)[:k] > 0
    beta = np.zeros(k)
    idx = np.where(active)[0]
    a = g[np.ix_(idx, idx)] + np.diag(pen[idx])
    beta[idx] = np.linalg.solve(a, g[idx, k])
    n = g[0, 0]
    ssr = float(g[k, k] - 2 * beta @ g[:k, k] + beta @ g[:k, :k] @ beta)
    sd = math.sqrt(max(ssr, 0.0) / max(n - 1, 1))
    return pd.DataFrame({SERIES: [sid], "coef": [beta.tolist()], "resid_sd": [sd]})


def _history(rows: DataFrame, max_chunk, trend_only: bool) -> DataFrame:
    """Per-series fitting constants from the rows to fit on, and which features they allow."""
    w = chunk_window()
    gaps = lagged(rows, {"_prev": F.lag(TS, 1).over(w)}, back=1, max_chunk=max_chunk)
    gap = (F.unix_timestamp(F.col(TS).cast("timestamp")) - F.unix_timestamp(F.col("_prev").cast("timestamp")))
    h = gaps.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("_nfit"),
        F.min(F.unix_timestamp(F.col(TS).cast("timestamp"))).cast("double").alias("_t0"),
        F.max(F.unix_timestamp(F.col(TS).cast("timestamp"))).cast("double").alias("_t1"),
        F.min(F.when(gap > 0, gap)).alias("_spacing"),
        F.max(F.abs(F.col(VALUE))).alias("_ymax"))
    span = F.col("_t1") - F.col("_t0")
    return h.select(
        SERIES, "_nfit", F.lit(not trend_only).alias("_use_changes"), "_t0", "_t1", F.when(F.col("_ymax") > 0, F.col("_ymax")).otherwise(1.0).alias("_ymax"),
        (F.lit(not trend_only) & (span >= 2 * 365.25 * DAY)).alias("_use_yearly"),
        (F.lit(not trend_only) & ((span >= 14 * DAY) & (F.col("_spacing") < 7 * DAY))).alias("_use_weekly"),
        (F.lit(not trend_only) & ((span >= 2 * DAY) & (F.col("_spacing") < DAY))).alias("_use_daily"),
        (F.lit(not trend_only) & (F.col("_nfit") >= 30)).alias("_use_monthly"))


def fit(rows: DataFrame, max_chunk=None, trend_only: bool = False) -> DataFrame:
    """``(series_id, coef, resid_sd, <history constants>)`` for the given rows; ``trend_only`` leaves
    changepoints and seasons out (a straight line by least squares)."""
    hist = bounded(_history(rows, max_chunk, trend_only))
    feats = features(F.col(TS))
    names = feature_names()
    design = rows.join(hist, SERIES).select(
        SERIES, *[feats[n].alias(n) for n in names], (F.col(VALUE) / F.col("_ymax")).alias("_y"))
    coefs = solve(gram(design, names + ["_y"]), len(names), _solve_fn,
                  f"{SERIES} string, coef array<double>, resid_sd double")
    return bounded(coefs.join(hist, SERIES))


def predict(points: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``yhat`` and component columns (trend, yearly, weekly, daily, monthly)."""
    feats = features(F.col(TS))
    names = feature_names()
    df = points.join(model, SERIES)
    comp = {"trend": [], "yearly": [], "weekly": [], "daily": [], "monthly": []}
    for i, n in enumerate(names, start=1):
        term = F.element_at(F.col("coef"), i) * feats[n]
        if n in ("_one", "_t") or n.startswith("_cp"):
            comp["trend"].append(term)
        else:
            comp[n.split("_")[1]].append(term)
    out = df
    for name, terms in comp.items():
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        out = out.withColumn(name, total * F.col("_ymax"))
    return out.withColumn("yhat", F.col("trend") + F.col("yearly") + F.col("weekly") + F.col("daily")
                          + F.col("monthly"))


def additive_forecast(prep: Prepared, horizons: Sequence[int], model: str = "prophet",
                      with_components: bool = False, trend_only: bool = False):
    facts = prep.varying()
    data = prep.clean.join(facts.select(SERIES, "n"), SERIES).where(F.col(TS).isNotNull())
    # hold-out: first 80 % (no split at n <= 5)
    split = F.when(F.col("n") > 5, F.floor(F.col("n") * 0.8)).otherwise(F.col("n"))
    train = data.where(F.col(SEQ) < split).drop("n")
    test = data.where(F.col(SEQ) >= split).drop("n")
    m_train = fit(train, prep.max_chunk, trend_only)
    scored = predict(test, m_train).select(SERIES, F.col(VALUE).alias("actual"), F.col("yhat").alias("forecast"))
    from ..stats import forecast_metrics
    metrics = forecast_metrics(scored, "actual", "forecast", zero_policy="skip")
    m_all = fit(data.drop("n"), prep.max_chunk, trend_only)
    fut = steps_for(prep, facts, horizons)
    pred = predict(fut, m_all)
    lower, upper = spread_interval(F.col("yhat"), F.col("resid_sd") * F.col("_ymax"))
    cols = [SERIES, F.lit(model).alias("model"), F.col("horizon").cast("int").alias("horizon"),
            F.col("step").cast("int").alias("step"), TS, SEQ, F.col("yhat").alias("forecast"),
            lower.alias("lower"), upper.alias("upper")]
    if with_components:
        cols += ["trend", "yearly", "weekly", "daily", "monthly"]
    rows = pred.select(*cols)
    info = m_all.select(SERIES, "_use_yearly", "_use_weekly", "_use_daily", "_use_monthly").join(
        metrics, SERIES, "left").select(
        SERIES, F.lit(model).alias("model"), F.lit("ok").alias("status"),
        F.lit("Additive piecewise-linear trend with Fourier seasonalities (ridge fit)").alias("description"),
        F.col("_use_yearly").alias("yearly"), F.col("_use_weekly").alias("weekly"),
        F.col("_use_daily").alias("daily"), F.col("_use_monthly").alias("monthly"),
        "mse", "rmse", "mae", "mape")
    return rows, info


def forecast_components(prep: Prepared, horizons: Sequence[int]) -> DataFrame:
    """per-step trend and seasonal parts of the additive forecast."""
    rows, _ = additive_forecast(prep, horizons, with_components=True)
    return rows.select(SERIES, "horizon", "step", TS, "forecast", "trend", "yearly", "weekly", "daily", "monthly")
