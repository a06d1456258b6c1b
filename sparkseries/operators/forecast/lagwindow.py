"""Lag-window autoregressive forecaster (survey F8; re-aim of the neural forecaster).

Steps: min-max scale per series; windows of ``L = max(2, min(5, n // 4))``
previous scaled values with the next value as target; first 80 % of the
windows train a linear autoregression (distributed normal equations), the rest
give hold-out metrics in original units (MAPE skips zero actuals); recursive
``h``-step rollout from the last ``L`` values; interval ``+-1.96 RMSE`` when
hold-out metrics exist, else ``x0.9 / x1.1``.  Series need >= 10 points.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...schema import SEQ, SERIES, VALUE
from ..joins import bounded
from ..linalg import gram, solve
from ..order import chunk_window, lagged
from .common import Prepared, error_interval, steps_for

MAX_L = 5
MIN_POINTS = 10


def windows(prep: Prepared, min_points: int = MIN_POINTS, length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Scaled lag windows ``(series_id, seq, L, win, n_win, train_size, x1..x5, target, scaled)``
    and the per-series scaler/size table; ``length`` (1..5) sets L for every series."""
    if length is not None and not 1 <= length <= MAX_L:
        raise ValueError(f"length must lie in 1..{MAX_L}")
    facts = prep.varying().where(F.col("n") >= min_points)
    data = prep.clean.join(facts.select(SERIES), SERIES, "left_semi")
    scaler = data.groupBy(SERIES).agg(F.min(VALUE).alias("smin"), F.max(VALUE).alias("smax"))
    info = facts.select(SERIES, "n").join(scaler, SERIES).withColumn(
        "L", (F.lit(length) if length else F.greatest(F.lit(2), F.least(F.lit(MAX_L), F.floor(F.col("n") / 4)))).cast("int"))
    info = info.withColumn("n_win", F.col("n") - F.col("L")).withColumn(
        "train_size", F.floor(F.col("n_win") * 0.8).cast("bigint"))
    info = bounded(info)
    scaled = data.join(info, SERIES).withColumn(
        "scaled", (F.col(VALUE) - F.col("smin")) / (F.col("smax") - F.col("smin")))
    w = chunk_window()
    # x1 is the oldest of the L inputs: lag L ... lag 1; unused slots (j > L) are 0
    exprs = {f"_lag{k}": F.lag("scaled", k).over(w) for k in range(1, MAX_L + 1)}
    lg = lagged(scaled, exprs, back=MAX_L, max_chunk=prep.max_chunk)
    xs = {}
    for j in range(1, MAX_L + 1):
        lag_for_j = F.col("L") - j + 1
        xs[f"x{j}"] = F.when(F.col("L") >= j, F.coalesce(*[F.when(lag_for_j == k, F.col(f"_lag{k}"))
                                                            for k in range(1, MAX_L + 1)])).otherwise(F.lit(0.0))
    out = lg.where(F.col(SEQ) >= F.col("L")).select(
        SERIES, SEQ, "L", (F.col(SEQ) - F.col("L")).alias("win"), "n_win", "train_size", "smin", "smax",
        *[e.alias(k) for k, e in xs.items()], F.col("scaled").alias("target"), VALUE)
    return out, info


def _coef_fn(sid: str, g: np.ndarray) -> pd.DataFrame:
    # columns: const, x1..x5, target ; unused x are all-zero -> min-norm lstsq gives 0
    k = g.shape[0] - 1
    beta, *_ = np.linalg.lstsq(g[:k, :k], g[:k, k], rcond=None)
    return pd.DataFrame({SERIES: [sid], "coef": [beta.tolist()]})


def fit(win: DataFrame) -> DataFrame:
    train = win.where(F.col("win") < F.col("train_size")).withColumn("_one", F.lit(1.0))
    cols = ["_one"] + [f"x{j}" for j in range(1, MAX_L + 1)] + ["target"]
    return solve(gram(train, cols), MAX_L + 1, _coef_fn, f"{SERIES} string, coef array<double>")


def _predict(coef, xcols):
    pred = F.element_at(coef, 1)
    for j, x in enumerate(xcols, start=2):
        pred = pred + F.element_at(coef, j) * F.col(x)
    return pred


def lag_window_forecast(prep: Prepared, horizons: Sequence[int], model: str = "lstm", length: int | None = None):
    win, info = windows(prep, length=length)
    coefs = bounded(fit(win))
    xcols = [f"x{j}" for j in range(1, MAX_L + 1)]
    test = win.where(F.col("win") >= F.col("train_size")).join(coefs, SERIES)
    span = F.col("smax") - F.col("smin")
    test = test.withColumn("forecast", _predict(F.col("coef"), xcols) * span + F.col("smin"))
    from ..stats import forecast_metrics
    metrics = forecast_metrics(test.withColumn("actual", F.col("target") * span + F.col("smin")),
                               "actual", "forecast", zero_policy="skip")
    # rollout state: the last L scaled values of every series (oldest first)
    last = win.join(info.select(SERIES, "n"), SERIES).where(F.col(SEQ) == F.col("n") - 1)
    start = last.select(SERIES, "L", "smin", "smax",
                        F.concat(F.slice(F.array(*[F.col(x) for x in xcols]), 2, F.col("L") - 1),
                                 F.array(F.col("target"))).alias("_tail"))
    hmax = max(horizons)

    def rollout(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            c = np.asarray(r["coef"], dtype=float)
            L = int(r["L"])
            hist = list(np.asarray(r["_tail"], dtype=float))
            preds = []
            for _ in range(hmax):
                x = np.zeros(MAX_L)
                x[:L] = hist[-L:]
                nxt = float(c[0] + c[1:] @ x)
                preds.append(nxt)
                hist.append(nxt)
            for k, v in enumerate(preds, start=1):
                out.append((r[SERIES], k, v * (r["smax"] - r["smin"]) + r["smin"]))
        return pd.DataFrame(out, columns=[SERIES, "step", "forecast"])

    path = start.join(coefs, SERIES).groupBy(SERIES).applyInPandas(
        rollout, schema=f"{SERIES} string, step int, forecast double")
    facts = prep.varying().where(F.col("n") >= MIN_POINTS)
    rows = steps_for(prep, facts, horizons).join(path, [SERIES, "step"]).join(metrics.select(SERIES, "rmse"), SERIES, "left")
    point = F.col("forecast")
    lower, upper = error_interval(point, F.col("rmse"))
    rows = rows.select(SERIES, F.lit(model).alias("model"), F.col("horizon").cast("int").alias("horizon"),
                       F.col("step").cast("int").alias("step"), "ts", SEQ, point.alias("forecast"),
                       lower.alias("lower"), upper.alias("upper"))
    infos = info.select(SERIES, "L").join(metrics, SERIES, "left").select(
        SERIES, F.lit(model).alias("model"), F.lit("ok").alias("status"),
        F.lit("Linear autoregression on min-max scaled lag windows").alias("description"),
        F.col("L").alias("sequence_length"), "mse", "rmse", "mae", "mape")
    return rows, infos
