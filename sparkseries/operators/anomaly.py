"""Anomaly detection (survey D1-D5).

Z-score and IQR rules are two narrow passes: a grouped aggregate per series,
then a size-checked broadcast join of that small table back onto the points and
a filter.  No sort and no shuffle of the observations, so a series holding a
third of the data costs the same as many small ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import is_missing
from ..schema import SERIES, TB, TS, VALUE
from .joins import bounded
from .stats import quantile_columns

METHODS = ("zscore", "iqr", "isolation_forest")
MIN_POINTS = 3
ANOMALY_COLUMNS = (SERIES, TS, TB, VALUE, "score", "lower_bound", "upper_bound", "method", "threshold")


def _clean(long: DataFrame) -> DataFrame:
    return long.where(~is_missing(F.col(VALUE)))


def zscore_anomalies(long: DataFrame, threshold: float = 3.0, min_points: int = MIN_POINTS,
                     flagged_only: bool = True) -> DataFrame:
    """Flag ``|v - mean| / std > threshold`` (strict; sample std; std = 0 flags nothing)."""
    clean = _clean(long)
    stats = clean.groupBy(SERIES).agg(F.count(VALUE).alias("_n"), F.avg(VALUE).alias("_mean"),
                                      F.stddev_samp(VALUE).alias("_std"))
    stats = bounded(stats.where(F.col("_n") >= min_points))
    t = float(threshold)
    scored = clean.join(stats, SERIES).select(
        SERIES, TS, TB, VALUE,
        F.try_divide(F.col(VALUE) - F.col("_mean"), F.col("_std")).alias("score"),
        (F.col("_mean") - F.lit(t) * F.col("_std")).alias("lower_bound"),
        (F.col("_mean") + F.lit(t) * F.col("_std")).alias("upper_bound"),
        F.lit("zscore").alias("method"), F.lit(t).alias("threshold"))
    # a series that holds an infinite value has no finite mean: no score, no flag (Spark orders NaN
    # above every number, so it must not reach the comparison)
    score = F.col("score")
    scored = scored.withColumn("score", F.when(~F.isnan(score), score))
    scored = scored.withColumn("is_anomaly", F.coalesce(F.abs(F.col("score")) > F.lit(t), F.lit(False)))
    return scored.where("is_anomaly").drop("is_anomaly") if flagged_only else scored


def iqr_anomalies(long: DataFrame, threshold: float = 3.0, min_points: int = MIN_POINTS,
                  flagged_only: bool = True, approx: bool = False,
                  max_chunk: int | None = None) -> DataFrame:
    """Flag values strictly outside ``[q1 - t*iqr, q3 + t*iqr]`` (default t = 3)."""
    clean = _clean(long)
    counts = clean.groupBy(SERIES).agg(F.count(VALUE).alias("_n"))
    qs = quantile_columns(clean, {"_q1": 0.25, "_q3": 0.75}, approx=approx, max_chunk=max_chunk)
    t = float(threshold)
    iqr = F.col("_q3") - F.col("_q1")
    bounds = bounded(counts.where(F.col("_n") >= min_points).join(qs, SERIES).select(
        SERIES, (F.col("_q1") - F.lit(t) * iqr).alias("lower_bound"),
        (F.col("_q3") + F.lit(t) * iqr).alias("upper_bound"), iqr.alias("_iqr"), "_q1", "_q3"))
    v = F.col(VALUE)
    scored = clean.join(bounds, SERIES).select(
        SERIES, TS, TB, VALUE,
        # distance outside the box in IQR units (0 inside)
        F.try_divide(F.greatest(F.col("_q1") - v, v - F.col("_q3"), F.lit(0.0)), F.col("_iqr")).alias("score"),
        "lower_bound", "upper_bound", F.lit("iqr").alias("method"), F.lit(t).alias("threshold"),
        F.coalesce(((v < F.col("lower_bound")) | (v > F.col("upper_bound")))
                   & ~F.isnan("lower_bound") & ~F.isnan("upper_bound"), F.lit(False)).alias("is_anomaly"))
    return scored.where("is_anomaly").drop("is_anomaly") if flagged_only else scored


def detect_anomalies(long: DataFrame, method: str = "zscore", threshold: float = 3.0,
                     columns=None, **kw) -> DataFrame:
    """Dispatcher; the method is checked before any job runs.  ``columns`` restricts the
    series (the UI's column choice).  Output: :data:`ANOMALY_COLUMNS`."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    if threshold is None or threshold <= 0:
        raise ValueError("threshold must be positive")
    if columns:
        long = long.where(F.col(SERIES).isin(list(columns)))
    if method == "zscore":
        return zscore_anomalies(long, threshold, **kw)
    if method == "iqr":
        return iqr_anomalies(long, threshold, **kw)
    from .isolation import isolation_forest_anomalies
    return isolation_forest_anomalies(long, threshold=threshold, **kw)


def anomaly_summary(long: DataFrame, anomalies: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """``(series_id, total_points, anomalies_count, anomalies_percentage)`` per analysed series."""
    totals = _clean(long).groupBy(SERIES).agg(F.count(VALUE).alias("total_points")) \
        .where(F.col("total_points") >= min_points)
    flagged = anomalies.groupBy(SERIES).agg(F.count(F.lit(1)).alias("anomalies_count"))
    return (totals.join(flagged, SERIES, "left")
            .select(SERIES, "total_points",
                    F.coalesce(F.col("anomalies_count"), F.lit(0)).cast("bigint").alias("anomalies_count"))
            .withColumn("anomalies_percentage",
                        F.col("anomalies_count") * 100.0 / F.col("total_points")))
