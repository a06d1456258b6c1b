"""Composed reports (survey R1, R3, R4).

Each report is a set of tidy per-series DataFrames computed from one cleaned
base; sections are independent plans, so an empty section never hides the others.  :func:`nested` rolls sections up into one row per
series with STRUCT / ARRAY columns (left joins on ``series_id``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import is_missing
from ..operators import decompose, diagnostics, order, pieces, stats
from ..schema import SEQ, SERIES, TS, VALUE

EDA_SECTIONS = ("summary_stats", "stationarity_tests", "autocorrelation", "distribution_analysis",
                "seasonal_decomposition", "trend_analysis")


# ---------------------------------------------------------------- R4
def series_status(long: DataFrame) -> DataFrame:
    """Which series qualify for which analysis, and why not (one row per series)."""
    v = F.col(VALUE)
    c = long.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(~is_missing(v), v)).alias("n"),
        F.min(F.when(~is_missing(v), v)).alias("_mn"), F.max(F.when(~is_missing(v), v)).alias("_mx"),
        F.count(F.col(TS)).alias("_nts"))
    n = F.col("n")
    const = F.coalesce(F.col("_mn") == F.col("_mx"), F.lit(False))
    reason = (F.when(n == 0, "no_values")
              .when(n < 5, "fewer_than_5")
              .when(n < 8, "fewer_than_8: no tests")
              .when(n < 10, "fewer_than_10: no decomposition")
              .when(F.col("_nts") == 0, "no_time"))
    return c.select(
        SERIES, "n_rows", "n", (n == 0).alias("all_missing"), const.alias("is_constant"),
        (n > 1).alias("autocorrelation_ok"), (n >= 3).alias("anomaly_ok"), (n >= 5).alias("forecast_ok"),
        (n >= 8).alias("tests_ok"), ((n >= 10) & (F.col("_nts") > 0)).alias("decomposition_ok"),
        reason.alias("reason"))


# ---------------------------------------------------------------- R3
def basic_report(long: DataFrame) -> DataFrame:
    """describe + missing values + lag-1 autocorrelation + seasonal variation, per series."""
    clean = long.where(~is_missing(F.col(VALUE)))
    d = stats.describe(clean)
    m = stats.missing_values(long).select(SERIES, "missing_values")
    a = order.lag1_autocorr(long)
    s = stats.seasonal_variation(clean)
    return (m.join(d, SERIES, "left").join(a, SERIES, "left").join(s, SERIES, "left"))


# ---------------------------------------------------------------- R1
def _with_status(ids: DataFrame, section: DataFrame, least: int, per_point: bool = False) -> DataFrame:
    """``section`` plus a ``status`` and a row for every series of ``ids(series_id, _n)``:
    ``ok``, ``all_missing``, ``insufficient`` (under ``least`` points) or ``undefined``."""
    why = (F.when(F.col("_n") == 0, "all_missing").when(F.col("_n") < least, "insufficient")
           .otherwise("undefined"))
    if "status" in section.columns:
        section = section.withColumnRenamed("status", "test_status")
    section = section.withColumn("status", F.lit("ok"))
    if per_point:  # points stay where they are; only the absent series are added
        absent = ids.join(section.select(SERIES).distinct(), SERIES, "left_anti")
        return section.unionByName(absent.select(SERIES, why.alias("status")), allowMissingColumns=True)
    out = section.join(ids, SERIES, "right")
    return out.withColumn("status", F.coalesce(F.col("status"), why)).drop("_n")


def eda_report(long: DataFrame, max_chunk: int | None = None,
               sections: Sequence[str] = EDA_SECTIONS) -> dict[str, DataFrame]:
    """The asked EDA sections as DataFrames keyed by section name; only these are planned.

    * summary_stats          C4 + last rolling mean / std (E4)
    * stationarity_tests     ADF + KPSS (n >= 8)
    * autocorrelation        ACF + PACF rows (n >= 8)
    * distribution_analysis  normality test + histogram bins (n >= 5)
    * seasonal_decomposition automatic calendar + additive decomposition (n >= 10)
    * trend_analysis         linear trend with p-value (n >= 5)

    Every section has a ``status`` and at least one row for every series.  Sections that need order
    share one set of stored pieces (:mod:`..operators.pieces`): the points are exchanged and sorted
    for the first of them and only mapped over by the others."""
    base = long.select(SERIES, TS, "tiebreak", VALUE)
    clean = base.where(~is_missing(F.col(VALUE)))
    ids = base.groupBy(SERIES).agg(F.count(F.when(~is_missing(F.col(VALUE)), 1)).alias("_n"))

    shared = []

    def parts():
        if not shared:
            shared.append(pieces.cut(clean, max_chunk))
        return shared[0]

    def summary():
        recent = pieces.points(parts()).where((F.col("n") >= 10) & (F.col(SEQ) >= F.col("n") - 5))
        last = recent.groupBy(SERIES).agg(F.avg(VALUE).alias("rolling_mean_last"), F.stddev_samp(VALUE).alias("rolling_std_last"))
        return stats.summary_stats(base, max_chunk=max_chunk).join(last, SERIES, "left")

    def distribution():
        hist = stats.histogram(clean).groupBy(SERIES).agg(
            F.array_sort(F.collect_list(F.struct("bin", "bin_lo", "bin_hi", "n"))).alias("histogram"))
        norm = diagnostics.normality_test(clean, max_chunk=max_chunk)
        return _with_status(ids, norm.join(hist, SERIES, "left"), 5)

    build = {
        "summary_stats": summary,
        "stationarity_tests": lambda: _with_status(ids, diagnostics.stationarity_tests(None, parts=parts()), 8),
        "autocorrelation": lambda: _with_status(ids, diagnostics.autocorrelation(None, parts=parts()), 8),
        "distribution_analysis": distribution,
        "seasonal_decomposition": lambda: _with_status(
            ids, decompose.auto_decompose(clean, max_chunk=max_chunk), 10, per_point=True),
        "trend_analysis": lambda: _with_status(ids, stats.linear_trend(pieces.points(parts()).drop("n")), 5),
    }
    def guarded(name: str) -> DataFrame:
        """A section, or for every series a row that says why there is none: a job that fails while
        one section is being planned leaves the others alone."""
        try:
            return build[name]()
        except PySparkException as e:
            return ids.select(SERIES, F.lit(f"failed: {e.getCondition() or type(e).__name__}").alias("status"))

    return {name: guarded(name) for name in sections}


def nested(sections: dict[str, DataFrame]) -> DataFrame:
    """One row per series, one STRUCT (or bounded ARRAY of STRUCT) per section.

    Only bounded lists are rolled up: ACF/PACF lags (<= 21), histogram bins (<= 20) and,
    for the decomposition, the seasonal pattern per phase (<= period) — never a whole series;
    the full decomposition stays a row-per-point table."""
    out = None
    for name, df in sections.items():
        cols = [c for c in df.columns if c != SERIES]
        if cols == ["status"]:  # a section that failed
            part = df.select(SERIES, F.struct(*cols).alias(name))
        elif name == "autocorrelation":
            part = df.groupBy(SERIES).agg(
                F.first("status").alias("_s"),
                F.array_sort(F.collect_list(F.when(F.col("lag").isNotNull(), F.struct("lag", "acf", "pacf")))).alias("_l"))
            part = part.select(SERIES, F.struct(F.col("_s").alias("status"), F.col("_l").alias("lags")).alias(name))
        elif name == "seasonal_decomposition":
            phases = df.groupBy(SERIES, "status", "frequency", "period", (F.col(SEQ) % F.col("period")).alias("phase")) \
                .agg(F.first("seasonal").alias("seasonal"))
            part = phases.groupBy(SERIES).agg(F.struct(
                F.first("status").alias("status"), F.first("frequency").alias("frequency"), F.first("period").alias("period"),
                F.array_sort(F.collect_list(F.when(F.col("phase").isNotNull(), F.struct("phase", "seasonal"))))
                .alias("seasonal_pattern")).alias(name))
        else:
            part = df.select(SERIES, F.struct(*cols).alias(name))
        out = part if out is None else out.join(part, SERIES, "full")
    return out
