"""Descriptive statistics per series (survey C1-C9).

Everything is a grouped aggregate on ``series_id`` — partial aggregation on the
map side, so a hot series costs one small row per input partition in the shuffle.
Exact quantiles are the one non-decomposable statistic: a mergeable sketch brackets the
wanted ranks, one more pass counts around the brackets, and only the values inside them are
ordered, instead of Spark's ``percentile`` aggregate, whose buffer keeps all distinct
values of a group in one task.  ``approx=True`` stops at the ``percentile_approx`` sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import is_missing
from ..schema import SEQ, SERIES, TS, VALUE
from .joins import bounded
from .order import chunk_rows, cumulative_sum, with_seq

QUARTILES = (0.25, 0.5, 0.75)
#: The sketch is off by at most a share 1 / ACCURACY of the ranks; brackets reach three times as far.
ACCURACY = 2000
MARGIN = 3 / ACCURACY


# ---------------------------------------------------------------- quantiles
def quantile_table(clean: DataFrame, probs: Sequence[float], extra: dict | None = None,
                   max_chunk: int | None = None) -> DataFrame:
    """``(series_id, n, <extra>, quantiles)``: exact quantiles (array in the order of ``probs``) with NumPy
    'linear' interpolation, ``h = (n-1)q``, ``x[floor h] + (h - floor h)(x[floor h + 1] - x[floor h])``.

    1. One pass takes ``extra`` aggregates, the count and a mergeable sketch, whose rank error gives
       an interval of values around each quantile that holds the wanted ranks.
    2. One pass counts what lies between the intervals and, by value, what lies inside; equal values
       and gaps are combined on the map side, so about 1 % of the rows are ever sorted.
    3. Running counts over those rows give the exact ranks.  A series whose ranks missed the
       intervals would be sorted whole (:func:`_sorted_quantiles`)."""
    asked = [float(p) for p in probs]
    order = sorted(set(asked))
    inf = float("inf")
    sides = [min(max(p + side, 0.0), 1.0) for p in order for side in (-MARGIN, MARGIN)]
    facts = bounded(clean.groupBy(SERIES).agg(
        F.count(VALUE).alias("n"), *[e.alias(k) for k, e in (extra or {}).items()],
        F.percentile_approx(VALUE, sides, ACCURACY).alias("_edges")))
    # few points: the interval is everything
    wide = F.col("n") * MARGIN < 2
    low = [F.when(wide | F.lit(p - MARGIN <= 0), -inf).otherwise(F.col("_edges")[2 * i]) for i, p in enumerate(order)]
    high = [F.when(wide | F.lit(p + MARGIN >= 1), inf).otherwise(F.col("_edges")[2 * i + 1]) for i, p in enumerate(order)]
    edges = facts.where(F.col("n") > 0).select(SERIES, *[x.alias(f"_l{i}") for i, x in enumerate(low)],
                                                *[x.alias(f"_h{i}") for i, x in enumerate(high)])
    v = F.col(VALUE)
    slot = sum((F.when(v > F.col(f"_h{i}"), 1).otherwise(0) for i in range(len(order))), F.lit(0))
    inside = F.coalesce(*[F.when((F.col("_s") == i) & (v >= F.col(f"_l{i}")), v) for i in range(len(order))])
    counts = (clean.where(v.isNotNull()).join(edges, SERIES).withColumn("_s", slot).where(F.col("_s") < len(order))
              .groupBy(SERIES, "_s", inside.alias(VALUE)).agg(F.count(F.lit(1)).alias("_c")))
    limit = max_chunk if max_chunk is not None else chunk_rows(clean)
    counts = bounded(counts, observe={"groups": F.count(F.lit(1))})
    if counts.sparkseries_metrics["groups"] <= limit:
        run = Window.partitionBy(SERIES).orderBy("_s", F.asc_nulls_first(VALUE)).rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.sparkseries_plain.withColumn("_hi", F.sum("_c").over(run))
    else:
        ranked = with_seq(counts.sparkseries_plain, order=("_s", VALUE), max_chunk=max_chunk)
        ranked = cumulative_sum(ranked, "_c", "_hi", max_chunk=max_chunk)
    found = _pick(ranked.where(v.isNotNull()), facts.select(SERIES, "n"), order)
    found = bounded(found, observe={"missed": F.count(F.when(F.exists("_q", lambda x: x.isNull()), 1))})
    if found.sparkseries_metrics["missed"]:
        hit = ~F.exists("_q", lambda x: x.isNull())
        rest = clean.join(found.where(~hit).select(SERIES), SERIES, "left_semi")
        found = found.where(hit).unionByName(_sorted_quantiles(rest, order, max_chunk))
    own = F.transform(F.array(*[F.lit(order.index(p)) for p in asked]), lambda i: F.get("_q", i))
    out = facts.drop("_edges").join(found, SERIES, "left")
    return out.select(*[c for c in out.columns if c != "_q"], own.alias("quantiles"))


def _pick(ranked: DataFrame, sizes: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``(series_id, _q)`` from ``ranked(series_id, value, _c, _hi)``, running counts of distinct values."""
    wanted = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(p)
        lo = F.floor(h)
        hi = F.least(lo + 1, F.col("n") - 1)
        wanted += [F.struct(F.lit(i).alias("i"), lo.cast("double").alias("_r"), F.lit("lo").alias("role"), (h - lo).alias("frac")),
                   F.struct(F.lit(i).alias("i"), hi.cast("double").alias("_r"), F.lit("hi").alias("role"), (h - lo).alias("frac"))]
    need = sizes.where(F.col("n") > 0).select(SERIES, F.array(*wanted).alias("_w"))
    here = F.filter("_w", lambda w: (w._r < F.col("_hi")) & (w._r >= F.col("_hi") - F.col("_c")))
    picked = ranked.join(need, SERIES).select(SERIES, VALUE, F.explode_outer(here).alias("_p")).select(SERIES, VALUE, "_p.*")
    g = picked.groupBy(SERIES).agg(*[
        F.max(F.when((F.col("i") == i) & (F.col("role") == role), F.col(x))).alias(f"{name}{i}")
        for i in range(len(probs)) for role, x, name in (("lo", VALUE, "_lo"), ("hi", VALUE, "_hi"), ("lo", "frac", "_f"))])
    return g.select(SERIES, F.array(*[_between(f"_lo{i}", f"_hi{i}", f"_f{i}") for i in range(len(probs))]).alias("_q"))


def _sorted_quantiles(clean: DataFrame, probs: Sequence[float], max_chunk: int | None = None) -> DataFrame:
    """Quantiles by ordering all distinct values: ``(series_id, _q)``."""
    counts = clean.groupBy(SERIES, VALUE).agg(F.count(F.lit(1)).alias("_c"))
    ranked = cumulative_sum(with_seq(counts, order=(VALUE,), max_chunk=max_chunk), "_c", "_hi", max_chunk=max_chunk)
    return _pick(ranked, clean.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n")), probs)


def quantiles(clean: DataFrame, probs: Sequence[float] = QUARTILES, approx: bool = False,
              accuracy: int = 10000, max_chunk: int | None = None) -> DataFrame:
    """``(series_id, q, quantile)``, exact (:func:`quantile_table`) or by the sketch alone."""
    probs = [float(p) for p in probs]
    if approx:
        table = clean.groupBy(SERIES).agg(F.percentile_approx(VALUE, probs, accuracy).alias("quantiles"))
    else:
        table = quantile_table(clean, probs, None, max_chunk).where(F.col("n") > 0)
    return table.select(SERIES, F.posexplode("quantiles").alias("_i", "quantile")).select(
        SERIES, F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1).alias("q"), "quantile")


def _between(lo: str, hi: str, frac: str):
    """Linear interpolation that never multiplies an infinite gap by zero."""
    same = (F.col(frac) == 0) | (F.col(lo) == F.col(hi))
    return F.when(same, F.col(lo)).otherwise(F.col(lo) + (F.col(hi) - F.col(lo)) * F.col(frac))


def quantiles_from_counts(counts: DataFrame, probs: Sequence[float], value: str = VALUE,
                          count: str = "cnt") -> DataFrame:
    """Exact linear-interpolation quantiles from ``(series_id, value, cnt)`` value counts.

    For data with few distinct values per series (step-function scores, codes): the counts
    are a map-side combined aggregate, positions come from a running count over the small
    per-series table, and no observation is sorted.  Returns ``(series_id, q, quantile)``."""
    w = Window.partitionBy(SERIES).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.select(SERIES, value, F.sum(count).over(w).alias("_hi"), F.col(count).alias("_c"))
    cum = cum.withColumn("_lo", F.col("_hi") - F.col("_c"))
    n = cum.groupBy(SERIES).agg(F.max("_hi").alias("n"))
    wanted = []
    for p in [float(x) for x in probs]:
        h = (F.col("n") - 1) * F.lit(p)
        lo = F.floor(h)
        wanted += [F.struct(F.lit(p).alias("q"), lo.alias("pos"), F.lit("lo").alias("role"), (h - lo).alias("frac")),
                   F.struct(F.lit(p).alias("q"), F.least(lo + 1, F.col("n") - 1).alias("pos"), F.lit("hi").alias("role"),
                            (h - lo).alias("frac"))]
    need = n.select(SERIES, F.explode(F.array(*wanted)).alias("w")).select(SERIES, "w.*")
    hit = need.join(cum, SERIES).where((F.col("pos") >= F.col("_lo")) & (F.col("pos") < F.col("_hi")))
    g = hit.groupBy(SERIES, "q").agg(
        F.max(F.when(F.col("role") == "lo", F.col(value))).alias("_a"),
        F.max(F.when(F.col("role") == "hi", F.col(value))).alias("_b"), F.max("frac").alias("_f"))
    return g.select(SERIES, "q", _between("_a", "_b", "_f").alias("quantile"))


def quantile_columns(clean: DataFrame, named: dict[str, float], approx: bool = False,
                     max_chunk: int | None = None, extra: dict | None = None) -> DataFrame:
    """Quantiles as columns, e.g. ``{'q1': .25, 'q3': .75}`` -> ``(series_id, <extra>, q1, q3)``; the
    ``extra`` aggregates are taken in the same pass."""
    if approx:
        table = clean.groupBy(SERIES).agg(*[e.alias(k) for k, e in (extra or {}).items()],
                                          F.percentile_approx(VALUE, [float(p) for p in named.values()], 10000).alias("quantiles"))
    else:
        table = quantile_table(clean, list(named.values()), extra, max_chunk)
    return table.select(SERIES, *(extra or {}), *[F.col("quantiles")[i].alias(c) for i, c in enumerate(named)])


# ---------------------------------------------------------------- C1 / C2 / C3
DESCRIBE = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _moments() -> dict:
    return {"count": F.count(VALUE), "mean": F.avg(VALUE), "std": F.stddev_samp(VALUE), "min": F.min(VALUE), "max": F.max(VALUE)}


def describe(clean: DataFrame, approx: bool = False, max_chunk: int | None = None) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 %, max per series (pandas ``describe``)."""
    return quantile_columns(clean, DESCRIBE, approx, max_chunk, _moments()).select(
        SERIES, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def missing_values(long: DataFrame) -> DataFrame:
    """Per series: missing count and percentage on the raw column (NULL or NaN)."""
    miss = F.when(is_missing(F.col(VALUE)), 1).otherwise(0)
    return long.groupBy(SERIES).agg(
        F.sum(miss).cast("bigint").alias("missing_values"),
        (F.avg(miss) * 100.0).alias("missing_percentage"))


# ---------------------------------------------------------------- C4
def summary_stats(long: DataFrame, approx: bool = False, min_points: int = 5,
                  max_chunk: int | None = None) -> DataFrame:
    """EDA summary: describe + median, population skewness, excess kurtosis and the
    missing count/percentage of the raw column.  Series below ``min_points`` get a status row."""
    missing = is_missing(F.col(VALUE))
    raw = long.withColumn(VALUE, F.when(~missing, F.col(VALUE)))
    miss = F.when(F.col(VALUE).isNull(), 1).otherwise(0)
    out = quantile_columns(raw, DESCRIBE, approx, max_chunk, _moments() | {
        "skewness": F.skewness(VALUE), "kurtosis": F.kurtosis(VALUE), "missing_values": F.sum(miss).cast("bigint"),
        "missing_percentage": F.avg(miss) * 100.0})
    out = out.withColumn("status", F.when(F.col("count") >= min_points, "ok").otherwise("insufficient"))
    stat_cols = ["mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis"]
    return out.select(
        SERIES, "status", "count",
        *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in stat_cols],
        F.when(F.col("status") == "ok", F.col("q50")).alias("median"),
        "missing_values", "missing_percentage")


# ---------------------------------------------------------------- C5
def histogram(clean: DataFrame, bins: int | None = None) -> DataFrame:
    """Equal-width histogram per series: ``b = min(20, max(5, n // 10))`` bins over
    [min, max] (constant data: [v - .5, v + .5]); last bin closed; empty bins kept.

    Bins cover the finite values.  Infinite values are counted in two more rows, only where
    they occur: bin -1 up to the first edge and bin ``b`` (the number of bins) from the last.

    Rows ``(series_id, bin, bin_lo, bin_hi, n)``.  The per-series edges table is
    size-checked and broadcast; counting is a partial aggregate.
    """
    b = F.lit(bins) if bins is not None else F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.col("n") / 10)))
    inf = float("inf")
    finite = F.abs(F.col(VALUE)) < inf
    fv = F.when(finite, F.col(VALUE))
    edges = clean.groupBy(SERIES).agg(
        F.count(fv).alias("n"), F.min(fv).alias("_mn"), F.max(fv).alias("_mx"),
        F.count(F.when(F.col(VALUE) == -inf, 1)).alias("_below"), F.count(F.when(F.col(VALUE) == inf, 1)).alias("_above"))
    const = F.col("_mn") == F.col("_mx")
    edges = edges.where(F.col("n") > 0).select(
        SERIES, b.cast("int").alias("bins"), "_below", "_above",
        F.when(const, F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
        F.when(const, F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi"))
    edges = bounded(edges)
    v, lo, hi, nb = F.col(VALUE), F.col("lo"), F.col("hi"), F.col("bins")
    step = (hi - lo) / nb

    def edge(i):
        return F.when(i >= nb, hi).otherwise(i * step + lo)

    raw = F.floor((v - lo) * (nb / (hi - lo))).cast("int")
    idx = F.least(F.greatest(raw, F.lit(0)), nb - 1)
    idx = F.when(v < edge(idx), idx - 1).otherwise(idx)
    idx = F.when((v >= edge(idx + 1)) & (idx != nb - 1), idx + 1).otherwise(idx)
    counts = (clean.where(finite).join(edges, SERIES).withColumn("bin", idx)
              .groupBy(SERIES, "bin").agg(F.count(F.lit(1)).alias("n")))
    spine = edges.select(SERIES, "lo", "hi", "bins",
                         F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    i = F.col("bin")
    inner = (spine.join(counts, [SERIES, "bin"], "left")
             .select(SERIES, "bin", (i * step + lo).alias("bin_lo"), edge(i + 1).alias("bin_hi"),
                     F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))
    outer = edges.select(SERIES, F.explode(F.array(
        F.struct(F.lit(-1).alias("bin"), F.lit(-inf).alias("bin_lo"), lo.alias("bin_hi"), F.col("_below").alias("n")),
        F.struct(nb.alias("bin"), hi.alias("bin_lo"), F.lit(inf).alias("bin_hi"), F.col("_above").alias("n")))).alias("_o"))
    return inner.unionByName(outer.select(SERIES, "_o.*").where("n > 0"))


# ---------------------------------------------------------------- C6
def seasonal_variation(clean: DataFrame, min_points: int = 3) -> DataFrame:
    """Sample std of the daily, weekly (Mon-Sun) and monthly bucket means; empty buckets
    do not exist here, undefined std is 0.  Datetime series with >= ``min_points`` points."""
    timed = clean.where(F.col(TS).isNotNull())
    out = None
    for name, unit in (("daily_variation", "day"), ("weekly_variation", "week"),
                       ("monthly_variation", "month")):
        bucket = F.date_trunc(unit, F.col(TS))
        means = timed.groupBy(SERIES, bucket.alias("_b")).agg(F.avg(VALUE).alias("_m"),
                                                              F.count(F.lit(1)).alias("_c"))
        part = means.groupBy(SERIES).agg(
            F.sum("_c").alias("_n"),
            F.coalesce(F.stddev_samp("_m"), F.lit(0.0)).alias(name))
        part = part.where(F.col("_n") >= min_points).drop("_n")
        out = part if out is None else out.join(part, SERIES)
    return out


# ---------------------------------------------------------------- C7
def linear_trend(clean: DataFrame, min_points: int = 5, with_p_value: bool = True,
                 max_chunk: int | None = None) -> DataFrame:
    """OLS of value on position 0..n-1: slope, intercept, R^2, two-sided p-value of the
    slope (t with n-2 df), significant (p < .05) and direction (sign of the slope)."""
    seqd = clean if SEQ in clean.columns else with_seq(clean, max_chunk=max_chunk)
    x, y = F.col(SEQ).cast("double"), F.col(VALUE)
    fit = seqd.groupBy(SERIES).agg(
        F.count(y).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"))
    fit = fit.where(F.col("n") >= min_points)
    fit = fit.withColumn("direction", F.when(F.col("slope") > 0, "increasing")
                         .when(F.col("slope") < 0, "decreasing").otherwise("flat"))
    if not with_p_value:
        return fit
    from ..functions.dist import t_two_sided_p
    r2 = F.col("r_squared")
    df = F.col("n") - 2
    t = F.sqrt(F.try_divide(r2 * df, 1 - r2))
    p = F.when(r2 >= 1.0, F.lit(0.0)).otherwise(t_two_sided_p(t, df.cast("double")))
    return (fit.withColumn("p_value", p)
            .withColumn("significant_trend", F.col("p_value") < 0.05))


# ---------------------------------------------------------------- C8
def forecast_metrics(pairs: DataFrame, actual: str = "actual", pred: str = "forecast",
                     by: Sequence[str] = (SERIES,), zero_policy: str = "null") -> DataFrame:
    """MSE, RMSE, MAE, MAPE (%) per group.  ``zero_policy='null'``: MAPE is NULL if any
    actual is 0; ``'skip'``: zero actuals are left out (NULL if all are 0)."""
    a, p = F.col(actual), F.col(pred)
    err = a - p
    ape = F.abs(F.try_divide(err, a))
    aggs = [F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
            F.count(F.lit(1)).alias("n_eval")]
    if zero_policy == "null":
        aggs.append(F.when(F.sum(F.when(a == 0, 1).otherwise(0)) > 0, F.lit(None))
                    .otherwise(F.avg(ape) * 100.0).alias("mape"))
    elif zero_policy == "skip":
        aggs.append((F.avg(F.when(a != 0, ape)) * 100.0).alias("mape"))
    else:
        raise ValueError("zero_policy must be 'null' or 'skip'")
    m = pairs.groupBy(*by).agg(*aggs)
    inf = F.lit(float("inf"))
    return m.select(*by, "n_eval", "mse", F.sqrt("mse").alias("rmse"), "mae",
                    F.when(F.abs(F.col("mape")) == inf, None).otherwise(F.col("mape")).alias("mape"))


# ---------------------------------------------------------------- C9
def stats_matrix(described: DataFrame, series: Sequence[str]) -> DataFrame:
    """Statistic x series matrix: one row per statistic, one column per series."""
    stats = [c for c in described.columns if c != SERIES]
    tall = described.select(SERIES, *[F.col(c).cast("double") for c in stats]).unpivot(
        [SERIES], stats, "statistic", "v")
    return tall.groupBy("statistic").pivot(SERIES, list(series)).agg(F.first("v"))
