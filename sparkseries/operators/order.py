"""Ordering, positions and bounded-lookback windows (survey E1-E11).

Skew model: any one series may hold a third of all rows, so nothing here puts a
whole series into one task.

* :func:`with_seq` numbers the points of every series (0-based).  When every
  series is at most ``sparkseries.chunkRows`` long (a proven bound from the
  per-series count table) it is a plain ``row_number`` window.  The rows of
  longer series are range-partitioned on ``(series_id, ts, tiebreak)`` —
  Spark's sampled range boundaries split a hot series over many partitions —
  numbered inside each partition with ``monotonically_increasing_id`` after a
  local sort, checkpointed (so boundaries and ids are fixed once), and shifted
  by the prefix sum of the per-(series, partition) counts.
* :func:`halo_frame` cuts every series into chunks of ``chunkRows`` positions and
  copies the ``back`` last / ``fwd`` first rows of each chunk into its
  neighbours.  Window functions with a bounded frame (lags, rolling means,
  centred moving averages) then run per ``(series_id, chunk)`` — bounded tasks —
  and give exactly the whole-series answer on the core rows.
* Running sums (:func:`cumulative_sum`) add per-chunk prefix offsets the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import is_missing
from ..schema import SEQ, SERIES, TB, TS, VALUE
from ..session import CONF_CHUNK_ROWS, DEFAULT_CHUNK_ROWS, checkpoint, conf_int
from .joins import bounded, static_bound

CHUNK = "_chunk"
CORE = "_core"


def chunk_rows(df: DataFrame) -> int:
    return conf_int(df.sparkSession, CONF_CHUNK_ROWS, DEFAULT_CHUNK_ROWS)


def series_sizes(long: DataFrame) -> DataFrame:
    """``(series_id, n)`` materialised in the checkpoint folder and size-checked for broadcast
    (the longest series and the total are observed in the same job)."""
    return bounded(long.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n")),
                   observe={"max_n": F.max("n"), "total": F.sum("n")})


def _size_facts(sizes: DataFrame) -> tuple[int, int, int]:
    """(longest series, number of series, total rows) — observed metrics when available."""
    m = getattr(sizes, "sparkseries_metrics", None)
    if m is not None and "max_n" in m:
        return int(m["max_n"] or 0), int(m["rows"]), int(m["total"] or 0)
    row = sizes.agg(F.max("n").alias("m"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("t")).first()
    return int(row["m"] or 0), int(row["k"]), int(row["t"] or 0)


# ---------------------------------------------------------------- E1 / E2
def order_series(long: DataFrame, order: Sequence[str] = (TS, TB)) -> DataFrame:
    """Rows sorted by ``(series_id, ts, tiebreak)``.  Range partitioning keeps a hot
    series spread over many partitions; use only for output — operators use ``seq``."""
    keys = [SERIES, *order]
    return long.repartitionByRange(*keys).sortWithinPartitions(*keys)


def with_seq(long: DataFrame, order: Sequence[str] = (TS, TB), seq_col: str = SEQ,
             sizes: DataFrame | None = None, max_chunk: int | None = None) -> DataFrame:
    """Add ``seq`` = 0-based position of the row inside its series by ``order``.

    ``sizes`` (``series_id, n``) may be passed when already known.
    """
    limit = max_chunk if max_chunk is not None else chunk_rows(long)
    sizes = sizes if sizes is not None else series_sizes(long)
    longest, n_series, total = _size_facts(sizes)
    keys = [SERIES, *order]
    if longest <= limit:
        w = Window.partitionBy(SERIES).orderBy(*order)
        return long.withColumn(seq_col, (F.row_number().over(w) - 1).cast("bigint"))

    # series within the chunk bound keep the plain window; only the long ones take the range path
    big_ids = sizes.where(F.col("n") > limit).select(SERIES)
    small_part = long.join(big_ids, SERIES, "left_anti")
    big_part = long.join(big_ids, SERIES, "left_semi")
    w = Window.partitionBy(SERIES).orderBy(*order)
    small_seq = small_part.withColumn(seq_col, (F.row_number().over(w) - 1).cast("bigint"))

    spark = long.sparkSession
    big_total = int(sizes.where(F.col("n") > limit).agg(F.sum("n")).first()[0] or 0)
    # sorting spills, so a range may hold more rows than a chunk: the sampled boundaries and the task
    # results that reach the driver grow with the ranges
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-big_total // max(limit, DEFAULT_CHUNK_ROWS)))
    # The sampled range boundaries and the partition-local ids are only reproducible if the
    # tagged rows are read back from one materialisation: a recomputation may sample different
    # boundaries.  So the tagged rows are checkpointed (shared folder) before both uses.
    ranged = checkpoint(big_part.repartitionByRange(n_parts, *keys)
                        .sortWithinPartitions(*keys)
                        .withColumn("_rid", F.monotonically_increasing_id())
                        .withColumn("_pid", F.shiftright(F.col("_rid"), 33)))
    parts = ranged.groupBy(SERIES, "_pid").agg(F.min("_rid").alias("_first"),
                                               F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(SERIES).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(SERIES, "_pid", "_first",
                         F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    # a series starts or ends a partition at most twice: rows <= partitions + 2 * series
    parts = static_bound(parts, n_parts + 2 * n_series)
    big_seq = (ranged.join(parts, [SERIES, "_pid"])
               .withColumn(seq_col, F.col("_rid") - F.col("_first") + F.col("_off"))
               .drop("_rid", "_pid", "_first", "_off"))
    return small_seq.unionByName(big_seq)


def halo_frame(seqd: DataFrame, back: int, fwd: int = 0, max_chunk: int | None = None) -> DataFrame:
    """Chunked frame for bounded windows: adds ``_chunk`` and ``_core``.

    Compute window functions over :func:`chunk_window` and keep ``_core`` rows.
    """
    size = max_chunk if max_chunk is not None else chunk_rows(seqd)
    if back >= size or fwd >= size:
        raise ValueError("window reach must be smaller than the chunk size")
    s = F.col(SEQ)
    c = F.floor(s / F.lit(size))
    pos = s - c * F.lit(size)
    copies = F.filter(F.array(
        F.struct(c.alias("c"), F.lit(True).alias("core")),
        F.when(pos >= F.lit(size - back), F.struct((c + 1).alias("c"), F.lit(False).alias("core"))),
        F.when((pos < F.lit(fwd)) & (c > 0), F.struct((c - 1).alias("c"), F.lit(False).alias("core"))),
    ), lambda x: x.isNotNull())
    exploded = seqd.select("*", F.explode(copies).alias("_copy"))
    keep = [F.col(f"`{c}`") for c in seqd.columns]
    return exploded.select(*keep, F.col("_copy.c").alias(CHUNK), F.col("_copy.core").alias(CORE))


def chunk_window() -> Window:
    return Window.partitionBy(SERIES, CHUNK).orderBy(SEQ)


def lagged(long_seq: DataFrame, exprs: dict[str, Column], back: int, fwd: int = 0,
           max_chunk: int | None = None) -> DataFrame:
    """Evaluate window ``exprs`` (built on :func:`chunk_window`) over a halo frame
    and return the core rows with the new columns."""
    frame = halo_frame(long_seq, back, fwd, max_chunk)
    # one projection for all window columns (a withColumn chain re-analyses the plan per column)
    keep = [F.col(f"`{c}`") for c in long_seq.columns if c not in exprs]
    out = frame.select(*keep, F.col(CORE), *[e.alias(n) for n, e in exprs.items()])
    return out.where(F.col(CORE)).drop(CORE)


# ---------------------------------------------------------------- E3
def lag1_autocorr(long: DataFrame, max_chunk: int | None = None) -> DataFrame:
    """Pearson corr(x_t, x_{t-1}) over pairs where both are present, on the raw series
    (missing values keep their place).  ``(series_id, lag1_autocorr)``; needs > 1 point."""
    seqd = with_seq(long, max_chunk=max_chunk)
    v = F.when(~is_missing(F.col(VALUE)), F.col(VALUE))
    w = chunk_window()
    pairs = lagged(seqd.withColumn("_v", v), {"_prev": F.lag("_v", 1).over(w)}, back=1,
                   max_chunk=max_chunk)
    return pairs.groupBy(SERIES).agg(
        F.count("_v").alias("_n"), F.corr("_v", "_prev").alias("lag1_autocorr")
    ).where(F.col("_n") > 1).select(SERIES, "lag1_autocorr")


# ---------------------------------------------------------------- E4
def rolling_stats(long: DataFrame, window: int | None = None, min_points: int = 10,
                  max_chunk: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Trailing mean / sample std over ``w`` points, NULL until the window is full.

    ``w`` defaults to ``min(5, n // 2)`` per series (5 whenever ``n >= 10``).  Returns
    ``(full rolling series, last value per series)``; the last-value table only covers
    series with at least ``min_points`` points, as in the EDA report.
    """
    sizes = series_sizes(long)
    seqd = with_seq(long, sizes=sizes, max_chunk=max_chunk)
    reach = window if window is not None else 5
    if window is None:
        wcol = F.least(F.lit(5), F.floor(F.col("n") / 2)).cast("int")
    else:
        wcol = F.lit(window)
    seqd = seqd.join(sizes, SERIES).withColumn("_w", wcol)
    w = chunk_window()
    exprs = {}
    for k in range(1, reach + 1):
        frame = w.rowsBetween(-(k - 1), 0)
        exprs[f"_m{k}"] = F.avg(VALUE).over(frame)
        exprs[f"_s{k}"] = F.stddev_samp(VALUE).over(frame)
    rolled = lagged(seqd, exprs, back=reach - 1, max_chunk=max_chunk)
    full = (F.col(SEQ) >= F.col("_w") - 1) & (F.col("_w") >= 1)
    mean = F.coalesce(*[F.when(F.col("_w") == k, F.col(f"_m{k}")) for k in range(1, reach + 1)])
    std = F.coalesce(*[F.when(F.col("_w") == k, F.col(f"_s{k}")) for k in range(1, reach + 1)])
    out = rolled.select(SERIES, TS, TB, SEQ, VALUE, F.col("_w").alias("window_size"), "n",
                        F.when(full, mean).alias("rolling_mean"),
                        F.when(full, std).alias("rolling_std"))
    last = (out.where(F.col("n") >= min_points)
            .groupBy(SERIES).agg(F.max_by(F.struct("rolling_mean", "rolling_std"), F.col(SEQ)).alias("_l"))
            .select(SERIES, F.col("_l.rolling_mean").alias("rolling_mean_last"),
                    F.col("_l.rolling_std").alias("rolling_std_last")))
    return out.drop("n"), last


# ---------------------------------------------------------------- E5
def difference(long: DataFrame, d: int = 1, seasonal_d: int = 0, m: int = 1,
               max_chunk: int | None = None) -> DataFrame:
    """Apply ``d`` first differences and ``seasonal_d`` lag-``m`` differences.

    ``value`` becomes the differenced value (NULL where undefined); rows keep their seq."""
    seqd = with_seq(long, max_chunk=max_chunk) if SEQ not in long.columns else long
    reach = d + seasonal_d * m
    if reach == 0:
        return seqd
    # expand (1-B)^d (1-B^m)^D into lag coefficients, then one window pass
    coef = {0: 1}
    for step in [1] * d + [m] * seasonal_d:
        nxt: dict[int, int] = {}
        for lag, a in coef.items():
            nxt[lag] = nxt.get(lag, 0) + a
            nxt[lag + step] = nxt.get(lag + step, 0) - a
        coef = nxt
    w = chunk_window()
    terms = [F.lit(a) * (F.col(VALUE) if lag == 0 else F.lag(VALUE, lag).over(w))
             for lag, a in sorted(coef.items()) if a != 0]
    expr = terms[0]
    for t in terms[1:]:
        expr = expr + t
    return lagged(seqd, {"_diff": expr}, back=reach, max_chunk=max_chunk) \
        .withColumn(VALUE, F.col("_diff")).drop("_diff")


# ---------------------------------------------------------------- E6
def cumulative_sum(long_seq: DataFrame, col: str = VALUE, out: str = "cumsum",
                   max_chunk: int | None = None) -> DataFrame:
    """Running sum in ``seq`` order: per-chunk running sums plus the prefix of chunk totals."""
    size = max_chunk if max_chunk is not None else chunk_rows(long_seq)
    chunked = long_seq.withColumn(CHUNK, F.floor(F.col(SEQ) / F.lit(size)))
    totals = chunked.groupBy(SERIES, CHUNK).agg(F.sum(col).alias("_tot"))
    prior = Window.partitionBy(SERIES).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = bounded(totals.select(SERIES, CHUNK, F.coalesce(F.sum("_tot").over(prior), F.lit(0.0)).alias("_off")))
    run = Window.partitionBy(SERIES, CHUNK).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    return (chunked.join(offsets, [SERIES, CHUNK])
            .withColumn(out, F.col("_off") + F.sum(col).over(run))
            .drop(CHUNK, "_off"))


# ---------------------------------------------------------------- E7
def lag_windows(long_seq: DataFrame, length: int, col: str = VALUE,
                max_chunk: int | None = None) -> DataFrame:
    """Supervised windows: ``x1..xL`` = the L previous values (x1 oldest), ``target`` = value.
    The first L rows of each series have no full window and are dropped."""
    w = chunk_window()
    exprs = {f"x{i}": F.lag(col, length - i + 1).over(w) for i in range(1, length + 1)}
    out = lagged(long_seq, exprs, back=length, max_chunk=max_chunk)
    return out.where(F.col(SEQ) >= length).withColumn("target", F.col(col))


# ---------------------------------------------------------------- E8 / E9 / E10
def last_n(long_seq: DataFrame, k: int, sizes: DataFrame | None = None) -> DataFrame:
    """The last ``k`` points of every series (by seq); uses the per-series size table."""
    sizes = sizes if sizes is not None else series_sizes(long_seq)
    return long_seq.join(sizes, SERIES).where(F.col(SEQ) >= F.col("n") - k).drop("n")


def sample_recent(long: DataFrame, k: int = 5000, mode: str = "recent", seed: int = 0,
                  max_chunk: int | None = None) -> DataFrame:
    """A size-capped subset in time order: the most recent ``k`` points (deterministic),
    or ``mode='random'``: the ``k`` points with the smallest seeded hash."""
    if mode == "recent":
        return last_n(with_seq(long, max_chunk=max_chunk), k)
    if mode == "random":
        h = F.xxhash64(F.col(SERIES), F.col(TS), F.col(TB), F.lit(seed))
        ranked = with_seq(long.withColumn("_h", h), order=("_h",), seq_col="_hr", max_chunk=max_chunk)
        return ranked.where(F.col("_hr") < k).drop("_h", "_hr")
    raise ValueError("mode must be 'recent' or 'random'")


def chronological_split(long_seq: DataFrame, frac: float = 0.8, min_points: int = 0,
                        sizes: DataFrame | None = None) -> DataFrame:
    """Adds ``split`` in {'train','test'}: train = first ``floor(n*frac)`` points.
    Series with ``n <= min_points`` are all train (the additive model's rule)."""
    sizes = sizes if sizes is not None else series_sizes(long_seq)
    cut = F.floor(F.col("n") * F.lit(frac))
    is_train = (F.col(SEQ) < cut) | (F.col("n") <= F.lit(min_points))
    return (long_seq.join(sizes, SERIES)
            .withColumn("split", F.when(is_train, "train").otherwise("test"))
            .withColumn("n_train", F.when(F.col("n") <= F.lit(min_points), F.col("n")).otherwise(cut).cast("bigint"))
            .drop("n"))


# ---------------------------------------------------------------- E11
def min_max_scale(long: DataFrame, col: str = VALUE, out: str = "scaled") -> tuple[DataFrame, DataFrame]:
    """(x - min) / (max - min) per series; returns (scaled frame, scaler table)."""
    scaler = bounded(long.groupBy(SERIES).agg(F.min(col).alias("scale_min"), F.max(col).alias("scale_max")))
    scaled = long.join(scaler, SERIES).withColumn(
        out, F.try_divide(F.col(col) - F.col("scale_min"), F.col("scale_max") - F.col("scale_min")))
    return scaled.drop("scale_min", "scale_max"), scaler


def inverse_scale(df: DataFrame, scaler: DataFrame, col: str, out: str | None = None) -> DataFrame:
    out = out or col
    return (df.join(scaler, SERIES)
            .withColumn(out, F.col(col) * (F.col("scale_max") - F.col("scale_min")) + F.col("scale_min"))
            .drop("scale_min", "scale_max"))
