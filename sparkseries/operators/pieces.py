"""Series as stored pieces: the one ordered exchange that diagnostics share.

:func:`cut` puts every series in order once and writes it as runs of at most ``chunkRows`` values, a
row each: ``(series_id, c, lo, n, size, ys)`` with ``lo`` the position of the first value and ``n`` the
points of the series.  A series that fits one run is gathered by a grouped sort; a longer one is
numbered by range partitions first (:func:`.order.with_seq`), so no task holds more than one run.

Everything that needs order afterwards is a map over these rows: positions (:func:`points`), values
before a run (:func:`with_before`), lag products (:func:`lag_sums`).  What leaves a task is a few
numbers per run, which meet by series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SEQ, SERIES, TB, TS, VALUE
from ..session import stored
from .joins import bounded
from .order import chunk_rows, series_sizes, with_seq

#: A run is one array in one row.
PIECE_ROWS = 1 << 17


def cut(clean: DataFrame, max_chunk: int | None = None) -> DataFrame:
    """The pieces of ``clean(series_id, ts, tiebreak, value)`` (no missing values), written once."""
    limit = max_chunk if max_chunk is not None else min(chunk_rows(clean), PIECE_ROWS)
    sizes = series_sizes(clean)

    def rows(g: DataFrame, c, lo) -> DataFrame:
        return g.select(SERIES, c.cast("long").alias("c"), lo.cast("long").alias("lo"), "n", F.lit(limit).cast("long").alias("size"),
                        F.transform("p", lambda x: x[VALUE]).alias("ys"))

    short = clean.join(sizes.where(F.col("n") <= limit), SERIES).groupBy(SERIES).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct(TS, TB, VALUE))).alias("p"))
    out = rows(short, F.lit(0), F.lit(0))
    if (sizes.sparkseries_metrics["max_n"] or 0) > limit:
        many = sizes.where(F.col("n") > limit)
        seqd = with_seq(clean.join(many.select(SERIES), SERIES, "left_semi"), sizes=many, max_chunk=limit)
        long = seqd.select(SERIES, SEQ, VALUE).join(many, SERIES).groupBy(SERIES, F.floor(F.col(SEQ) / limit).alias("k")).agg(
            F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct(SEQ, VALUE))).alias("p"))
        out = out.unionByName(rows(long, F.col("k"), F.col("k") * limit))
    return stored(out, "pieces")


def points(parts: DataFrame) -> DataFrame:
    """``(series_id, seq, value, n)``: a narrow explode, no exchange."""
    return parts.select(SERIES, "lo", "n", F.posexplode("ys").alias("_i", VALUE)).select(
        SERIES, (F.col("lo") + F.col("_i")).alias(SEQ), VALUE, "n")


def sizes_and_means(parts: DataFrame) -> DataFrame:
    """``(series_id, n, mean)``."""
    total = F.aggregate("ys", F.lit(0.0), lambda a, x: a + x)
    return parts.groupBy(SERIES).agg(F.max("n").alias("n"), (F.sum(total) / F.max("n")).alias("mean"))


def with_before(parts: DataFrame, need: DataFrame) -> DataFrame:
    """``parts`` joined with ``need(series_id, reach, ...)``, and ``ahead``: the up to ``reach`` values
    before each piece (taken from as many earlier pieces as that takes)."""
    need = bounded(need.drop("n"))
    rows = parts.join(need, SERIES)
    later = F.sequence(F.lit(1).cast("long"), F.least(F.ceil(F.col("reach") / F.col("size")), F.ceil(F.col("n") / F.col("size")) - 1 - F.col("c")))
    given = rows.where((F.col("reach") > 0) & (F.col("lo") + F.size("ys") < F.col("n"))).select(
        SERIES, "c", "lo", "reach", "size", "ys", F.explode(later).alias("_j"))
    skip = F.greatest(F.lit(0), (F.col("c") + F.col("_j")) * F.col("size") - F.col("reach") - F.col("lo")).cast("int")
    given = given.select(SERIES, (F.col("c") + F.col("_j")).alias("c"), F.struct(
        "lo", F.slice("ys", skip + 1, F.size("ys") - skip).alias("v")).alias("t")).groupBy(SERIES, "c").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list("t")), lambda x: x.v)).alias("ahead"))
    return rows.join(given, [SERIES, "c"], "left").withColumn("ahead", F.coalesce("ahead", F.array().cast("array<double>")))


def lagged_products(x: np.ndarray, first: int, most: int) -> np.ndarray:
    """sum_t x_t x_{t-k} over t >= first, for k = 0 .. most (pairs inside ``x``)."""
    return np.array([x[max(first, k):] @ x[max(first, k) - k:len(x) - k] if max(first, k) < len(x) else 0.0 for k in range(most + 1)])


def lag_sums(parts: DataFrame, need: DataFrame) -> DataFrame:
    """``(series_id, lag, total)`` for lags 0 .. reach around the mean; ``need(series_id, reach, mean)``."""
    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                x = np.concatenate([r.ahead, r.ys]) - r.mean
                total = lagged_products(x, len(r.ahead), int(r.reach))
                yield pd.DataFrame({SERIES: getattr(r, SERIES), "lag": np.arange(len(total), dtype="int32"), "total": total})

    rows = with_before(parts, need).select(SERIES, "ahead", "ys", "mean", "reach")
    return rows.mapInPandas(run, f"{SERIES} string, lag int, total double").groupBy(SERIES, "lag").agg(F.sum("total").alias("total"))
