"""Isolation-forest anomalies on one value per series (survey D3).

A re-aim of the usual isolation forest (100 trees, ``min(256, n)`` points per
tree sampled without replacement, depth limit ``ceil(log2 psi)``, score
``2^(-E[h(x)] / c(psi))``, the 5 % highest scores flagged); seeded, hence
deterministic, but not bit-equal to any particular library.

Spark layout — only samples and trees are small, the data never gathers:

1. sampling, alike for every length: each (row, tree) pair is a candidate with the
   same probability ``p = min(1, 2 psi / n)``, drawn in the scan stage before any
   shuffle (one seeded hash gives a row's first tree, a geometric gap; only rows that
   have one draw for the trees after it), so about ``2 psi`` rows a tree are shuffled;
   per (series, tree) the ``psi`` smallest hashes win (bounded groups);
2. ``applyInPandas`` per (series, tree) grows the tree on <= 256 values and
   emits its leaves as value intervals with their path length;
3. ``applyInPandas`` per series merges the 100 interval sets into one step
   function of the average path length (<= 100 x 256 breakpoints);
4. scoring is a bucketed range join: the step function is exploded onto
   equal-width value buckets, every point joins its bucket (equi-join, the
   segment table is size-checked for broadcast) and keeps the segment holding it;
5. the cut-off is the exact 95th percentile of the scores, from per-level score counts
   (a partial aggregate; no sort of the points).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import is_missing
from ..schema import SERIES, TB, TS, VALUE
from .joins import bounded
from .stats import quantiles_from_counts

N_TREES = 100
MAX_SAMPLES = 256
CONTAMINATION = 0.05
EULER = 0.5772156649015329
BUCKETS = 256
#: Expected candidates of a tree in units of its sample: with 2 x 256 fewer than 256 come once in 10^30 trees.
OVERSAMPLE = 2.0


def avg_path_length(n: float) -> float:
    """c(n): average unsuccessful-search path length of a binary search tree."""
    if n > 2:
        return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    if n == 2:
        return 1.0
    return 0.0


def _grow(values: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Leaves of one random 1-D isolation tree: list of (lo, hi, path length), intervals (lo, hi]."""
    leaves = []
    stack = [(values, -np.inf, np.inf, 0)]
    while stack:
        v, lo, hi, depth = stack.pop()
        vmin, vmax = (v.min(), v.max()) if len(v) else (0.0, 0.0)
        if depth >= max_depth or len(v) <= 1 or vmin == vmax:
            leaves.append((lo, hi, depth + avg_path_length(len(v))))
            continue
        thr = rng.uniform(vmin, vmax)
        left, right = v[v <= thr], v[v > thr]
        stack.append((left, lo, thr, depth + 1))
        stack.append((right, thr, hi, depth + 1))
    return leaves


def _tree_fn(seed: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        sid, tree = pdf[SERIES].iloc[0], int(pdf["_tree"].iloc[0])
        v = pdf[VALUE].to_numpy(dtype=float)
        key = zlib.crc32(f"{sid}|{tree}|{seed}".encode())
        rng = np.random.default_rng([seed, tree, key])
        depth = int(math.ceil(math.log2(max(len(v), 2))))
        leaves = _grow(v, rng, depth)
        return pd.DataFrame({SERIES: sid, "_tree": tree, "lo": [x[0] for x in leaves],
                             "hi": [x[1] for x in leaves], "h": [x[2] for x in leaves]})
    return build


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Average the trees' step functions: breakpoints = union of leaf bounds."""
    sid = pdf[SERIES].iloc[0]
    n_trees = pdf["_tree"].nunique()
    his = pdf["hi"].to_numpy()
    cuts = np.unique(his[np.isfinite(his)])
    # elementary segments (cuts[i-1], cuts[i]] plus the two unbounded ends
    edges = np.r_[-np.inf, cuts, np.inf]
    total = np.zeros(len(edges) - 1)
    for _, g in pdf.groupby("_tree"):
        g = g.sort_values("hi")
        # each elementary segment's upper edge falls in exactly one leaf of this tree
        idx = np.searchsorted(g["hi"].to_numpy(), edges[1:], side="left")
        total += g["h"].to_numpy()[np.minimum(idx, len(g) - 1)]
    return pd.DataFrame({SERIES: sid, "lo": edges[:-1], "hi": edges[1:], "avg_h": total / n_trees})


def isolation_forest_anomalies(long: DataFrame, threshold: float = 3.0, contamination: float = CONTAMINATION,
                               n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES, seed: int = 42,
                               min_points: int = 3, flagged_only: bool = True, max_chunk: int | None = None,
                               **_ignored) -> DataFrame:
    """Flag the ``contamination`` share of highest isolation scores per series.
    ``threshold`` is carried into the output but not used (as in the reference)."""
    clean = long.where(~is_missing(F.col(VALUE)))
    info = clean.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n"), F.min(VALUE).alias("vmin"),
                                     F.max(VALUE).alias("vmax"))
    info = bounded(info.where(F.col("n") >= min_points).withColumn(
        "psi", F.least(F.lit(max_samples), F.col("n"))).withColumn(
        "p", F.least(F.lit(1.0), F.lit(OVERSAMPLE) * F.col("psi") / F.col("n"))))
    rowkey = [F.col(SERIES), F.col(TS), F.col(TB), F.col(VALUE)]
    base = clean.join(info, SERIES)

    def uniform(h):  # [0, 1) with 53 bits
        return F.shiftrightunsigned(h, 11) * F.lit(2.0 ** -53)

    # first tree of a row: the gap of a geometric law, so most rows of a long series stop here
    gap = F.log1p(-uniform(F.xxhash64(*rowkey, F.lit(seed)))) / F.log1p(-F.col("p"))
    first = F.when(F.col("p") >= 1.0, F.lit(0)).otherwise(F.least(F.floor(gap), F.lit(n_trees))).cast("int")
    drawn = base.withColumn("_first", first).where(F.col("_first") < n_trees)
    drawn = drawn.withColumn("_key", F.xxhash64(*rowkey, F.lit(seed + 2)))
    later = F.filter(F.sequence(F.col("_first"), F.lit(n_trees - 1)),
                     lambda t: (t == F.col("_first")) | (uniform(F.xxhash64(F.col("_key"), t)) < F.col("p")))
    cand = drawn.select("*", F.explode(later).alias("_tree")).withColumn(
        "_u", F.xxhash64(F.col("_key"), F.col("_tree"), F.lit(seed + 1)))
    w = Window.partitionBy(SERIES, "_tree").orderBy("_u", TS, TB)
    sample = cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("psi"))
    leaves = sample.select(SERIES, "_tree", VALUE).groupBy(SERIES, "_tree").applyInPandas(
        _tree_fn(seed), schema=f"{SERIES} string, _tree int, lo double, hi double, h double")
    segments = leaves.groupBy(SERIES).applyInPandas(
        _merge, schema=f"{SERIES} string, lo double, hi double, avg_h double")
    # bucketed range join: segments onto equal-width buckets over [vmin, vmax]
    span = F.col("vmax") - F.col("vmin")

    def bucket(x):
        raw = F.floor((x - F.col("vmin")) / span * BUCKETS)
        return F.when(span <= 0, F.lit(0)).otherwise(F.least(F.greatest(raw, F.lit(0)), F.lit(BUCKETS - 1))).cast("int")

    seg = segments.join(info.select(SERIES, "vmin", "vmax", "psi"), SERIES)
    lo_b = F.when(F.col("lo") == float("-inf"), F.lit(0)).otherwise(bucket(F.col("lo")))
    hi_b = F.when(F.col("hi") == float("inf"), F.lit(BUCKETS - 1)).otherwise(bucket(F.col("hi")))
    seg = seg.select(SERIES, "lo", "hi", "avg_h", "psi",
                     F.explode(F.sequence(lo_b, F.greatest(lo_b, hi_b))).alias("_b"))
    seg = bounded(seg)
    pts = clean.join(info.select(SERIES, "vmin", "vmax"), SERIES).withColumn("_b", bucket(F.col(VALUE)))
    scored = pts.join(seg, [SERIES, "_b"]).where((F.col(VALUE) > F.col("lo")) & (F.col(VALUE) <= F.col("hi")))
    cpsi = F.when(F.col("psi") > 2, 2.0 * (F.log(F.col("psi") - 1.0) + F.lit(EULER))
                  - 2.0 * (F.col("psi") - 1.0) / F.col("psi")).when(F.col("psi") == 2, 1.0).otherwise(1.0)
    scored = scored.select(SERIES, TS, TB, VALUE, F.pow(F.lit(2.0), -F.col("avg_h") / cpsi).alias("score"))
    # exact cut-off from score-level counts (scores take <= n_trees * psi distinct values per series)
    levels = scored.groupBy(SERIES, F.col("score").alias(VALUE)).agg(F.count(F.lit(1)).alias("cnt"))
    cut = quantiles_from_counts(levels, [1.0 - contamination]).select(SERIES, F.col("quantile").alias("_cut"))
    out = scored.join(bounded(cut), SERIES).select(
        SERIES, TS, TB, VALUE, "score", F.lit(None).cast("double").alias("lower_bound"),
        F.lit(None).cast("double").alias("upper_bound"), F.lit("isolation_forest").alias("method"),
        F.lit(float(threshold)).alias("threshold"), (F.col("score") > F.col("_cut")).alias("is_anomaly"))
    return out.where("is_anomaly").drop("is_anomaly") if flagged_only else out
