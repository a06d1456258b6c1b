"""Holt's linear-trend exponential smoothing (survey F3), fitted by least squares
over an (alpha, beta) grid.

For fixed (alpha, beta) the recursion is affine in the state ``s = (level, trend)``::

    s_t = A s_{t-1} + c y_t,   A = [[1-a, 1-a], [-ab, 1-ab]],  c = [a, ab]
    e_t = y_t - (level_{t-1} + trend_{t-1})

so a chunk of consecutive points maps an unknown incoming state ``s`` to
``M s + v`` and contributes ``R0 - 2 R1.s + s' R2 s`` to the squared error.
Each bounded chunk is summarised for the whole grid at once (NumPy; blocks of the
chunk run side by side and are composed) in ``applyInPandas`` grouped by
``(series_id, chunk)``; the per-series composition then walks the (few) chunk
summaries in order.  No task ever holds more than one chunk, whatever the length of
a series.  A series of one chunk is fitted where it is and sends one row.

Start: ``level_0 = y_0``, ``trend_0 = y_1 - y_0``; errors are summed from t = 1.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...schema import SEQ, SERIES, VALUE
from ..joins import bounded
from ..order import chunk_rows
from .common import Z95, Prepared, steps_for

# The smoothing-parameter grid (0.05 .. 0.95 by 0.05 for both).
GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))
_A, _B = (np.array(x) for x in zip(*[(a, b) for a in GRID for b in GRID]))
#: Points of a chunk; a task keeps twelve numbers per grid point for each of its ~sqrt(n) blocks.
CHUNK_ROWS = 1 << 17
SUMMARY_FIELDS = ("m00", "m01", "m10", "m11", "v0", "v1", "r0", "r1a", "r1b", "r2aa", "r2ab", "r2bb")
SUMMARY_SCHEMA = f"{SERIES} string, _c long, " + ", ".join(f"{f} array<double>" for f in SUMMARY_FIELDS)


def _blocks(y: np.ndarray) -> dict:
    """Summaries of the rows of ``y`` (blocks of consecutive points), all side by side: fields of
    shape (blocks, grid)."""
    a, ab = _A, _A * _B
    shape = (len(y), a.size)
    f = {k: np.zeros(shape) for k in SUMMARY_FIELDS}
    m00, m01, m10, m11 = np.ones(shape), np.zeros(shape), np.zeros(shape), np.ones(shape)
    v0, v1 = np.zeros(shape), np.zeros(shape)
    for x in y.T[:, :, None]:
        ga, gb, level = m00 + m10, m01 + m11, v0 + v1
        r = x - level
        f["r0"] += r * r
        f["r1a"] += r * ga
        f["r1b"] += r * gb
        f["r2aa"] += ga * ga
        f["r2ab"] += ga * gb
        f["r2bb"] += gb * gb
        m10, m11 = m10 - ab * ga, m11 - ab * gb
        m00, m01 = (1 - a) * ga, (1 - a) * gb
        v0, v1 = level + a * r, v1 + ab * r
    return f | {"m00": m00, "m01": m01, "m10": m10, "m11": m11, "v0": v0, "v1": v1}


def _then(f: dict, g: dict) -> dict:
    """The summary of a stretch of points followed by another."""
    p0 = g["r2aa"] * f["v0"] + g["r2ab"] * f["v1"] - g["r1a"]
    p1 = g["r2ab"] * f["v0"] + g["r2bb"] * f["v1"] - g["r1b"]
    out = {"r0": f["r0"] + g["r0"] + f["v0"] * (p0 - g["r1a"]) + f["v1"] * (p1 - g["r1b"]),
           "r1a": f["r1a"] - f["m00"] * p0 - f["m10"] * p1, "r1b": f["r1b"] - f["m01"] * p0 - f["m11"] * p1}
    for name, (x, y), (z, w) in (("r2aa", ("m00", "m10"), ("m00", "m10")), ("r2ab", ("m00", "m10"), ("m01", "m11")),
                                 ("r2bb", ("m01", "m11"), ("m01", "m11"))):
        out[name] = f[name] + f[x] * (g["r2aa"] * f[z] + g["r2ab"] * f[w]) + f[y] * (g["r2ab"] * f[z] + g["r2bb"] * f[w])
    for i in "01":
        out[f"m{i}0"] = g[f"m{i}0"] * f["m00"] + g[f"m{i}1"] * f["m10"]
        out[f"m{i}1"] = g[f"m{i}0"] * f["m01"] + g[f"m{i}1"] * f["m11"]
        out[f"v{i}"] = g[f"m{i}0"] * f["v0"] + g[f"m{i}1"] * f["v1"] + g[f"v{i}"]
    return out


def summarise(y: np.ndarray) -> dict:
    """The summary of consecutive points: about sqrt(n) blocks side by side, then one after the other."""
    size = max(1, int(np.sqrt(len(y))))
    whole = len(y) // size * size
    parts = [_blocks(y[:whole].reshape(-1, size))] + ([_blocks(y[None, whole:])] if whole < len(y) else [])
    out = None
    for f in parts:
        for i in range(len(f["r0"])):
            one = {k: v[i] for k, v in f.items()}
            out = one if out is None else _then(out, one)
    return out


def _chunk_summary(pdf: pd.DataFrame) -> pd.DataFrame:
    f = summarise(pdf.sort_values(SEQ)[VALUE].to_numpy(dtype=float))
    return pd.DataFrame({SERIES: [pdf[SERIES].iloc[0]], "_c": [int(pdf["_c"].iloc[0])], **{k: [f[k].tolist()] for k in SUMMARY_FIELDS}})


FIT_SCHEMA = (f"{SERIES} string, alpha double, beta double, level double, trend double, "
              "sse double, n_err long")


def _best(sid, s0, s1, sse, n: int) -> pd.DataFrame:
    best = int(np.argmin(sse))
    return pd.DataFrame({SERIES: [sid], "alpha": [float(_A[best])], "beta": [float(_B[best])],
                         "level": [float(s0[best])], "trend": [float(s1[best])],
                         "sse": [float(max(sse[best], 0.0))], "n_err": [n - 1]})


def _fit_whole(pdf: pd.DataFrame) -> pd.DataFrame:
    """A series of one chunk: the recursion itself, every grid point side by side."""
    y = pdf.sort_values(SEQ)[VALUE].to_numpy(dtype=float)
    s0, s1, sse = np.full(_A.size, y[0]), np.full(_A.size, y[1] - y[0]), np.zeros(_A.size)
    for x in y[1:]:
        r = x - (s0 + s1)
        sse += r * r
        s0, s1 = s0 + s1 + _A * r, s1 + _A * _B * r
    return _best(pdf[SERIES].iloc[0], s0, s1, sse, len(y))


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_c")
    y0, y1 = float(pdf["_y0"].iloc[0]), float(pdf["_y1"].iloc[0])
    s0, s1, sse = np.full(_A.size, y0), np.full(_A.size, y1 - y0), np.zeros(_A.size)
    for _, row in pdf.iterrows():
        f = {k: np.asarray(row[k], dtype=float) for k in SUMMARY_FIELDS}
        sse += (f["r0"] - 2 * (f["r1a"] * s0 + f["r1b"] * s1)
                + f["r2aa"] * s0 * s0 + 2 * f["r2ab"] * s0 * s1 + f["r2bb"] * s1 * s1)
        s0, s1 = f["m00"] * s0 + f["m01"] * s1 + f["v0"], f["m10"] * s0 + f["m11"] * s1 + f["v1"]
    return _best(pdf[SERIES].iloc[0], s0, s1, sse, int(pdf["_n"].iloc[0]))


def holt_fit(seqd: DataFrame, facts: DataFrame, max_chunk: int | None = None) -> DataFrame:
    """Per series: best (alpha, beta) by SSE, final level and trend. ``seqd`` has ``seq``;
    ``facts`` has ``(series_id, n)`` for the series to fit (n >= 2)."""
    size = max_chunk if max_chunk is not None else min(chunk_rows(seqd), CHUNK_ROWS)
    facts = bounded(facts.select(SERIES, "n"), observe={"most": F.max("n")})
    rows = seqd.join(facts, SERIES).select(SERIES, SEQ, VALUE, "n")
    fits = rows.where(F.col("n") <= size + 1).groupBy(SERIES).applyInPandas(_fit_whole, schema=FIT_SCHEMA)
    if (facts.sparkseries_metrics["most"] or 0) <= size + 1:
        return fits
    rows = rows.where(F.col("n") > size + 1)
    body = rows.where(F.col(SEQ) >= 1).withColumn("_c", F.floor((F.col(SEQ) - 1) / F.lit(size)))
    summaries = body.select(SERIES, "_c", SEQ, VALUE).groupBy(SERIES, "_c").applyInPandas(
        _chunk_summary, schema=SUMMARY_SCHEMA)
    starts = rows.where(F.col(SEQ) <= 1).groupBy(SERIES).agg(
        F.max("n").alias("_n"), F.max(F.when(F.col(SEQ) == 0, F.col(VALUE))).alias("_y0"),
        F.max(F.when(F.col(SEQ) == 1, F.col(VALUE))).alias("_y1"))
    return fits.unionByName(summaries.join(starts, SERIES).groupBy(SERIES).applyInPandas(_compose, schema=FIT_SCHEMA))


def holt_forecast(prep: Prepared, horizons: Sequence[int], model: str = "exponential_smoothing"):
    """Forecast rows and info rows for the non-constant series of ``prep``."""
    facts = prep.varying()
    fit = holt_fit(prep.clean.join(facts.select(SERIES), SERIES, "left_semi"), facts, prep.max_chunk)
    steps = steps_for(prep, facts, horizons).join(fit, SERIES)
    k = F.col("step").cast("double")
    point = F.col("level") + k * F.col("trend")
    sigma2 = F.try_divide(F.col("sse"), F.col("n_err").cast("double"))
    # ETS(A,A,N) variance: sigma^2 (1 + sum_{j<k} alpha^2 (1 + j beta)^2)
    a, b = F.col("alpha"), F.col("beta")
    km1 = k - 1
    s1 = km1
    s2 = km1 * k / 2
    s3 = km1 * k * (2 * km1 + 1) / 6
    var = sigma2 * (1 + a * a * (s1 + 2 * b * s2 + b * b * s3))
    half = F.lit(Z95) * F.sqrt(var)
    rows = steps.select(SERIES, F.lit(model).alias("model"), F.col("horizon").cast("int").alias("horizon"),
                        F.col("step").cast("int").alias("step"), "ts", SEQ, point.alias("forecast"),
                        (point - half).alias("lower"), (point + half).alias("upper"))
    info = fit.select(SERIES, F.lit(model).alias("model"), F.lit("ok").alias("status"),
                      F.lit("Holt linear trend exponential smoothing").alias("description"),
                      "alpha", "beta", "level", "trend", "sse")
    return rows, info
