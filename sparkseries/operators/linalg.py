"""Distributed per-series normal equations.

:func:`gram` forms ``[X | y]' [X | y]`` for every series with partial sums:
each input partition computes its small matrices with NumPy
(``mapInPandas``), emits them as ``(series_id, i, j, v)`` cells, and a grouped
sum (map-side combined) adds the partitions up.  A series spread over many
partitions costs one cell set per partition, never a gather of its rows.
:func:`solve` then runs one tiny least-squares / ridge solve per series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SERIES

#: Bytes of partial matrices an input partition keeps before it sends them on.
PARTIAL_BYTES = 32 << 20

CELL_SCHEMA = f"{SERIES} string, i int, j int, v double"


def gram(df: DataFrame, columns: Sequence[str], key: str = SERIES) -> DataFrame:
    """Upper-triangle cells of the cross-product matrix of ``columns`` per ``key``.

    Rows with a NULL in any column are skipped."""
    cols = list(columns)
    k = len(cols)
    iu, ju = np.triu_indices(k)

    most = max(1, PARTIAL_BYTES // (8 * k * k))

    def cells_of(acc):
        sids = np.repeat(np.array(list(acc), dtype=object), len(iu))
        return pd.DataFrame({SERIES: sids, "i": np.tile(iu.astype("int32"), len(acc)),
                             "j": np.tile(ju.astype("int32"), len(acc)),
                             "v": np.concatenate([m[iu, ju] for m in acc.values()])})

    def partial(batches):
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            pdf = pdf.dropna()
            if pdf.empty:
                continue
            for sid, g in pdf.groupby(key, sort=False):
                x = g[cols].to_numpy(dtype=float)
                m = x.T @ x
                acc[sid] = acc[sid] + m if sid in acc else m
                if len(acc) >= most:  # many series: partial sums go on, memory stays bounded
                    yield cells_of(acc)
                    acc = {}
        if acc:
            yield cells_of(acc)

    cells = df.select(F.col(key).alias(SERIES), *cols).mapInPandas(partial, CELL_SCHEMA)
    return cells.groupBy(SERIES, "i", "j").agg(F.sum("v").alias("v"))


def assemble(pdf: pd.DataFrame, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    i = pdf["i"].to_numpy()
    j = pdf["j"].to_numpy()
    m[i, j] = pdf["v"].to_numpy()
    m[j, i] = pdf["v"].to_numpy()
    return m


def solve(cells: DataFrame, n_features: int, fn: Callable[[str, np.ndarray], pd.DataFrame],
          schema: str) -> DataFrame:
    """Apply ``fn(series_id, G)`` to every series' full ``(n_features + 1)^2`` matrix
    (features first, target last).  Groups hold ``O(n_features^2)`` cells only."""
    k = n_features + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf[SERIES].iloc[0], assemble(pdf, k))

    return cells.groupBy(SERIES).applyInPandas(run, schema=schema)


def ols_from_gram(g: np.ndarray, cols: Sequence[int] | None = None, ridge: np.ndarray | None = None):
    """Coefficients, SSR and N for regressing the last column on ``cols``.

    ``g`` must include a constant column if an intercept is wanted; N is read from it
    when ``const_index`` is given by the caller.  Uses a least-squares solve (handles
    rank deficiency).  A matrix with non-finite cells gives NaN results."""
    k = g.shape[0] - 1
    idx = list(range(k)) if cols is None else list(cols)
    if not np.isfinite(g).all():  # infinite observations: no fit, and no failure for other series
        return np.full(len(idx), np.nan), float("nan"), np.full((len(idx), len(idx)), np.nan)
    xtx = g[np.ix_(idx, idx)].copy()
    xty = g[idx, k]
    if ridge is not None:
        xtx = xtx + np.diag(np.asarray(ridge)[idx])
    beta, *_ = np.linalg.lstsq(xtx, xty, rcond=None)
    ssr = float(g[k, k] - 2 * beta @ xty + beta @ g[np.ix_(idx, idx)] @ beta)
    return beta, max(ssr, 0.0), xtx
