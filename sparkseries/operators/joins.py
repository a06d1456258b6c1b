"""Size-checked broadcast of per-series side tables.

Most operators compute a small table with one row per series (mean/std,
quartiles, min/max, ...) and attach it back to the observations.  Attaching it
with a broadcast hash join keeps the big side where it is (no shuffle, no hot
task for a series that holds a third of all rows).  A broadcast is only safe
when the side has a proven size bound, so:

* :func:`bounded` computes the side table once, writes it to the shared
  checkpoint folder (lineage cut: later plans see a small leaf, and a lost
  executor does not recompute it), counts it and hints ``broadcast`` only if the
  count is within ``sparkseries.broadcastMaxRows``; beyond it the join is left
  to AQE (shuffle join with skew splitting).  The check runs before the big side
  is planned, so a data-sized shuffle is never started only to be discarded.
* :func:`static_bound` is for sides whose row count is known from the plan
  itself (for example one row per unpivoted column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import (CONF_BROADCAST_BYTES, CONF_BROADCAST_ROWS, DEFAULT_BROADCAST_BYTES,
                       DEFAULT_BROADCAST_ROWS, checkpoint, conf_int)


def max_broadcast_rows(df: DataFrame) -> int:
    return conf_int(df.sparkSession, CONF_BROADCAST_ROWS, DEFAULT_BROADCAST_ROWS)


def bounded(small: DataFrame, max_rows: int | None = None, observe: dict | None = None, keep=checkpoint) -> DataFrame:
    """Materialise ``small`` (checkpointed) and broadcast it iff its row count and its size are
    within the bounds (``sparkseries.broadcastMaxRows`` / ``sparkseries.broadcastMaxBytes``).

    ``observe`` adds named aggregate columns computed in the same job; their values are
    left on the result as ``df.sparkseries_metrics`` (with ``rows``).  A hint covers the checked
    rows only but survives ``explode``: multiply rows from ``df.sparkseries_plain`` instead.
    ``keep`` is how the table is written (iterations pass a form of ``session.stored``)."""
    limit = max_rows if max_rows is not None else max_broadcast_rows(small)
    max_bytes = conf_int(small.sparkSession, CONF_BROADCAST_BYTES, DEFAULT_BROADCAST_BYTES)
    # the checkpoint job computes and writes the table and, as observed metrics, counts its rows
    # and its size (JSON text length: an over-estimate of the broadcast's binary size)
    size = Observation("sparkseries_side_rows")
    extra = [e.alias(k) for k, e in (observe or {}).items()]
    text = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in small.columns])))
    small = keep(small.observe(size, F.count(F.lit(1)).alias("rows"),
                                     F.coalesce(F.sum(text), F.lit(0)).alias("bytes"), *extra))
    metrics = dict(size.get)
    fits = metrics["rows"] <= limit and metrics["bytes"] <= max_bytes
    out = F.broadcast(small) if fits else small
    out.sparkseries_metrics = metrics
    out.sparkseries_plain = small  # without the hint, for use below an explode
    return out


def static_bound(small: DataFrame, n_rows: int, max_rows: int | None = None) -> DataFrame:
    """Broadcast a side whose row count is known to be at most ``n_rows`` from the plan."""
    limit = max_rows if max_rows is not None else max_broadcast_rows(small)
    return F.broadcast(small) if n_rows <= limit else small
