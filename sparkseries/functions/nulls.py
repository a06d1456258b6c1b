"""NULL / NaN / infinity normalisation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column | str) -> Column:
    """NaN becomes NULL; +-Inf is kept (pandas ``dropna`` keeps infinities)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c.cast("double"))


def is_missing(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | F.isnan(c)
