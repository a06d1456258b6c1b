"""Registered queries: every operator of the inventory run on the driver tables,
each paired (where SQL can express it) with an equivalent DuckDB query.

Conventions for comparability: double outputs are rounded to 6 decimals in both
(double sums differ in the last bits with the summation order); timestamps stay
``TIMESTAMP``; every computed column is aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6
# Rounding for comparable output: before rounding to d decimals, values move away from zero
# by a thousandth of the rounding unit (10^-(d+3)), in Spark and in the SQL alike.  Exact
# decimal ties (e.g. means of 2-decimal prices over 32 rows) then round the same way even when
# the two engines' sums differ in the last bit, and rounding an already rounded value again
# changes nothing.


def fround(c, digits: int = DIGITS):
    """Spark side of the shared rounding rule."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.signum(c) * F.lit(10.0 ** -(digits + 3)), digits)


def rnd(expr: str, digits: int = DIGITS) -> str:
    """SQL side of the shared rounding rule."""
    return f"round(({expr}) + sign({expr}) * {10.0 ** -(digits + 3)!r}, {digits})"


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return wrap


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every DOUBLE/FLOAT column (top level) to ``digits`` decimals."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(fround(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


# modules below add their queries to the registry on import
from . import catalog_core, catalog_series, catalog_forecast, catalog_reports  # noqa: E402,F401
