"""Typing, role resolution and the wide -> long reshape (survey B1-B11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import is_missing, nan_to_null
from ..schema import SERIES, TB, TS, VALUE
from .joins import bounded

TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# pandas' default missing-value tokens for text readers.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)


# ---------------------------------------------------------------- B1 / B2 / B3
def resolve_time_column(df: DataFrame, time_col: str | None = None) -> tuple[DataFrame, str | None]:
    """Pick the time column: the named one, else the first date/time field, else the
    first column when it is text and *every* non-null value parses as a timestamp.

    Returns ``(df, name)`` with the column cast to ``TIMESTAMP_NTZ``; ``name`` is None when
    there is no time column (integer-indexed data).  Numeric columns are never cast.
    """
    fields = {f.name: f for f in df.schema.fields}
    if time_col is not None:
        if time_col not in fields:
            raise ValueError(f"time column {time_col!r} not in {list(fields)}")
        return df.withColumn(time_col, _as_ts(F.col(time_col), fields[time_col].dataType)), time_col
    for f in df.schema.fields:
        if isinstance(f.dataType, TIME_TYPES):
            return df.withColumn(f.name, _as_ts(F.col(f.name), f.dataType)), f.name
    if not df.schema.fields:
        return df, None
    first = df.schema.fields[0]
    if isinstance(first.dataType, T.StringType):
        c = F.col(first.name)
        # one aggregate pass: all non-null values must parse
        row = df.agg(F.count(c).alias("n"), F.count(F.try_to_timestamp(c)).alias("ok")).first()
        if row["n"] > 0 and row["n"] == row["ok"]:
            return df.withColumn(first.name, F.try_to_timestamp(c).cast("timestamp_ntz")), first.name
    return df, None


def _as_ts(c, dtype):
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, T.StringType):
        return F.try_to_timestamp(c).cast("timestamp_ntz")
    return c.cast("timestamp_ntz")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """All numeric fields (bool is not numeric); error when there are none."""
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]
    if not cols:
        raise ValueError("the table has no column of a numeric type")
    return cols


def select_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """User column choice (the UI's ``columns=``); unknown names are an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}; available {df.columns}")
    return df.select(*keep, *columns)


# ---------------------------------------------------------------- B4 / B5 / B7
def to_long(df: DataFrame, time_col: str | None, value_cols: Sequence[str],
            keys: Sequence[str] = (), tiebreak: str | None = None,
            include_column: bool | None = None, sep: str = "|") -> DataFrame:
    """Wide -> canonical long ``(series_id, ts, tiebreak, value)``.

    ``series_id`` is the column name, or ``key1|key2[|column]`` when group keys are given
    (the column name is kept when several value columns are unpivoted).  Without a
    ``tiebreak`` column the input order is captured by ``monotonically_increasing_id``.
    NaN becomes NULL here (Spark counts NaN; pandas does not).
    """
    value_cols = list(value_cols)
    if not value_cols:
        raise ValueError("the table has no column of a numeric type")
    if include_column is None:
        include_column = len(value_cols) > 1 or not keys
    tb = F.col(tiebreak) if tiebreak else F.monotonically_increasing_id()
    ts = F.col(time_col).cast("timestamp_ntz") if time_col else F.lit(None).cast("timestamp_ntz")
    base = df.select(*[F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)],
                     ts.alias(TS), tb.alias(TB), *[as_double(c).alias(c) for c in value_cols])
    ids = [f"_k{i}" for i in range(len(keys))] + [TS, TB]
    long = base.unpivot(ids, value_cols, "_col", VALUE)
    parts = [F.col(f"_k{i}") for i in range(len(keys))] + ([F.col("_col")] if include_column else [])
    return long.select(F.concat_ws(sep, *parts).alias(SERIES), TS, TB, nan_to_null(VALUE).alias(VALUE))


def as_double(column: str):
    """A value column as DOUBLE, whatever numeric type it has."""
    return F.col(column).cast("double")


def drop_missing(long: DataFrame) -> DataFrame:
    """Drop NULL and NaN values; +-Inf is kept."""
    return long.where(~is_missing(F.col(VALUE)))


# ---------------------------------------------------------------- B6
def parse_columns(df: DataFrame, columns: Sequence[str] | None = None,
                  na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Type text columns the way a CSV reader with inference would.

    NA tokens become NULL; a column becomes BIGINT if every non-null value is an integer
    (and nothing was missing), DOUBLE if every one is a number, TIMESTAMP_NTZ if every one
    parses as a time, else it stays text.  Decided in one aggregate pass.
    """
    cols = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df
    na = list(na_tokens)

    def cleaned(c):
        t = F.trim(F.col(c))
        return F.when(t.isin(na) | F.col(c).isNull(), F.lit(None)).otherwise(t)

    aggs = []
    for i, c in enumerate(cols):
        x = cleaned(c)
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.count(x.try_cast("bigint")).alias(f"i{i}"),
            F.count(x.try_cast("double")).alias(f"d{i}"),
            F.count(F.try_to_timestamp(x)).alias(f"t{i}"),
            F.count(F.when(x.isNull(), 1)).alias(f"m{i}"),
        ]
    row = df.agg(*aggs).first()
    typed = {}
    for i, c in enumerate(cols):
        n, missing = row[f"n{i}"], row[f"m{i}"]
        x = cleaned(c)
        if n == 0:
            typed[c] = F.lit(None).cast("double")
        elif row[f"i{i}"] == n and missing == 0:
            typed[c] = x.try_cast("bigint")
        elif row[f"d{i}"] == n:
            typed[c] = x.try_cast("double")
        elif row[f"t{i}"] == n:
            typed[c] = F.try_to_timestamp(x).cast("timestamp_ntz")
        else:
            typed[c] = x
    return df.select(*[typed[c].alias(c) if c in typed else F.col(f"`{c}`") for c in df.columns])


# ---------------------------------------------------------------- B8 / B9 / B10
def series_counts(long: DataFrame) -> DataFrame:
    """Per series: raw rows, non-missing points, min, max (partial+final aggregate, no sort)."""
    v = F.col(VALUE)
    ok = F.when(~is_missing(v), v)
    return long.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(ok).alias("n"),
        F.min(ok).alias("min_value"),
        F.max(ok).alias("max_value"),
    )


def all_missing(long: DataFrame) -> DataFrame:
    """``(series_id, all_missing)``: the series has rows but no usable value."""
    return series_counts(long).select(SERIES, (F.col("n") == 0).alias("all_missing"))


def is_constant(long: DataFrame) -> DataFrame:
    """``(series_id, is_constant)``: min == max over non-missing values (exact, float-safe)."""
    return series_counts(long).select(
        SERIES, (F.col("min_value") == F.col("max_value")).alias("is_constant"))


def min_points_guard(long: DataFrame, min_points: int) -> tuple[DataFrame, DataFrame]:
    """Split a cleaned long frame into (qualifying rows, per-series status of the rest).

    The qualifying side is a left-semi join against the per-series count table, which is
    size-checked before it is broadcast.
    """
    counts = long.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n"))
    counts = bounded(counts)
    ok = counts.where(F.col("n") >= min_points).select(SERIES)
    short = counts.where(F.col("n") < min_points).select(
        SERIES, F.col("n"), F.lit("insufficient").alias("status"),
        F.lit(f"needs at least {min_points} points").alias("reason"))
    return long.join(ok, SERIES, "left_semi"), short


# ---------------------------------------------------------------- B11
def first_series(df: DataFrame, time_col: str | None = None) -> DataFrame:
    """First time column + first numeric column as one series (the series endpoint)."""
    df, tcol = resolve_time_column(df, time_col)
    if tcol is None:
        raise ValueError("Could not identify a time column")
    col = numeric_columns(df, exclude=[tcol])[0]
    return to_long(df, tcol, [col])
