"""Strict-JSON encoding of result frames (survey R2).

:func:`json_safe` rewrites every column from the schema: NaN and +-Inf become
NULL at any depth (inside arrays, maps and structs), map keys become strings,
dates and timestamps become ISO-8601 text.  :func:`to_json_rows` then renders
one JSON object per row with NULL fields kept.  Pure column expressions: runs
inside whole-stage codegen, no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
ISO_DATE = "yyyy-MM-dd"


def safe_expr(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(d)
    if isinstance(dtype, T.DecimalType):
        return c.cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, ISO_TS)
    if isinstance(dtype, T.DateType):
        return F.date_format(c, ISO_DATE)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: safe_expr(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        keyed = F.transform_keys(c, lambda k, v: _key_text(k, dtype.keyType))
        return F.transform_values(keyed, lambda k, v: safe_expr(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        if not dtype.fields:
            return c
        return F.when(c.isNull(), F.lit(None)).otherwise(F.struct(*[
            safe_expr(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]))
    return c


def _key_text(k: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return k
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_format(k, ISO_TS if not isinstance(dtype, T.DateType) else ISO_DATE)
    return k.cast("string")


def json_safe(df: DataFrame) -> DataFrame:
    """Same columns, every value strict-JSON representable."""
    return df.select(*[safe_expr(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def to_json_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON document per row (NULL fields kept as ``null``)."""
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in safe.columns]),
                                 {"ignoreNullFields": "false"}).alias(column))
