"""Canonical long layout shared by every operator.

A *long* frame has one row per observation::

    series_id STRING, ts TIMESTAMP_NTZ (nullable for integer-indexed data),
    tiebreak <any orderable type>, value DOUBLE

``(series_id, ts, tiebreak)`` is the total order of a series.  Operators that
need positions add ``seq BIGINT`` (0-based) with :func:`sparkseries.operators.order.with_seq`.
"""

SERIES = "series_id"
TS = "ts"
TB = "tiebreak"
VALUE = "value"
SEQ = "seq"

ORDER = (TS, TB)
LONG_COLUMNS = (SERIES, TS, TB, VALUE)
