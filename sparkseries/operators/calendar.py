"""Calendar operators (survey G1-G5): resampling, gap spine, interpolation,
frequency inference and future time stamps.

Bucket labels follow pandas' conventions: 'D' day, 'h' hour, 'W' Monday-Sunday
weeks labelled by the Sunday, 'M'/'Q'/'Y' labelled by the period's last day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SEQ, SERIES, TB, TS, VALUE
from .joins import bounded
from .order import chunk_rows, chunk_window, lagged, with_seq

FREQS = ("h", "D", "W", "M", "Q", "Y")
#: Frequencies that a series can be resampled to on its own account (:func:`regularize_mixed`).
RESAMPLED = ("D", "W", "M", "Q", "Y")
# Seasonal period per frequency used by additive decomposition.
PERIODS = {"h": 24, "D": 7, "B": 5, "W": 52, "M": 12, "Q": 4, "Y": 1}
DAY = 86_400_000_000  # microseconds
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def bucket_label(ts: Column, freq: str) -> Column:
    """Period label of ``ts`` for ``freq`` (TIMESTAMP_NTZ)."""
    if freq == "h":
        return _ntz(F.date_trunc("hour", ts))
    if freq == "D":
        return _ntz(F.date_trunc("day", ts))
    if freq == "W":
        return _ntz(F.date_add(F.date_trunc("week", ts).cast("date"), 6))
    if freq == "M":
        return _ntz(F.last_day(ts))
    if freq == "Q":
        return _ntz(F.date_sub(F.add_months(F.date_trunc("quarter", ts).cast("date"), 3), 1))
    if freq == "Y":
        return _ntz(F.make_date(F.year(ts), F.lit(12), F.lit(31)))
    raise ValueError(f"unknown frequency {freq!r}; valid: {FREQS}")


def _bucket_index(label: Column, freq: str) -> Column:
    """Integer position of a bucket label on its calendar (consecutive buckets differ by 1)."""
    if freq == "h":
        return F.floor(F.unix_timestamp(label.cast("timestamp")) / 3600).cast("bigint")
    if freq == "D":
        return F.datediff(label.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    if freq == "W":
        return F.floor(F.datediff(label.cast("date"), F.lit("1970-01-04").cast("date")) / 7).cast("bigint")
    months = (F.year(label) * 12 + F.month(label) - 1).cast("bigint")
    if freq == "M":
        return months
    if freq == "Q":
        return F.floor(months / 3).cast("bigint")
    if freq == "Y":
        return F.year(label).cast("bigint")
    raise ValueError(freq)


def _label_of_index(idx: Column, freq: str) -> Column:
    if freq == "h":
        return _ntz(F.timestamp_seconds(idx * 3600))
    if freq == "D":
        return _ntz(F.date_add(F.lit("1970-01-01").cast("date"), idx.cast("int")))
    if freq == "W":
        return _ntz(F.date_add(F.lit("1970-01-04").cast("date"), (idx * 7).cast("int")))
    if freq == "M":
        return _ntz(F.last_day(F.make_date(F.floor(idx / 12).cast("int"), (idx % 12 + 1).cast("int"), F.lit(1))))
    if freq == "Q":
        m = idx * 3
        return _ntz(F.last_day(F.make_date(F.floor(m / 12).cast("int"), (m % 12 + 3).cast("int"), F.lit(1))))
    if freq == "Y":
        return _ntz(F.make_date(idx.cast("int"), F.lit(12), F.lit(31)))
    raise ValueError(freq)


# ---------------------------------------------------------------- G1
def resample_mean(clean: DataFrame, freq: str) -> DataFrame:
    """Mean per calendar bucket: ``(series_id, ts=label, value=mean, n)`` (empty buckets absent).
    ``tiebreak`` is the bucket index, so the result is again a long frame."""
    label = bucket_label(F.col(TS), freq)
    g = clean.where(F.col(TS).isNotNull()).groupBy(SERIES, label.alias(TS)).agg(
        F.avg(VALUE).alias(VALUE), F.count(VALUE).alias("n"))
    return g.select(SERIES, TS, _bucket_index(F.col(TS), freq).alias(TB), VALUE, "n")


# ---------------------------------------------------------------- G2
def calendar_spine(resampled: DataFrame, freq: str, max_chunk: int | None = None) -> DataFrame:
    """Add rows (value NULL) for the empty buckets between each series' first and last bucket.

    The spine is generated in two levels — chunks of ``chunkRows`` buckets, repartitioned,
    then the buckets of each chunk — so a long calendar is not produced in one task."""
    return _spine(resampled, lambda i: _label_of_index(i, freq), max_chunk)


def _spine(resampled: DataFrame, label, max_chunk: int | None) -> DataFrame:
    size = max_chunk if max_chunk is not None else chunk_rows(resampled)
    span = resampled.groupBy(SERIES).agg(F.min(TB).alias("_lo"), F.max(TB).alias("_hi"))
    n_chunks = F.floor((F.col("_hi") - F.col("_lo")) / F.lit(size)).cast("bigint")
    chunks = (span.select(SERIES, "_lo", "_hi", F.explode(F.sequence(F.lit(0).cast("bigint"), n_chunks)).alias("_c"))
              .repartition(SERIES, "_c"))
    start = F.col("_lo") + F.col("_c") * F.lit(size)
    stop = F.least(start + F.lit(size - 1), F.col("_hi"))
    spine = chunks.select(SERIES, F.explode(F.sequence(start, stop)).alias(TB))
    spine = spine.withColumn(TS, label(F.col(TB)))
    extra = [c for c in resampled.columns if c not in (SERIES, TS, TB)]
    return spine.join(resampled.drop(TS), [SERIES, TB], "left").select(SERIES, TS, TB, *extra)


# ---------------------------------------------------------------- G3
def interpolate_linear(long_seq: DataFrame, max_chunk: int | None = None) -> DataFrame:
    """Linear interpolation by position (pandas ``interpolate()`` defaults): interior gaps
    linear, trailing gap = last value, leading gap stays NULL.

    Previous/next valid points are found inside each chunk; a gap crossing chunk borders
    takes them from a per-chunk summary (last / first valid point of every chunk)."""
    size = max_chunk if max_chunk is not None else chunk_rows(long_seq)
    ch = F.floor(F.col(SEQ) / F.lit(size))
    df = long_seq.withColumn("_c", ch).withColumn(
        "_pt", F.when(F.col(VALUE).isNotNull(), F.struct(F.col(SEQ).alias("s"), F.col(VALUE).alias("v"))))
    w = Window.partitionBy(SERIES, "_c").orderBy(SEQ)
    df = (df.withColumn("_prev", F.last("_pt", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_next", F.first("_pt", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))))
    summary = df.groupBy(SERIES, "_c").agg(F.max_by("_pt", F.when(F.col("_pt").isNotNull(), F.col(SEQ))).alias("_lastpt"),
                                           F.min_by("_pt", F.when(F.col("_pt").isNotNull(), F.col(SEQ))).alias("_firstpt"))
    wc = Window.partitionBy(SERIES).orderBy("_c")
    carry = summary.select(
        SERIES, "_c",
        F.last("_lastpt", ignorenulls=True).over(wc.rowsBetween(Window.unboundedPreceding, -1)).alias("_cprev"),
        F.first("_firstpt", ignorenulls=True).over(wc.rowsBetween(1, Window.unboundedFollowing)).alias("_cnext"))
    carry = bounded(carry)
    df = df.join(carry, [SERIES, "_c"])
    prev = F.coalesce(F.col("_prev"), F.col("_cprev"))
    nxt = F.coalesce(F.col("_next"), F.col("_cnext"))
    interp = prev.v + (nxt.v - prev.v) * (F.col(SEQ) - prev.s) / (nxt.s - prev.s)
    filled = (F.when(F.col(VALUE).isNotNull(), F.col(VALUE))
              .when(prev.isNull(), F.lit(None).cast("double"))
              .when(nxt.isNull(), prev.v)
              .otherwise(interp))
    keep = [c for c in long_seq.columns if c != VALUE]
    return df.select(*keep, filled.alias(VALUE))


# ---------------------------------------------------------------- G4
def infer_frequency(long: DataFrame, max_chunk: int | None = None) -> DataFrame:
    """``(series_id, freq)``: one regular frequency or NULL (fewer than 3 stamps or irregular).

    Codes: ``{k}D``/``D``, ``{k}h``, ``{k}min``, ``{k}s``, ``{k}ms``, ``{k}us``, ``W-<DAY>``, ``B``, ``MS``/``M``, ``QS-<MON>``/``Q-<MON>``,
    ``YS-<MON>``/``Y-<MON>`` (start / end of period).  Uses distinct stamps in time order."""
    stamps = long.where(F.col(TS).isNotNull()).select(SERIES, TS).distinct()
    seqd = with_seq(stamps.withColumn(TB, F.lit(0)), max_chunk=max_chunk)
    w = chunk_window()
    ts = F.col(TS)
    month_idx = (F.year(ts) * 12 + F.month(ts)).cast("bigint")
    d = lagged(seqd.withColumn("_mi", month_idx),
               {"_prev": F.lag(TS, 1).over(w), "_pmi": F.lag("_mi", 1).over(w)}, back=1, max_chunk=max_chunk)
    gap = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.col("_prev").cast("timestamp"))
    dow = F.dayofweek(ts)  # 1 = Sunday
    midnight = F.date_trunc("day", ts) == ts.cast("timestamp")
    g = d.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(gap).alias("dmin"), F.max(gap).alias("dmax"),
        F.min(F.col("_mi") - F.col("_pmi")).alias("mmin"), F.max(F.col("_mi") - F.col("_pmi")).alias("mmax"),
        F.min(F.when(midnight, 1).otherwise(0)).alias("all_midnight"),
        F.min(F.when(F.dayofmonth(ts) == 1, 1).otherwise(0)).alias("all_first"),
        F.min(F.when(F.to_date(ts) == F.last_day(ts), 1).otherwise(0)).alias("all_last"),
        F.min(F.when(dow.isin(1, 7), 0).otherwise(1)).alias("all_weekday"),
        F.max(F.when((gap == 3 * DAY) & (dow != 2), 1).otherwise(0)).alias("bad_gap3"),
        F.min(dow).alias("dow_min"), F.max(dow).alias("dow_max"),
        F.min(F.month(ts)).alias("mon_min"),
    )
    day, hour, minute, second = DAY, DAY // 24, DAY // 1440, DAY // 86400
    uniform = F.col("dmin") == F.col("dmax")
    step = F.col("dmin")  # microseconds
    wd = F.element_at(F.array(*[F.lit(x) for x in ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")]),
                      F.col("dow_min"))
    anchor_start = F.element_at(F.array(*[F.lit(m) for m in MONTHS]),
                                (((F.col("mon_min") - 1) % F.col("mmin")) + 1).cast("int"))
    anchor_end = F.element_at(F.array(*[F.lit(m) for m in MONTHS]),
                              (((F.col("mon_min") - 1) % F.col("mmin")) + 13 - F.col("mmin")).cast("int"))

    def mult(k: Column, unit: str) -> Column:
        k = k.cast("bigint")
        return F.when(k == 1, F.lit(unit)).otherwise(F.concat(k.cast("string"), F.lit(unit)))

    monthly = (F.col("mmin") == F.col("mmax")) & (F.col("all_midnight") == 1)
    freq = (
        F.when(F.col("n") < 3, F.lit(None))
        .when(uniform & (step == 7 * day) & (F.col("dow_min") == F.col("dow_max")), F.concat(F.lit("W-"), wd))
        .when(uniform & (step % day == 0), mult(step / day, "D"))
        .when(uniform & (step % hour == 0), mult(step / hour, "h"))
        .when(uniform & (step % minute == 0), mult(step / minute, "min"))
        .when(uniform & (step % second == 0), mult(step / second, "s"))
        .when(uniform & (step % 1000 == 0), mult(step / 1000, "ms"))
        .when(uniform, mult(step, "us"))
        .when((F.col("all_weekday") == 1) & (F.col("all_midnight") == 1) & (F.col("dmin") == day)
              & (F.col("dmax") == 3 * day) & (F.col("bad_gap3") == 0), F.lit("B"))
        .when(monthly & (F.col("mmin") == 1) & (F.col("all_first") == 1), F.lit("MS"))
        .when(monthly & (F.col("mmin") == 1) & (F.col("all_last") == 1), F.lit("M"))
        .when(monthly & (F.col("mmin") == 3) & (F.col("all_first") == 1), F.concat(F.lit("QS-"), anchor_start))
        .when(monthly & (F.col("mmin") == 3) & (F.col("all_last") == 1), F.concat(F.lit("Q-"), anchor_end))
        .when(monthly & (F.col("mmin") == 12) & (F.col("all_first") == 1), F.concat(F.lit("YS-"), anchor_start))
        .when(monthly & (F.col("mmin") == 12) & (F.col("all_last") == 1), F.concat(F.lit("Y-"), anchor_end))
    )
    return g.select(SERIES, freq.alias("freq"))


# ---------------------------------------------------------------- G5
def step_forward(last: Column, freq: Column, i: Column) -> Column:
    """The ``i``-th time stamp after ``last`` for a frequency code (NULL freq -> 'D')."""
    f = F.coalesce(freq, F.lit("D"))
    num = F.regexp_extract(f, r"^(\d*)", 1)
    k = F.when(num == "", F.lit(1)).otherwise(num.cast("bigint"))
    unit = F.regexp_replace(f, r"^\d+", "")
    i = i.cast("bigint")
    k = k.cast("bigint")
    d = last.cast("date")
    micros = F.unix_micros(last.cast("timestamp"))
    wd = F.dayofweek(last)  # 1 = Sunday
    wk = (wd + 5) % 7  # Monday = 0
    base = F.when(wk > 4, F.date_sub(d, (wk - 4).cast("int"))).otherwise(d)
    bday = F.date_add(base, (i + 2 * F.floor((F.least(wk, F.lit(4)) + i) / 5)).cast("int"))

    def plus_seconds(sec):
        return F.timestamp_micros(micros + sec * F.lit(1_000_000).cast("bigint"))

    return _ntz(
        F.when(unit == "D", plus_seconds(i * k * 86400))
        .when(unit == "h", plus_seconds(i * k * 3600))
        .when(unit == "min", plus_seconds(i * k * 60))
        .when(unit == "s", plus_seconds(i * k))
        .when(unit == "ms", F.timestamp_micros(micros + i * k * 1000))
        .when(unit == "us", F.timestamp_micros(micros + i * k))
        .when(unit.startswith("W-"), plus_seconds(i * 7 * 86400))
        .when(unit == "B", bday.cast("timestamp"))
        .when(unit == "MS", F.add_months(F.trunc(d, "month"), i).cast("timestamp"))
        .when(unit == "M", F.last_day(F.add_months(d, i)).cast("timestamp"))
        .when(unit.startswith("QS-"), F.add_months(F.trunc(d, "month"), i * 3).cast("timestamp"))
        .when(unit.startswith("Q-"), F.last_day(F.add_months(d, i * 3)).cast("timestamp"))
        .when(unit.startswith("YS-"), F.add_months(F.trunc(d, "month"), i * 12).cast("timestamp"))
        .when(unit.startswith("Y-"), F.last_day(F.add_months(d, i * 12)).cast("timestamp"))
        .otherwise(plus_seconds(i * 86400))
    )


def future_dates(last: DataFrame, horizon: int) -> DataFrame:
    """``last``: ``(series_id, last_ts, freq, n)`` -> ``(series_id, step, ts, seq)`` for steps 1..h.

    Integer-indexed series (``last_ts`` NULL) get ``ts`` NULL; ``seq`` = n + step - 1."""
    if horizon < 1:
        raise ValueError("horizon must be a positive integer")
    steps = last.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.select(
        SERIES, "step",
        F.when(F.col("last_ts").isNull(), F.lit(None).cast("timestamp_ntz"))
        .otherwise(step_forward(F.col("last_ts"), F.col("freq"), F.col("step"))).alias(TS),
        (F.col("n") + F.col("step") - 1).cast("bigint").alias(SEQ))


def regularize(clean: DataFrame, freq: str, max_chunk: int | None = None) -> DataFrame:
    """resample -> spine -> interpolate: a regular, gap-free long series with ``seq``."""
    r = resample_mean(clean, freq).drop("n")
    spined = calendar_spine(r, freq, max_chunk)
    first = bounded(spined.groupBy(SERIES).agg(F.min(TB).alias("_tb0")))
    seqd = spined.join(first, SERIES).withColumn(SEQ, F.col(TB) - F.col("_tb0")).drop("_tb0")
    return interpolate_linear(seqd, max_chunk)


def by_frequency(freq: Column, fn) -> Column:
    """``fn(code)`` for the code that the column ``freq`` holds, as one expression over all codes."""
    out = None
    for code in RESAMPLED:
        out = F.when(freq == code, fn(code)) if out is None else out.when(freq == code, fn(code))
    return out


def regularize_mixed(clean: DataFrame, codes: DataFrame, max_chunk: int | None = None) -> DataFrame:
    """:func:`regularize` with a frequency of its own for each series, ``codes(series_id, frequency)``:
    the calendar is data, so the plan is the same for any mixture."""
    rows = clean.where(F.col(TS).isNotNull()).join(codes, SERIES)
    index = by_frequency(F.col("frequency"), lambda f: _bucket_index(bucket_label(F.col(TS), f), f))
    means = rows.groupBy(SERIES, index.alias(TB)).agg(F.avg(VALUE).alias(VALUE))
    first = bounded(means.groupBy(SERIES).agg(F.min(TB).alias("_tb0")))
    spined = _spine(means.withColumn(TS, F.lit(None).cast("timestamp_ntz")), lambda i: F.lit(None).cast("timestamp_ntz"), max_chunk)
    seqd = spined.join(first, SERIES).withColumn(SEQ, F.col(TB) - F.col("_tb0")).drop("_tb0", TS).join(codes, SERIES)
    seqd = seqd.withColumn(TS, by_frequency(F.col("frequency"), lambda f: _label_of_index(F.col(TB), f))).drop("frequency")
    return interpolate_linear(seqd, max_chunk)
