"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back: cuts the
    lineage, survives lost executors and fixes the rows for every later use."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, name: str, max_rows: int = 500_000, max_bytes: int = 32 << 20) -> DataFrame:
    """Write ``df`` and hint a broadcast only if its rows and the bytes of its texts are within
    the bounds; beyond them the join stays a shuffle join that adaptive execution can split."""
    out = materialize(df, name)
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema
             if f.dataType.typeName() in ("string", "binary")]
    rows, size = out.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(texts, F.lit(0).cast("long"))), F.lit(0))).first()
    return F.broadcast(out) if rows <= max_rows and size <= max_bytes else out


def crc_mod(doc_id, n: int):
    """crc32 of the decimal text of ``doc_id``, modulo ``n`` (folds of the labelled rows)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of the UTF-8 bytes of ``text``: one shift a bit, a byte entering
    at the first of its eight bits."""
    raw = f"encode({text})"
    each = f"('0x' || substr(hex({raw}), (2 * b + 1)::INTEGER, 2))::BIGINT"
    bits = f"flatten(list_transform(range(octet_length({raw})), lambda b: [{each}, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({bits}, lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384), 4294967295), 4294967295)"


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows (id, component) for every id that
    reaches a smaller one; component is the smallest id reachable (which has no row itself).

    Alternating large-star / small-star rounds.  Each round is a grouped minimum (combined on
    the map side) and a join back that adaptive execution splits where a hub is hot; the edge
    list is written between the rounds and the loop ends when a round changes nothing."""
    def fingerprint(e):
        h = F.xxhash64("a", "b").cast("decimal(38,0)")
        return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)"))).first())

    cur = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where("a <> b").distinct(), "edges")
    mark = fingerprint(cur)
    if mark[0] == 0:
        return cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(low, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low2.select("a", F.col("m").alias("b")))
                 .where("a <> b").distinct())
        cur = materialize(small, "edges")
        now = fingerprint(cur)
        if now == mark:
            return cur.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
        mark = now
    raise RuntimeError("connected components did not settle")


def number(rows: DataFrame, groups: list[str], order: list[str], name: str, pos: str = "__llm_pos") -> DataFrame:
    """``rows`` with ``pos``: their place from 0 in each group, in ascending order (nulls first;
    without groups, in the whole table).  ``rows`` must be written or read, not computed.

    Rows are dealt by ranges of (groups, order, place in the input), so neither a hot group nor a
    run of equal rows meets in one task; each range is sorted alone and written, and one row per
    (range, group) carries the number of rows before it."""
    dealt = (rows.withColumn("__llm_row", F.monotonically_increasing_id())
             .repartitionByRange(*groups, *order, "__llm_row").sortWithinPartitions(*groups, *order, "__llm_row")
             .drop("__llm_row").withColumn("__llm_at", F.monotonically_increasing_id()))
    dealt = materialize(dealt, f"{name}-ranges").withColumn("__llm_part", F.shiftright("__llm_at", 33))
    own = [F.col(g).alias(f"__llm_g{i}") for i, g in enumerate(groups)]
    keys = [f"__llm_g{i}" for i in range(len(groups))]
    per = dealt.groupBy(F.col("__llm_part").alias("__llm_p"), *own).agg(
        F.count(F.lit(1)).alias("__llm_n"), F.min("__llm_at").alias("__llm_first"))
    before = Window.partitionBy(*keys).orderBy("__llm_p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__llm_p", *keys, (F.coalesce(F.sum("__llm_n").over(before), F.lit(0)) - F.col("__llm_first")).alias("__llm_shift"))
    on = F.col("__llm_part") == F.col("__llm_p")
    for g, k in zip(groups, keys):
        on = on & F.col(g).eqNullSafe(F.col(k))
    return dealt.join(small_side(per, f"{name}-counts"), on).select(*rows.columns, (F.col("__llm_at") + F.col("__llm_shift")).alias(pos))
