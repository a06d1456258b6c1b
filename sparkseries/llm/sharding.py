"""Sharding by Karmarkar-Karp differencing: near-equal bytes, groups of equal texts never split.

A partial partition is a vector of ``ways`` bins with what has been put into each.  Differencing
starts with one partial partition per item (its size in one bin, nothing in the others) and
repeatedly combines the two of largest spread, one of them in opposite order, until one is left;
its bins are the shards.  Only differences matter, so the smallest bin is subtracted each time.

At scale the items are the groups (a row per distinct text, however many copies) and the rounds are:

1. Groups are dealt by a hash to chunks of about ``CHUNK`` (of fewer, where ``UNITS`` bins suffice).  Each chunk is differenced into as many
   bins as there are shards; its bins are the items of the next round.  Groups larger than
   total / ``UNITS`` (there are fewer than ``UNITS`` of them) do not enter a chunk: a spread that
   large must be answered by what other chunks hold.  Nor does a reserve of about ``UNITS`` groups,
   chosen by hash: bins are near-equal, and the last round needs small items to even out with.
2. This is repeated until at most ``UNITS`` bins are left.
3. The large groups, the reserve and the bins left, about 3 * ``UNITS`` at most, are differenced
   together in one task.  Their shards go back down the rounds by joins.

So no task differences more than a fixed number of items whatever the size of the table, and every
choice depends on sizes and hashes alone: reruns agree.  Rows get ``slot`` numbers, gapless in each
shard in ascending doc_id order, by range partitions.

Defined results: null text has size 1 (no bytes, plus 1), no crc, and is a group of its own, apart
from the empty text; rows that share a doc_id or are equal keep a row and a slot each; an empty
table gives an empty result; other columns are ignored (``write_shards`` keeps them).
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, number, small_side, table

SHARDS = 8
CHUNK = 4096
UNITS = 32_768


def difference(sizes: list[int], ways: int) -> list[int]:
    """The bin of each item by Karmarkar-Karp differencing into ``ways`` bins.

    Of equal spreads the earlier one goes first; bins are numbered from the largest sum down."""
    # a tree of merges: node k < n is item k; merge n + j joined nodes a and b, b's bins reversed
    tree: list[tuple[int, int, list[int]]] = []
    heap = [(-s, k, (s,) + (0,) * (ways - 1)) for k, s in enumerate(sizes)]  # bins from the largest down
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heap[0]
        sums = [p + q for p, q in zip(x, reversed(y))]
        order = sorted(range(ways), key=lambda i: -sums[i])
        least = sums[order[-1]]
        bins = tuple(sums[i] - least for i in order)
        heapq.heapreplace(heap, (-bins[0], len(sizes) + len(tree), bins))
        tree.append((a, b, order))
    out = [0] * len(sizes)
    if not heap:
        return out
    place = {heap[0][1]: list(range(ways))}  # node -> where its bins went
    for j in range(len(tree) - 1, -1, -1):
        own = place.pop(len(sizes) + j)
        a, b, order = tree[j]
        at = [0] * ways
        for rank, i in enumerate(order):
            at[i] = own[rank]
        place[a], place[b] = at, at[::-1]
    for k in range(len(sizes)):
        out[k] = place[k][0]
    return out


def _sorted_items(t) -> tuple[list, list, list]:
    """Names, sizes and kinds of the items, the largest first."""
    kinds = t.column("bin").to_pylist() if "bin" in t.column_names else [False] * t.num_rows
    rows = sorted(zip(t.column("item").to_pylist(), t.column("size").to_pylist(), kinds), key=lambda r: (-r[1], r[0]))
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def assign(items: DataFrame, ways: int = SHARDS, chunk: int = CHUNK, units: int = UNITS) -> DataFrame:
    """(item, shard) for ``items(item string, size long)``, one row per indivisible item."""
    def chunked(level):
        def run(key, t):
            name = key[0].as_py()
            ids, sizes, _ = _sorted_items(t)
            up = [f"{level}/{name}/{b}" for b in difference(sizes, ways)]
            return pa.table({"item": pa.array(ids, pa.string()), "size": pa.array(sizes, pa.int64()), "up": pa.array(up, pa.string())})
        return run

    items = materialize(items, "kk-items")
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = F.col("size") * units > total
    top, rest, links, level = items.where(large), items.where(~large), [], 0
    count = rest.count()
    if count > units:
        single = F.pmod(F.xxhash64(F.lit(-1), "item"), F.lit(-(-count // units))) == 0
        top, rest = top.unionByName(rest.where(single)), rest.where(~single)
        count = rest.count()
    while count > units:
        n = max(-(-count // chunk), units // ways)  # as many bins as the last task takes, for fine bins
        name = F.pmod(F.xxhash64(F.lit(level), "item"), F.lit(n)).alias("chunk")
        linked = materialize(rest.select("item", "size", name).groupBy("chunk")
                             .applyInArrow(chunked(level), "item string, size long, up string"), "kk-bins")
        links.append(linked.select("item", "up"))
        rest = materialize(linked.groupBy(F.col("up").alias("item")).agg(F.sum("size").alias("size")), "kk-items")
        count, level = rest.count(), level + 1

    def last(_, t):
        ids, sizes, bins = _sorted_items(t)
        return pa.table({"item": pa.array(ids, pa.string()), "shard": pa.array(difference(sizes, ways), pa.int32()), "bin": pa.array(bins, pa.bool_())})

    pool = top.withColumn("bin", F.lit(False)).unionByName(rest.withColumn("bin", F.lit(level > 0)))
    done = materialize(pool.groupBy(F.lit(0).alias("one")).applyInArrow(last, "item string, shard int, bin boolean"), "kk-shards")
    shards, bins = done.where("not bin").drop("bin"), done.where("bin").drop("bin")
    for linked in reversed(links):
        bins = materialize(linked.join(small_side(bins.withColumnRenamed("item", "u"), "kk-down"), F.col("up") == F.col("u"))
                           .select("item", "shard"), "kk-shards")
    return shards.unionByName(bins) if links else shards


def _group(text):
    """A name for the group of equal texts (null apart from the empty text)."""
    return F.coalesce(F.sha2(text, 256), F.lit("null"))


def plan(docs: DataFrame, shards: int = SHARDS, chunk: int = CHUNK, units: int = UNITS) -> DataFrame:
    """(doc_id, size, text_crc32, group, shard, slot) for every row of ``docs(doc_id, text)``."""
    rows = materialize(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), _group(F.col("text")).alias("group")), "kk-rows")
    groups = rows.groupBy(F.col("group").alias("item")).agg(F.sum("size").alias("size"))
    given = assign(groups, shards, chunk, units).withColumnRenamed("item", "g")
    placed = materialize(rows.join(given, F.col("group") == F.col("g")).drop("g"), "kk-placed")
    return number(placed, ["shard"], ["doc_id", "group"], "kk", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, column: str = "shard") -> None:
    """Write the rows of ``docs``, all columns, as Parquet below ``path``/``column``=K, in slot order."""
    if column in docs.columns:
        raise ValueError(f"documents have a column {column}; give the shard another name")
    given = materialize(plan(docs, shards).select(F.col("shard").alias(column), F.col("group").alias("__llm_g")).distinct(), "kk-given")
    rows = docs.withColumn("__llm_group", _group(F.col("text"))).join(given, F.col("__llm_group") == F.col("__llm_g"))
    order = (column, "doc_id", "__llm_group")
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__llm_group", "__llm_g")
     .write.partitionBy(column).parquet(path))


def op12_karmarkar_karp(spark, sf_dir) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
