"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

Vectors are scaled to length 1 and turned by one random orthogonal matrix, so any leading block of
columns estimates a whole distance.  A coarse quantiser (k-means on a bounded sample) deals all
vectors into lists; a query scans the lists of its nearest centroids.  Inside a list the columns
are read in blocks: after each block a hypothesis test compares the scaled partial distance with
the distance of the worst neighbour kept so far and abandons the candidates that are too far with
high confidence; only survivors read the next block.  Survivors of all blocks are measured
exactly, in double precision on the original vectors.

Index bounds: ``SAMPLE`` vectors (by hash) train at most ``MAX_LISTS`` centroids; every vector is
indexed.  Equal vectors are one entry with their smallest ids (one more than are asked for), found
by a grouped limit over distinct ids.  Lists are cut into blocks of ``BLOCK`` vectors
and their queries into blocks of ``QUERY_BLOCK``, so a hot list spreads over tasks.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; ties go to the smaller id; repeated ids count once; a query
with fewer than k candidates in its lists gets those; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side, table

SAMPLE = 40_000
MAX_LISTS = 1024
TARGET = 0.97  # share of the true neighbours of sampled queries whose lists are scanned
TRIALS = 200
MIN_PROBES = 8
BLOCK = 8192
QUERY_BLOCK = 2048
COLUMNS = 16
EPS = 2.1  # strictness of the test, in units of 1 / sqrt(columns read)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(good, F.lit(False)))


def centroids(rows: np.ndarray, n_lists: int, seed: int = 1, steps: int = 12) -> np.ndarray:
    """Spherical k-means; empty lists take a random row."""
    rng = np.random.default_rng(seed)
    c = rows[rng.choice(len(rows), n_lists, replace=False)]
    for _ in range(steps):
        own = (rows @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, rows)
        norm = np.linalg.norm(total, axis=1)
        empty = norm < 1e-12
        total[empty] = rows[rng.choice(len(rows), int(empty.sum()))]
        c = total / np.linalg.norm(total, axis=1, keepdims=True)
    return c


def probes_needed(rows: np.ndarray, center: np.ndarray, k: int, seed: int = 1) -> int:
    """How many of its nearest lists a query has to scan: for sampled queries, the exact
    neighbours within the sample are looked up and the places of their lists counted."""
    own = (rows @ center.T).argmax(axis=1)
    picked = np.random.default_rng(seed).choice(len(rows), min(TRIALS, len(rows)), replace=False)
    near = rows[picked] @ rows.T
    near[np.arange(len(picked)), picked] = -np.inf
    best = np.argsort(-near, axis=1)[:, :k]
    order = np.argsort(np.argsort(-(rows[picked] @ center.T), axis=1), axis=1)
    place = np.take_along_axis(order, own[best], axis=1)
    return int(np.quantile(place, TARGET)) + 1


def adaptive_scan(query: np.ndarray, turned: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``turned`` that can be among the k nearest to ``query`` (both turned, length 1)."""
    n, dims = turned.shape
    first = min(n, 4 * k)
    d = ((turned[:first] - query) ** 2).sum(axis=1)
    kept = np.arange(first)
    worst = np.partition(d, k - 1)[k - 1] if first >= k else np.inf
    for at in range(first, n, 1024):  # the bound gets tighter from batch to batch
        alive = np.arange(at, min(at + 1024, n))
        part = np.zeros(len(alive))
        for lo in range(0, dims, COLUMNS):
            hi = min(lo + COLUMNS, dims)
            part += ((turned[alive, lo:hi] - query[lo:hi]) ** 2).sum(axis=1)
            bound = worst * (hi / dims) * (1 + EPS / np.sqrt(hi)) ** 2 if hi < dims else worst
            stay = part <= bound
            alive, part = alive[stay], part[stay]
            if not len(alive):
                break
        if len(alive):
            kept, d = np.concatenate([kept, alive]), np.concatenate([d, part])
            if len(d) >= k:
                worst = np.partition(d, k - 1)[k - 1]
    return kept[d <= worst * (1 + 1e-6) + 1e-9]


def nearest(vectors: DataFrame, is_query, k: int = 5, seed: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine found for each row of
    ``vectors(vec_id, embedding)`` for which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return empty
    dims, total = size["d"], size["count"]
    rows = rows.where(F.size("v") == dims).select("*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.reverse("v")).alias("h2"))
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = rows.dropDuplicates(["h1", "h2", "vec_id"]).withColumn("nth", nth).where(F.col("nth") <= k + 1)
    entries = materialize(few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids")), "ann-entries")
    share = int((1 << 30) * min(1.0, SAMPLE / max(total, 1)))
    sample = [r[0] for r in entries.where(F.pmod(F.col("h1"), F.lit(1 << 30)) < share).select("v").orderBy("v").limit(2 * SAMPLE).collect()]
    if not sample:
        sample = [r[0] for r in entries.select("v").limit(1).collect()]
    x = np.array(sample)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n_lists = int(max(1, min(MAX_LISTS, len(x), round(np.sqrt(total)))))
    center = centroids(x, n_lists, seed)
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]
    probes = min(n_lists, max(MIN_PROBES, probes_needed(x, center, k, seed)))
    model = spark.sparkContext.broadcast((center, turn))

    def lists(count):
        def run(batches):
            c, _ = model.value
            for b in batches:
                if not b.num_rows:
                    continue
                v = b.column(0).flatten().to_numpy().reshape(b.num_rows, dims)
                near = (v @ c.T) if count > 1 else None
                best = np.argpartition(-near, count - 1, axis=1)[:, :count] if count > 1 else (v @ c.T).argmax(axis=1)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, count, dtype=np.int32)),
                                                          pa.array(best.ravel().astype(np.int32)))],
                    names=[*b.schema.names, "lists"])
        return run

    base = "v array<double>, h1 long, h2 long"
    placed = materialize(entries.select("v", "h1", "h2", "ids").mapInArrow(lists(1), base + ", ids array<long>, lists array<int>")
                         .select("v", "h1", "ids", F.col("lists")[0].alias("list")), "ann-placed")
    asked = rows.where(is_query).select("vec_id", "h1", "h2")
    questions = entries.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    probed = (questions.select("v", "h1", "h2").mapInArrow(lists(probes), base + ", lists array<int>")
              .select("v", "h1", "h2", F.explode("lists").alias("list")))
    probed = materialize(probed, "ann-probed")
    cuts = (placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
            .join(probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("q_blocks")), "list"))
    cuts = small_side(cuts, "ann-cuts")  # one row per list
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = (probed.join(cuts, "list").withColumn("qb", F.pmod(F.col("h1"), F.col("q_blocks")).cast("int"))
            .withColumn("xb", spread(F.col("blocks"))).select("list", "xb", "qb", "v", "h1", "h2"))
    right = (placed.join(cuts, "list").withColumn("xb", F.pmod(F.col("h1"), F.col("blocks")).cast("int"))
             .withColumn("qb", spread(F.col("q_blocks"))).select("list", "xb", "qb", "v", "ids"))

    def scan(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"h1": [], "h2": [], "score": [], "ids": []})
        _, r = model.value
        qv, cv = np.stack(q["v"].to_numpy()), np.stack(c["v"].to_numpy())
        qn, cn = np.sqrt((qv ** 2).sum(axis=1)), np.sqrt((cv ** 2).sum(axis=1))
        turned = (cv / cn[:, None]) @ r
        ids, low = c["ids"].to_numpy(), np.array([i[0] for i in c["ids"]])
        out = {"h1": [], "h2": [], "score": [], "ids": []}
        for i, (h1, h2) in enumerate(zip(q["h1"], q["h2"])):
            near = adaptive_scan((qv[i] / qn[i]) @ r, turned, k + 1)
            s = (cv[near] * qv[i]).sum(axis=1) / (cn[near] * qn[i])
            for j in np.lexsort((low[near], -s))[:k + 1]:
                out["h1"].append(h1)
                out["h2"].append(h2)
                out["score"].append(s[j])
                out["ids"].append(ids[near[j]])
        return pd.DataFrame(out)

    by = ["list", "xb", "qb"]
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(scan, "h1 long, h2 long, score double, ids array<long>")
    best = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), F.col("ids")[0]))
    hits = materialize(hits.withColumn("nth", best).where(F.col("nth") <= k + 1).drop("nth"), "ann-hits")
    pairs = (asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(hits, ["h1", "h2"])
             .select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").distinct())
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_adaptive_scan(spark, sf_dir) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
