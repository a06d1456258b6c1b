"""Mixing sources to target weights by entropy balancing.

Every document starts with rate 1.  Among all rates that give each source its target number of
words, entropy balancing takes those closest to 1 in relative entropy; the solution is an
exponential tilt in the document size,

    rate = min(max_copies, exp(lambda_source * size / scale_source)),

and lambda solves the convex dual of one token constraint per source.  The dual is solved by
safeguarded Newton steps: each is one grouped aggregate over the (source, size) counts, joined
with the current lambda of each source.  Rates become whole copies: every document gets
floor(rate), and one more where its deterministic priority (hash / fractional part, so the
chance is the fractional part) is below a cut that is moved until the source's words meet its
target; the cut is found from binned sums in two passes, never by sorting a source.

Everything is DataFrame code.  The only global orderings are over one row per source.

Defined results: null text and texts without words have size 0 and take 0 words (one copy is
kept); a null source is a source of its own, last in order; repeated rows are separate documents
(equal ones get equal copies); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, small_side, table

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BINS = 4096
TOLERANCE = 1e-7
MAX_STEPS = 60


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: (src, source, source_size, scale, target) from ``sizes(source, size)``.

    Sources in code-point order (null last) weigh ``weights`` repeating and share the sum of all
    sizes; no target exceeds ``max_copies`` times its source, the excess being reshared by weight.
    The reshared level is the largest of the levels reached after capping the sources in order of
    cap / weight (that sequence rises while sources are capped and falls after)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"),
                                      F.sum(F.col("size").cast("double") * F.col("size")).alias("sq"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    per = per.select("*", F.row_number().over(order).alias("src"))
    per = per.select("*", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                       (F.col("src") - 1) % len(weights) + 1).alias("weight"),
                     (F.col("source_size") * float(max_copies)).alias("cap"))
    every = Window.partitionBy()
    before = (Window.orderBy(F.col("cap") / F.col("weight"), "src")
              .rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0.0)
    per = per.select(
        "*", F.sum("source_size").over(every).alias("total"), F.sum("weight").over(every).alias("weights"),
        F.coalesce(F.sum("cap").over(before), zero).alias("capped"),
        F.coalesce(F.sum("weight").over(before), zero).alias("gone"))
    per = per.select("*", ((F.col("total") - F.col("capped")) / (F.col("weights") - F.col("gone"))).alias("level"))
    per = per.select("*", F.max("level").over(every).alias("top"))
    return per.select("src", "source", "source_size",
                      F.when(F.col("source_size") > 0, F.col("sq") / F.col("source_size"))
                      .otherwise(1.0).alias("scale"),
                      F.least("cap", F.col("top") * F.col("weight")).alias("target"))


def _rate(lam, z, max_copies):
    return F.least(F.lit(float(max_copies)), F.exp(F.least(lam * z, F.lit(50.0))))


def solve_dual(counts: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """Newton on the dual: ``counts(src, size, n)`` and ``targets(src, source_size, scale, target)``
    -> (src, scale, target, lam).  A step that leaves the bracket is replaced by its middle."""
    ratio = F.col("target") / F.col("source_size")
    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    state = targets.where(live).select(
        "src", "scale", "target", F.log(ratio).alias("lam"),
        (F.col("scale") * F.least(F.lit(0.0), F.log(ratio)) - 1e-9).alias("lo"),
        (F.col("scale") * math.log(max_copies) + 1e-9).alias("hi"), F.lit(1.0).alias("gap"))
    state = materialize(state, "mix-dual")
    counts = counts.where("size > 0")
    for _ in range(MAX_STEPS):
        w = _rate(F.col("lam"), F.col("size") / F.col("scale"), max_copies)
        mass = F.col("n") * F.col("size") * w
        slope = F.when(w < max_copies, mass * F.col("size") / F.col("scale")).otherwise(0.0)
        step = (counts.join(state, "src").groupBy("src")
                .agg(F.sum(mass).alias("mass"), F.sum(slope).alias("slope")))
        g = F.col("mass") - F.col("target")
        nxt = state.join(step, "src").select(
            "src", "scale", "target", "lam", "slope", g.alias("g"), F.abs(g / F.col("target")).alias("gap"),
            F.when(g <= 0, F.col("lam")).otherwise(F.col("lo")).alias("lo"),
            F.when(g >= 0, F.col("lam")).otherwise(F.col("hi")).alias("hi"))
        # in the logarithm of the mass, which is nearly straight in lambda
        newton = (F.col("lam") - F.log1p(F.col("g") / F.col("target")) * (F.col("g") + F.col("target"))
                  / F.nullif(F.col("slope"), F.lit(0.0)))
        nxt = nxt.select("src", "scale", "target",
                         F.when(F.col("gap") <= TOLERANCE, F.col("lam"))
                         .when((newton > F.col("lo")) & (newton < F.col("hi")), newton)
                         .otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"), "lo", "hi", "gap")
        state = materialize(nxt, "mix-dual")
        if state.where(F.col("gap") > TOLERANCE).isEmpty():
            break
    return state.select("src", "scale", "target", "lam")


def _cut(rows: DataFrame, need: DataFrame) -> DataFrame:
    """``rows(src, bin, size)`` with ``need(src, room)``: per source the last bin whose running
    sum still fits (``bin``), and the room left after it."""
    sums = rows.groupBy("src", "bin").agg(F.sum("size").alias("s"))
    run = Window.partitionBy("src").orderBy("bin")
    sums = sums.select("src", "bin", F.sum("s").over(run).alias("run"))
    fit = (sums.join(need, "src").where(F.col("run") <= F.col("room"))
           .groupBy("src").agg(F.max("bin").alias("bin"), F.max("run").alias("run")))
    return (need.join(fit, "src", "left")
            .select("src", F.coalesce("bin", F.lit(-1)).cast("long").alias("bin"),
                    (F.col("room") - F.coalesce("run", F.lit(0))).alias("room")))


def mix(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 9) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, rate, copies, taken) for every row of
    ``docs(doc_id, text, source)``; ``key`` is a hash of id and text that finds a row again."""
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    sized = materialize(docs.select("doc_id", key.alias("key"), "source", word_count(F.col("text")).alias("size")),
                        "mix-sizes")
    targets = small_side(source_targets(sized, weights, max_copies), "mix-targets")
    t = targets.withColumnRenamed("source", "t_source")
    rows = sized.join(t, sized["source"].eqNullSafe(t["t_source"]), "left").drop("t_source")
    counts = materialize(rows.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    lam = small_side(solve_dual(counts, targets, max_copies).select("src", "lam"), "mix-lambda")
    rate = F.when(F.col("size") == 0, 1.0).otherwise(
        F.coalesce(_rate(F.col("lam"), F.col("size") / F.col("scale"), max_copies), F.lit(0.0)))
    base = F.least(F.floor("rate"), F.lit(max_copies)).cast("long")
    u = (F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "key"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rows = rows.join(lam, "src", "left").select("*", rate.alias("rate"))
    rows = rows.select("*", base.alias("base"), (F.col("rate") - base).alias("frac"))
    # priorities up to 4: below 1 for an expected extra copy, above for the moved cut
    p = F.when((F.col("frac") > 1e-12) & (F.col("size") > 0), F.least(u / F.col("frac"), F.lit(3.999999)) / 4 * BINS)
    rows = rows.select("*", p.alias("p"))
    rows = materialize(rows, "mix-rates")
    rows = rows.select("*", F.floor("p").alias("bin"), F.floor((F.col("p") - F.floor("p")) * BINS).alias("sub"))
    need = rows.groupBy("src").agg(
        (F.max("target") - F.sum(F.col("base") * F.col("size"))).alias("room"))
    first = small_side(_cut(rows.where("bin is not null").select("src", "bin", "size"), need), "mix-cut")
    edge = first.select("src", (F.col("bin") + 1).alias("edge"), "room")
    inside = rows.join(edge, "src").where("bin = edge").select("src", F.col("sub").alias("bin"), "size")
    second = _cut(inside, edge.select("src", "room"))
    # the next group of documents is taken as well where that comes nearer to the target
    nxt = (rows.join(edge, "src").where("bin = edge").join(second.select("src", F.col("bin").alias("last"), F.col("room").alias("left_over")), "src")
           .where("sub > last").groupBy("src", "sub", "left_over").agg(F.sum("size").alias("s")))
    nxt = (nxt.groupBy("src").agg(F.min(F.struct("sub", "s", "left_over")).alias("m"))
           .where((F.col("m.s") - F.col("m.left_over")) < F.col("m.left_over"))
           .select("src", F.col("m.sub").alias("extra")))
    cuts = small_side(edge.join(second.select("src", F.col("bin").alias("last")), "src").join(nxt, "src", "left")
                      .select("src", "edge", F.coalesce("extra", "last").alias("last")), "mix-cuts")
    more = F.coalesce((F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & (F.col("sub") <= F.col("last"))),
                      F.lit(False))
    copies = F.least(F.col("base") + more.cast("long"), F.lit(max_copies)).cast("long")
    return (rows.join(cuts, "src", "left")
            .select("doc_id", "key", "source", "size", "source_size", "target", "rate", copies.alias("copies"))
            .select("*", (F.col("copies") * F.col("size")).alias("taken")))


def op9_entropy_mixing(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def stage_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (none for 0 copies)."""
    plan = mix(docs).groupBy("doc_id", "key").agg(F.max("copies").alias("__llm_copies"))
    key = F.xxhash64(F.lit(9), "doc_id", "text")
    rows = docs.withColumn("__llm_key", key).alias("d")
    plan = plan.select(F.col("doc_id").alias("__llm_id"), F.col("key").alias("__llm_key2"), "__llm_copies")
    joined = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_key") == F.col("__llm_key2")))
    return (joined.where("__llm_copies > 0")
            .withColumn("__llm_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__llm_copies"))))
            .select(*docs.columns))
