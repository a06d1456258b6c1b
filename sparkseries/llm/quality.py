"""Quality rules judged by an isolation forest over rule statistics.

One pass over the texts gives each document its rule statistics.  Repeated lines and words are
judged by the base rule; the forest reads symbols, capitals, other signs and word length (rates
smoothed by a fixed prior).  An isolation tree (random axis splits of ``TREE_ROWS`` rows; a row
that is isolated in few splits is anomalous) loses its power when it is grown from many more rows,
so the table is dealt by a hash into groups of at most about ``FOREST_ROWS`` (trees x rows per tree)
documents that pass the base rule.  Every group grows a forest in which each of these documents
enters a tree, every document gets the mean path length over the trees of its group, and the score
above which a document is rejected is calibrated from all labelled rows of all groups.

Defined results: null and empty texts have all counts 0 and are rejected by the base rule
(fewer than 50 words); no labelled rows, or labels of one kind only: only the base rule rejects;
repeated rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_PATTERN, materialize, table

TREES = 128
TREE_ROWS = 256
FOREST_ROWS = TREES * TREE_ROWS
GROUP_ROWS = 500_000  # rows of a group, those that fail the base rule included
SCORE_BINS = 2000
MAX_GOOD_REJECTED = 0.003

WORD = re.compile(WORD_PATTERN)
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\v\f\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["f_symbols", "f_upper", "f_other", "f_word_len"]
PRIOR_WORDS, PRIOR_CHARS = 30, 150  # smoothing, so that short texts are not extreme by chance


def rule_stats(text: str | None) -> tuple:
    """The five counts and the ratios that the forest reads."""
    if not text:
        return (0, 0, 0, 0, 0) + (0.0,) * len(FEATURES)
    words = WORD.findall(text)
    n = len(words)
    chars = len("".join(words))
    symbols = sum(map(text.count, SYMBOLS))
    dup, lines = 0, text.split("\n")
    if len(lines) > 1:
        seen = set()
        for line in lines:
            if line.strip(BLANK):
                if line in seen:
                    dup += 1
                seen.add(line)
    repeat = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            until = 0  # words before this position are counted already
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeat += i + 3 - max(i, until)
                    until = i + 3
    letters = len(_NOT_LETTER.sub("", text))
    upper = len(_NOT_UPPER.sub("", text))
    return (n, chars, symbols, dup, repeat,
            symbols / (n + PRIOR_WORDS), upper / (letters + PRIOR_CHARS),
            (chars - letters) / (chars + PRIOR_CHARS), (chars + PRIOR_CHARS) / (n + PRIOR_WORDS))


_NOT_LETTER = re.compile(r"[\W\d_]+")
_NOT_UPPER = re.compile(r"[^A-ZÀ-ÖØ-Þ]+")


def with_stats(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, more..., counts..., ratios...) per row of ``docs(doc_id, more..., text)``."""
    kept = ["doc_id", *more]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in kept]
                          + [T.StructField(c, T.LongType()) for c in COUNTS]
                          + [T.StructField(c, T.DoubleType()) for c in FEATURES])

    def run(batches):
        for b in batches:
            rows = list(zip(*map(rule_stats, b.column(len(kept)).to_pylist())))
            if rows:
                cols = [pa.array(r, pa.int64() if i < len(COUNTS) else pa.float64()) for i, r in enumerate(rows)]
                yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], *cols], names=[*kept, *COUNTS, *FEATURES])

    return docs.select(*kept, "text").mapInArrow(run, schema)


def _path_norm(n) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow_forest(sample: np.ndarray, enter: np.ndarray | None = None, seed: int = 3) -> list[tuple]:
    """Trees as flat arrays (feature, split, left, path length); ``left + 1`` is the right child.
    Each row enters a tree: beyond ``FOREST_ROWS`` rows the trees are larger, below them rows enter several.  ``enter``: how many times each row counts."""
    if enter is not None:
        sample = np.repeat(sample, enter, axis=0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    per = min(max(TREE_ROWS, -(-len(sample) // TREES)), len(sample))
    trees = []
    for t in range(TREES if per >= 2 else 0):
        rows = sample[order[np.arange(t * per, (t + 1) * per) % len(sample)]]
        limit = math.ceil(math.log2(per))
        feat, split, left, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            at, x, depth = todo.pop()
            spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) else []
            if depth >= limit or len(x) <= 1 or not len(spread):
                path[at] = depth + _path_norm(len(x))
                continue
            f = int(rng.choice(spread))
            s = rng.uniform(x[:, f].min(), x[:, f].max())
            go = x[:, f] < s
            feat[at], split[at], left[at] = f, s, len(feat)
            for part in (x[go], x[~go]):
                todo.append((len(feat), part, depth + 1))
                feat.append(-1)
                split.append(0.0)
                left.append(0)
                path.append(0.0)
        trees.append((np.array(feat), np.array(split), np.array(left), np.array(path), limit))
    return trees


def forest_score(trees, x: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / normal path): near 1 for rows isolated early."""
    if not trees:
        return np.zeros(len(x))
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feat, split, left, path, limit in trees:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(limit):
            f = feat[at]
            inner = f >= 0
            at = np.where(inner, left[at] + (x[rows, np.where(inner, f, 0)] >= split[at]), at)
        total += path[at]
    return 2.0 ** (-(total / len(trees)) / _path_norm(TREE_ROWS))


def calibrate(bins: dict) -> float:
    """Score cut from ``{bin: (bad, good)}``: among the cuts that reject at most
    ``MAX_GOOD_REJECTED`` of the good rows, the one with the best balance of rejected bad rows
    less ten times the rejected good rows."""
    bad = sum(b for b, _ in bins.values())
    good = sum(g for _, g in bins.values())
    best, cut, b_run, g_run = 0.0, 2.0, 0, 0
    if not bad or not good:
        return cut
    for k in sorted(bins, reverse=True):
        b_run, g_run = b_run + bins[k][0], g_run + bins[k][1]
        if g_run > MAX_GOOD_REJECTED * good:
            break
        gain = b_run / bad - 10 * g_run / good
        if gain > best:
            best, cut = gain, k / SCORE_BINS
    return cut


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def n_groups(rows: int, judged: int) -> int:
    """Groups that hold less than ``FOREST_ROWS`` documents to judge, by a margin for uneven hashes."""
    return max(-(-judged // (FOREST_ROWS - FOREST_ROWS // 32)) if judged > FOREST_ROWS else 1, -(-rows // GROUP_ROWS), 1)


def with_score(stats: DataFrame) -> DataFrame:
    """``stats`` with ``base_failed`` and ``score``, one row for each of its rows."""
    rows, judged = stats.agg(F.count(F.lit(1)), F.count_if(~base_failed())).first()
    groups = n_groups(rows, judged)
    h = F.xxhash64(F.lit(3), "doc_id", *FEATURES)
    # equal rows, however many, are one row of their group
    dealt = (stats.groupBy(*stats.columns).agg(F.count(F.lit(1)).alias("__llm_n"))
             .select("*", base_failed().alias("base_failed"), h.alias("__llm_h"),
                     F.pmod(F.xxhash64(F.lit(5), "doc_id", *FEATURES), F.lit(groups)).alias("__llm_group")))
    out = T.StructType([*dealt.schema.fields[:-2], T.StructField("score", T.DoubleType())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("__llm_h", "ascending"), *((c, "ascending") for c in FEATURES)])
        x = np.column_stack([t[c].to_numpy() for c in FEATURES])
        enter = np.where(t["base_failed"].to_numpy(), 0, t["__llm_n"].to_numpy())
        score = forest_score(grow_forest(x, enter), x)
        return t.select([f.name for f in out.fields[:-1]]).append_column("score", pa.array(score))

    scored = dealt.groupBy("__llm_group").applyInArrow(run, out)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__llm_n")))
    return scored.withColumn("__llm_n", each).drop("__llm_n")


def score_cut(scored: DataFrame, labels: DataFrame) -> float:
    """The score from which on documents are rejected, by all rows with ``labels(doc_id, quality)``."""
    kinds = (labels.where("quality is not null and doc_id is not null")
             .groupBy("doc_id").agg(F.max("quality").alias("__quality")))
    binned = (scored.where("not base_failed").join(kinds, "doc_id")
              .select("__quality", F.floor(F.col("score") * SCORE_BINS).alias("bin"))
              .groupBy("bin").agg(F.sum((F.col("__quality") == 0).cast("long")).alias("bad"),
                                  F.sum((F.col("__quality") == 1).cast("long")).alias("good")))
    return calibrate({r["bin"]: (r["bad"], r["good"]) for r in binned.collect()})


def judge(docs: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """(doc_id, more..., counts, base_failed, kept, score) per document."""
    scored = materialize(with_score(materialize(with_stats(docs, *more), "quality-stats")), "quality-scores")
    cut = score_cut(scored, labels)
    return scored.select("doc_id", *more, *COUNTS, "base_failed",
                         (~F.col("base_failed") & (F.col("score") < cut)).alias("kept"), "score")


def op3_quality_rules(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, found again by their id and a hash of id and text."""
    keyed = docs.withColumn("__llm_key", F.xxhash64(F.lit(3), "doc_id", "text"))
    kept = (judge(keyed, table(spark, sf_dir, "labels"), "__llm_key").where("kept")
            .select(F.col("doc_id").alias("__llm_id"), F.col("__llm_key").alias("__llm_key2")))
    same = F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_key") == F.col("__llm_key2"))
    return keyed.join(kept, same, "left_semi").select(*docs.columns)
