"""Suffix-array dedup: passages of ``MIN_WORDS`` or more words that occur twice, by a sparse
suffix array.

1. Every stretch of ``W + K - 1`` words selects one of its words: where the smallest hash of K
   words begins (the minimiser).  Equal stretches select the same place whatever stands around
   them, so only suffixes at selected places are kept, about 2 / (W + 1) of all.
2. A window of MIN_WORDS words that begins at p belongs to the suffix m(p) selected by its first
   W + K - 1 words; at least ``RIGHT = MIN_WORDS - W + 1`` words to the right of m(p) lie inside
   the window.  Sorting the suffixes by (the fingerprint of) their first RIGHT words makes
   suffixes that can belong to equal windows neighbours; a suffix without a neighbour leaves.
3. Neighbours are compared by a second fingerprint, of the whole stretch that their windows cover
   to the left and right.  Where all of a class agree, all their windows are repeated.
4. Where they differ, the match of one member of each different stretch is extended left and
   right: its windows, one by one, are compared with those of its neighbours.

So every repeated window is found, copies are counted by grouped sums (map-side combine) and one
representative is extended for any number of equal stretches; pairs are never listed.  Windows
that overlap or touch are joined to maximal spans.  Fingerprints are 64-bit hashes.

Defined results: null text and texts of fewer than MIN_WORDS words have no windows and no rows;
a passage repeated within one text counts; rows that are equal in id and text repeat each other;
spans are given in words (``[^\\x20\\x09-\\x0D]+``); ``is_copy`` says that some window of the span
occurs earlier in order of (doc_id, place); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .ngram_join import WordHashes, _mix

MIN_WORDS = 50
K = 6
W = 34
RIGHT = MIN_WORDS - W + 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Prints:
    """Fingerprints of word ranges of one text, from prefix sums of a polynomial hash."""

    def __init__(self, text: str | None, cache: WordHashes):
        words = text.encode().split() if text else []
        self.n = len(words)
        w = _mix(np.fromiter(map(cache.__getitem__, words), np.uint64, self.n))
        power = np.full(self.n + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.inverse = np.full(self.n + 1, _INV, np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * power[:-1], dtype=np.uint64)])

    def of(self, start, end) -> np.ndarray:
        """Hashes of the words [start, end)."""
        length = (np.asarray(end) - np.asarray(start)).astype(np.uint64)
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + length * _BASE)

    def suffixes(self):
        """(place m, first window, last window) of each selected suffix."""
        count = self.n - MIN_WORDS + 1
        if count <= 0:
            e = np.zeros(0, np.int64)
            return e, e, e
        starts = np.arange(count + W - 1)
        h = self.of(starts, starts + K)
        m = np.arange(count) + sliding_window_view(h, W).argmin(axis=1)
        first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        last = np.concatenate([first[1:] - 1, [count - 1]])
        return m[first], first, last


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def sparse_suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, at, rk, sk) for each kept suffix; ``at`` packs (first window, m - first, last - first)."""
    def run(batches):
        cache = WordHashes()
        for b in batches:
            rows, cols = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                p = Prints(text, cache)
                m, lo, hi = p.suffixes()
                if len(m):
                    rows.append(np.full(len(m), i))
                    cols.append((lo << 16 | (m - lo) << 8 | (hi - lo), p.of(m, m + RIGHT),
                                 p.of(lo, hi + MIN_WORDS) * _BASE + (m - lo).astype(np.uint64)))
            if rows:
                at, rk, sk = (np.concatenate(c) for c in zip(*cols))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.concatenate(rows))), pa.array(at, pa.int64()), _signed(rk), _signed(sk)],
                    names=["doc_id", "at", "rk", "sk"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, at long, rk long, sk long")


def _windows(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(rk, sk, off, print, n, doc_id, p): the windows of one member of each stretch."""
    wanted = reps.groupBy(F.col("doc_id").alias("d2")).agg(F.collect_list(F.struct("at", "rk", "sk", "n")).alias("want"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("d2")))

    def run(batches):
        cache = WordHashes()
        for b in batches:
            out = []
            for doc, text, want in zip(*(b.column(i).to_pylist() for i in range(3))):
                p = Prints(text, cache)
                for x in want:
                    lo, left, more = x["at"] >> 16, x["at"] >> 8 & 0xFF, x["at"] & 0xFF
                    if lo + more + MIN_WORDS > p.n or int(p.of(lo + left, lo + left + RIGHT).view(np.int64)) != x["rk"]:
                        continue  # another text of the same id
                    ps = np.arange(lo, lo + more + 1)
                    k = len(ps)
                    out.append((np.full(k, x["rk"]), np.full(k, x["sk"]), ps - lo, p.of(ps, ps + MIN_WORDS).view(np.int64),
                                np.full(k, x["n"]), np.full(k, -1 if doc is None else doc), ps))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)],
                                                 names=["rk", "sk", "off", "print", "n", "doc_id", "p"])

    return rows.select("doc_id", "text", "want").mapInArrow(
        run, "rk long, sk long, off long, print long, n long, doc_id long, p long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, is_copy): maximal spans of repeated windows."""
    all_rows = materialize(sparse_suffixes(docs), "suffixes")
    classes = (all_rows.groupBy("rk").agg(F.count(F.lit(1)).alias("n"), F.min("sk").alias("lo"), F.max("sk").alias("hi"))
               .where("n > 1").select("rk", (F.col("lo") != F.col("hi")).alias("mixed")))
    # grouped sides are written first: a join that reads both sides from shuffles of their own can
    # be split where a class is hot
    shared = materialize(all_rows.join(materialize(classes, "suffix-classes"), "rk"), "suffix-shared")
    groups = shared.groupBy("rk", "sk", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "at")).alias("rep"))
    groups = materialize(groups.select("rk", "sk", "mixed", "n", F.col("rep.doc_id").alias("doc_id"), F.col("rep.at").alias("at")), "suffix-groups")
    wins = materialize(_windows(groups.where("mixed").select("rk", "sk", "n", "doc_id", "at"), docs), "suffix-windows")
    twice = (wins.groupBy("print").agg(F.sum("n").alias("c"), F.min(F.struct("doc_id", "p")).alias("first"))
             .where("c > 1").select("print", "first"))
    found = wins.join(materialize(twice, "suffix-twice"), "print").select(
        "rk", "sk", "off", (F.struct("doc_id", "p") == F.col("first")).alias("first"))
    offs = found.groupBy("rk", "sk").agg(F.collect_list(F.struct("off", "first")).alias("offs"))
    sides = materialize(groups.select("rk", "sk", F.col("doc_id").alias("rep_doc"), F.col("at").alias("rep_at"))
                        .join(offs, ["rk", "sk"], "left"), "suffix-sides")
    lo = F.shiftright("at", 16)
    more = F.col("at").bitwiseAND(0xFF)
    own = F.col("doc_id").eqNullSafe(F.col("rep_doc")) & (F.col("at") == F.col("rep_at"))

    def run(a, b, later):
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), later.alias("later"))

    each = F.when(F.col("mixed"), F.transform("offs", lambda o: run(lo + o["off"], lo + o["off"], ~(own & o["first"]))))
    runs = (shared.join(sides, ["rk", "sk"])
            .select("doc_id", F.explode(each.otherwise(F.array(run(lo, lo + more, ~own)))).alias("r")).select("doc_id", "r.*"))
    by_doc = Window.partitionBy("doc_id").orderBy("a", "b")
    before = F.max("b").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("*", F.coalesce((F.col("a") > before + MIN_WORDS).cast("int"), F.lit(1)).alias("new"))
    runs = runs.select("*", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)).alias("span"))
    spans = runs.groupBy("doc_id", "span").agg(
        F.min("a").alias("start_word"), (F.max("b") + MIN_WORDS).alias("end_word"), F.max("later").alias("is_copy"))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "is_copy")


def op7_sparse_suffix(spark, sf_dir) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS p FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, p, md5(array_to_string(w[p + 1:p + 50], ' ')) AS h FROM p),
r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS c, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS nth FROM k),
q AS (SELECT * FROM r WHERE c > 1),
s AS (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50
              OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS new FROM q),
t AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM s)
SELECT doc_id, min(p)::BIGINT AS start_word, (max(p) + 50)::BIGINT AS end_word,
       (max(p) + 50 - min(p))::BIGINT AS n_words, bool_or(nth > 1) AS is_copy
FROM t GROUP BY doc_id, span
"""
