"""Spelling variant grouping by a trie-node pair dictionary.

Words one edit apart share everything but one position.  All words make a forward trie and, read
backwards, a reversed trie; a node is an integer.  A word w with L code points has, for each place i,

    the skipped pair  (node of w[:i], reversed node of w[i+1:])   one code point left out
    the split pair    (node of w[:i], reversed node of w[i:])     nothing left out

Nodes stand for strings, so two words share a skipped pair just if they differ by one replacement
there, and the skipped pair of w is a split pair of v just if leaving out that code point turns w
into v.  Joining integer pairs thus gives the exact neighbours, without comparing words.  Where a
code point is repeated, each of its places gives the same shorter word; only the first one counts.

A pair's members are at most one word per letter of the alphabet and one shorter word, so a pair is a
small group whatever the table.  Each gives its members their neighbour count and their best
neighbour (counts and the two largest members suffice); links are never listed.

Node numbers come from the sorted words: a word makes new nodes for the prefixes that it does not
share with the word before it.  ``trie_nodes`` numbers the words by range partitions and works in
blocks of ``BLOCK`` neighbours; the first word of a block shares nodes with earlier blocks, which one
row per block (its first and last word, and the last word's nodes) settles in the driver between two
passes: V / ``BLOCK`` rows for V distinct words.

``forms``: a word's form is its best neighbour where that one is at least ``RATIO`` times as frequent;
roots follow forms to the end by pointer doubling (counts rise by ``RATIO``, so chains are short).

Defined results: null text has no words; a null doc_id takes no code point out of a word; ties go to
the smaller word in code-point order; repeated rows count each time; an empty table gives an empty
result; other columns are ignored.  A text of any length is one row, a run of any length one word.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_sql, materialize, number, table

RUN = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
DROP_EVERY = 31
BLOCK = 1 << 15
MAX_CHAIN = 64


def lower_ascii(col):
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n) over ``docs(doc_id, text)``.  A run too short to be a word is left out at once; a
    run of ``min_length`` or more is met whole, since shorter ones never contain such a match."""
    run = F.regexp_extract_all("text", F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(run).alias("run"))
    runs = runs.select("id", lower_ascii("run").alias("run"))
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", F.coalesce(F.when(h % drop_every == 0, h % F.length("run")), F.lit(-1)).cast("int").alias("at"))
    word = F.when(F.col("at") < 0, F.col("run")).otherwise(
        F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)")))
    return (runs.select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _block_nodes(words: list[str], shared: int, carried: np.ndarray, base: int):
    """Node numbers of the prefixes of sorted ``words``, one array (lengths 1, 2, ...) per word.

    ``shared`` code points of the first word belong to earlier words, with the nodes ``carried``;
    new nodes are numbered from ``base``."""
    path, before = carried, None
    for w in words:
        k = shared if before is None else _common(before, w)
        path = np.concatenate([path[:k], np.arange(base, base + len(w) - k)])
        base += len(w) - k
        before = w
        yield path


def trie_nodes(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, nodes) for ``words(id, word, pos)``, distinct words and their places in sorted order: the
    numbers of the nodes of all prefixes of each word, the shortest first.  Number 0 is the root."""
    rows = words.select("id", "word", "pos", F.floor(F.col("pos") / block).alias("block"))

    def ends(key, t):
        t = t.sort_by("pos")
        w = t.column("word").to_pylist()
        last = None
        for last in _block_nodes(w, 0, np.zeros(0, np.int64), 0):
            pass
        new = sum(len(b) - _common(a, b) for a, b in zip([""] + w, w))
        # below the shortest prefix shared with the block's first word nothing is known yet
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "first": [w[0]], "last": [w[-1]],
                         "new": pa.array([new], pa.int64()), "path": pa.array([last], pa.list_(pa.int64()))})

    edges = sorted(rows.groupBy("block").applyInArrow(
        ends, "block long, first string, last string, new long, path array<long>").collect(), key=lambda r: r["block"])
    start, before, path, base = {}, "", np.zeros(0, np.int64), 1
    for e in edges:
        shared = _common(before, e["first"])
        start[e["block"]] = (shared, path[:shared], base)
        # within the block the first word's nodes are 0 .. len - 1; its shared ones are not new
        own = np.array(e["path"], np.int64)
        path = np.where(own < shared, np.concatenate([path[:shared], np.zeros(max(0, len(own) - shared), np.int64)])[:len(own)], base + own - shared)
        base += e["new"] - shared
        before = e["last"]

    def run(key, t):
        t = t.sort_by("pos")
        shared, carried, base = start[key[0].as_py()]
        paths = list(_block_nodes(t.column("word").to_pylist(), shared, carried, base))
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
        nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(paths), pa.int64()))
        return pa.table({"id": t.column("id").cast(pa.int64()), "nodes": nodes})

    return rows.groupBy("block").applyInArrow(run, "id long, nodes array<long>")


def neighbours(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, n_near, best) for the words of ``words(id, word, n)`` that have a near word: how many, and
    the near word of largest n as (n, -id).  ``id`` is a word's place in code-point order."""
    forward = trie_nodes(words.select("id", "word", F.col("id").alias("pos")), block).withColumnRenamed("nodes", "prefix")
    mirrored = materialize(words.select("id", F.reverse("word").alias("word")), "spell-mirrored")
    mirrored = materialize(number(mirrored, [], ["word"], "spell-mirrored", "pos"), "spell-mirrored")
    backward = trie_nodes(mirrored, block).select(F.col("id").alias("id2"), F.reverse("nodes").alias("suffix"))
    rows = words.join(forward.withColumnRenamed("id", "id1"), F.col("id") == F.col("id1")).join(backward, F.col("id") == F.col("id2"))
    zero = F.array(F.lit(0).cast("long"))
    rows = rows.select("id", "n", "word", F.concat(zero, "prefix").alias("p"), F.concat("suffix", zero).alias("s"))
    # place i: prefix p[i]; s[i + 1] skips the code point there, s[i] splits before it; the first of
    # a run of equal code points stands for them all
    rows = rows.select("n", "id", "p", "s", F.split("word", "").alias("c"), F.length("word").alias("size"))

    def at(col, i):
        return F.get(F.col(col), i)

    def pair(i, s, kind):
        return F.struct(at("p", i).alias("p"), at("s", s).alias("s"), kind.alias("kind"))

    skipped = F.transform(F.sequence(F.lit(0), F.col("size") - 1),
                          lambda i: pair(i, i + 1, F.when((i == 0) | (at("c", i) != at("c", i - 1)), F.lit(2)).otherwise(F.lit(1))))
    split = F.transform(F.sequence(F.lit(0), F.col("size")), lambda i: pair(i, i, F.lit(0)))
    each = rows.select(F.struct("n", (-F.col("id")).alias("minus")).alias("own"), F.explode(F.concat(skipped, split)).alias("x"))
    each = each.select("own", "x.p", "x.s", "x.kind")
    group = Window.partitionBy("p", "s")
    ranked = group.orderBy(F.col("kind") == 0, F.desc("own")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    skips, firsts = F.when(F.col("kind") > 0, F.col("own")), F.when(F.col("kind") == 2, F.col("own"))
    shorter = F.when(F.col("kind") == 0, F.col("own"))
    each = each.select(
        "own", "kind", F.count(skips).over(ranked).alias("m"), F.count(firsts).over(ranked).alias("longer"),
        F.nth_value(skips, 1).over(ranked).alias("top"), F.nth_value(skips, 2).over(ranked).alias("second"),
        F.max(firsts).over(ranked).alias("best_longer"), F.max(shorter).over(ranked).alias("shorter"))
    other = F.when(F.col("top") == F.col("own"), F.col("second")).otherwise(F.col("top"))
    has = (F.col("kind") == 2) & F.col("shorter").isNotNull()
    each = each.select(
        "own", F.when(F.col("kind") == 0, F.col("longer")).otherwise(F.col("m") - 1 + has.cast("long")).alias("near"),
        F.when(F.col("kind") == 0, F.col("best_longer")).otherwise(F.greatest(other, F.when(has, F.col("shorter")))).alias("best"))
    return (each.where("near > 0").groupBy((-F.col("own.minus")).alias("id"))
            .agg(F.sum("near").alias("n_near"), F.max("best").alias("best")))


def forms(counted: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for ``counted(word, n)``, distinct words."""
    ids = materialize(number(materialize(counted, "spell-counted"), [], ["word"], "spell", "id"), "spell-ids")
    near = neighbours(ids, block).withColumnRenamed("id", "near_id")
    rows = ids.join(near, F.col("id") == F.col("near_id"), "left")
    form = F.col("best.n") >= ratio * F.col("n")
    rows = materialize(rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                   F.when(form, -F.col("best.minus")).alias("form_id"), F.when(form, F.col("best.n")).alias("form_n")), "spell-forms")
    # pointer doubling: after k rounds ``to`` is 2 ** k forms ahead, or the end
    links = materialize(rows.where("form_id is not null").select("id", F.col("form_id").alias("to")), "spell-links")
    for _ in range(MAX_CHAIN):
        ahead = links.select(F.col("id").alias("mid"), F.col("to").alias("end"))
        step = materialize(links.join(ahead, F.col("to") == F.col("mid"), "left")
                           .select("id", F.coalesce("end", "to").alias("to"), F.col("mid").isNotNull().alias("moved")), "spell-links")
        links = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    name = ids.select(F.col("id").alias("name_id"), F.col("word").alias("name"))
    roots = (links.join(name, F.col("to") == F.col("name_id")).select(F.col("id").alias("root_id"), F.col("name").alias("root")))
    named = (rows.where("form_id is not null").select("id", "form_id").join(name, F.col("form_id") == F.col("name_id"))
             .select(F.col("id").alias("own_id"), F.col("name").alias("form")))
    out = rows.join(named, F.col("id") == F.col("own_id"), "left").join(roots, F.col("id") == F.col("root_id"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_trie_pairs(spark, sf_dir) -> DataFrame:
    return forms(words(table(spark, sf_dir, "documents")))


OP13_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run
  FROM documents),
hashed AS (SELECT run, {crc32_sql("doc_id::VARCHAR || ':' || run")} AS h FROM runs WHERE length(run) >= {MIN_LENGTH}),
dropped AS (
  SELECT CASE WHEN h % {DROP_EVERY} = 0
              THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run) + 2)::INTEGER) ELSE run END AS word
  FROM hashed),
words AS (SELECT word, count(*) AS n FROM dropped WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING count(*) >= {MIN_COUNT}),
skipped AS (SELECT word, n, i, substr(word, 1, i::INTEGER) || chr(1) || substr(word, (i + 2)::INTEGER) AS masked,
                   substr(word, 1, i::INTEGER) || substr(word, (i + 2)::INTEGER) AS shorter
            FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM skipped a JOIN skipped b ON a.masked = b.masked AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM skipped s JOIN words w ON s.shorter = w.word
  UNION SELECT w.word, s.word, s.n FROM skipped s JOIN words w ON s.shorter = w.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near),
form AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= {RATIO} * w.n THEN r.other END AS form,
         CASE WHEN r.n >= {RATIO} * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chain AS (
  SELECT word, form AS hop, 1 AS step FROM form WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN form f ON f.word = c.hop WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(hop, step) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n
FROM form f LEFT JOIN roots r ON r.word = f.word
"""
