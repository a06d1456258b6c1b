"""Line dedup: repeated runs of lines by distributed prefix doubling.

Every document is a sequence of line ids (64-bit hashes of its lines that hold a word).  A suffix
is a place (document, line).  Round 0 names each suffix by its line id; round k + 1 names it by
the pair of names at its place and 2**k lines further on, so a name stands for 2**(k + 1) lines.
Suffixes that share a name share that many lines: the classes of each round are the
longest-common-prefix intervals of the suffix array at that depth, nested from round to round.
A suffix whose name is its own only can share no longer prefix and leaves, so each round handles
what is repeated at its depth alone, and the rounds end when no class has two members.

Within an interval the first suffix (by document id, then place) stays and the others are later
copies.  ``maximal_runs`` turns them into runs: a later place takes the first suffix of its deepest
interval as its source, places whose sources follow each other make one run, and the run's exact
length is the common prefix of its first place and that source, read off the names of the rounds
from the deepest down (2**k lines further where the names of round k agree).  The lines of runs of
``MIN_LINES`` lines or more are deleted; the content of every deleted line remains at an earlier
place.  Runs that overlap themselves shrink to their first period.  A run of one line counts: it is
a passage that recurs between different neighbours.

Counting names is a grouped aggregate with map-side combine; a line that a third of all documents
hold is one name there, and the join back is left to adaptive execution, which splits it.

Every side of a join grows with the data, and Spark sizes it by the files it comes from: places
compress to a few bits each, and a run is one row before its lines are.  So all joins are merge
joins at every size, and none is ever broadcast.

Defined results: null text has no lines and stays null; blank lines are passed over and stay;
rows equal in doc_id and text are one document (all get the same result); an empty table gives
an empty result; other columns are ignored by the operator and kept by the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, table

MIN_LINES = 1
MAX_ROUNDS = 40


def _lines(text):
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, raw, name): lines with a word; ``pos`` counts them, ``raw`` counts all."""
    both = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("raw"), x.alias("line")))
    some = F.filter(both, lambda s: s["line"].rlike(WORD_PATTERN))
    return (docs.where("text is not null")
            .select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(some).alias("pos", "s"))
            .select("doc_id", "th", "pos", F.col("s.raw").alias("raw"), F.xxhash64("s.line").alias("name")))


def _shared(rows: DataFrame) -> DataFrame:
    """Suffixes whose name others have too, with ``later``: not the first of their interval."""
    place = F.struct("doc_id", "th", "pos")
    first = rows.groupBy("name").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    return (rows.join(first.select("name", "first").hint("merge"), "name")
            .withColumn("later", place != F.col("first")))


def repeated_suffixes(docs: DataFrame) -> list[DataFrame]:
    """One table (doc_id, th, pos, raw, name, first, later) per round k: the suffixes that share
    2**k lines with another one, and the first suffix of their interval."""
    rounds = []
    cur = line_table(docs)
    for k in range(MAX_ROUNDS):
        rows = _shared(cur)
        if k == 0:
            rows = rows.dropDuplicates(["doc_id", "th", "pos"])
        rows = materialize(rows, f"lines-{k}")
        if rows.isEmpty():
            break
        rounds.append(rows)
        ahead = rows.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"),
                            (F.col("pos") - F.lit(2 ** k)).alias("p2"), F.col("name").alias("then")).hint("merge")
        cur = (rows.join(ahead, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2"))
                         & (F.col("pos") == F.col("p2")))
               .select("doc_id", "th", "pos", "raw", F.xxhash64("name", "then").alias("name")))
    return rounds


def maximal_runs(rounds: list[DataFrame]) -> DataFrame:
    """(doc_id, th, pos, src, length): repeated runs from ``pos`` on, as long as they agree with the
    run at the place ``src`` (doc_id, th, pos), which is earlier and stays."""
    each = None
    for k, rows in enumerate(rounds):
        part = rows.where("later").select("doc_id", "th", "pos", F.struct(F.lit(k).alias("k"), F.col("first").alias("src")).alias("m"))
        each = part if each is None else each.union(part)
    each = materialize(each.groupBy("doc_id", "th", "pos").agg(F.max_by("m", "m.k").alias("m"))
                       .select("doc_id", "th", "pos", "m.k", "m.src"), "lines-later")
    # a place whose predecessor is a later copy of its source's predecessor is inside a run
    ahead = each.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), (F.col("pos") + 1).alias("p2"),
                        F.col("src.doc_id").alias("sd"), F.col("src.th").alias("st"), (F.col("src.pos") + 1).alias("sp")).hint("merge")
    inside = (F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")) & (F.col("pos") == F.col("p2"))
              & F.col("src.doc_id").eqNullSafe(F.col("sd")) & (F.col("src.th") == F.col("st")) & (F.col("src.pos") == F.col("sp")))
    runs = each.join(ahead, inside, "left_anti").select(
        "doc_id", "th", "pos", "k", "src", F.expr("shiftleft(1, k)").alias("length"))
    runs = materialize(runs, "lines-runs")
    grown = runs.where(F.col("k") == len(rounds) - 1)
    for k in range(len(rounds) - 2, -1, -1):  # only runs of deeper rounds can agree that much further
        own = rounds[k].select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), F.col("pos").alias("p2"), F.col("name").alias("n2"))
        src = rounds[k].select(F.col("doc_id").alias("d3"), F.col("th").alias("t3"), F.col("pos").alias("p3"), F.col("name").alias("n3"))
        more = grown.join(own.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2"))
                          & (F.col("pos") + F.col("length") == F.col("p2")), "left")
        more = more.join(src.hint("merge"), F.col("n2").isNotNull() & F.col("src.doc_id").eqNullSafe(F.col("d3")) & (F.col("src.th") == F.col("t3"))
                         & (F.col("src.pos") + F.col("length") == F.col("p3")), "left")
        far = F.when(F.col("n2") == F.col("n3"), 2 ** k).otherwise(0)
        more = materialize(more.select("doc_id", "th", "pos", "k", "src", (F.col("length") + far).alias("length")), "lines-runs")
        grown = more.union(runs.where(F.col("k") == k))
    return grown.drop("k")


def later_copies(rounds: list[DataFrame], min_lines: int = MIN_LINES) -> DataFrame | None:
    """(doc_id, th, gone, longest): raw numbers of the lines to delete, and the longest of the runs
    they come from, in lines."""
    if not rounds:
        return None
    runs = maximal_runs(rounds).where(F.col("length") >= min_lines)
    # runs of several sources overlap; each place is taken once, and a run inside another is no longer than it
    before = Window.partitionBy("doc_id", "th").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("length")
    runs = runs.select("doc_id", "th", "length", F.greatest("pos", F.max(end).over(before)).alias("lo"), end.alias("end"))
    starts = runs.where("lo < end").select("doc_id", "th", F.explode(F.sequence(F.col("lo"), F.col("end") - 1)).alias("pos"), "length")
    return _gone(starts, rounds[0])


def _gone(starts: DataFrame, lines: DataFrame) -> DataFrame:
    raw = lines.select("doc_id", "th", "pos", "raw").hint("merge")
    d, t = F.col("x.doc_id"), F.col("x.th")
    joined = starts.alias("x").join(raw.alias("y"), d.eqNullSafe(F.col("y.doc_id")) & (t == F.col("y.th"))
                                    & (F.col("x.pos") == F.col("y.pos")))
    return (joined.groupBy(d.alias("doc_id"), t.alias("th"))
            .agg(F.collect_set("raw").alias("gone"), F.max("length").alias("longest")))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Every row of ``docs`` with ``__llm_lines``, ``__llm_gone`` (deleted lines), ``__llm_longest``
    (lines of its longest run) and the text without its later copies in ``__llm_text``."""
    gone = later_copies(repeated_suffixes(docs.select("doc_id", "text")), min_lines)
    rows = docs.withColumn("__llm_th", F.xxhash64("text"))
    if gone is None:
        rows = rows.withColumn("__llm_set", F.lit(None).cast("array<int>")).withColumn("__llm_longest", F.lit(None).cast("int"))
    else:
        gone = materialize(gone, "lines-gone").select(
            F.col("doc_id").alias("__llm_id"), F.col("th").alias("__llm_th2"), F.col("gone").alias("__llm_set"),
            F.col("longest").alias("__llm_longest"))
        rows = rows.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_th") == F.col("__llm_th2")), "left")
    lines = _lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__llm_set"))
    text = F.when(F.col("__llm_set").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n"))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return rows.select(*docs.columns, count.alias("__llm_lines"),
                       F.coalesce(F.size("__llm_set"), F.lit(0)).cast("long").alias("__llm_gone"),
                       F.coalesce("__llm_longest", F.lit(0)).cast("long").alias("__llm_longest"),
                       text.alias("__llm_text"))


def op2_line_dedup(spark, sf_dir) -> DataFrame:
    """Per document: lines, deleted lines, and the digest of the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("__llm_lines").alias("n_lines"), F.col("__llm_gone").alias("n_removed"),
        F.sha2(F.coalesce("__llm_text", F.lit("")), 256).alias("clean_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, hash(text) AS th, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS raw
  FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS pos
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
q AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM w),
g AS (SELECT doc_id, pos FROM q WHERE nth > 1),
k AS (
  SELECT l.doc_id, count(g.pos) AS n_removed, count(*) AS n_lines,
         string_agg(l.line, chr(10) ORDER BY l.raw) FILTER (WHERE g.pos IS NULL) AS clean
  FROM l LEFT JOIN w ON w.doc_id = l.doc_id AND w.raw = l.raw
         LEFT JOIN g ON g.doc_id = w.doc_id AND g.pos = w.pos
  GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.clean, '')) AS clean_sha256
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def stage_line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs.  A document none of whose lines is left goes: all it said
    stands in earlier documents.  ``n_chars`` follows the new text."""
    rows = dedup_lines(docs)
    rows = rows.where((F.col("__llm_gone") == 0) | F.col("__llm_text").rlike(WORD_PATTERN))
    new = {"text": F.col("__llm_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("__llm_gone") > 0, F.length("__llm_text").cast(kind)).otherwise(F.col("n_chars"))
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
