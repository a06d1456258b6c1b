"""What the corpus pipeline needs in the driver's memory."""

import os
import subprocess
import sys

import numpy as np
import pyspark.sql.functions as F

from sparkseries.llm import bpe, line_dedup, mixing, ngram_join
from sparkseries.llm.ngram_join import WordHashes, shingle_set

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
IMPORTS = """
import re, sys
def mb():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
import numpy, pyarrow, regex, tiktoken, xxhash, pyspark.sql
before = mb()
import corpus_pipeline
print("pandas" in sys.modules, mb() - before)
"""


def test_import_is_small():
    """A pattern with a least count of 100,001 took 66 MB, pandas 26 MB more."""
    out = subprocess.run([sys.executable, "-c", IMPORTS], cwd=REPO, capture_output=True, text=True, check=True).stdout
    pandas, mb = out.split()
    assert pandas == "False" and float(mb) < 30


def test_blank_runs_up_to_the_bound_stay():
    """Only runs over ``BLANKS`` are taken out, whatever the pattern finds."""
    cut = lambda t: [r.span() for r in bpe.LONG_BLANKS.finditer(t) if r.end() - r.start() > bpe.BLANKS]
    for n, found in ((99, []), (bpe.BLANKS, []), (bpe.BLANKS + 1, [(1, bpe.BLANKS + 2)])):
        assert cut("a" + " \t" * (n // 2) + " " * (n % 2) + "b") == found


def test_frequent_are_the_most_frequent_by_count_and_hash(spark, monkeypatch):
    """Above the cut's count all, at it about as many as there is room for, smallest hashes first;
    no task sends the driver more than its part of them."""
    common = " ".join(f"c{i}" for i in range(40))
    texts = [common + f" u{k} v{k}" for k in range(6)]
    texts += [" ".join(f"t{j}x{i}" for i in range(900)) for j in range(4) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None), (100, "")], "doc_id long, text string")
    counts: dict[int, int] = {}
    for t in texts:
        for h in shingle_set(t, WordHashes(), 4).tolist():
            counts[h] = counts.get(h, 0) + 1
    for most, slack in ((100_000, 0), (1500, 200), (37, 0), (5, 5)):
        monkeypatch.setattr(ngram_join, "MAX_FREQUENT", most)
        h, c = ngram_join._frequent(docs, 4)
        assert (np.diff(h.astype(object)) > 0).all() and [counts[x] for x in h.tolist()] == c.tolist()
        many = {x for x, n in counts.items() if n >= 2}
        assert abs(len(h) - min(most, len(many))) <= slack
        if len(h) < len(many):
            least = min(c.tolist())
            assert {x for x in many if counts[x] > least} <= set(h.tolist())
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            edge = [signed(x) for x in h.tolist() if counts[x] == least]
            rest = [signed(x) for x in many - set(h.tolist()) if counts[x] == least]
            assert not rest or max(edge) < min(rest)


def test_no_sorted_limit_and_no_counted_limit(spark, monkeypatch):
    """A sorted limit brings as many rows from every task; a counted one costs two exchanges."""
    kind = type(spark.range(1))
    limit = kind.limit

    def only_by_spark(self, n):  # first() is a limit as well
        assert not sys._getframe(1).f_globals["__name__"].startswith("sparkseries")
        return limit(self, n)

    monkeypatch.setattr(kind, "limit", only_by_spark)
    docs = spark.createDataFrame([(i, f"line {i % 3}\nwords of document {i} " * 9, "s" + str(i % 2)) for i in range(30)],
                                 "doc_id long, text string, source string")
    assert ngram_join.link_components(docs.select("doc_id", "text")).count() == 30
    assert line_dedup.dedup_lines(docs).agg(F.sum("__llm_gone")).first()[0] > 0
    assert mixing.mix(docs).count() == 30
