"""Toxic words are counted in tasks, not in the driver."""

import inspect
from collections import defaultdict

from sparkseries.llm import toxicity


def test_toxic_words_are_counted_by_distinct_contexts(spark):
    rows = [(1, "Bad thing here bad thing there", 1), (2, "bad thing here", 1), (3, "a bad day", 0), (4, None, 1), (5, "", 0), (6, "a bad day", 0)]
    want = defaultdict(lambda: (set(), set()))
    for _, text, kind in rows:
        w = ["", *toxicity.WORD.findall((text or "").lower()), ""]
        for i in range(1, len(w) - 1):
            want[w[i]][kind].add((w[i - 1], w[i + 1]))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    got = {r["word"]: (r["t"], r["o"]) for r in toxicity.word_counts(df).collect()}
    assert got == {w: (len(k[1]), len(k[0])) for w, k in want.items()}
    assert toxicity.marks(df.limit(0)) == b""


def test_toxicity_texts_stay_out_of_the_driver():
    assert "toLocalIterator" not in inspect.getsource(toxicity)
