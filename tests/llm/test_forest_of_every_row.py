"""Forests of every row: no document is left out of the quality model."""

import numpy as np

from sparkseries.llm import quality


def test_every_row_enters_a_tree(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 4)
    monkeypatch.setattr(quality, "TREE_ROWS", 8)
    for at in range(100):  # only a tree that holds the one other row can split
        x = np.zeros((100, 1))
        x[at] = 1.0
        assert any(feat[0] >= 0 for feat, *_ in quality.grow_forest(x)), at


def test_groups_hold_no_more_than_a_forest():
    for judged in (0, 1, 32_768, 32_769, 500_000, 15_000_000):
        for rows in (judged, 20 * judged + 5):
            groups = quality.n_groups(rows, judged)
            assert judged <= groups * quality.FOREST_ROWS and rows <= groups * quality.GROUP_ROWS


def test_judge_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(quality, "FOREST_ROWS", 64)  # read by the driver: about five groups
    words = "the quick brown fox jumps over a lazy dog near old river banks".split()
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(words, 80)) + f" w{i}" for i in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0])] * 3 + [(7, texts[7]), (400, None), (401, "few")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    assert quality.n_groups(305, 303) > 1
    out = quality.judge(docs, labels).collect()
    assert len(out) == len(rows) and sum(r["kept"] for r in out) == 304
    assert len({r["score"] for r in out if r["doc_id"] == 7}) == 1 and len({r["score"] for r in out if r["doc_id"] is None}) == 1
