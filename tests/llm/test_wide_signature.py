"""Long documents get a second signature."""

import numpy as np

from sparkseries.llm import ngram_join


def test_wide_signatures_refuse_long_pairs_and_lose_no_link(spark):
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in rng.integers(1 << 30, size=6000)]
    near = base.copy()
    for k in rng.choice(6000, 60, replace=False):  # about 240 of 6000 shingles differ
        near[k] = "changed"
    half = base[:3500] + [f"v{k}" for k in rng.integers(1 << 30, size=2500)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(half)), (4, "few words"), (4, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = ngram_join._profiles(docs, 4, 85).select("doc_id", "n_shingles", "sig", "wide")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4)], "a long, b long")
    sides = nodes.where("doc_id <> 4")
    old = (pairs.join(sides.selectExpr("doc_id a", "n_shingles n_a", "sig sig_a"), "a")
           .join(sides.selectExpr("doc_id b", "n_shingles n_b", "sig sig_b"), "b").where(ngram_join._may_link(85)))
    assert {(r["a"], r["b"]) for r in old.collect()} == {(1, 2), (1, 3), (2, 3)}  # 512 cells are full
    got = {(r["a"], r["b"]) for r in ngram_join._wide_pairs(pairs, nodes, 85).collect()}
    assert got == {(1, 2), (1, 4)}
    out = {(r["doc_id"], r["component_id"]) for r in ngram_join.link_components(docs.where("doc_id <> 4")).collect()}
    assert out == {(1, 1), (2, 1), (3, 3)}
