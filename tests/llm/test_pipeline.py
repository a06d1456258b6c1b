"""The corpus pipeline on the smallest given tables: each stage's decisions take effect in the next."""

from collections import Counter

import pytest
from conftest import SF_SMALL

import corpus_pipeline
from sparkseries.llm import line_dedup, quality
from sparkseries.llm.common import materialize, table
from .test_operators import WORD, brute_components, tokenizers_  # noqa: F401


@pytest.fixture(scope="module")
def stages(spark):
    """Documents, and what each stage leaves of them."""
    out = [table(spark, SF_SMALL, "documents")]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out.append(materialize(f(spark, out[-1], SF_SMALL), f"test-stage-{k}"))
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_quality_stage_keeps_what_the_verdict_keeps(spark, stages):
    kept = {r["doc_id"] for r in quality.op3_quality_rules(spark, SF_SMALL).where("kept").collect()}
    assert {d for d, _ in rows(stages[1])} == kept and stages[1].columns == stages[0].columns


def test_line_stage_leaves_each_line_once(stages):
    lines = Counter(x for _, t in rows(stages[2]) for x in (t or "").split("\n") if WORD.search(x))
    before = {x for _, t in rows(stages[1]) for x in (t or "").split("\n") if WORD.search(x)}
    assert set(lines) == before and set(lines.values()) == {1}


def test_line_stage_deletes_exact_runs(spark, monkeypatch):
    """The stage works out the runs with their exact lengths, as the operator does."""
    said = []
    maximal_runs = line_dedup.maximal_runs
    monkeypatch.setattr(line_dedup, "maximal_runs", lambda rounds: said.append(maximal_runs(rounds)) or said[-1])
    run = "\n".join(f"line {x}" for x in range(5))
    data = [(1, f"{run}\nfirst"), (2, f"second\n{run}\nline 1"), (3, run), (4, "own")]
    out = line_dedup.stage_line_dedup(spark, spark.createDataFrame(data, "doc_id long, text string"), "")
    assert sorted(rows(out)) == [(1, f"{run}\nfirst"), (2, "second"), (4, "own")]
    assert len(said) == 1
    runs = {(r["doc_id"], r["pos"]): (r["src"]["doc_id"], r["src"]["pos"], r["length"]) for r in said[0].collect()}
    assert runs == {(2, 1): (1, 0, 5), (2, 6): (1, 1, 1), (3, 0): (1, 0, 5)}


def test_one_document_of_each_group_stays(stages):
    component = brute_components(rows(stages[2]), 5, 80)
    assert sorted(d for d, _ in rows(stages[3])) == sorted(d for d, c in component.items() if d == c)


def test_mix_takes_whole_documents_at_most_three_times(stages):
    copies = Counter(rows(stages[4]))
    assert set(copies) <= set(rows(stages[3])) and max(copies.values()) <= 3
    assert stages[4].columns == stages[0].columns


def test_last_stage_and_run(spark, stages, tokenizers_):  # noqa: F811
    want = Counter((d, len(tokenizers_[0].encode_ordinary(t or ""))) for d, t in rows(stages[4]))
    for df in (stages[5], corpus_pipeline.run(spark, SF_SMALL)):
        assert Counter((r["doc_id"], r["n_tokens"]) for r in df.collect()) == want
