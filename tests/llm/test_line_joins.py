"""Line dedup broadcasts nothing, however small its tables seem to Spark, and takes each place once."""

from sparkseries.llm import line_dedup


def test_no_side_is_broadcast(spark, monkeypatch):
    """A run of many lines is one row before it is exploded: the exploded lines were broadcast."""
    text = "\n".join(f"line {x}" for x in range(40))
    data = [(i, f"head {i}\n{text}\nline 3\n") for i in range(4)] + [(9, None), (None, "line 1\nown"), (None, "line 1\nown")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    plans, write = [], line_dedup.materialize

    def planned(df, name):
        df.collect()  # the plan after adaptive execution
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(line_dedup, "materialize", planned)
    out = line_dedup.dedup_lines(docs)
    rows = [(-1 if r["doc_id"] is None else r["doc_id"], r["__llm_gone"], r["__llm_longest"]) for r in out.collect()]
    plans.append(("result", out._jdf.queryExecution().executedPlan().toString()))
    assert sorted(rows) == [(-1, 0, 0), (-1, 0, 0), (0, 2, 1), (1, 41, 41), (2, 41, 41), (3, 41, 41), (9, 0, 0)]
    assert any(name == "lines-gone" for name, _ in plans) and any("SortMergeJoin" in plan for _, plan in plans)
    assert not [name for name, plan in plans if "Broadcast" in plan]


def test_overlapping_runs_give_each_place_once(spark, monkeypatch):
    """Windows of a block in earlier documents: every place of a later block has a source of its own."""
    data = [(i, "\n".join(f"line {x}" for x in range(i, i + 4))) for i in range(4)]
    data += [(10 + i, "\n".join([f"own {i}", *(f"line {x}" for x in range(7)), f"end {i}"])) for i in range(3)]
    taken, find = [], line_dedup._gone
    monkeypatch.setattr(line_dedup, "_gone", lambda starts, lines: taken.append(starts) or find(starts, lines))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    places = sorted((r["doc_id"], r["pos"]) for r in taken[0].collect())
    assert places == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2)] + [(10 + i, p) for i in range(3) for p in range(1, 8)]
    assert all(got[10 + i]["__llm_text"] == f"own {i}\nend {i}" and got[10 + i]["__llm_longest"] == 4 for i in range(3))
    assert [got[i]["__llm_text"] for i in range(4)] == [data[0][1], "line 4", "line 5", "line 6"]
