"""Merkle manifest, Karmarkar-Karp sharding and spelling variants against brute-force versions."""

import hashlib
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseries.llm import merkle, sharding, spelling
from sparkseries.llm.common import number

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: The last columns clash with names used inside the operators.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, idx long, leaf_no int, tree long, n long, "
          "g string, size long, word string, id long, block long")
CLASH = (7, 7, 7, 7, "x", 7, "x", 7, 7)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    data = [(i, "text " + "ab" * int(rng.integers(0, 40)), ["en", "de", None, "fr"][int(rng.choice(4, p=[.6, .2, .1, .1]))],
             "s" if i % 3 else None, 5 * i if i % 5 else None) for i in range(150)]
    data += [(3, data[3][1], "en", "s", 9), (3, data[3][1], "en", "s", 9), (None, "no id", "en", None, 1), (None, None, None, None, None),
             (900, None, "de", "x", 0), (901, "", "de", "x", 0), (902, "one of its language", "zz", "é", 3),
             (903, "long " * 60_000, "fr", "s", 300_000), (904, "日本 語", "fr", "s", 4)]
    return [r + CLASH for r in data]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- numbering --------------------------------------------------------------------------------

def test_number(spark, docs, rows):
    from sparkseries.llm.common import materialize
    got = number(materialize(docs.select("doc_id", "lang"), "t"), ["lang"], ["doc_id"], "t").collect()
    per = {}
    for r in got:
        per.setdefault(r["lang"], []).append((r["__llm_pos"], -1 if r["doc_id"] is None else r["doc_id"]))
    assert sum(map(len, per.values())) == len(rows)
    for x in per.values():
        x.sort()
        assert [p for p, _ in x] == list(range(len(x))) and [d for _, d in x] == sorted(d for _, d in x)


# ---- Merkle manifest --------------------------------------------------------------------------

def brute_leaf(row, more=0):
    doc, text, lang, source, n = row[:5]
    def one(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"
    return H(one(doc), one(source), one(lang), one(None if n is None else n + more), one(text))


def brute_levels(hexes):
    levels = [hexes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i:i + 2]) for i in range(0, len(last), 2)])
    return levels


def brute_manifest(rows):
    """(doc_id, leaf) sorted -> (subroot, root, siblings, folded root) for every row."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees.append((own, brute_levels([brute_leaf(r) for r in own])))
    top = brute_levels([t[1][-1][0] for t in trees])
    out = []
    for k, (own, levels) in enumerate(trees):
        for pos, row in enumerate(own):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None
            acc, siblings = brute_leaf(row, 1 if tampered else 0), []
            for start, all_levels in ((pos, levels), (k, top)):
                at = start
                for level in all_levels[:-1]:
                    pair = [x for x in (at & ~1, at | 1) if x < len(level)]
                    siblings += [level[x] for x in pair if x != at]
                    acc = H(*[acc if x == at else level[x] for x in pair])
                    at >>= 1
            out.append((-1 if row[0] is None else row[0], levels[0][pos], levels[-1][0], top[-1][0], H(*siblings), acc, acc == top[-1][0]))
    return sorted(out)


def manifest_rows(df):
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(tuple(-1 if c == "doc_id" and r[c] is None else r[c] for c in cols) for r in df.collect())


def op11_over(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return merkle.op11_octopus_manifest(spark, str(tmp_path))


def test_manifest_query(spark, docs, rows, tmp_path):
    assert manifest_rows(op11_over(spark, docs, tmp_path)) == brute_manifest(rows)


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_of_many_blocks_and_subsets(spark, docs, rows, levels):
    """Small blocks take several passes; proofs of any subset hold, fetched coordinates are minimal."""
    cols = {c: F.col(c) for c in merkle.FIELDS}
    m = merkle.build(docs.select("doc_id", "lang", merkle.leaf_hash(cols.values()).alias("leaf")), levels)
    want = {(r[0], r[1]): r for r in brute_manifest(rows)}
    for some in (m.leaves, m.leaves.where("doc_id % 9 = 0"), m.leaves.where("doc_id = 902"), m.leaves.where("false")):
        got = merkle.prove(m, some, levels).withColumn("folded", merkle.fold(F.col("leaf"), F.col("__llm_proof"))).collect()
        assert len(got) == some.count()
        for r in got:
            w = want[-1 if r["doc_id"] is None else r["doc_id"], r["leaf"]]
            siblings = [x["digest"] for x in r["__llm_proof"] if x["digest"] is not None]
            assert (r["__llm_subroot"], r["__llm_root"], H(*siblings), r["folded"]) == (w[2], m.root, w[4], m.root)


def test_missing_is_minimal():
    """No fetched node can be derived from the requested leaves and the other fetched nodes."""
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 37, 64):
        for _ in range(20):
            pos = np.unique(rng.integers(0, n, rng.integers(1, n + 1)))
            need = merkle.missing(2, pos, n, 5)
            assert len(set(need)) == len(need)
            span = {(t, lv, i): set(range(i << lv, min((i + 1) << lv, n))) for t, lv, i in need if t == 2}
            covered = [x for s in span.values() for x in s] + pos.tolist()
            assert sorted(covered) == list(range(n))  # each leaf once: nothing twice, nothing derivable
            assert [x for x in need if x[0] == merkle.TOP] == [(-1, 0, 3), (-1, 1, 0), (-1, 2, 1)]  # of tree 2 among five


def test_manifest_one_tree_one_leaf_empty(spark, empty):
    one = spark.createDataFrame([(5, "en", "aa")], "doc_id long, lang string, leaf string")
    m = merkle.build(one)
    r = merkle.prove(m, m.leaves).first()
    assert (m.root, r["__llm_subroot"], r["__llm_root"], r["__llm_proof"]) == ("aa", "aa", "aa", [])
    m = merkle.build(empty.select("doc_id", "lang", F.lit("x").alias("leaf")))
    assert m.root is None and merkle.prove(m, m.leaves).count() == 0


def test_tampering_is_found(spark, docs):
    cols = {c: F.col(c) for c in merkle.FIELDS}
    m = merkle.build(docs.select("doc_id", "lang", merkle.leaf_hash(cols.values()).alias("leaf")))
    out = merkle.prove(m, m.leaves).withColumn("folded", merkle.fold(F.sha2("leaf", 256), F.col("__llm_proof")))
    assert out.where(F.col("folded") == m.root).count() == 0


# ---- sharding ---------------------------------------------------------------------------------

def brute_difference(sizes, ways):
    """Differencing with explicit lists of items in each bin."""
    parts = [(-s, k, [(s, [k])] + [(0, [])] * (ways - 1)) for k, s in enumerate(sizes)]
    made = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: p[:2])
        a, b = parts.pop(0)[2], parts.pop(0)[2]
        bins = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda p: -p[0])
        bins = [(s - bins[-1][0], items) for s, items in bins]
        parts.append((-bins[0][0], made, bins))
        made += 1
    return sorted(sum(sizes[k] for k in items) for _, items in parts[0][2])


def test_difference_is_karmarkar_karp():
    rng = np.random.default_rng(1)
    for ways in (2, 3, 8):
        for n in (1, 2, 5, 60):
            sizes = [int(x) for x in rng.integers(0, 1000, n)]
            got = [0] * ways
            for s, b in zip(sizes, sharding.difference(sizes, ways)):
                got[b] += s
            assert sorted(got) == brute_difference(sizes, ways)
    assert sharding.difference([], 8) == []
    assert sorted(brute_difference([8, 7, 6, 5, 4], 2)) == [14, 16]  # the example in the literature


@pytest.fixture(scope="module")
def many(spark):
    """One text in a third of all rows, one very long text, nulls, empties, repeated rows."""
    rng = np.random.default_rng(8)
    data = [(i, "x" * int(rng.integers(1, 400)) + str(i % 1500)) for i in range(2000)]
    data += [(5000 + i, "the same text") for i in range(1000)] + [(9000, "y" * 90_000), (9001, None), (9002, None), (9003, ""), (9003, ""), (None, "z")]
    return spark.createDataFrame([(*r, "l", "s", 1, *CLASH) for r in data], SCHEMA).repartition(4), data


@pytest.mark.parametrize("chunk, units", [(4096, 32_768), (64, 128)])
def test_sharding_plan(many, chunk, units):
    docs, data = many
    got = sharding.plan(docs, 8, chunk, units).collect()
    key = lambda d, t: (-1 if d is None else d, t is None, len((t or "").encode()) + 1)
    assert Counter((-1 if r["doc_id"] is None else r["doc_id"], r["text_crc32"], r["size"]) for r in got) == Counter(
        (-1 if d is None else d, None if t is None else zlib.crc32(t.encode()), key(d, t)[2]) for d, t in data)
    group, size, slots = {}, Counter(), {}
    for r in got:
        group.setdefault(r["group"], set()).add(r["shard"])
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]))
    assert all(len(s) == 1 for s in group.values()) and len(size) == 8
    # the two large items fix the best spread of the others: all but their shards are near equal
    rest = sorted(size.values())
    assert max(rest[-1] - max(90_001, rest[0]), 0) <= 700 or rest[-1] - rest[0] <= 700
    for s in slots.values():
        s.sort()
        assert [a for a, _ in s] == list(range(len(s))) and [d for _, d in s] == sorted(d for _, d in s)
    again = sharding.plan(docs.repartition(7), 8, chunk, units).collect()
    assert Counter((r["doc_id"], r["group"], r["shard"]) for r in again) == Counter((r["doc_id"], r["group"], r["shard"]) for r in got)


def test_sharding_is_the_plain_method_when_all_fits(many):
    docs, data = many
    sums = Counter()
    for _, t in data:
        sums["null" if t is None else hashlib.sha256(t.encode()).hexdigest()] += len((t or "").encode()) + 1
    total = Counter()
    for r in sharding.plan(docs).collect():
        total[r["shard"]] += r["size"]
    ordered = [s for _, s in sorted(sums.items(), key=lambda x: (-x[1], x[0]))]
    assert sorted(total.values()) == brute_difference(ordered, 8)


def test_sharding_empty_and_query(spark, empty, many, tmp_path):
    assert sharding.plan(empty).count() == 0
    docs, data = many
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.op12_karmarkar_karp(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert out.where("law <> 'bytes' or grown_shard is not null").count() == 0 and out.count() == len(data)


def test_shard_files(spark, many, tmp_path):
    docs, data = many
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "shard"}
    assert Counter((r[0], r[1]) for r in back.select("doc_id", "text").collect()) == Counter(data)
    with pytest.raises(ValueError):
        sharding.write_shards(back, str(tmp_path / "again"))


# ---- spelling ---------------------------------------------------------------------------------

def brute_words(rows, drop_every=31):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % drop_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_forms(n, ratio=10):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def spelled(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=lambda r: r[0])


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    base = ["committee", "aabbaabba", "zzzzzzzz", "éclatante", "Ébauchées", "receive" * 2]
    letters = list("abcez") + ["é", "Ø"]
    data = []
    for i in range(120):
        out = []
        for _ in range(60):
            w = base[int(rng.choice(6, p=[.4, .2, .1, .1, .1, .1]))]
            for _ in range(int(rng.choice(3, p=[.8, .15, .05]))):
                at, how = int(rng.integers(len(w))), int(rng.integers(3))
                w = w[:at] + ("" if how == 0 else str(rng.choice(letters))) + w[at + (how < 2):]
            out.append(w)
        data.append((i, " ".join(out)))
    data += [(500, None), (501, ""), (502, "short ones only 12345678 日本語日本語日本語"), (None, "Committee COMMITTEE commitee commitee"), (503, data[0][1]), (503, data[0][1]),
             (504, " ".join(["a" * 3000, "a" * 3001, "a" * 1500 + "b" + "a" * 1499] * 2)), (505, "×÷×÷×÷× ×÷×÷×÷× aaaaaaaŸaaaaaaa")]
    return data


@pytest.mark.parametrize("block", [spelling.BLOCK, 5])
def test_spelling(spark, texts, block):
    docs = spark.createDataFrame([(*r, "l", "s", 1, *CLASH) for r in texts], SCHEMA).repartition(4)
    want = brute_words(texts)
    counted = spelling.words(docs)
    assert {r["word"]: r["n"] for r in counted.collect()} == want
    assert spelled(spelling.forms(counted, 10, block)) == brute_forms(want)


def test_spelling_chains_and_ties(spark):
    """Forms of forms, equal counts, and words of equal letters."""
    n = {"abcdefgh": 5000, "abcdefgx": 400, "abcdefxx": 30, "abcdexxx": 2, "abcdefg": 400, "aaaaaaa": 3, "aaaaaaaa": 3, "zzzzzzz": 40, "zzzzzzzy": 400, "zzzzzzzx": 400}
    got = spelled(spelling.forms(spark.createDataFrame(list(n.items()), "word string, n long"), 10, 3))
    assert got == brute_forms(n)
    by = {r[0]: r for r in got}
    assert by["abcdexxx"][2] == "abcdefgh" and by["zzzzzzz"][1] == "zzzzzzzx"


def test_trie_nodes_are_the_trie(spark):
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 9))) for _ in range(150)})
    rows = spark.createDataFrame([(i, w, i) for i, w in enumerate(words)], "id long, word string, pos long")
    for block in (1, 7, 1000):
        node = {}
        for r in spelling.trie_nodes(rows, block).collect():
            for k, x in enumerate(r["nodes"]):
                assert node.setdefault(words[r["id"]][:k + 1], x) == x
        assert len(set(node.values())) == len(node) and 0 not in node.values()


def test_spelling_empty(spark, empty):
    assert spelling.forms(spelling.words(empty)).count() == 0
