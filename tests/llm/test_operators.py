"""Each operator against a brute-force version, with nulls, ties, repeats, empty and long texts."""

import hashlib
import re
import string
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sparkseries.llm import ann, bpe, dac, line_dedup, mixing, ngram_join, ppm, quality, suffix_dedup, toxicity
from sparkseries.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n long, score double"


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words, n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 300)
    passage = prose(2, 70)
    words = base.split()
    near = " ".join(words[:150] + ["changed"] + words[151:])
    lines = "\n".join(prose(10 + i, 9) for i in range(8))
    data = [
        (0, base, "en", "b", 1), (1, base, "en", "a", 1), (2, near, "en", None, 1), (3, None, None, "a", None),
        (4, "", "de", "c", 0), (5, " \t\n ", "de", "c", 4), (6, "two Words", "de", "c", 9), (7, "Two words", "de", "c", 9),
        (8, prose(3, 80) + " " + passage + " " + prose(4, 60), "fr", "a", 1), (9, passage + " " + prose(5, 90), "fr", "b", 1),
        (10, lines, "en", "b", 1), (11, prose(6, 12) + "\n\n" + lines + "\nend of it", "en", "a", 1), (11, lines, "en", "a", 1),
        (12, "aa\naa\naa\naa", "en", "b", 1), (None, base, "en", "a", 1), (13, prose(7, 6000), "en", "d", 1),
        (14, "$$ ## " * 80, "en", "d", 1), (15, "日本 語 " * 60, "en", "d", 1), (15, "日本 語 " * 60, "en", "d", 1),
    ]
    return [r + (7, 7, 0.5) for r in data]  # the last columns clash with inner names


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def some(x):
    return -1 if x is None else int(x)


def collect(df, *cols):
    return sorted(tuple(some(r[c]) if c == "doc_id" else r[c] for c in cols) for r in df.collect())


# ---- components -------------------------------------------------------------------------------

def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 75), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, 75: 50, 100: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- n-gram join ------------------------------------------------------------------------------

def brute_components(rows, n, pct):
    sets = {}
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOWER))
        k = min(n, len(w))
        if r[0] is not None:
            sets.setdefault(r[0], []).append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= pct * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("n, pct", [(4, 85), (5, 80)])
def test_ngram_join(docs, rows, n, pct):
    want = brute_components(rows, n, pct)
    got = ngram_join.link_components(docs, n, pct).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == {**want, None: None}


def test_ngram_join_random(spark, monkeypatch):
    """Short texts over few words: many links, chains and open keys; small tiles."""
    monkeypatch.setattr(ngram_join, "TILE", 4)
    rng = np.random.default_rng(5)
    data, bases = [], [prose(s, 40, 30).split() for s in range(12)]
    for i in range(240):
        w = list(bases[rng.integers(len(bases))])
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(len(w))] = "x" + str(rng.integers(6))
        data.append((i, " ".join(w[:rng.integers(25, 41)])))
    got = ngram_join.link_components(spark.createDataFrame(data, "doc_id long, text string"), 4, 60)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute_components(data, 4, 60)


def test_signature_bounds_overlap():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[::2], rng.integers(0, 1 << 63, 50).astype(np.uint64)]))
        diff = int(np.bitwise_count(ngram_join.signature(a).view(np.uint64) ^ ngram_join.signature(b).view(np.uint64)).sum())
        assert (len(a) + len(b) - diff) // 2 >= len(np.intersect1d(a, b))


def test_near_duplicate_stage(spark, docs, rows):
    kept = ngram_join.stage_near_duplicates(spark, docs, "")
    want = brute_components(rows, 5, 80)
    assert kept.columns == docs.columns
    assert collect(kept, "doc_id") == sorted([(i,) for i, c in want.items() if i == c] + [(-1,)])


# ---- quality ----------------------------------------------------------------------------------

def brute_counts(text):
    words = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside))


def test_rule_counts(rows):
    for r in rows:
        if len(r[1] or "") < 5000:
            assert quality.rule_stats(r[1])[:5] == brute_counts(r[1]), r[0]
    assert quality.rule_stats("a a a")[4] == 0 and quality.rule_stats("a a a a")[4] == 4


def test_quality_verdicts(spark):
    good = [(i, prose(i, 120)) for i in range(300)]
    short = [(5000, "few words"), (5001, None), (5002, "again and again " * 40)]
    docs = spark.createDataFrame(good + short, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}  # labels of one kind
    assert all(out[i]["kept"] for i, _ in good)
    assert all(out[i]["base_failed"] and not out[i]["kept"] for i, _ in short)
    assert all(r["kept"] != r["base_failed"] for r in quality.judge(docs, labels.limit(0)).collect())
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_quality_on_labelled_rows(spark):
    """The forest never sees labels; on the given table it has to tell the labelled kinds apart."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = quality.judge(spark.read.parquet(f"{d}/documents.parquet"), labels).where("not base_failed")
    got = {r["quality"]: r["kept"] for r in out.join(labels, "doc_id").groupBy("quality").agg({"kept": "count"})
           .withColumnRenamed("count(kept)", "kept").collect()}
    kept = {r["quality"]: r["n"] for r in out.where("kept").join(labels, "doc_id").groupBy("quality").count()
            .withColumnRenamed("count", "n").collect()}
    assert kept.get(0, 0) <= 0.05 * got[0] and kept[1] >= 0.99 * got[1]


def test_forest_score_is_the_mean_path():
    x = np.random.default_rng(2).standard_normal((700, 4))
    trees = quality.grow_forest(x)
    for row, score in list(zip(x, quality.forest_score(trees, x)))[::97]:
        total = 0.0
        for feat, split, left, path, _ in trees:
            at = 0
            while feat[at] >= 0:
                at = left[at] + (row[feat[at]] >= split[at])
            total += path[at]
        assert score == pytest.approx(2 ** (-total / len(trees) / quality._path_norm(quality.TREE_ROWS)))


# ---- line dedup -------------------------------------------------------------------------------

def brute_lines(rows):
    texts = sorted({(some(r[0]), r[1]) for r in rows if r[1] is not None})
    seen, gone = set(), defaultdict(set)
    for d, t in texts:
        for i, x in enumerate(t.split("\n")):
            if WORD.search(x):
                if x in seen:
                    gone[d, t].add(i)
                seen.add(x)
    return {k: "\n".join(x for i, x in enumerate(k[1].split("\n")) if i not in gone[k]) for k in texts}


def test_line_runs_are_exact(spark):
    """Every run is the whole common prefix with its source, which is earlier; runs cover all later
    copies and none begins inside another of the same source; a minimum keeps short runs."""
    rng = np.random.default_rng(12)
    data = [(i, "\n".join(f"line {x}" for x in rng.integers(0, 25 if i % 3 else 4, rng.integers(1, 40)))) for i in range(60)]
    data += [(100, "\n\n".join(f"line {x}" for x in range(300))), (101, "\n".join(f"line {x}" for x in range(2, 299))), (102, "a\n" * 37)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    lines = {d: [x for x in t.split("\n") if WORD.search(x)] for d, t in data}
    rounds = line_dedup.repeated_suffixes(df)
    runs = line_dedup.maximal_runs(rounds).collect()
    covered = set()
    for r in runs:
        a, b = lines[r["doc_id"]][r["pos"]:], lines[r["src"]["doc_id"]][r["src"]["pos"]:]
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert r["length"] == common and (r["src"]["doc_id"], r["src"]["pos"]) < (r["doc_id"], r["pos"])
        covered |= {(r["doc_id"], r["pos"] + i) for i in range(common)}
    seen, later = set(), set()
    for d in sorted(lines):
        for i, x in enumerate(lines[d]):
            if x in seen:
                later.add((d, i))
            seen.add(x)
    assert covered == later
    assert max(r["length"] for r in runs) == 297
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, 30).collect()}
    assert got[101]["__llm_gone"] == 297 and got[101]["__llm_longest"] == 297 and got[102]["__llm_gone"] == 36
    assert sum(r["__llm_gone"] for r in got.values()) < len(later)


def test_line_dedup(spark, docs, rows):
    one_text = [r for r in rows if r[0] != 11]  # an id of its own for each text
    df = spark.createDataFrame(one_text, SCHEMA)
    got = {(some(r["doc_id"]), r["text"]): r["__llm_text"] for r in line_dedup.dedup_lines(df).collect() if r["text"] is not None}
    assert got == brute_lines(one_text)
    stage = line_dedup.stage_line_dedup(spark, docs, "")
    assert stage.columns == docs.columns
    kept = [r["text"] for r in stage.where("doc_id in (10, 11)").collect()]
    lines = rows[10][1].split("\n")
    assert all(any(x in (t or "").split("\n") for t in kept) for x in lines)  # no line is lost
    assert sum((t or "").count(lines[0]) for t in kept) == 1


def test_line_dedup_stage_deletes_single_lines(spark):
    """A passage that is one line between different neighbours, short lines, one-line documents."""
    passage = prose(40, 60)
    data = [(0, f"{prose(41, 9)}\n{passage}\n{prose(42, 9)}"), (1, f"{prose(43, 9)}\n\n{passage}\n{prose(44, 9)}"),
            (2, passage), (3, f"short\n{prose(45, 9)}\nshort\nshort"), (4, None), (5, "short\nnew")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.stage_line_dedup(spark, spark.createDataFrame(data, "doc_id long, text string"), "").collect()}
    assert got == {0: data[0][1], 1: f"{prose(43, 9)}\n\n{prose(44, 9)}", 3: f"short\n{prose(45, 9)}", 4: None, 5: "new"}


# ---- mixing -----------------------------------------------------------------------------------

def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / share > 3 * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weight[s] / share for s in open_}
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(spark, docs, rows):
    rng = np.random.default_rng(1)
    data = [(i, "w " * int(rng.integers(1, 80)), rng.choice(["a", "b", "c", "d"]), 1) for i in range(4000)]
    data += [(5000, None, "a", 1), (5001, "x y", None, 1), (5002, "x", "Z", 1), (5002, "x", "Z", 1)]
    df = spark.createDataFrame([(i, t, None if s is None else str(s), size) for i, t, s, size in data],
                               "doc_id long, text string, source string, size int")
    out = mixing.mix(df).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = brute_targets(dict(sizes))
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in want:
        assert abs(taken[s] - want[s]) <= 80
    key = lambda r: (some(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, mixing.mix(df.repartition(7)).collect()))
    stage = mixing.stage_mixing(spark, docs, "")
    copies = defaultdict(int)
    for r in mixing.mix(docs).collect():
        copies[some(r["doc_id"])] += r["copies"]
    assert stage.columns == docs.columns
    count = defaultdict(int)
    for r in stage.collect():
        count[some(r["doc_id"])] += 1
    assert dict(count) == {k: v for k, v in copies.items() if v}


# ---- byte-level BPE and token files -----------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizers_():
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), t


ODD = [(100, "a" * 700 + " b\n\n  c" + "\t" * 90 + "x  y"), (101, "it's   I'll\x1c!\x1c wé  " * 40), (102, "<|endoftext|> x\n"), (104, "a <|endoftext|> b"), (105, "x<|endoftext|>"),
       (103, "nul\x00 in it"), (104, "日本語 テキスト　" * 50)]


@pytest.mark.parametrize("chunk, overlap", [(200, 30), (32_768, 256)])
def test_bpe(spark, rows, tokenizers_, chunk, overlap):
    data = [(r[0], r[1]) for r in rows] + ODD
    out = bpe.digests(spark.createDataFrame(data, "doc_id long, text string").repartition(3), *bpe._vocabulary(), chunk, overlap)
    want = []
    for i, t in data:
        ids = tokenizers_[0].encode_ordinary(t or "")
        want.append((some(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert collect(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_bpe_long_blank_runs(spark, tokenizers_, monkeypatch):
    """Runs that the library cannot take whole, against the library on the pieces around them; short
    runs, with a small bound, against the library itself."""
    plain, _ = tokenizers_
    blanks = {" " * 2_000_000: " ", "\n" * 2_000_000: "\n", " \n\t" * 400_000: "\t"}
    data, want = [], []
    for k, (run, last) in enumerate(blanks.items()):
        single = plain._encode_single_piece(run[:-1])
        data.append((k, "a b" + run + "x y" + run))
        want.append((k, plain.encode_ordinary("a b") + single + plain.encode_ordinary(last + "x y") + plain._encode_single_piece(run)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for out in (bpe.digests(docs, *bpe._vocabulary()), bpe.stage_byte_bpe(spark, docs, "")):
        got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()}
        assert got == {k: (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
                       for (k, ids), (_, t) in zip(want, data)}
    monkeypatch.setattr(bpe, "BLANKS", 3)
    monkeypatch.setattr(bpe, "LONG_BLANKS", bpe.regex.compile(r"\s{4,}"))
    codec = bpe.Codec.of(*bpe._vocabulary())
    for text in ("a    b", "    b", "a    ", "a\n\n\n\n\nb  c \t\r\n 's", "  \u00a0\u3000\n x     \n     y", "x" + " " * 50 + "9" + "\n" * 9):
        assert codec.encode(text) == plain.encode_ordinary(text)


def test_token_files(spark, rows, tokenizers_, tmp_path):
    import public_tokenizers as P
    data = [(r[0], r[1]) for r in rows if r[0] != 11] + ODD
    path = str(tmp_path / "tokens")
    dac.write_tokens(spark.createDataFrame(data, "doc_id long, text string").repartition(4), path, P.path("byte_bpe_50k.json"), P.PATTERN, 300)
    start, want, every = 0, [], []
    for i, t in sorted(data, key=lambda r: some(r[0])):
        ids = (tokenizers_[1].encode(t, add_special_tokens=False).ids if t else []) + [0]
        want.append((some(i), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        every += ids
    assert collect(dac.read_documents(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want)
    for s in dac.read_segments(spark, path).collect():
        seg = dac.Segment(bytes(s["payload"]))
        assert [seg[i] for i in range(0, seg.n_ids, 3)] == every[s["start"]:s["start"] + seg.n_ids][::3]


def test_codes_of_any_width():
    ids = np.concatenate([np.arange(0, 2000), [255, 256, 65535, 65536, 2 ** 24, 2 ** 32 - 1]]).astype(np.uint32)
    seg = dac.Segment(dac.pack_segment([1], np.array([len(ids)]), ids))
    assert (seg.ids() == ids).all() and [seg[i] for i in range(len(ids))] == ids.tolist()
    with pytest.raises(IndexError):
        seg[len(ids)]


# ---- suffix dedup -----------------------------------------------------------------------------

def brute_spans(rows):
    windows = defaultdict(list)
    for r in rows:
        w = WORD.findall(r[1] or "")
        for p in range(len(w) - 49):
            windows[tuple(w[p:p + 50])].append((some(r[0]), p))
    hits = defaultdict(dict)
    for places in windows.values():
        if len(places) > 1:
            for d, p in places:
                hits[d][p] = (d, p) != min(places)
    out = []
    for d, at in hits.items():
        for p in sorted(at):
            if out and out[-1][0] == d and p <= out[-1][2]:
                out[-1][2], out[-1][3] = p + 50, out[-1][3] or at[p]
            else:
                out.append([d, p, p + 50, at[p]])
    return sorted(map(tuple, out))


def test_suffix_spans(spark, rows):
    own = [r for i, r in enumerate(rows) if r[0] is not None and (r[0] not in (11, 15) or r[0] != rows[i - 1][0])]
    filler = [prose(50 + i, 90) for i in range(6)]
    passage = prose(99, 64)
    extra = [(200 + i, f"{f[:i * 7]} {passage if i % 2 else passage[:330]} {f}") for i, f in enumerate(filler)]
    data = [(r[0], r[1]) for r in own] + extra + [(300, passage + " " + passage)]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(data, "doc_id long, text string").repartition(3))
    assert collect(got, "doc_id", "start_word", "end_word", "is_copy") == brute_spans(data)


# ---- learned operators ------------------------------------------------------------------------

def test_ppm_lengths_are_a_code():
    """Code lengths of all bytes after a context leave a probability of at most 1."""
    trees = ppm.Trees({"x": [b"abracadabra " * 20], "y": [b"the cat sat on the mat " * 20]})
    for context in (b"abra", b"the ", b"zzzz", b"\0\0\0c"):
        bits = trees.text_lengths([context + bytes([b]) for b in range(256)]) - trees.text_lengths([context] * 256)
        assert (np.exp2(-bits).sum(axis=0) <= 1.0001).all()
    a = trees.text_lengths([b"abracadabra the cat"])
    monkey = ppm.SLICE
    try:
        ppm.SLICE = 5
        assert np.allclose(a, trees.text_lengths([b"abracadabra the cat"]))
    finally:
        ppm.SLICE = monkey


def test_ppm_predicts(spark, docs, empty):
    words = {"aa": "der die und nicht ein zu", "bb": "the of and to in is", "cc": "le la les des est que"}
    rng = np.random.default_rng(3)
    data = [(i, " ".join(rng.choice(words[x].split(), 30)), x) for i, x in enumerate(list(words) * 30)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    trees = ppm.learn(df.where("doc_id < 60"))
    out = {r["doc_id"]: r for r in ppm.predict(df, trees).collect()}
    assert all(out[i]["lang_pred"] == x for i, _, x in data)
    odd = {some(r["doc_id"]): r for r in ppm.predict(docs, trees).collect()}
    assert odd[3]["lang_pred"] == odd[4]["lang_pred"] == odd[5]["lang_pred"] == odd[14]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in odd.values()) and len(odd) == 17
    assert ppm.predict(empty, trees).count() == 0
    assert {r["lang_pred"] for r in ppm.predict(docs, ppm.learn(empty)).collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(4)
    data = []
    for i in range(600):
        w = prose(int(rng.integers(1000)) + 100, 90).split()
        bad = i % 5 == 0
        for k in rng.choice(90, 4 if bad else 0, replace=False):
            w[k] = str(rng.choice(["horribleword", "nastything", "vilethought"]))
        data.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.Model(df.where("doc_id < 450"))
    out = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [(out[i] >= 0.3, bad) for i, _, bad in data if i >= 450]
    assert sum(p == b for p, b in held) >= 0.95 * len(held)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(empty, model).count() == 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.Model(df.where("toxic = 0"))).collect()} == {0.0}


# ---- neighbours -------------------------------------------------------------------------------

def test_nearest(spark):
    rng = np.random.default_rng(0)
    center = rng.standard_normal((12, 24))
    v = center[rng.integers(12, size=1500)] + 0.4 * rng.standard_normal((1500, 24))
    v[700:900] = v[0]  # one common vector
    data = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(5000, None), (5050, [0.0] * 24), (5100, [1.0] * 23 + [float("nan")]), (5150, [1.0] * 5), (5200, [None] + [1.0] * 23)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 50))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = 0
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s.round(12)))[:5].tolist()
        hit += len(set(want) & {i for i, _ in found})
        assert len(found) == 5 and all(abs(s[i] - x) < 1e-12 for i, x in found)
    assert hit >= 0.9 * 5 * len(got)
    assert [i for i, _ in got[700]] == [0, 701, 702, 703, 704]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_nearest_repeated_rows_in_a_group_of_equal_vectors(spark):
    from pyspark.sql import functions as F
    data = [(1, [1.0, 2.0, 2.0])] * 6 + [(i, [1.0, 2.0, 2.0]) for i in range(2, 9)] + [(20 + i, [1.0, -float(i), 0.5]) for i in range(9)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") == 1).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 3, 4, 5, 6] and all(abs(r["score"] - 1) < 1e-12 for r in got)


# ---- empty tables -----------------------------------------------------------------------------

def test_empty_tables(spark, empty):
    import public_tokenizers as P
    assert ngram_join.link_components(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.stage_mixing(spark, empty, "").count() == 0
    assert bpe.digests(empty, *bpe._vocabulary()).count() == 0
    assert suffix_dedup.repeated_spans(empty).count() == 0
    path = f"{spark.sparkContext.getCheckpointDir()}/empty-tokens"
    dac.write_tokens(empty, path, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert dac.read_documents(spark, path).count() == 0
