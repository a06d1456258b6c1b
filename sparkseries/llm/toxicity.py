"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text.  The ordinary one is trained on windows of
ordinary text.  The toxic one holds the same content (so that common prose costs the same under
both and cancels) and in front of it what marks toxic text: the words whose share of distinct
contexts lies in toxic documents far more than chance allows.  (Training it on whole toxic
windows alone was tried: such documents are mostly ordinary prose, and 12 of 990 clean documents
of the small table came out ahead of 2 of 120 toxic ones.)  A window that the toxic dictionary
compresses into fewer bytes than the ordinary one is nearer to toxic text.  A document is
described by its window differences, and a logistic curve fitted on labelled rows turns them into
a score.

Bounds: the dictionaries see about ``TRAIN_ROWS`` labelled documents and the curve about
``CURVE_ROWS`` (chosen by a hash).  Every window of every whole text is scored.

Defined results: null, empty and blank texts have no windows and get the score of the curve at
difference 0; no labelled rows of one kind: score 0 for all; repeated rows get equal scores; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialize, table

WINDOW_WORDS = 12
TRAIN_ROWS = 10_000
CURVE_ROWS = 20_000
ORDINARY_BYTES = 32_768
MARK_BYTES = 2_048
MARK_Z = 6.0
SEEN_CONTEXTS = 200_000  # contexts a task holds before it sends them on
LEVEL = 3
THRESHOLD = 0.3
N_FEATURES = 9
WORD = re.compile(r"[^\W\d_]+")


def windows(text: str | None) -> list[bytes]:
    """Consecutive windows of lower-cased words; the whole text is covered."""
    words = text.lower().encode().split() if text else []
    return [b" " + b" ".join(words[i:i + WINDOW_WORDS]) for i in range(0, len(words), WINDOW_WORDS)]


def ordinary_content(texts: list[str]) -> bytes:
    samples = [w for t in texts for w in windows(t)]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes serve
        return b"".join(samples)[-ORDINARY_BYTES:]


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, t, o): the distinct contexts (the words before and after) in which each word is seen in
    toxic and in other documents of ``rows(text, toxic)``; copies of a text add no context."""
    def run(batches):
        for b in batches:
            seen = [set(), set()]
            for text, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = ["", *WORD.findall((text or "").lower()), ""]
                seen[kind].update(zip(words[1:-1], words, words[2:]))
                if len(seen[kind]) >= SEEN_CONTEXTS:  # on it goes; the same context again is dropped later
                    yield contexts(seen)
                    seen = [set(), set()]
            yield contexts(seen)

    def contexts(seen):
        each = [(w, xxhash.xxh3_64_intdigest(f"{a} {c}") - (1 << 63), k) for k in (0, 1) for w, a, c in seen[k]]
        word, near, kind = zip(*each) if each else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.int64()), pa.array(kind, pa.int32())],
                                          names=["word", "near", "kind"])

    found = rows.select("text", "toxic").mapInArrow(run, "word string, near long, kind int").distinct()
    return found.groupBy("word").agg(F.sum("kind").cast("long").alias("t"), F.sum(1 - F.col("kind")).cast("long").alias("o"))


def marks(rows: DataFrame) -> bytes:
    """Words of toxic text, by the number of distinct contexts in toxic and in other documents."""
    counts = materialize(word_counts(rows), "toxic-words")
    toxic, other = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("o"), F.lit(0))).first()
    share = toxic / max(toxic + other, 1)
    n = F.col("t") + F.col("o")
    z = (F.col("t") - n * share) / F.sqrt(n * share * (1 - share) + 1)
    # the strongest only: of words of three bytes or more, no more than this many have room
    found = (counts.select("word", "t", z.alias("z")).where((F.col("z") >= MARK_Z) & (F.col("t") >= 4) & (F.length("word") >= 3))
             .orderBy(F.desc("z"), F.desc("word")).limit(MARK_BYTES // 4 + 1).select("word").collect())
    out = b""
    for (w,) in found:  # the strongest end up last, nearest to the text
        if len(out) + len(w.encode()) + 1 > MARK_BYTES:
            break
        out = b" " + w.encode() + out
    return out


def ordinary_dictionary(rows: DataFrame) -> bytes:
    """The ordinary dictionary of ``rows(doc_id, text)``, trained in a task: the training holds several
    times the bytes of the (bounded) rows, which the driver does not see."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        return pa.table({"content": pa.array([ordinary_content([x or "" for x in t["text"].to_pylist()])], pa.binary())})

    got = rows.select("doc_id", "text", F.lit(0).alias("one")).groupBy("one").applyInArrow(run, "content binary").first()
    return bytes(got[0])


def fit_dictionaries(rows: DataFrame) -> tuple[bytes, bytes]:
    """The two dictionaries of ``rows(doc_id, text, toxic)``."""
    plain = ordinary_dictionary(rows.where("toxic = 0"))
    return plain, marks(rows) + plain


class Distance:
    """Compressed lengths under the two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        # every place of a dictionary is searched, for matches of four bytes or more
        p = zstandard.ZstdCompressionParameters(
            window_log=17, chain_log=16, hash_log=16, search_log=6, min_match=4, strategy=zstandard.STRATEGY_GREEDY,
            write_checksum=False, write_content_size=False, write_dict_id=False)
        self.parts = []
        for raw in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(raw or b"        ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.parts.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d))

    def of(self, rows: list[bytes]) -> np.ndarray:
        """Bytes saved by the toxic dictionary, per window."""
        a, b = (np.fromiter((len(c.compress(w)) for w in rows), np.int32, len(rows)) for c in self.parts)
        return a - b

    def features(self, texts: list) -> np.ndarray:
        """Three largest differences, log windows, windows by bytes saved and their shares, per text."""
        every = [windows(t) for t in texts]
        out = np.zeros((len(texts), N_FEATURES))
        d = self.of([w for ws in every for w in ws])
        at = 0
        for i, ws in enumerate(every):
            if ws:
                own = d[at:at + len(ws)]
                top = np.sort(own)[::-1][:3]
                out[i, :len(top)] = top
                n, h5, h4, h3 = len(ws), (own >= 5).sum(), (own >= 4).sum(), (own >= 3).sum()
                out[i, 3:] = np.log(n), np.sqrt(h5), np.sqrt(h4), np.sqrt(h3), h5 / n, h3 / n
                at += len(ws)
        return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps; the scale of x goes into w."""
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / dev])
    w, ridge = np.zeros(a.shape[1]), 1e-2 * np.eye(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    out = np.concatenate([[w[0] - (w[1:] * mean / dev).sum()], w[1:] / dev])
    return out


NAMES = [f"f{i}" for i in range(N_FEATURES)]


class Model:
    """Dictionaries and curve from ``rows(doc_id, text, toxic)``, all of which are training rows."""

    def __init__(self, rows: DataFrame):
        self.curve = None
        rows = rows.where("toxic in (0, 1)")
        total = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
        if len(total) < 2:
            return

        def sample(seed, size):
            share = size / sum(total.values())
            return rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30)))

        train = materialize(sample(6, TRAIN_ROWS).select("doc_id", "text", "toxic"), "toxic-train")
        if train.select("toxic").distinct().count() < 2:
            return
        self.dictionaries = fit_dictionaries(train)
        data = features(sample(7, CURVE_ROWS), self.dictionaries, extra=["toxic"]).toPandas()
        self.curve = fit_curve(data[NAMES].to_numpy(float), data["toxic"].to_numpy(float))


def features(docs: DataFrame, dictionaries: tuple[bytes, bytes], extra: list[str] = ()) -> DataFrame:
    """(doc_id, *extra, f0, f1, ...) per row."""
    kept = ["doc_id", *extra]

    def run(batches):
        d = Distance(*dictionaries)
        for b in batches:
            f = d.features(b.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], *(pa.array(c) for c in f.T.copy())],
                                             names=[*kept, *NAMES])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, "text").mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} double" for c in NAMES))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row of ``docs(doc_id, text)``."""
    if model.curve is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    w = model.curve
    f = features(docs, model.dictionaries)
    z = sum((c * float(k) for c, k in zip(map(F.col, NAMES), w[1:])), F.lit(float(w[0])))
    return f.select("doc_id", (F.lit(1.0) / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0))))).alias("score"))


def op6_compression_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = (table(spark, sf_dir, "labels").where("toxic is not null").groupBy("doc_id")
              .agg(F.max("toxic").cast("int").alias("toxic")))
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    train = docs.select("doc_id", "text").where(~held).join(labels, "doc_id")
    out = score(docs, Model(train))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
