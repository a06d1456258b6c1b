"""Language identification by prediction by partial matching.

For each language a context tree over bytes counts which byte follows which context of up to
``ORDER`` bytes.  The code length of a byte is that of the longest context which the language has
seen: -log2(c / (T + D)) if the byte was seen there, else the escape -log2(D / (T + D)) plus its
code length in the next shorter context, down to 8 bits without context (T occurrences and D
distinct bytes in the context).  The statistics are frozen, so the code length of a text is a sum
over its (ORDER + 1)-grams of a fixed number per language; the language with the shortest code
wins and the score is its share of 2 ** -length.

Trees are grown from a bounded sample of the training rows: about ``WINDOWS`` windows of
``WINDOW`` characters for each language, at most ``MAX_LANGS`` languages.  Every byte of every
whole text is scored.

Defined results: null text or text without a letter gives ``und`` with score 0; no training rows:
``und`` everywhere; equal code lengths go to the first language in order; repeated rows get equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, table

ORDER = 4
WINDOW = 1000
WINDOWS = 700
MAX_LANGS = 256
SLICE = 1 << 19
LETTER = regex.compile(r"\p{L}")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Codes of the n-grams that end at each place (zeros before the beginning)."""
    code = data.astype(np.uint64)
    for i in range(1, n):
        code[i:] |= data[:-i].astype(np.uint64) << np.uint64(8 * i) if i < len(data) else 0
    return code


class Lookup:
    """Sorted distinct codes -> row number or -1, by a slot table with an exact second step."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        bits = max(8, int(np.ceil(np.log2(len(codes) + 1))) + 3)
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        at = ((codes * _SPREAD) >> self.shift).astype(np.int64)
        self.slots[at] = np.arange(len(codes), dtype=np.int32)
        lost = np.flatnonzero(self.slots[at] != np.arange(len(codes)))
        self.over, self.over_rows = codes[lost], lost  # shared slots, in order of code

    def find(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(codes), -1, np.int64)
        rows = self.slots[(codes * _SPREAD) >> self.shift].astype(np.int64)
        miss = np.flatnonzero(self.codes[rows] != codes)
        rows[miss] = -1
        if len(self.over) and len(miss):
            j = np.minimum(np.searchsorted(self.over, codes[miss]), len(self.over) - 1)
            hit = self.over[j] == codes[miss]
            rows[miss[hit]] = self.over_rows[j[hit]]
        return rows


class Trees:
    """Frozen context trees of all languages, as tables of code lengths in bits."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.langs = sorted(samples)
        self.order = order
        n_lang = len(self.langs)
        data = {x: [np.frombuffer(b, np.uint8) for b in samples[x] if b] for x in self.langs}
        self.gram, self.cost, self.ctx, self.escape = [], [], [], []
        for k in range(order + 1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            counts = []
            for x in self.langs:
                every = [grams(d, k + 1) & mask for d in data[x]]
                counts.append(np.unique(np.concatenate(every) if every else np.zeros(0, np.uint64), return_counts=True))
            codes = np.unique(np.concatenate([c for c, _ in counts])) if counts else np.zeros(0, np.uint64)
            contexts = np.unique(codes >> np.uint64(8))
            escape = np.zeros((len(contexts), n_lang), np.float32)
            # what an unseen byte costs in the next shorter contexts, by language
            low = self.lengths(codes & np.uint64(max((1 << 8 * k) - 1, 0)), k - 1)
            cost = low.astype(np.float32)
            for j, (c, n) in enumerate(counts):
                if not len(c):
                    continue
                ctx, first, inverse = np.unique(c >> np.uint64(8), return_index=True, return_inverse=True)
                total = np.bincount(inverse, n)
                kinds = np.bincount(inverse)
                esc = -np.log2(kinds / (total + kinds))
                escape[np.searchsorted(contexts, ctx), j] = esc
            cost += escape[np.searchsorted(contexts, codes >> np.uint64(8))]
            for j, (c, n) in enumerate(counts):
                if len(c):
                    _, inverse = np.unique(c >> np.uint64(8), return_inverse=True)
                    room = np.bincount(inverse, n) + np.bincount(inverse)
                    cost[np.searchsorted(codes, c), j] = -np.log2(n / room[inverse])
            self.gram.append(Lookup(codes))
            self.cost.append(cost)
            self.ctx.append(Lookup(contexts))
            self.escape.append(escape)

    def lengths(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Code lengths (rows, languages) of (k + 1)-grams in contexts of k bytes."""
        if k < 0:
            return np.full((len(codes), len(self.langs)), 8.0, np.float32)
        rows = self.gram[k].find(codes)
        out = self.cost[k][np.maximum(rows, 0)] if len(self.cost[k]) else np.zeros((len(codes), len(self.langs)), np.float32)
        miss = np.flatnonzero(rows < 0)
        if len(miss):
            low = self.lengths(codes[miss] & np.uint64((1 << 8 * k) - 1), k - 1)
            at = self.ctx[k].find(codes[miss] >> np.uint64(8))
            seen = np.flatnonzero(at >= 0)
            low[seen] += self.escape[k][at[seen]]
            out[miss] = low
        return out

    def text_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        total = np.zeros((len(texts), len(self.langs)))
        mask = np.uint64((1 << 8 * (self.order + 1)) - 1)
        todo, size = [], 0

        def flush():
            if todo:
                sums = np.add.reduceat(self.lengths(np.concatenate([c for _, c in todo]), self.order),
                                       np.cumsum([0] + [len(c) for _, c in todo[:-1]]), axis=0, dtype=np.float64)
                np.add.at(total, [i for i, _ in todo], sums)

        for i, t in enumerate(texts):
            d = np.frombuffer(t, np.uint8)
            for at in range(0, len(d), SLICE):  # a slice sees the bytes before it
                back = min(at, self.order)
                todo.append((i, (grams(d[at - back:at + SLICE], self.order + 1) & mask)[back:]))
                size += len(todo[-1][1])
                if size >= SLICE:
                    flush()
                    todo, size = [], 0
        flush()
        return total


def learn(rows: DataFrame, windows: int = WINDOWS, window: int = WINDOW) -> Trees:
    """Trees from ``rows(doc_id, text, lang)``, all of which are training rows."""
    rows = rows.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    n = F.ceil(F.length("text") / window)
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum(n)).orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return Trees({})
    share = F.element_at(F.create_map(*[F.lit(v) for k, s in sizes.items() for v in (k, windows / max(s, 1))]), F.col("lang"))
    pick = F.pmod(F.xxhash64(F.lit(8), "doc_id", "no"), F.lit(1 << 30)) / float(1 << 30) < share
    picked = (rows.select("doc_id", "lang", "text", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("no"))
              .where(pick).select("lang", F.substring("text", F.col("no") * window + 1, F.lit(window)).alias("t"))
              .orderBy("lang", "t").limit(2 * windows * len(sizes)))
    samples: dict[str, list[bytes]] = {k: [] for k in sizes}
    for r in picked.toLocalIterator():
        samples[r["lang"]].append(r["t"].encode())
    return Trees({k: v for k, v in samples.items() if v})


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        model = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if LETTER.search(t)] if model.langs else []
            if known:
                bits = model.text_lengths([texts[i].encode() for i in known])
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
                for i, k, s in zip(known, best, share):
                    lang[i], score[i] = model.langs[k], s
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op8_ppm_language(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 5) == 0
    trees = learn(docs.where(~F.coalesce(held, F.lit(False))))
    return predict(docs, trees).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
