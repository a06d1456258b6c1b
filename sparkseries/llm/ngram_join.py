"""N-gram Jaccard join: exact links between documents by word shingles, and their components.

Plan:

1. One pass over the texts: sorted distinct 64-bit shingle hashes per document, from them the
   set size, a 128-bit set fingerprint, a 512-bit signature and the prefix keys.  Documents with
   equal sets collapse to one representative (their smallest id).
2. Prefix keys: two sets with Jaccard >= t share a key among the first ``s - ceil(t s) + 1``
   shingles of each under any common order.  The order is by hash, with the shingles that are
   frequent in a small sample last; the sample decides only speed, never results.
3. Every key pairs its documents with its smallest document (a star: linear, however large the
   key's group is).  A pair stays if its sizes allow the similarity and the signatures do: the
   signature holds the parity of the hashes in each of 512 cells, so the bit count of the xor
   never exceeds the symmetric difference, and (a + b - count) / 2 bounds the overlap from above.
4. Long documents fill the 512 cells, so their remaining pairs get the same bound from
   4096 cells first.  What remains is decided by the exact intersection of the sorted shingle arrays.
5. Components of these links.  Where a key still holds several components (of keys with the same
   documents, one is enough), its documents are dealt into size-banded tiles (documents of one band against their own and the next band,
   large tiles dealt on by hash), the pairs across components get the same bound and the exact
   intersection, and the components are formed again.  So no link is lost and pairs inside a
   component are never enumerated.

Defined results: null and empty texts and texts without words have n_shingles 0 and form their
own component; fewer words than a shingle make one shingle of the whole sequence; rows that share
a doc_id count as one document; rows with a null doc_id are returned with a null component and
linked with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, table

SIG_LONGS = 8
WIDE_LONGS, WIDE_FROM = 64, 800  # the second signature and the set size from which a document has one
SAMPLE_DOCS = 20_000
MAX_FREQUENT = 100_000
TILE = 256
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                               0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, kept while there is room."""

    def __missing__(self, word):
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MUL[4]
    h = (h ^ (h >> np.uint64(33))) * _MUL[5]
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None, cache: WordHashes) -> np.ndarray:
    words = text.encode().lower().split() if text else []  # bytes: A-Z and \x20 \x09-\x0D only
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, cache: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams."""
    w = word_hashes(text, cache)
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h * _MUL[i % 4] + w[i:len(w) - k + 1 + i])
    return np.unique(h)


def signature(s: np.ndarray, longs: int = SIG_LONGS) -> np.ndarray:
    """Parity of the hashes in each of 512 (64 a long) cells, as longs."""
    odd = (np.bincount((s >> np.uint64(20)).astype(np.int64) % (longs * 64), minlength=longs * 64) & 1)
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefix(s: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, pct: int) -> np.ndarray:
    size = len(s) + (-pct * len(s)) // 100 + 1  # s - ceil(t s) + 1
    if not len(frequent):
        return s[:size]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    rank = np.where(frequent[at] == s, ranks[at], 0)
    return s[np.argsort(rank, kind="stable")[:size]]


def _frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles seen twice or more in a sample of about ``SAMPLE_DOCS`` documents, with
    their sampled counts: the most frequent, about ``MAX_FREQUENT`` of them.  Only these come to the
    driver, with one row for each count; a sorted limit would send it as many rows from every task."""
    total = max(docs.count(), 1)
    parts = max(1, total // SAMPLE_DOCS)

    def run(batches):
        cache = WordHashes()
        for b in batches:
            s = [shingle_set(t, cache, n) for t in b.column(0).to_pylist()]
            if s:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s).view(np.int64))], names=["h"])

    rows = (docs.where(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(parts)) == 0).select("text")
            .mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c >= 2"))
    rows = materialize(rows, "ngram-frequent")
    sizes = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    least, most = _frequent_cut(sizes)
    rows = rows.where((F.col("c") > least) | ((F.col("c") == least) & (F.col("h") <= most))).toArrow()
    h = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["c"].to_numpy()[order]


def _frequent_cut(sizes: dict[int, int]) -> tuple[int, int]:
    """(count, hash): above that count all shingles are taken, at it those up to that hash, so that
    they are about ``MAX_FREQUENT``; ``sizes`` has the number of shingles of each count, and hashes
    are uniform."""
    room = MAX_FREQUENT
    for c in sorted(sizes, reverse=True):
        if sizes[c] > room:
            return c, (room << 64) // sizes[c] - (1 << 63)
        room -= sizes[c]
    return 0, 0


def _profiles(docs: DataFrame, n: int, pct: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig, wide, keys) per row; ``wide`` is null below ``WIDE_FROM`` shingles."""
    seen = docs.sparkSession.sparkContext.broadcast(_frequent(docs, n))  # at most 16 * MAX_FREQUENT bytes

    def run(batches):
        cache, (frequent, ranks) = WordHashes(), seen.value
        for b in batches:
            size, h1, h2, sig, wide, keys = [], [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, cache, n)
                size.append(len(s))
                d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                h1.append(d[0])
                h2.append(d[1])
                sig.append(signature(s))
                wide.append(signature(s, WIDE_LONGS) if len(s) >= WIDE_FROM else None)
                keys.append(_prefix(s, frequent, ranks, pct).view(np.int64) if len(s) else np.empty(0, np.int64))
            if size:
                ends = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(size, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, SIG_LONGS * len(sig) + 1, SIG_LONGS, dtype=np.int32)),
                                              pa.array(np.concatenate(sig))),
                     pa.array(wide, pa.list_(pa.int64())),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))],
                    names=["doc_id", "n_shingles", "h1", "h2", "sig", "wide", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, h1 long, h2 long, sig array<long>, wide array<long>, keys array<long>")


def _may_link(pct: int):
    """Sizes and signatures of sides a and b allow the similarity (n_a, n_b, sig_a, sig_b)."""
    diff = sum((F.bit_count(F.col("sig_a")[i].bitwiseXOR(F.col("sig_b")[i])).cast("long") for i in range(SIG_LONGS)),
               F.lit(0).cast("long"))
    return _allows(diff, pct)


def _allows(diff, pct: int):
    """Sizes allow the similarity, and a symmetric difference of at least ``diff`` does."""
    both = F.col("n_a") + F.col("n_b")
    most = F.floor((both - diff) / 2)
    sizes = 100 * F.least("n_a", "n_b") >= pct * F.greatest("n_a", "n_b")
    return sizes & (100 * most >= pct * (both - most))


def _wide_pairs(pairs: DataFrame, nodes: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) that the wide signatures allow; where a side has none, the pair stays."""
    for c in "ab":
        pairs = pairs.join(nodes.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")), c)
    odd = F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    diff = F.aggregate(odd, F.lit(0).cast("long"), lambda total, x: total + x)
    return pairs.where(_allows(F.coalesce(diff, F.lit(0).cast("long")), pct)).select("a", "b").distinct()


def _exact(pairs: DataFrame, docs: DataFrame, n: int, pct: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets have 100 * intersection >= pct * union."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = materialize(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id"), "ngram-texts")
    rows = (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b"))

    def run(batches):
        cache, last, left = WordHashes(), None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2), batch.column(3)
            hit = []
            for i in range(len(a)):
                t = ta[i].as_py()
                if left is None or t != last:
                    last, left = t, shingle_set(t, cache, n)
                right = shingle_set(tb[i].as_py(), cache, n)
                common = len(np.intersect1d(left, right, assume_unique=True))
                hit.append(100 * common >= pct * (len(left) + len(right) - common) > 0)
            if a:
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(hit))

    return rows.mapInArrow(run, "a long, b long").distinct()


def _tile_pairs(members: DataFrame, pct: int) -> DataFrame:
    """Pairs across components inside keys that hold several, from size-banded tiles.
    ``members(key, id, component, n, sig)``."""
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / pct)).cast("long")
    rows = members.select("*", band.alias("band"))
    rows = rows.select("*", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("tile"))
    size = rows.groupBy("key", "tile").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("cuts"),
                                           F.min("component").alias("lo"), F.max("component").alias("hi"))
    rows = rows.join(size.where("lo <> hi"), ["key", "tile"])
    own = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    rows = rows.select("key", "tile", "band", "id", "component", "n", "sig", own.alias("own"),
                       F.explode(every).alias("other"))
    rows = rows.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    by = ["key", "tile", "i", "j"]
    rows = rows.select(*by, "band", "id", "component", "n", "sig", "own").repartition(*by).sortWithinPartitions(*by)

    def pairs_of(tile, i, j, band, ids, comp, n, sig, own):
        l, r = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for at in range(0, len(l), 64):
            k = l[at:at + 64, None]
            diff = np.bitwise_count(sig[k] ^ sig[r]).sum(axis=2).astype(np.int64)
            both = n[k] + n[r]
            most = (both - diff) // 2
            ok = ((comp[k] != comp[r]) & (ids[k] < ids[r] if i == j else ids[k] != ids[r])
                  & ((band[k] == tile) | (band[r] == tile))
                  & (100 * np.minimum(n[k], n[r]) >= pct * np.maximum(n[k], n[r])) & (100 * most >= pct * (both - most)))
            x, y = np.nonzero(ok)
            if len(x):
                x, y = ids[k[x, 0]], ids[r[y]]
                yield np.minimum(x, y), np.maximum(x, y)

    def run(batches):
        carry = None
        for b in itertools.chain(batches, [None]):
            t = pa.Table.from_batches([x for x in (carry, b) if x is not None]).combine_chunks() if carry or b else None
            if t is None or not t.num_rows:
                continue
            col = {c: t[c].to_numpy() for c in (*by, "band", "id", "component", "n", "own")}
            new = np.zeros(t.num_rows, bool)
            for c in by:
                new[1:] |= col[c][1:] != col[c][:-1]
            starts = np.concatenate([[0], np.flatnonzero(new)])
            sig = t["sig"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SIG_LONGS)
            ends = np.append(starts[1:], t.num_rows)
            if b is not None:  # the last group may go on in the next batch
                carry = pa.RecordBatch.from_arrays([x.combine_chunks() for x in t.slice(starts[-1]).columns], schema=t.schema)
                starts, ends = starts[:-1], ends[:-1]
            out = [p for s, e in zip(starts, ends) for p in pairs_of(
                col["tile"][s], col["i"][s], col["j"][s], *(col[c][s:e] for c in ("band", "id", "component", "n")), sig[s:e], col["own"][s:e])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _distinct_groups(members: DataFrame) -> DataFrame:
    """``members`` of one key (the smallest) for each set of documents: keys with the same documents,
    such as the shingles of one passage, would give the same pairs again."""
    prints = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"),
                                        F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    kept = materialize(prints.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key"), "ngram-kept")
    return members.join(kept, "key")


def link_components(docs: DataFrame, n: int = 4, pct: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs(doc_id, text)``; documents link when
    100 * |A and B| >= pct * |A or B|."""
    prof = materialize(_profiles(docs, n, pct), "ngram-profiles")
    sets = prof.where("n_shingles > 0 and doc_id is not null")
    rep = sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    same = sets.join(rep, ["h1", "h2"])
    equal = same.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    nodes = same.where("doc_id = rep").select("doc_id", "n_shingles", "sig", "wide", "keys").dropDuplicates(["doc_id", "n_shingles", "sig"])
    nodes = materialize(nodes, "ngram-nodes")
    keys = nodes.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    hubs = (keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.count(F.lit(1)).alias("m"))
            .where("hub <> top"))
    shared = materialize(keys.join(hubs.select("key", "hub", "m"), "key"), "ngram-shared")
    star = shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    side = nodes.select("doc_id", "n_shingles", "sig")

    def with_sides(p):
        for c in "ab":
            p = p.join(side.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")), c)
        return p

    tested = materialize(with_sides(star).where(_may_link(pct)).select("a", "b").distinct(), "ngram-pairs")
    close = materialize(_wide_pairs(tested, nodes, pct), "ngram-close")
    links = materialize(_exact(close, docs, n, pct).union(equal), "ngram-links")
    comp = components(links)
    # keys of three or more documents that are not one component yet
    wide = shared.where("m > 2").select("key", "id").distinct()
    named = wide.join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    open_keys = (named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                 .where("lo <> hi").select("key"))
    members = named.join(open_keys, "key").join(
        side.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig"), "id")
    members = _distinct_groups(materialize(members, "ngram-members"))
    rest = _tile_pairs(members, pct).join(tested, ["a", "b"], "left_anti")
    rest = materialize(_wide_pairs(rest, nodes, pct), "ngram-rest")
    if not rest.isEmpty():
        more = materialize(_exact(rest, docs, n, pct), "ngram-more")
        if not more.isEmpty():
            comp = components(links.union(more))
    out = prof.select("doc_id", "n_shingles").join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op4_ngram_jaccard(spark, sf_dir) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one whose id is the component (five-word shingles,
    similarity 0.8 or more).  Rows that repeat an id keep one row; rows without an id stay."""
    comp = link_components(docs, n=5, pct=80).where("component_id <> doc_id").select(F.col("doc_id").alias("__llm_id")).distinct()
    rows = docs.join(comp, docs["doc_id"].cast("long") == comp["__llm_id"], "left_anti")
    named, bare = rows.where("doc_id is not null"), rows.where("doc_id is null")
    return named.dropDuplicates(["doc_id"]).union(bare).select(*docs.columns)
