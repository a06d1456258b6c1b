"""Byte-level BPE encoding and decoding of whole texts, long ones in overlapping chunks.

1. Chunks: every text is cut at multiples of ``CHUNK`` characters; a chunk also sees ``OVERLAP``
   characters on both sides.  Chunks are rows, so one very long text is spread over tasks.
2. Pre-tokenise in parallel: around each of its two borders a chunk runs the pre-token pattern
   over what it sees and reports the boundaries it finds there.
3. Stitch: two neighbours have resynchronised at the first place that both report as a boundary
   between a visible character and a blank.  There the text is cut.  A border without such a
   place (a run longer than the overlap) is no cut: its chunks stay together.
4. Encode the pieces between cuts by rank merges, and decode by concatenating the raw bytes of
   the ids.

A cut after a non-blank character is exact: every pre-token to its left ends there in the whole
text too, because the only look-ahead of the pattern asks what follows blanks.  The left scan
starts ``OVERLAP`` characters before the border (in the middle of a pre-token, perhaps), the
right one at a place of its own; each is wrong only until it meets a true boundary, and a
boundary at a change from letters, digits or signs to a blank is one for any start.

A run of white space longer than the overlap is no place to cut, however long (see ``Codec.encode``).

Defined results: null text is empty (no ids); rows that share a doc_id are separate documents;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

CHUNK = 32_768
OVERLAP = 256
#: Longest run of white space that goes to the library's pattern matcher.
BLANKS = 100_000
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # White_Space of Unicode
#: Runs whose length is then compared with ``BLANKS``: a pattern with that least count takes 66 MB in each process.
LONG_BLANKS = regex.compile(SPACE + "{100,}")


class Codec:
    """Ranks file -> encode / decode; ``path`` is read where the codec is made (each worker)."""

    _made: dict = {}

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.raw = {v: k for k, v in ranks.items()}

    @classmethod
    def of(cls, path: str, pattern: str) -> "Codec":
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def encode(self, text: str) -> list[int]:
        """Ids of a text.  The library's pattern matcher fails on a run of about a million white-space
        characters, so runs over ``BLANKS`` are taken out: all of a run but its last character is one
        pre-token (all of it at the end of the text), and the rest begins with that character."""
        if len(text) <= BLANKS:
            return self.encoding.encode_ordinary(text)
        out, at = [], 0
        for run in LONG_BLANKS.finditer(text):
            if run.end() - run.start() <= BLANKS:
                continue
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += self.encoding.encode_ordinary(text[at:run.start()])
            out += self.encoding._encode_single_piece(text[run.start():end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def boundaries(self, seen: str, start: int, lo: int, hi: int) -> list[int]:
        """Ends of pre-tokens in [lo, hi) of a text of which ``seen`` begins at ``start``: those
        after a visible character and before a blank."""
        out, n = [], len(seen)
        for m in self.pattern.finditer(seen):
            e = m.end()
            if e < n and lo <= start + e < hi and not seen[e - 1].isspace() and seen[e] in " \n\r\t":
                out.append(start + e)
        return out


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with an id of their own, so that rows that share a doc_id stay apart."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def cuts(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, key, cut): the places where texts longer than a chunk are cut."""
    longer = docs.where(F.length("text") > chunk)
    border = F.explode(F.sequence(F.lit(1), F.floor((F.length("text") - 1) / chunk).cast("int"))).alias("k")
    rows = longer.select("doc_id", "key", "text", border).select(
        "doc_id", "key", "k", F.expr(f"substring(text, greatest(k * {chunk} - {overlap}, 0) + 1, {2 * overlap})").alias("seen"))
    rows = rows.repartition("key", "k")

    def run(batches):
        codec = Codec.of(path, pattern)
        for b in batches:
            out = []
            for k, seen in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                at = k * chunk
                start = max(at - overlap, 0)
                # the left chunk scans from where it begins to see, the right one from half way
                left = codec.boundaries(seen, start, at, at + overlap)
                skip = (at - start) // 2
                right = set(codec.boundaries(seen[skip:], start + skip, at, at + overlap))
                out.append(next((p for p in left if p in right), None))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], names=["doc_id", "key", "cut"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key long, cut long").where("cut is not null").distinct()


def pieces(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, key, n, no, piece): every text as consecutive pieces, ``n`` of them."""
    made = materialize(cuts(docs, path, pattern, chunk, overlap), "bpe-cuts")
    ends = made.groupBy(F.col("doc_id").alias("d2"), F.col("key").alias("k2")).agg(F.sort_array(F.collect_set("cut")).alias("ends"))
    longer = docs.where(F.length("text") > chunk).join(
        ends, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("key") == F.col("k2")), "left")
    ends = F.coalesce("ends", F.array().cast("array<bigint>"))
    spans = F.zip_with(F.concat(F.array(F.lit(0).cast("bigint")), ends),
                       F.concat(ends, F.array(F.length("text").cast("bigint"))),
                       lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cut = (longer.select("doc_id", "key", "text", (F.size(ends) + 1).alias("n"), F.posexplode(spans).alias("no", "s"))
           .select("doc_id", "key", "n", "no", F.expr("substring(text, int(s.a) + 1, int(s.b - s.a))").alias("piece")))
    short = docs.where(F.length("text") <= chunk).select(
        "doc_id", "key", F.lit(1).alias("n"), F.lit(0).alias("no"), F.col("text").alias("piece"))
    return short.unionByName(cut.repartition("key", "no"))


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, key, n, no, ids) for the pieces of every text of ``docs(doc_id, text)``."""
    rows = pieces(_numbered(docs), path, pattern, chunk, overlap)

    def run(batches):
        codec = Codec.of(path, pattern)
        for b in batches:
            text = b.column(4)
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [codec.encode(t) for t in text.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "key", "n", "no", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key long, n int, no int, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``tokens`` with ``raw``: the bytes of its ``ids``, concatenated."""
    @F.arrow_udf("binary")
    def run(ids: pa.Array) -> pa.Array:
        codec = Codec.of(path, pattern)
        return pa.array([codec.decode(x) for x in ids.to_pylist()], pa.binary())

    return tokens.withColumn("raw", run("ids"))


def digests(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per document, from its encoded pieces.

    Texts of one piece are digested where they are encoded; the pieces of a longer text meet in
    order in one group, which holds the ids of one document."""
    rows = pieces(_numbered(docs), path, pattern, chunk, overlap)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def digest(codec, parts):
        said, raw, n = hashlib.sha256(), hashlib.sha256(), 0
        for ids in parts:
            if len(ids):
                said.update((" " if n else "").encode() + " ".join(map(str, ids)).encode())
                raw.update(codec.decode(ids))
                n += len(ids)
        return n, said.hexdigest(), raw.hexdigest()

    def whole(batches):
        codec = Codec.of(path, pattern)
        for b in batches:
            out = [digest(codec, [codec.encode(t)]) for t in b.column(4).to_pylist()]
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in zip(*out))], names=names)

    def parted(batches):
        """Rows in order of (key, doc_id, copy, no): a document's pieces follow each other."""
        codec = Codec.of(path, pattern)
        rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        for (doc, _), group in itertools.groupby(rows, key=lambda r: (r[0], r[1])):
            by_no = [[g[3] for g in part] for _, part in itertools.groupby(group, key=lambda r: r[2])]
            for copy in range(len(by_no[0])):  # equal rows come side by side
                n, a, d = digest(codec, (p[copy] for p in by_no))
                yield pa.RecordBatch.from_arrays([pa.array([doc], b_type), pa.array([n], pa.int64()), pa.array([a]), pa.array([d])], names=names)

    b_type = pa.int64() if kind in ("bigint", "int") else pa.string()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    single = rows.where("n = 1").mapInArrow(whole, schema)

    def ids_of(batches):
        codec = Codec.of(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(
                [codec.encode(t) for t in b.column(4).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "key", "no", "ids"])

    many = (rows.where("n > 1").mapInArrow(ids_of, f"doc_id {kind}, key long, no int, ids array<int>")
            .repartition("key").sortWithinPartitions("key", "doc_id", "no").mapInArrow(parted, schema))
    return single.unionByName(many)


def _vocabulary():
    import public_tokenizers as P
    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def op5_byte_bpe(spark, sf_dir) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *_vocabulary())


def stage_byte_bpe(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: token count and digests of every document that is left."""
    return digests(docs, *_vocabulary())
