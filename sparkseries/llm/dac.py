"""Token-id output in directly addressable codes.

An id is split into levels of 8 bits, lowest first.  Level 0 holds one byte for every id and a
bitmap that says whether the id goes on; level 1 holds one byte for each id that goes on, and so
forth.  A rank directory (ones before every 512th bit) turns a place on one level into the place
on the next, so any id is read by a few array accesses without decoding its block.

File format: a folder of Parquet files (any store that Spark writes), one row per segment:
``part, seq`` (order), ``ahead`` (ids before the segment within its part), ``n_tokens``,
``payload``.  The payload is the segment in binary:

    magic "DAC1", n_docs u32, n_ids u64, n_levels u32, has_null u32
    doc ids i64[n_docs] (a null id is kept as the first when has_null), ends u64[n_docs]
    per level: n u64, bytes u8[n], continuation bitmap u8[ceil(n / 8)], rank directory u64[ceil(n / 512)]

all little-endian.  Parts follow doc_id order (range partitioning), so files in order of
(part, seq) hold the ids of all documents in ascending doc_id order; the commit protocol of the
Parquet writer covers lost executors.

Encoding looks up space-delimited units: between two visible characters a single space always
starts a pre-token of a byte-level vocabulary, so the ids of a text are those of its units in
order.  A new unit is split into pre-tokens by the vocabulary's pattern, and the tokenizers library
encodes the distinct new pre-tokens in one call.  Texts where that does not hold (runs of white
space, white space other than single spaces and line feeds) and texts that hold a token which the
vocabulary adds to its merges (an end-of-text mark, say) go to the library whole.

Defined results: null text is empty (the end id only); documents that share a doc_id are ordered
by a hash of their text; a null doc_id comes first; an empty table gives an empty result; other
columns are ignored.  A document is never cut: its segment must fit one binary value (2 GB), which
a text of about 900 million ids fills, near the longest string that a row can hold.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import small_side, table

MAGIC = b"DAC1"
BLOCK = 512
SEGMENT_IDS = 1 << 20
END_ID = 0


# ---- codes ------------------------------------------------------------------------------------

def pack_levels(ids: np.ndarray) -> bytes:
    out, rest, levels = [], ids.astype(np.uint32), 0
    while levels == 0 or len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(more)])[:len(more):BLOCK].astype("<u8")
        out += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = rest[more] >> 8
        levels += 1
    return struct.pack("<I", levels) + b"".join(out)


def pack_segment(doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> bytes:
    levels = pack_levels(ids)
    null = sum(d is None for d in doc_ids)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([MAGIC, struct.pack("<IQ", len(doc_ids), len(ids)), levels[:4], struct.pack("<I", null),
                     known.tobytes(), ends.astype("<u8").tobytes(), levels[4:]])


class Segment:
    """A read-only view of one segment."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        n_docs, self.n_ids, n_levels, null = struct.unpack_from("<IQII", payload, 4)
        at = 24
        known = np.frombuffer(payload, "<i8", n_docs, at)
        self.doc_ids = [None] * null + known[null:].tolist()
        at += 8 * n_docs
        self.ends = np.frombuffer(payload, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self.levels = []
        for _ in range(n_levels):
            n = struct.unpack_from("<Q", payload, at)[0]
            at += 8
            parts = []
            for kind, size in (("u1", n), ("u1", -(-n // 8)), ("<u8", -(-n // BLOCK))):
                parts.append(np.frombuffer(payload, kind, size, at))
                at += parts[-1].nbytes
            self.levels.append(parts)

    def __getitem__(self, i: int) -> int:
        """The i-th id by access to its bytes and ranks alone."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, shift = 0, 0
        for low, bits, ranks in self.levels:
            value |= int(low[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK * BLOCK
            inside = np.unpackbits(bits[block >> 3:(i >> 3) + 1], bitorder="little")[:i - block]
            i = int(ranks[block // BLOCK]) + int(inside.sum())
            shift += 8
        return value

    def ids(self) -> np.ndarray:
        value = np.zeros(0, np.uint32)
        for low, bits, _ in reversed(self.levels):
            out = low.astype(np.uint32)
            more = np.unpackbits(bits, count=len(low), bitorder="little").astype(bool)
            out[more] |= value << np.uint32(8)
            value = out
        return value


# ---- tokenizer --------------------------------------------------------------------------------

class _Known:
    """Texts whose ids are known: an Arrow array of the texts, and their ids one after the other.

    More than ``ROOM`` texts are replaced by none at the start of a slice."""

    ROOM = 2_000_000

    def __init__(self):
        self.texts = pa.array([], pa.large_string())
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def places(self, texts: pa.Array) -> np.ndarray:
        """The place of each of these distinct texts, -1 where it is new."""
        at = np.full(len(texts), -1, np.int64)
        if len(texts) < len(self.texts):  # the smaller side is hashed
            found = pc.index_in(self.texts, value_set=texts)
            known = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            at[found.drop_null().to_numpy()] = known
        elif len(self.texts):
            at[:] = pc.fill_null(pc.index_in(texts, value_set=self.texts), -1).to_numpy(zero_copy_only=False)
        return at

    def learn(self, texts: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Adds texts; their places."""
        first = len(self.texts)
        self.texts = pa.concat_arrays([self.texts, texts])
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return np.arange(first, first + len(texts))

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts at these places, one after the other, and how many each has."""
        begin, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        shift = np.cumsum(size) - size
        at = np.repeat((begin - shift).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], size


def _sums(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the first ``counts[0]`` sizes, the next ``counts[1]``, ..."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    last = np.cumsum(counts)
    return total[last] - total[last - counts]


#: Texts whose units are not cut by single spaces and line feeds alone: other white space (also what
#: only Python counts as such), runs of it, white space at either end, and the separator.
ODD = ("[\\x00\\x09\\x0b-\\x0d\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
       "|[ \\n][ \\n]|^[ \\n]|[ \\n]$")

#: Letters of the Latin blocks up to U+024F (no signs of them), and ASCII signs but the apostrophe.
LETTERS = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"
SIGNS = r"[!-&(-/:-@\[-`{-~]"


class _Encoder:
    """The tokenizers library behind two caches: units, made of pre-tokens, which it encodes.

    Cutting, counting and looking up units is array work; Python sees each new unit once.  Many
    texts are joined by line feeds for one call of the pattern or of the library: between texts
    without line feeds one is a pre-token of its own."""

    #: Pre-tokens in one call of the library, whose result holds each token as text too.
    WORDS = 20_000

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(pattern)
        self.line_feed = self.whole("\n")
        self.units, self.words = _Known(), _Known()

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _word_ids(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens and how many each has."""
        parts = [self._some_ids(new.slice(at, self.WORDS)) for at in range(0, len(new), self.WORDS)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _some_ids(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = new.filter(pc.not_equal(new, "\n"))
        known = {}
        if len(plain) and len(self.line_feed) == 1:
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), pa.scalar("\n", pa.large_string()))[0].as_py()
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.line_feed[0])
            if len(at) + 1 == len(plain):
                sizes = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
                if len(plain) == len(new):
                    return np.delete(ids, at), sizes
                known = dict(zip(plain.to_pylist(), np.split(np.delete(ids, at), at - np.arange(len(at)))))
        each = [known[w] if w in known else self.whole(w) for w in new.to_pylist()]
        return np.concatenate([np.array(x, np.uint32) for x in each]), np.array([len(x) for x in each], np.int64)

    def _cut(self, units: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of all units, and how many each has.  Units beyond Latin letters (of
        which versions of Unicode may differ) stay whole for the library to split."""
        latin = [u != "\n" and u != "" and (u.isascii() or max(u) < "\u0250") for u in units]
        found = self.pattern.findall("\n".join(itertools.compress(units, latin)))
        breaks = np.flatnonzero(np.fromiter(("\n" == w for w in found), bool, len(found)))
        counts = np.fromiter((u != "" for u in units), np.int64, len(units))
        if any(latin):
            counts[latin] = np.diff(np.concatenate([[-1], breaks, [len(found)]])) - 1
        if all(latin):
            return [w for w in found if w != "\n"], counts
        rest = iter(w for w in found if w != "\n")
        parts = (itertools.islice(rest, n) if x else [u] * n for u, x, n in zip(units, latin, counts.tolist()))
        return list(itertools.chain.from_iterable(parts)), counts

    def _learn(self, units: pa.Array) -> np.ndarray:
        """Places of units that are new, from their pre-tokens; of those, new ones from the library.

        A word alone is one pre-token and a word with signs after it two; the pattern cuts the rest."""
        alone = pc.match_substring_regex(units, f"^ ?{LETTERS}+$").to_numpy(zero_copy_only=False)
        signs = pc.extract_regex(units, f"^(?P<a> ?{LETTERS}+)(?P<b>{SIGNS}+)$")
        two = signs.is_valid().to_numpy(zero_copy_only=False) & ~alone
        pairs = signs.filter(pa.array(two))
        sides = pa.concat_arrays([pairs.field(0), pairs.field(1)]).cast(pa.large_string())
        rest = units.filter(pa.array(~(alone | two)))
        words, counts = self._cut(rest.to_pylist())
        coded = pa.concat_arrays([units.filter(pa.array(alone)), sides.take(pa.array(np.arange(2 * len(pairs)).reshape(2, -1).T.ravel())),
                                  pa.array(words, pa.large_string())]).dictionary_encode()
        units = pa.concat_arrays([units.filter(pa.array(alone)), units.filter(pa.array(two)), rest])
        counts = np.concatenate([np.ones(alone.sum(), np.int64), np.full(len(pairs), 2), counts])
        at = self.words.places(coded.dictionary)
        if (at < 0).any():
            new = coded.dictionary.filter(pa.array(at < 0))
            at[at < 0] = self.words.learn(new, *self._word_ids(new))
        ids, sizes = self.words.ids(at[coded.indices.to_numpy()])
        out = np.empty(len(units), np.int64)  # learnt in groups, asked for in their own order
        out[np.concatenate([np.flatnonzero(alone), np.flatnonzero(two), np.flatnonzero(~(alone | two))])] = self.units.learn(
            units, ids, _sums(sizes, counts))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, as the library gives them, each with ``END_ID`` appended; how many each has."""
        self.units, self.words = (_Known() if len(x.texts) > x.ROOM else x for x in (self.units, self.words))
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, ODD)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0"), "\0")
        coded = cut.flatten().dictionary_encode()
        at = self.units.places(coded.dictionary)
        if (at < 0).any():
            at[at < 0] = self._learn(coded.dictionary.filter(pa.array(at < 0)))
        ids, sizes = self.units.ids(at[coded.indices.to_numpy()])
        own = _sums(sizes, pc.list_value_length(cut).to_numpy())
        ids = np.insert(ids, np.cumsum(own), END_ID)
        if not odd.any():
            return ids, own + 1
        parts = iter(np.split(ids, np.cumsum(own + 1)))
        aside = pc.if_else(pa.array(odd), texts, None).to_pylist()
        each = [np.array([*self.whole(t), END_ID], np.uint32) if x else next(parts) for t, x in zip(aside, odd)]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


_ENCODERS: dict[str, _Encoder] = {}


def encode_array(texts: pa.Array, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, _Encoder(path, pattern))
    return encoder.encode(texts)


def encode_texts(texts: list[str | None], path: str, pattern: str) -> list[np.ndarray]:
    """Ids of each text with the end id."""
    ids, sizes = encode_array(pa.array([t or "" for t in texts], pa.large_string()), path, pattern)
    return np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _slices(texts: pa.Array, rows: int = 4000, size: int = 8 << 20):
    """(start, length) of runs of at most ``rows`` texts and about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size))
        n = max(1, min(rows, full - at))
        yield at, n
        at += n


# ---- files ------------------------------------------------------------------------------------

def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of ``docs(doc_id, text)`` in ascending doc_id order to the folder ``path``."""
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .withColumn("th", F.xxhash64("text")).repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th"))

    def run(batches):
        part, seq, ahead = TaskContext.get().partitionId(), 0, 0
        docs, ids, sizes, n = [], [], [], 0

        def segment():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([ahead], pa.int64()), pa.array([n], pa.int64()),
                 pa.array([pack_segment(docs, np.cumsum(np.concatenate(sizes)), np.concatenate(ids))], pa.binary())],
                names=["part", "seq", "ahead", "n_tokens", "payload"])

        for b in batches:
            for at, size in _slices(b.column(1)):
                cut = b.slice(at, size)
                names = cut.column(0).to_pylist()
                flat, own = encode_array(cut.column(1), tokenizer_path, pattern)
                ends, first = np.cumsum(own), 0
                while first < len(own):
                    # documents up to the one that fills the segment
                    begin = int(ends[first - 1]) if first else 0
                    last = min(int(np.searchsorted(ends, begin + segment_ids - n)) + 1, len(own))
                    docs += names[first:last]
                    ids.append(flat[begin:int(ends[last - 1])])
                    sizes.append(own[first:last])
                    n += int(ends[last - 1]) - begin
                    first = last
                    if n >= segment_ids:
                        yield segment()
                        seq, ahead = seq + 1, ahead + n
                        docs, ids, sizes, n = [], [], [], 0
        if docs:
            yield segment()

    (rows.select("doc_id", "text").mapInArrow(run, "part long, seq long, ahead long, n_tokens long, payload binary")
     .write.option("compression", "uncompressed").parquet(path))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, start, n_tokens, payload): ``start`` counts the ids before the segment.

    Only one row per part, its total, meets in one place."""
    seg = spark.read.schema("part long, seq long, ahead long, n_tokens long, payload binary").parquet(path)
    parts = seg.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (seg.join(small_side(parts, "dac-parts"), "part")
            .select("part", "seq", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "payload"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    def run(batches):
        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1)):
                s = Segment(payload.as_py())
                raw = memoryview(s.ids().astype("<u4").tobytes())
                ends = s.ends
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(ends - begins, pa.int64()),
                     pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_segments(spark, path).select("start", "payload").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_dac(spark, sf_dir) -> DataFrame:
    import public_tokenizers as P
    path = f"{ensure_checkpoint_dir(spark)}/llm/dac-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, P.path("byte_bpe_50k.json"), P.PATTERN)
    return read_documents(spark, path)
