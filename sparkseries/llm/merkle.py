"""Merkle dataset manifest: one hash tree per language, one tree over their roots, and inclusion
proofs for any set of documents by octopus multiproofs.

Hash: H(x) = lowercase hex sha256; digests enter a hash as their hex text.  A leaf is H of doc_id,
source, lang, n_chars and text, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value.
In a tree, leaves ascend by doc_id (null first; rows that share one by leaf); while there are
several nodes, each run of two consecutive ones (the last may be one) becomes the H of its digests.
The roots of the trees, ordered by lang (null first, then bytewise), are the leaves of the top tree.

``build`` numbers the leaves by range partitions and hashes each tree in blocks of
2 ** ``BLOCK_LEVELS`` neighbours: a pass turns a block into all its interior nodes, so a table of
any size takes a few passes and no task sees more than one block.  All nodes are kept, keyed by
coordinates (tree, level, idx).

``prove`` takes any subset of the leaves.  1. Each leaf partition (a block of one tree) computes the
minimal union of the coordinates that its requested leaves cannot derive: siblings, level by level,
of what is known, minus what is known.  2. One join fetches those nodes once for each partition.
3. Each partition derives the shared interiors and expands one proof per requested leaf.

A proof is an array of (left, digest), from the leaf to the root: ``left`` says whether the sibling
stands on the left; both are null where the run has one node.  ``fold`` recomputes a root from a
leaf and its proof with column functions alone.

Defined results: a null field is ``-`` and an empty one ``0:``; a null doc_id is a leaf like any
other and never tampered with; repeated rows are leaves of their own; an empty table has no trees,
no root and no proofs; other columns are ignored.  A text is hashed where it is read, however long.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import crc32_sql, crc_mod, materialize, number, small_side, table

BLOCK_LEVELS = 9
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "__llm_subroot string, __llm_root string, __llm_proof array<struct<left: boolean, digest: string>>"


def field(col):
    text = col.cast("string")
    return F.when(col.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(cols):
    return F.sha2(F.concat(*[field(c) for c in cols]), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def parents(hexes: list[str]) -> list[str]:
    return [digest(hexes[i:i + 2]) for i in range(0, len(hexes), 2)]


def sql_leaf(n_chars: str) -> str:
    """The leaf as SQL, with ``n_chars`` as given."""
    def one(c):
        return f"CASE WHEN ({c}) IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END"
    return "sha256(" + " || ".join(one(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


@dataclass
class Manifest:
    """``leaves``: the input rows with (__llm_tree, __llm_n, __llm_pos), n the leaves of the tree.  ``nodes``: (tree, level, idx,
    digest) of all trees, the top tree as tree -1.  ``trees``: (tree, lang, n, subroot), a row per
    language.  ``root`` is None for an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    n_trees: int
    root: str | None


def _climb(level_nodes: DataFrame, level: int, levels: int) -> DataFrame:
    """All nodes of the next ``levels`` levels above ``level_nodes(tree, n, idx, digest)`` of one level.

    ``n``: leaves of the tree.  A tree that has one node left climbs no further."""
    rows = level_nodes.select("tree", F.shiftright("idx", levels).alias("block"), "idx", "n", "digest")

    def run(key, t):
        tree, block = (k.as_py() for k in key)
        order = np.argsort(t.column("idx").to_numpy())
        hexes = t.column("digest").take(pa.array(order)).to_pylist()
        n = t.column("n")[0].as_py()
        count = -(-n // (1 << level))  # nodes of the tree on this level
        out_level, out_idx, out = [], [], []
        first = block << levels
        for up in range(level + 1, level + levels + 1):
            if count == 1:
                break
            hexes, first, count = parents(hexes), first >> 1, (count + 1) // 2
            out_level += [up] * len(hexes)
            out_idx += range(first, first + len(hexes))
            out += hexes
        return pa.table({"tree": pa.array([tree] * len(out), pa.int64()), "n": pa.array([n] * len(out), pa.int64()),
                         "level": pa.array(out_level, pa.int32()), "idx": pa.array(out_idx, pa.int64()), "digest": pa.array(out, pa.string())})

    return rows.groupBy("tree", "block").applyInArrow(run, "tree long, n long, level int, idx long, digest string")


def _grow(leaves: DataFrame, most: int, levels: int) -> DataFrame:
    """All nodes (tree, level, idx, digest) over ``leaves(tree, n, idx, digest)``; the largest tree has ``most``."""
    nodes = leaves.select("tree", F.lit(0).alias("level"), "idx", "digest")
    edge, level = leaves, 0
    while -(-most // (1 << level)) > 1:
        made = materialize(_climb(edge, level, levels), "merkle-nodes")
        nodes = nodes.unionByName(made.drop("n"))
        level += levels
        edge = made.where(F.col("level") == level).drop("level")
    return nodes


def build(rows: DataFrame, levels: int = BLOCK_LEVELS) -> Manifest:
    """Manifest of ``rows(doc_id, lang, leaf, ...)``; further columns stay with the leaves."""
    rows = materialize(rows, "merkle-leaves")
    langs = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "merkle-langs")
    langs = materialize(number(langs, [], ["lang"], "merkle-langs", "tree"), "merkle-trees")
    n_trees, most = langs.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    placed = number(rows, ["lang"], ["doc_id", "leaf"], "merkle", "__llm_pos")
    ids = small_side(langs.select(F.col("lang").alias("__llm_lang"), F.col("tree").alias("__llm_tree"), F.col("n").alias("__llm_n")), "merkle-ids")
    placed = materialize(placed.join(ids, F.col("lang").eqNullSafe(F.col("__llm_lang"))).drop("__llm_lang"), "merkle-placed")
    nodes = _grow(placed.select(F.col("__llm_tree").alias("tree"), F.col("__llm_n").alias("n"), F.col("__llm_pos").alias("idx"),
                                F.col("leaf").alias("digest")), most, levels)
    height = F.when(F.col("n") > 1, F.ceil(F.log2(F.col("n").cast("double")))).otherwise(0)  # right below 2 ** 48 leaves
    tops = nodes.where("idx = 0").join(langs.withColumnRenamed("tree", "t"), (F.col("tree") == F.col("t")) & (F.col("level") == height))
    trees = materialize(tops.select("tree", "lang", "n", F.col("digest").alias("subroot")), "merkle-roots")
    over = _grow(trees.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"),
                              F.col("tree").alias("idx"), F.col("subroot").alias("digest")), n_trees, levels)
    root = over.where("idx = 0").orderBy(F.desc("level")).select("digest").first() if n_trees else None
    return Manifest(placed, nodes.unionByName(over), trees, n_trees, root[0] if root else None)


def _heights(tree: int, n: int, n_trees: int):
    """(tree, level, nodes on it) of the path from a leaf to the root."""
    for name, count in ((tree, n), (TOP, n_trees)):
        level = 0
        while count > 1:
            yield name, level, count
            level, count = level + 1, (count + 1) // 2


def missing(tree: int, pos: np.ndarray, n: int, n_trees: int) -> list[tuple[int, int, int]]:
    """The minimal union of coordinates that the leaves ``pos`` of one tree need besides themselves."""
    out, known, name = [], np.unique(pos), tree
    for at, level, count in _heights(tree, n, n_trees):
        if at != name:
            name, known = at, np.array([tree], np.int64)
        other = np.setdiff1d(known ^ 1, known, assume_unique=True)
        out += [(at, level, i) for i in other[other < count].tolist()]
        known = np.unique(known >> 1)
    return out


def expand(tree: int, pos: np.ndarray, leaves: list[str], n: int, n_trees: int, fetched: dict) -> tuple[str, str, np.ndarray, np.ndarray, list]:
    """(subroot, root, steps, left, digests): for every requested leaf a row of ``steps`` (places in
    ``digests``, -1 for a run of one) and of ``left``, derived from the leaves and the fetched nodes."""
    at_leaf = dict(zip(pos.tolist(), leaves))  # rows that stand for one leaf are equal
    known, path, name = at_leaf, pos.copy(), tree
    digests, steps, left, subroot = [], [], [], None
    for at, level, count in _heights(tree, n, n_trees):
        if at != name:
            subroot = next(iter(known.values()))
            name, known, path = at, {tree: subroot}, np.full(len(pos), tree, np.int64)
        have = known | {i: fetched[at, level, i] for i in {i ^ 1 for i in known} - known.keys() if i < count}
        places = {i: len(digests) + k for k, i in enumerate(have)}
        digests += have.values()
        steps.append(np.fromiter((places.get(i, -1) for i in (path ^ 1).tolist()), np.int64, len(path)))
        left.append((path & 1).astype(bool))
        known = {i: digest([have[j] for j in (2 * i, 2 * i + 1) if j in have]) for i in {i >> 1 for i in known}}
        path = path >> 1
    root = next(iter(known.values()))
    shape = (len(pos), len(steps))
    return (root if subroot is None and name == tree else subroot, root,
            np.stack(steps, 1) if steps else np.zeros(shape, np.int64), np.stack(left, 1) if left else np.zeros(shape, bool), digests)


def prove(manifest: Manifest, requested: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``requested`` (rows of ``manifest.leaves``) with __llm_subroot, __llm_root and __llm_proof."""
    n_trees = manifest.n_trees
    rows = requested.withColumn("__llm_block", F.shiftright("__llm_pos", levels))
    by = ("__llm_tree", "__llm_block")

    def coordinates(key, t):
        tree, block = (k.as_py() for k in key)
        want = missing(tree, t.column("__llm_pos").to_numpy(), t.column("__llm_n")[0].as_py(), n_trees)
        cols = list(zip(*want)) or [[], [], []]
        return pa.table({"__llm_tree": pa.array([tree] * len(want), pa.int64()), "__llm_block": pa.array([block] * len(want), pa.int64()),
                         "t": pa.array(cols[0], pa.int64()), "l": pa.array(cols[1], pa.int32()), "i": pa.array(cols[2], pa.int64())})

    want = materialize(rows.select(*by, "__llm_pos", "__llm_n").groupBy(*by)
                       .applyInArrow(coordinates, "__llm_tree long, __llm_block long, t long, l int, i long"), "merkle-wanted")
    # leaves are needed only where a partition does not request all of them
    lowest = want.where(F.col("t") >= 0).agg(F.min("l")).first()[0]
    nodes = manifest.nodes.where((F.col("tree") < 0) | (F.col("level") >= (0 if lowest is None else lowest)))
    fetched = want.join(nodes, (F.col("t") == F.col("tree")) & (F.col("l") == F.col("level")) & (F.col("i") == F.col("idx"))
                        ).select(*by, "t", "l", "i", "digest")
    schema = StructType(requested.schema.fields + StructType.fromDDL(PROOF).fields)
    own, names = requested.columns, schema.names

    def proofs(key, mine, other):
        kept = mine.select(own)
        n = mine.column("__llm_n")[0].as_py()
        got = {(t, lv, i): d for t, lv, i, d in zip(*(other.column(c).to_pylist() for c in ("t", "l", "i", "digest")))}
        pos = mine.column("__llm_pos").to_numpy()
        subroot, root, steps, left, digests = expand(key[0].as_py(), pos, mine.column("leaf").to_pylist(), n, n_trees, got)
        alone = (steps < 0).ravel()
        taken = pa.array(digests, pa.string()).take(pa.array(steps.ravel(), pa.int64(), mask=alone))
        side = pa.array(left.ravel(), pa.bool_(), mask=alone)
        ends = pa.array(np.arange(len(pos) + 1) * steps.shape[1], pa.int32())
        proof = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([side, taken], names=["left", "digest"]))
        same = [pa.array([x] * len(pos), pa.string()) for x in (subroot, root)]
        return pa.table([*kept.columns, *same, proof], names=names)

    return rows.groupBy(*by).cogroup(fetched.groupBy(*by)).applyInArrow(proofs, schema)


def fold(leaf, proof):
    """The root that follows from ``leaf`` and ``proof``."""
    return F.aggregate(proof, leaf, lambda acc, x: F.sha2(
        F.when(x["digest"].isNull(), acc).when(x["left"], F.concat(x["digest"], acc)).otherwise(F.concat(acc, x["digest"])), 256))


def op11_octopus_manifest(spark, sf_dir) -> DataFrame:
    cols = {c: F.col(c) for c in FIELDS}
    changed = cols | {"n_chars": F.col("n_chars") + 1}
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", leaf_hash(cols.values()).alias("leaf"),
        F.when(crc_mod(F.col("doc_id"), 7) == 0, leaf_hash(changed.values())).alias("tampered"))
    manifest = build(docs)
    root = F.lit(manifest.root).cast("string")
    out = prove(manifest, manifest.leaves)
    siblings = F.array_join(F.transform("__llm_proof", lambda x: x["digest"]), "")
    return out.select(
        "doc_id", "leaf", F.col("__llm_subroot").alias("subroot"), root.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"),
        fold(F.coalesce("tampered", "leaf"), F.col("__llm_proof")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, lang, {sql_leaf("n_chars")} AS leaf,
         CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {sql_leaf("n_chars + 1")} END AS tampered
  FROM documents),
langs AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM base GROUP BY lang),
placed AS (
  SELECT b.*, l.tree, l.n, row_number() OVER (PARTITION BY l.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM base b JOIN langs l ON b.lang IS NOT DISTINCT FROM l.lang),
sub AS (
  SELECT tree, 0 AS level, pos AS idx, leaf AS digest, n AS cnt FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (cnt + 1) // 2
  FROM sub WHERE cnt > 1 GROUP BY tree, level, idx // 2, cnt),
subroots AS (SELECT tree, digest FROM sub WHERE cnt = 1),
top AS (
  SELECT 0 AS level, tree AS idx, digest, (SELECT count(*) FROM langs) AS cnt FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (cnt + 1) // 2
  FROM top WHERE cnt > 1 GROUP BY level, idx // 2, cnt),
height AS (SELECT tree, max(level) AS h FROM sub GROUP BY tree),
heads AS (  -- the levels on which a path has a run: below the subroot, then below the root
  SELECT p.tree, p.pos, s.level AS step, (p.pos >> s.level) AS at, s.tree AS t FROM placed p
  JOIN (SELECT DISTINCT tree, level FROM sub WHERE cnt > 1) s ON s.tree = p.tree
  UNION ALL
  SELECT p.tree, p.pos, h.h + s.level, (p.tree >> s.level), -1 FROM placed p JOIN height h ON h.tree = p.tree
  CROSS JOIN (SELECT DISTINCT level FROM top WHERE cnt > 1) s),
nodes AS (SELECT tree AS t, tree AS own, level, idx, digest FROM sub
          UNION ALL SELECT -1, h.tree, h.h + top.level, top.idx, top.digest FROM top, height h),
steps AS (
  SELECT e.tree, e.pos, e.step, e.at % 2 = 1 AS is_left, n.digest FROM heads e
  LEFT JOIN nodes n ON n.t = e.t AND n.own = e.tree AND n.level = e.step AND n.idx = xor(e.at, 1)),
proofs AS (SELECT tree, pos, string_agg(digest, '' ORDER BY step) AS siblings FROM steps GROUP BY tree, pos),
folds AS (
  SELECT tree, pos, 0 AS step, coalesce(tampered, leaf) AS acc FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.step + 1, sha256(CASE WHEN s.digest IS NULL THEN f.acc WHEN s.is_left THEN s.digest || f.acc
                                           ELSE f.acc || s.digest END)
  FROM folds f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.step = f.step),
folded AS (SELECT tree, pos, arg_max(acc, step) AS folded_root FROM folds GROUP BY tree, pos),
root AS (SELECT digest AS root FROM top WHERE cnt = 1)
SELECT p.doc_id, p.leaf, r.digest AS subroot, root.root, sha256(coalesce(x.siblings, '')) AS proof_sha256, f.folded_root,
       f.folded_root = root.root AS verified
FROM placed p JOIN subroots r ON r.tree = p.tree CROSS JOIN root
JOIN folded f ON f.tree = p.tree AND f.pos = p.pos LEFT JOIN proofs x ON x.tree = p.tree AND x.pos = p.pos
"""
