"""Merkle trees over a table: one per source, and one over their roots, with a proof for each row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import documents, written
from spanloom.llm.numbering import numbered

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def spelled(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(spelled, fields)), 256))


def hexed(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def _sibling(left: bool, arity: int) -> Column:
    """Digests of the siblings on one side, joined: slots go round, so the k-th after the last slot is on the left."""
    none = F.lit(b"")
    sides = [(F.col("slot") + k >= arity) == F.lit(left) for k in range(1, arity)]
    return F.concat(*(F.coalesce(F.when(on, F.col(f"h{k}")), none) for k, on in enumerate(sides, 1)))


def step(nodes: DataFrame, name: str, arity: int) -> tuple[DataFrame, DataFrame]:
    """One level: ``nodes(tree, size, idx, h, ...)`` with their siblings, and their parents.

    A node's slot is its place in its run of ``arity``.  Each other slot of the run is an equijoin with the
    node of that computed index: an XOR with 1 in binary trees, else the run's start plus the next slots in
    turn.  Slot zero's rows, which so hold their run in order, emit the parents.  (tree, idx) is
    unique, so no join key is hot.  ``near`` and ``far`` are the siblings to the left and to the right.
    """
    rows = nodes.withColumn("slot", F.pmod("idx", F.lit(arity)).cast("int"))
    for k in range(1, arity):
        at = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else F.col("idx") - F.col("slot") + F.pmod(F.col("slot") + k, F.lit(arity))
        kin = nodes.select(F.col("tree").alias("kin_tree"), F.col("idx").alias("kin_idx"), F.col("h").alias(f"h{k}"))
        rows = rows.join(kin, (F.col("tree") == F.col("kin_tree")) & (at == F.col("kin_idx")), "left").drop("kin_tree", "kin_idx")
    level = written(rows.select(*nodes.columns, "slot", _sibling(True, arity).alias("near"), _sibling(False, arity).alias("far")), name)
    parents = level.where("slot = 0").select(
        "tree", F.expr(f"(size + {arity - 1}) div {arity}").alias("size"), F.expr(f"idx div {arity}").alias("idx"), F.unhex(F.sha2(F.concat(hexed("h"), hexed("far")), 256)).alias("h")
    )
    return level, parents


def climbed(nodes: DataFrame, size: int, name: str, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels from the leaves up, and ``roots(tree, h, depth)``; ``size``: number of leaves of the largest tree."""
    levels, roots = [], []
    while True:
        roots.append(nodes.where("size = 1").select("tree", "h", F.lit(len(levels)).alias("depth")))
        if size <= 1:
            return levels, reduce(DataFrame.union, roots)
        level, parents = step(nodes.where("size > 1"), name, arity)
        levels.append(level)
        nodes, size = written(parents, name), -(-size // arity)


def descended(leaves: DataFrame, levels: list[DataFrame], roots: DataFrame, name: str, arity: int) -> DataFrame:
    """``leaves`` with the columns of ``roots(tree, depth, path, ...)``, paths made longer level by level.

    ``path`` is an array of (near, far) from the node up.  Each level joins its nodes with their
    parents' paths, so a path is shuffled once for ``arity`` nodes.
    """
    extra = [c for c in roots.columns if c not in ("tree", "depth", "path")]
    single = leaves.where("size = 1").join(roots.where("depth = 0").drop("depth"), "tree").select(*leaves.columns, *extra, "path")
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        up = roots.where(F.col("depth") == k + 1).select("tree", F.lit(0).cast("long").alias("parent"), *extra, F.col("path").alias("above"))
        if paths is not None:
            up = up.union(paths.select("tree", F.col("idx").alias("parent"), *extra, F.col("path").alias("above")))
        keep = leaves.columns if k == 0 else ["tree", "idx"]
        here = levels[k].withColumn("parent", F.expr(f"idx div {arity}")).join(up, ["tree", "parent"])
        paths = here.select(*keep, *extra, F.concat(F.array(F.struct("near", "far")), "above").alias("path"))
        if k:
            paths = written(paths, name)
    return single if paths is None else single.union(paths)


def folded(leaf: Column, path: Column) -> Column:
    """The root, as hex text, that a leaf's digest and its path lead to."""
    return F.aggregate(path, hexed(leaf), lambda h, s: F.sha2(F.concat(hexed(s["near"]), h, hexed(s["far"])), 256))


def proof_hash(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(hexed(s["near"]), hexed(s["far"])))), 256)


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", by: str = "source", arity: int = ARITY) -> tuple[DataFrame, str | None]:
    """One row per row of ``docs`` (``key``, ``by``, leaf, altered_leaf, subroot, path), and the root.

    Leaves hash the ``fields``; in a tree of one ``by`` value they ascend by ``key``, then by hash.  ``altered``
    replaces fields in altered_leaf, for a check of the rows as they are now against this manifest.
    Leaves are numbered over range partitions, so no source is gathered anywhere.

    Nulls hash as such and come first, as a key and as a source of its own; empty texts are not null.
    Repeated rows are leaves each.  Columns other than the named ones are ignored.  An empty table gives no rows and no root.
    """
    columns = {c: F.col(c) for c in fields}
    leaves = docs.select(F.col(key).alias("key"), F.col(by).cast("string").alias("by"), leaf_hash(list(columns.values())).alias("h"), leaf_hash(list((columns | (altered or {})).values())).alias("altered_leaf"))
    leaves = written(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    order = numbered(leaves, [F.asc_nulls_first("by"), F.asc_nulls_first("key"), F.asc("h"), F.asc("row")])
    parts = written(order.groupBy("part", "by").agg(F.min("n").alias("low"), F.count("*").alias("many")), "sources")
    trees = numbered(parts.groupBy("by").agg(F.min("low").alias("start"), F.sum("many").alias("size")), [F.asc_nulls_first("by")], "tree", "tree_part").drop("tree_part")
    starts = parts.select(F.col("part").alias("its_part"), F.col("by").alias("its_by")).join(trees, F.col("its_by").eqNullSafe(F.col("by"))).drop("by")
    nodes = order.join(starts, (F.col("part") == F.col("its_part")) & F.col("by").eqNullSafe(F.col("its_by")))
    nodes = written(nodes.select("tree", "size", (F.col("n") - F.col("start")).alias("idx"), "h", "key", "by", "altered_leaf"), "nodes")

    largest, n_trees = trees.agg(F.max("size"), F.count("*")).head()
    levels, roots = climbed(nodes, largest or 0, "level", arity)
    tops = written(roots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("size"), F.col("tree").alias("idx"), "h", "depth"), "tops")
    upper, root = climbed(tops, n_trees, "top-level", arity)
    top = root.select(hexed("h")).head()
    none = F.array().cast("array<struct<near:binary,far:binary>>")
    above = descended(tops, upper, root.select("tree", "depth", none.alias("path")), "top-path", arity)
    subroots = written(above.select(F.col("idx").alias("tree"), "depth", F.col("h").alias("subroot"), "path"), "subroots")
    rows = descended(nodes, levels, subroots, "path", arity)
    return rows.select(F.col("key").alias(key), F.col("by").alias(by), F.col("h").alias("leaf"), "altered_leaf", "subroot", "path"), top and top[0]


def verified(rows: DataFrame, root: str | None) -> DataFrame:
    """Rows of a manifest with digests as hex text, proof_sha256, the root that altered_leaf and the siblings lead to, and whether it is ``root``."""
    out = rows.withColumns({"folded_root": folded(F.col("altered_leaf"), F.col("path")), "proof_sha256": proof_hash(F.col("path")), "root": F.lit(root).cast("string")})
    return out.withColumns({"verified": F.col("folded_root") == F.col("root"), "leaf": hexed("leaf"), "subroot": hexed("subroot")}).drop("path", "altered_leaf")


def op12_merkle_manifest(spark, sf_dir):
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))).otherwise(F.col("text").cast("string"))
    rows, root = manifest(documents(spark, sf_dir), {"text": text})
    return verified(rows, root).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLE = {
    "op12_merkle_manifest": r"""
WITH RECURSIVE
crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
rows_ AS (
  SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 2 = 0 AS hit
  FROM documents, crc_table
),
spelled AS (
  SELECT doc_id, source, text,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS now
  FROM rows_
),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS altered FROM spelled
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS r, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM leaves
),
nodes AS (
  SELECT 0 AS lvl, tree, idx, leaf AS h FROM placed
  UNION ALL
  SELECT lvl + 1, tree, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS many FROM nodes) WHERE many > 1 GROUP BY lvl, tree, idx // 3
),
subroots AS (SELECT tree, arg_max(h, lvl) AS h FROM nodes GROUP BY tree),
tops AS (
  SELECT 0 AS lvl, tree AS idx, h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS many FROM tops) WHERE many > 1 GROUP BY lvl, idx // 3
),
kin AS (
  SELECT n.lvl, n.tree, n.idx, coalesce(string_agg(m.h, '' ORDER BY m.idx) FILTER (WHERE m.idx < n.idx), '') AS l, coalesce(string_agg(m.h, '' ORDER BY m.idx) FILTER (WHERE m.idx > n.idx), '') AS g
  FROM (SELECT *, count(*) OVER (PARTITION BY lvl, tree) AS many FROM nodes) n JOIN nodes m ON m.lvl = n.lvl AND m.tree = n.tree AND m.idx // 3 = n.idx // 3
  WHERE n.many > 1 GROUP BY n.lvl, n.tree, n.idx
),
top_kin AS (
  SELECT n.lvl, n.idx, coalesce(string_agg(m.h, '' ORDER BY m.idx) FILTER (WHERE m.idx < n.idx), '') AS l, coalesce(string_agg(m.h, '' ORDER BY m.idx) FILTER (WHERE m.idx > n.idx), '') AS g
  FROM (SELECT *, count(*) OVER (PARTITION BY lvl) AS many FROM tops) n JOIN tops m ON m.lvl = n.lvl AND m.idx // 3 = n.idx // 3 WHERE n.many > 1 GROUP BY n.lvl, n.idx
),
climb AS (
  SELECT r, tree, 0 AS lvl, idx, altered AS h, '' AS proof FROM placed
  UNION ALL
  SELECT r, c.tree, c.lvl + 1, c.idx // 3, sha256(l || h || g), proof || l || g FROM climb c JOIN kin k ON k.lvl = c.lvl AND k.tree = c.tree AND k.idx = c.idx
),
top_climb AS (
  SELECT r, 0 AS lvl, max(tree) AS idx, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM climb GROUP BY r
  UNION ALL
  SELECT r, c.lvl + 1, c.idx // 3, sha256(l || h || g), proof || l || g FROM top_climb c JOIN top_kin k ON k.lvl = c.lvl AND k.idx = c.idx
),
ends AS (SELECT r, arg_max(h, lvl) AS folded_root, sha256(arg_max(proof, lvl)) AS proof_sha256 FROM top_climb GROUP BY r),
root AS (SELECT arg_max(h, lvl) AS root FROM tops)
SELECT doc_id, leaf, s.h AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots s USING (tree) JOIN ends USING (r), root
""",
}
QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
