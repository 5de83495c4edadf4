"""Merkle manifest of a table: one hash tree per group of rows, and one over the groups' roots.

Every level is a sibling-shift self-join: the node in slot zero of each run computes the indices of its siblings (its own XOR 1 in a binary
tree, plus each slot offset otherwise), an equijoin finds them among the level's nodes, and the slot-zero rows emit the parents. Runs hold
at most ``fan`` digests, so the join keys are even however large a group is. Proofs go the other way: from the top down each node puts its
own siblings before its parent's path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomflow.llm.common import Stage, numbered

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that share a group are joined with its first row number in blocks of so many, so that no group is one key.
BLOCK_BITS = 14
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value so that no two lists of values give one text: ``-`` for null, else its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*texts: Column) -> Column:
    """SHA-256 of the texts one after the other, in lowercase hex."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


@dataclass
class Manifest:
    """``leaves``: tree, idx, n (leaves of the tree), leaf (as bytes) and the columns that were passed along; ``levels``: the runs of each
    level, lowest first, as tree, idx and n of their parents, and the digests; ``tops``: the root of each tree and its level; ``parents``:
    the manifest over these roots, if there is one above."""

    leaves: DataFrame
    levels: list[DataFrame]
    tops: DataFrame
    parents: Manifest | None = None


def _siblings(fan: int) -> Column:
    """Indices of a run's nodes, told by the one in slot zero."""
    idx, n = F.col("idx"), F.col("n")
    if fan == 2:
        return F.filter(F.array(idx, idx.bitwiseXOR(F.lit(1).cast("long"))), lambda i: i < n)
    return F.sequence(idx, F.least(idx + fan - 1, n - 1))


def _texts(run: Column) -> Column:
    return F.array_join(F.transform(run, lambda x: F.lower(F.hex(x))), "")


def _level(nodes: DataFrame, fan: int) -> DataFrame:
    """Parents of a level's nodes as tree, idx, n, with the digests of their runs in order. The plan is the same at every size."""
    asks = nodes.where(F.col("idx") % fan == 0).select("tree", "idx", "n", F.explode(_siblings(fan)).alias("other"))
    have = nodes.select("tree", F.col("idx").alias("other"), "hash")
    found = asks.hint("merge").join(have, ["tree", "other"]).groupBy("tree", "idx", "n").agg(F.sort_array(F.collect_list(F.struct("other", "hash"))).alias("run"))  # at most ``fan`` of them
    return found.select("tree", F.expr(f"idx div {fan}").alias("idx"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.col("run.hash").alias("run"))


def grow(leaves: DataFrame, stage: Stage, fan: int, name: str) -> Manifest:
    """Builds all trees level by level; as many rounds as the largest tree has levels. Each level is written once."""
    nodes, levels, tops = leaves.select("tree", "idx", "n", F.col("leaf").alias("hash")), [], []
    left = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while True:
        tops.append(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("level"), F.col("hash").alias("subroot")))
        if left <= 1:
            break
        levels.append(stage.write(_level(nodes.where("n > 1"), fan), f"{name}-{len(levels)}"))
        nodes, left = levels[-1].select("tree", "idx", "n", F.unhex(digest(_texts(F.col("run")))).alias("hash")), -(-left // fan)
    out = tops[0]
    for more in tops[1:]:
        out = out.union(more)
    return Manifest(leaves, levels, stage.write(out, f"{name}-tops"))


def build(docs: DataFrame, stage: Stage, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), fan: int = 16, changed: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table: a tree per group with leaves in order of key, and a tree over the groups' roots in order of group (null first).

    ``changed`` replaces fields for a second digest of each row (column ``other_leaf``), such as those of another copy of the table.
    Rows with one key follow each other by their digest; equal rows are leaves of their own. A null group is a group, null keys come first.
    An empty table has no leaves and no root. Columns that aren't named play no part.
    """
    col = {f: F.col(f) for f in {*fields, key, group}}
    other = {**col, **(changed or {})}
    hashed = lambda values: F.unhex(digest(*[field(values[f]) for f in fields]))
    first = docs.select(col[key].alias("key"), col[group].alias("group"), hashed(col).alias("leaf"), hashed(other).alias("other_leaf")).withColumn("tie", F.monotonically_increasing_id())
    rows = stage.write(first, "rows")  # texts are read and hashed once; the tie is fixed from here on
    placed = numbered(rows, [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("tie")], stage, "placed").withColumn("block", F.shiftright("row_number", BLOCK_BITS))
    blocks = placed.groupBy("group", "block").agg(F.min("row_number").alias("from"), F.count("*").alias("rows"))
    trees = blocks.groupBy(F.col("group").alias("tree_group")).agg(F.min("from").alias("tree"), F.sum("rows").alias("n"))
    spans = blocks.join(trees, F.col("group").eqNullSafe(F.col("tree_group"))).select("tree_group", F.col("block").alias("tree_block"), "tree", "n")
    leaves = placed.join(spans, F.col("group").eqNullSafe(F.col("tree_group")) & (F.col("block") == F.col("tree_block"))).select("tree", (F.col("row_number") - F.col("tree")).alias("idx"), "n", "leaf", "key", "group", "other_leaf")
    low = grow(stage.write(leaves, "leaves"), stage, fan, "level")
    roots = numbered(low.tops.select("tree", F.col("subroot").alias("leaf")), [F.col("tree")], stage, "roots")  # trees are numbered by their first rows, so in order of group
    n = roots.count()
    high = stage.write(roots.select(F.lit(-1).cast("long").alias("tree"), F.col("row_number").alias("idx"), F.lit(n).cast("long").alias("n"), "leaf", F.col("tree").alias("below")), "root-leaves")
    low.parents = grow(high, stage, fan, "root-level")
    stage.drop("rows", "placed")
    return low


def root_of(manifest: Manifest) -> DataFrame:
    """One row with the root of all; none for an empty table."""
    return manifest.parents.tops.select(F.lower(F.hex("subroot")).alias("root"))


def _step(run: Column, slot: Column) -> Column:
    """The digests of a run before and after a slot, as texts."""
    return F.struct(_texts(F.slice(run, F.lit(1), slot)).alias("left"), _texts(F.slice(run, slot + 2, F.size(run))).alias("right"))


def _down(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fan: int) -> DataFrame:
    """Leaves with their path (siblings of each level, lowest first) and what their tree's top carries. ``tops``: tree, level, path, carried.

    Each run of siblings is held once, by its parent, so that what moves is a parent's path and not one for each node.
    """
    carried = [c for c in tops.columns if c not in ("tree", "level", "path")]
    at = lambda level: tops.where(F.col("level") == level).drop("level").withColumn("idx", F.lit(0).cast("long"))
    slot = (F.col("idx") % fan).cast("int")

    def paths(nodes: DataFrame, level: int, runs: DataFrame | None, hint: str | None = None) -> DataFrame:
        """Nodes of a level with their paths, from the runs above them; tops have theirs already."""
        own = nodes.join(at(level), ["tree", "idx"])
        if runs is None:
            return own
        up = runs.select("tree", F.col("idx").alias("up"), "run", F.col("path").alias("rest"), *carried)
        asked = nodes.withColumn("up", F.expr(f"idx div {fan}"))
        below = (asked.hint(hint) if hint else asked).join(up, ["tree", "up"]).withColumn("path", F.concat(F.array(_step(F.col("run"), slot)), "rest"))
        columns = [*nodes.columns, "path", *carried]
        return below.select(*columns).union(own.select(*columns))

    runs = None
    for level in range(len(levels), 0, -1):
        runs = paths(levels[level - 1].select("tree", "idx", F.col("run").alias("own_run")), level, runs).withColumnRenamed("own_run", "run")
    return paths(leaves, 0, runs, "merge")


def proofs(manifest: Manifest, stage: Stage, fan: int = 16) -> DataFrame:
    """Each leaf with its path to the root, subroot and root. The path's steps hold the digests before and after the node on it."""
    top = manifest.parents.tops.select("tree", "level", F.array().cast(_PATH).alias("path"), F.lower(F.hex("subroot")).alias("root"))
    groups = _down(manifest.parents.leaves.select("tree", "idx", "below"), manifest.parents.levels, top, fan).select(F.col("below").alias("tree"), "path", "root")
    tops = stage.write(manifest.tops.join(groups, "tree").select("tree", "level", "path", F.lower(F.hex("subroot")).alias("subroot"), "root"), "paths")  # every level reads it
    return _down(manifest.leaves, manifest.levels, tops, fan)


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, F.lower(F.hex(leaf)), lambda acc, s: digest(s["left"], acc, s["right"]))


def tampered(text: Column, key: Column, every: int = 5) -> Column:
    """The text with A-Z lower-cased in rows whose key's crc32 ``every`` divides."""
    hit = F.coalesce(F.crc32(key.cast("string").cast("binary")) % every == 0, F.lit(False))
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)


def verify(docs: DataFrame, stage: Stage, key: str = "doc_id", text: str = "text", fan: int = 16, **more) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, and what a copy with tampered texts folds to with the original siblings.

    Null values are part of the digest; a null key is not tampered with. Null, empty and very long texts are hashed whole. Repeated rows
    have leaves and proofs of their own. A lone leaf is its group's root, and a lone group's root the root of all, with an empty proof.
    """
    manifest = build(docs, stage, key=key, fan=fan, changed={text: tampered(F.col(text), F.col(key))}, **more)
    found = proofs(manifest, stage, fan).withColumn("folded_root", fold(F.col("other_leaf"), F.col("path")))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.hex("leaf")).alias("leaf"), "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
