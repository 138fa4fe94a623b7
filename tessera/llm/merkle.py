"""Merkle manifest of a table: a digest for each row, each part and the whole, and each row's proof.

Rows are leaves. Each part (say, a language) has a tree over its leaves in the order of a key; the parts' roots, in the order of the
parts, are the leaves of one more tree, whose root stands for the table. While a level has several nodes, every ``arity`` consecutive
ones become the SHA-256 of their hexadecimal digests, one after another; the last run may be shorter, even of one.

A tree is climbed in aligned blocks of ``arity ** LEVELS`` leaves. A task walks a block recursively in postorder: each call returns
the digest of its subtree and, while it unwinds, appends the siblings of its children to the paths of the leaves below them. Block roots are
leaves of the next traversal, until each tree has one node; a leaf's path is that in its block, then that of the block's root. So no task holds
more than a block, whatever the size of a part, and there are as many traversals as the logarithm of the largest part to a base of 1,024.

Positions come from a sort by range, not from a window over a part: rows are numbered within their partition, and partitions are counted
in a table of at most a row for each partition and part. The numbered leaves, narrow rows without texts, are stored in the shared folder, and so is each
traversal, so a lost executor repeats no more than its own blocks.

Defined cases: null keys come first, rows of one key by their leaf; rows alike are leaves of their own, next to each other, and
have proofs of their own; a null part is a part, the first; an empty table gives no rows; a long text is hashed whole; a kept column
with the name of an added one is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.store import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that a block has: 1,024 leaves of a binary tree.
LEVELS = 10
NODE = "tree string, place bigint, row bigint, digest binary, path array<struct<at:int,others:array<binary>>>, root binary"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256, as hexadecimal text, of the fields one after another: ``-`` if null, else UTF-8 byte count, colon, value."""
    plain = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in plain)), 256)


def walk(digests: Sequence[bytes], paths: list[list], start: int, height: int, arity: int) -> bytes:
    """The digest of the subtree of that height over the leaves from ``start`` on; the leaves' paths get their siblings."""
    if not height:
        return digests[start]
    span = arity ** (height - 1)
    starts = range(start, min(start + arity * span, len(digests)), span)
    children = [walk(digests, paths, s, height - 1, arity) for s in starts]
    for at, s in enumerate(starts):
        step = {"at": at, "others": children[:at] + children[at + 1 :]}
        for path in paths[s : s + span]:
            path.append(step)
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def height(leaves: int, arity: int) -> int:
    """Levels above so many leaves, until one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // arity), levels + 1
    return levels


def _numbered(leaves: DataFrame, order: list) -> DataFrame:
    """``leaves(tree, digest, ...)`` with ``place``, from 0 in each tree, ``size``, the tree's leaves, and ``row``, a number of the row."""
    ranged = leaves.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "digest", "copy")
    at = stored(ranged.sortWithinPartitions("tree", *order, "digest", "copy").drop("copy").withColumn("row", F.monotonically_increasing_id()))
    chunk = F.call_function("shiftright", F.col("row"), F.lit(33))
    # A partition of the sort has the rows of a tree in one run.
    runs = at.groupBy("tree", chunk.alias("chunk")).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    runs = runs.select("tree", "chunk", "first", F.sum("n").over(tree).alias("size"), (F.sum("n").over(tree.orderBy("chunk")) - F.col("n")).alias("before"))
    return at.withColumn("chunk", chunk).join(runs, ["tree", "chunk"]).withColumn("place", F.col("row") - F.col("first") + F.col("before")).drop("chunk", "first", "before")


def _traverse(nodes: DataFrame, arity: int) -> DataFrame:
    """Each block of ``nodes(tree, place, size, row, digest)`` walked: nodes with their paths in it, the first of a block with its root."""
    block = arity**LEVELS

    def walked(part: pa.Table) -> pa.Table:
        part = part.sort_by("place")
        digests, paths = part["digest"].to_pylist(), [[] for _ in range(part.num_rows)]
        size = part["size"][0].as_py()
        root = walk(digests, paths, 0, LEVELS if size > block else height(size, arity), arity)
        kind = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.binary()))]))
        columns = [*(part[c] for c in ("tree", "place", "row", "digest")), pa.array(paths, kind), pa.array([root, *[None] * (len(paths) - 1)], pa.binary())]
        return pa.table(columns, names=["tree", "place", "row", "digest", "path", "root"])

    number = F.floor(F.col("place") / block).alias("block")
    return stored(nodes.select("tree", "place", "size", "row", "digest").groupBy("tree", number).applyInArrow(walked, NODE))


def _climbed(nodes: DataFrame, arity: int) -> DataFrame:
    """``(tree, row, digest, path, root)`` for each of ``nodes(tree, place, size, row, digest)``, with whole paths and roots."""
    block = arity**LEVELS
    below = _traverse(nodes, arity)
    number = F.floor(F.col("place") / block).alias("place")
    # The block of a tree's last leaf tells how many there are.
    tops = below.where("root IS NOT NULL").select("tree", number, F.lit(0).cast("long").alias("row"), F.col("root").alias("digest"))
    tops = tops.join(tops.groupBy("tree").agg(F.count("*").alias("size")), "tree")
    above = _climbed(tops, arity).select("tree", "place", F.col("path").alias("further"), F.col("root").alias("top")) if tops.where("size > 1").head(1) else None
    if above is None:
        above = tops.select("tree", "place", F.array().cast("array<struct<at:int,others:array<binary>>>").alias("further"), F.col("digest").alias("top"))
    joined = below.drop("root").withColumn("block", F.floor(F.col("place") / block)).join(above.withColumnRenamed("place", "block"), ["tree", "block"])
    return joined.select("tree", "place", "row", "digest", F.concat("path", "further").alias("path"), F.col("top").alias("root"))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right, as one text."""
    return F.array_join(F.flatten(F.transform(path, lambda s: F.transform(s["others"], _text))), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    text = lambda found: F.array_join(F.transform(found, _text), "")
    step = lambda got, s: F.sha2(F.concat(text(F.slice(s["others"], F.lit(1), s["at"])), got, text(F.slice(s["others"], s["at"] + 1, F.greatest(F.size(s["others"]) - s["at"], F.lit(0))))), 256)
    return F.aggregate(path, leaf, step)


def manifest(rows: DataFrame, keep: list[str], fields: Sequence[str] = FIELDS, part: str = "lang", key: str = "doc_id", arity: int = 2) -> DataFrame:
    """``rows``' columns ``keep`` with ``merkle_leaf``, ``merkle_subroot``, ``merkle_root`` (hexadecimal) and ``merkle_path``.

    A path has a step for each level, up to the part's root and on to the table's: the place of the own node in its run, and the others' digests.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(part).cast("string")), F.lit(""))
    leaves = rows.select(tree.alias("tree"), F.col(key).alias("key"), F.unhex(leaf_digest(*map(F.col, fields))).alias("digest"), F.struct(*keep).alias("kept"))
    leaves = _numbered(leaves, ["key"])
    climbed = _climbed(leaves, arity)
    parts = climbed.where("place = 0").select(F.lit("").alias("tree"), F.col("tree").alias("part"), F.col("root").alias("digest"))
    parts = _numbered(parts, ["part"])
    whole = _climbed(parts, arity).select("row", F.col("path").alias("further"), F.col("root").alias("whole")).join(parts.select("row", "part"), "row")
    done = climbed.join(whole.drop("row").withColumnRenamed("part", "tree"), "tree").join(leaves.select("row", "kept"), "row")
    added = ["merkle_leaf", "merkle_subroot", "merkle_root", "merkle_path"]
    return done.select(
        *(F.col("kept")[c].alias(c) for c in keep if c not in added),
        _text(F.col("digest")).alias("merkle_leaf"), _text(F.col("root")).alias("merkle_subroot"), _text(F.col("whole")).alias("merkle_root"), F.concat("path", "further").alias("merkle_path"),
    )
