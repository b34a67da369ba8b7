"""Merkle manifest of a table: one digest a row, a tree of eight over every group of rows, one tree over the groups.

Rows are put in order by range partitions and numbered within their group; every 4,096 consecutive ones (8**4, so that the
tree's own runs never straddle a cut) are a block. A block is traversed recursively in postorder: a subtree's digest comes back
from the call, and while the calls unwind each contained leaf has its siblings on that level appended. The blocks' roots are
the leaves of the next traversal, which is distributed in the same way, until a group has one node left. The leaves' paths are
then those of their block, followed by those of the blocks above. No task holds more than a block, and the driver holds nothing.

Digests are SHA-256 over hex text, as is usual for manifests that are compared across tools; they are kept as 32 bytes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import small
from lattica.operators.ranking import positions
from lattica.session import materialize

WIDTH = 8
#: Levels of a block, so WIDTH ** LEVELS nodes; more of them make fewer, larger blocks.
LEVELS = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

PATH = "array<struct<before:binary,after:binary>>"


def row_digest(*fields: Column) -> Column:
    """Hex SHA-256 of the values one after the other, each as its bytes' count, a colon and itself, or as `-` if null."""
    said = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*said), 256)


def fold(path: Column, leaf: Column) -> Column:
    """The hex root that a hex leaf and its path of siblings give."""
    text = lambda b: F.lower(F.hex(b))
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(text(s["before"]), node, text(s["after"])), 256))


def proof_digest(path: Column) -> Column:
    """Hex SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.lower(F.hex(F.concat(s["before"], s["after"])))), ""), 256)


def visit(leaves: list[bytes], paths: list[list], low: int, high: int, height: int) -> bytes:
    """The digest of leaves[low:high], a subtree of that height; appends to the paths of the leaves while it unwinds."""
    if height == 0:
        return leaves[low]
    step = WIDTH ** (height - 1)
    starts = range(low, high, step)
    children = [visit(leaves, paths, at, min(at + step, high), height - 1) for at in starts]
    for k, at in enumerate(starts):
        beside = {"before": b"".join(children[:k]), "after": b"".join(children[k + 1 :])}
        for path in paths[at : min(at + step, high)]:
            path.append(beside)
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def traverse(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``nodes`` with block, path and top: each block's tree, its leaves' paths and its root.

    A group of one block ends at its own root; in a group of several every block has all its levels, the last one too.
    """
    size = WIDTH**levels
    fields = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))

    def block(key, rows):
        rows = rows.sort_by("pos")
        leaves, height = rows.column("digest").to_pylist(), levels
        if key[1].as_py() == 0:
            height = next(h for h in range(levels + 1) if WIDTH**h >= len(leaves))
        paths: list[list] = [[] for _ in leaves]
        top = visit(leaves, paths, 0, len(leaves), height)
        return rows.append_column("path", pa.array(paths, fields)).append_column("top", pa.array([top] * len(leaves), pa.binary()))

    placed = nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    return placed.groupBy("grp", "block").applyInArrow(block, f"{schema}, path {PATH}, top binary")


def climb(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (grp, pos, digest and more) with path, a node's siblings up to the root of its group, and top, that root.

    ``pos`` counts from 0 without a gap in each group. Each pass divides the nodes by 4,096.
    """
    low = materialize(traverse(nodes, levels), "merkle-paths")
    roots = low.filter(F.col("pos") == F.col("block") * WIDTH**levels).select("grp", "block", "top")
    many = roots.groupBy("grp").agg(F.max("block").alias("last")).filter("last > 0").select("grp")
    if many.isEmpty():
        return low.drop("block")
    upper = roots.join(small(many), "grp", "left_semi").select("grp", F.col("block").alias("pos"), F.col("top").alias("digest"))
    above = climb(upper, levels).select("grp", F.col("pos").alias("block"), F.col("path").alias("__rest"), F.col("top").alias("__top"))
    joined = low.join(small(materialize(above, "merkle-above")), ["grp", "block"], "left")
    path = F.when(F.col("__rest").isNull(), F.col("path")).otherwise(F.concat("path", "__rest"))
    return joined.withColumns({"path": path, "top": F.coalesce("__top", "top")}).drop("block", "__rest", "__top")


def numbered(rows: DataFrame, group: str, order: list) -> DataFrame:
    """``rows`` with pos from 0 in each group, in order; ``group`` comes first in that order."""
    placed = materialize(positions(rows, [F.col(group), *order], "__pos"), "merkle-places")
    first = placed.groupBy(group).agg(F.min("__pos").alias("__first"))
    return placed.join(small(first), group).withColumn("pos", F.col("__pos") - F.col("__first")).drop("__pos", "__first")


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: list[str] | None = None, altered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(key, leaf, subroot, root, path, altered) for every row: its digest, its group's root, the root of all, its siblings.

    Groups are ordered bytewise, the null one first; rows of a group by ``key`` (null first), rows of one key by their digest, and
    equal rows are a leaf each. ``altered`` is a column for the digest of a row as it is found later, null where it is unchanged;
    it is carried along, so that a check needs no second join. Null and empty values differ, texts of any length are one digest,
    other columns are ignored, an empty table gives no rows.
    """
    fields = fields or FIELDS
    grp = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    found = F.lit(None).cast("string") if altered is None else altered
    rows = docs.select(F.col(key).alias("key"), grp.alias("grp"), F.unhex(row_digest(*map(F.col, fields))).alias("digest"), F.unhex(found).alias("altered"), F.monotonically_increasing_id().alias("uid"))
    rows = materialize(rows, "merkle-leaves")
    leaves = climb(numbered(rows, "grp", [F.col("key"), F.col("digest"), F.col("uid")]).drop("uid"), levels)
    tops = materialize(leaves.filter("pos = 0").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("digest")), "merkle-tops")
    ends = climb(numbered(tops, "grp", [F.col("name")]), levels)
    ends = materialize(ends.select(F.col("name").alias("grp"), F.col("path").alias("__above"), F.col("top").alias("__root")), "merkle-ends")
    text = lambda c: F.lower(F.hex(c))
    return leaves.join(small(ends), "grp").select(
        F.col("key").alias(key), text("digest").alias("leaf"), text("top").alias("subroot"), text("__root").alias("root"), F.concat("path", "__above").alias("path"), text("altered").alias("altered"),
    )


def verify(built: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified): each row as found, against the root of the manifest."""
    folded = built.withColumn("folded_root", fold(F.col("path"), F.coalesce("altered", "leaf")))
    return folded.select(key, "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
