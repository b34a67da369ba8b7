"""Tour numbers of a forest: pre-order positions, subtree sizes and depths by list ranking, so that a subtree is an interval.

A walk around the forest enters and leaves every node once. Each of these steps knows its next one from the node's first child,
next sibling or parent, which gives one linked list of twice as many steps as nodes. Its ranks come by pointer doubling: in each
round a step adds up what its target has and points to where that points, so that n nodes take log2(2n) rounds, however deep
the forest is and however many children a node has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.ranking import positions, running
from lattica.session import materialize


def tour(nodes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(node_id, parent_id, pre, size, depth): a node's place in pre-order from 0, the nodes of its subtree, its steps from a root.

    ``nodes`` is (node_id, parent_id, ...); children of one parent, and roots, come by the columns of ``order`` and then by
    node_id. A node whose parent is null or does not exist is a root. Repeated ids count once; nodes on a loop, and those that
    hang on one, have no place and do not appear. v lies below u if pre(u) < pre(v) < pre(u) + size(u).
    """
    order = order or []
    nodes = materialize(nodes.select("node_id", "parent_id", *(o for o in order if o not in ("node_id", "parent_id"))).dropDuplicates(["node_id"]), "tour-nodes")
    known = nodes.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    nodes = nodes.join(known, "parent_id", "left").withColumn("parent_id", F.when(F.col("there"), F.col("parent_id"))).drop("there")
    placed = materialize(positions(nodes, [F.col("parent_id"), *map(F.col, order), F.col("node_id")]).select("node_id", "parent_id", "pos"), "tour-places")
    behind = placed.select((F.col("pos") - 1).alias("pos"), F.col("node_id").alias("next"), F.col("parent_id").alias("next_parent"))
    first = placed.groupBy("parent_id").agg(F.min_by("node_id", "pos").alias("child")).filter("parent_id IS NOT NULL").withColumnRenamed("parent_id", "node_id")
    linked = placed.join(behind, "pos", "left").withColumn("sibling", F.when(F.col("next_parent").eqNullSafe(F.col("parent_id")), F.col("next"))).join(first, "node_id", "left")
    step = lambda node, enter: F.struct(node.alias("node"), enter.alias("enter"))
    n, yes, no = F.col("node_id"), F.lit(True), F.lit(False)
    down = step(F.coalesce("child", n), F.col("child").isNotNull())
    up = F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), yes)).when(F.col("parent_id").isNotNull(), step(F.col("parent_id"), no))
    steps = linked.select(step(n, yes).alias("step"), down.alias("next"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("rise"))
    steps = steps.unionByName(linked.select(step(n, no).alias("step"), up.alias("next"), F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("rise")))
    steps = materialize(steps, "tour-steps")
    reach, total = 1, 2 * placed.count()
    while reach < total:
        ahead = steps.select(F.col("step").alias("next"), F.col("next").alias("then"), F.col("entered").alias("e"), F.col("rise").alias("r"))
        moving = steps.filter("next IS NOT NULL").join(ahead, "next")
        moved = moving.select("step", F.col("then").alias("next"), (F.col("entered") + F.col("e")).alias("entered"), (F.col("rise") + F.col("r")).alias("rise"))
        steps = materialize(moved.unionByName(steps.filter("next IS NULL")), "tour-steps")
        reach *= 2
    ended = steps.filter("next IS NULL").select("step.node", "step.enter", "entered", "rise")
    both = ended.groupBy(F.col("node").alias("node_id")).agg(
        F.max(F.when(F.col("enter"), F.col("entered"))).alias("from"), F.max(F.when(~F.col("enter"), F.col("entered"))).alias("after"), F.max(F.when(F.col("enter"), -F.col("rise"))).alias("depth"))
    both = materialize(both.filter("`from` IS NOT NULL AND after IS NOT NULL"), "tour-ends")
    size = both.count()
    out = both.select("node_id", (size - F.col("from")).alias("pre"), (F.col("from") - F.col("after")).alias("size"), "depth")
    return placed.select("node_id", "parent_id").join(out, "node_id")


def inside(pre: Column, root_pre: Column, root_size: Column) -> Column:
    """Whether a node lies in a subtree, its root included."""
    return (pre >= root_pre) & (pre < root_pre + root_size)


def subtree_sums(numbered: DataFrame, own: DataFrame, value: str, node: str = "node_id") -> DataFrame:
    """(node_id, own, total): a node's value, and the sum over its subtree, as a difference of two running sums in pre-order.

    ``own`` is (node, value), several rows a node add up; a node without a row counts nothing. No ancestor is joined.
    """
    mine = own.groupBy(F.col(node).alias("node_id")).agg(F.sum(value).alias("own"))
    each = numbered.select("node_id", "pre", "size").join(mine, "node_id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    summed = materialize(running(each, [F.col("pre")], {"upto": "own"}), "tour-sums")
    last = summed.select(F.col("pre").alias("last"), F.col("upto").alias("through"))
    met = summed.withColumn("last", F.col("pre") + F.col("size") - 1).join(last, "last")
    return met.select("node_id", "own", (F.col("through") - F.col("upto") + F.col("own")).alias("total"))
