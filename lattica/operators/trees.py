"""Region trees as adjacency tables: closures, paths, roll-ups and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import materialize


def ancestors(nodes: DataFrame, max_depth: int = 20) -> DataFrame:
    """(node_id, ancestor_id, distance) for every node, itself at distance 0, as far as ``max_depth`` steps.

    One join of the frontier with the parent edges for each level, not for each node.
    """
    edges = nodes.select(F.col("node_id").alias("ancestor_id"), F.col("parent_id").alias("up")).filter("up is not null")
    level = nodes.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    out = level
    for _ in range(max_depth):
        level = level.join(edges, "ancestor_id").select("node_id", F.col("up").alias("ancestor_id"), (F.col("distance") + 1).alias("distance"))
        level = materialize(level, "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def paths(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(node_id, path, depth): names from the root down to the node."""
    named = closure.join(nodes.select(F.col("node_id").alias("ancestor_id"), "name"), "ancestor_id")
    listed = F.sort_array(F.collect_list(F.struct("distance", "name")), asc=False)
    return named.groupBy("node_id").agg(F.array_join(F.transform(listed, lambda x: x["name"]), " > ").alias("path"), F.max("distance").alias("depth"))


def subtree_counts(closure: DataFrame, notes: DataFrame) -> DataFrame:
    """(node_id, n_notes, first_seen, last_touched) over each node's whole subtree.

    Notes are summed by their own node before they meet the closure, so a note is shuffled once and not once an ancestor.
    """
    own = notes.groupBy("region_id").agg(F.count("*").alias("n"), F.min("created").alias("first"), F.max(F.coalesce("updated", "created")).alias("last"))
    rolled = closure.join(own, F.col("node_id") == F.col("region_id")).groupBy(F.col("ancestor_id").alias("node_id"))
    return rolled.agg(F.sum("n").alias("n_notes"), F.min("first").alias("first_seen"), F.max("last").alias("last_touched"))


def created_windows(notes: DataFrame, cutoffs: DataFrame, group: str, days: int = 30) -> DataFrame:
    """(group, cutoff, born, recent): notes created up to each cutoff, and of those in the ``days`` before it.

    ``cutoffs`` is a handful of dates, kept as an array beside each group's rows.
    """
    dates = [r[0] for r in cutoffs.orderBy("cutoff").collect()]  # the caller's few dates
    counts = [F.struct(F.lit(d).alias("cutoff"), F.count(F.when(F.col("created") <= d, 1)).alias("born"), F.count(F.when((F.col("created") <= d) & (F.col("created") > F.date_sub(F.lit(d), days)), 1)).alias("recent")) for d in dates]
    return notes.groupBy(group).agg(F.array(*counts).alias("c")).select(group, F.inline("c"))


def prefix_counts(rows: DataFrame, path: Column) -> DataFrame:
    """(prefix, depth, n): rows under each prefix of their container path."""
    listed = rows.select(path.alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    prefixes = listed.select("n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", F.lit(1), i), "/"))).alias("depth", "prefix"))
    return prefixes.groupBy("prefix", "depth").agg(F.sum("n").alias("n"))


def deepest_owner(owned: DataFrame) -> DataFrame:
    """(signal_id, owner_id) of (signal_id, owner_id, depth, is_tag): a tag before a region, a child before its parent."""
    return owned.groupBy("signal_id").agg(F.max_by("owner_id", F.struct("is_tag", "depth", "owner_id")).alias("owner_id"))


def one_sided(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that only one of two link tables has: empty if they agree both ways."""
    l, r = left.select(*keys).distinct().withColumn("l", F.lit(1)), right.select(*keys).distinct().withColumn("r", F.lit(1))
    return l.join(r, keys, "full_outer").filter("l is null or r is null").select(*keys, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def walk_down(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node_id, depth): everything below each root, the root at depth 0, breadth first; a loop is walked once."""
    level = materialize(roots.select(F.col("node_id").alias("root"), "node_id", F.lit(0).alias("depth")).distinct(), "walk")
    out, depth = level, 0
    children = edges.select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"))
    while True:
        depth += 1
        below = level.join(children, "node_id").select("root", F.col("child").alias("node_id"), F.lit(depth).alias("depth")).distinct()
        level = materialize(below.join(out.select("root", "node_id"), ["root", "node_id"], "left_anti"), "walk")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def pruned(closure: DataFrame, leaves: DataFrame, hit: Column) -> DataFrame:
    """(node_id, n): the containers that stay open when leaves (region_id, ...) are filtered by ``hit``, with the leaves left below."""
    own = leaves.filter(hit).groupBy(F.col("region_id").alias("node_id")).agg(F.count("*").alias("n"))
    return closure.join(own, "node_id").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.sum("n").alias("n"))


def container_roots(rows: DataFrame, path: Column, group: str) -> DataFrame:
    """(root, n, depth, members): the first container of each path, its rows, its deepest path and its distinct groups; rows without one are under ""."""
    p = F.filter(path, lambda x: F.coalesce(x != "", F.lit(False)))
    listed = rows.select(F.coalesce(F.get(p, F.lit(0)), F.lit("")).alias("root"), F.size(p).alias("d"), group)
    return listed.groupBy("root").agg(F.count("*").alias("n"), F.max("d").alias("depth"), F.count_distinct(group).alias("members"))
