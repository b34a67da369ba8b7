"""Tag and region graphs: co-occurrence, elevation, overlap, implied edges, neighbour walks and context vectors.

Self-joins go through an inverted relation (note -> tags). A note's tag set is one row's array, so its pairs are made inside
the row and counted with map-side combining; no pair of rows of one key is ever joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import materialize


#: Items of one key from which on its pairs are made block by block, in different tasks.
BLOCK = 200


def cooccurrence(links: DataFrame, key: str = "note_id", item: str = "tag_id", block: int = BLOCK) -> DataFrame:
    """(a, b, n): in how many ``key`` groups two items stand together, a < b. Items of a group are distinct.

    A group of more than ``block`` items is cut into blocks; two blocks at a time make their pairs in a task of their own.
    """
    sets = links.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    few = sets.filter((F.size("s") > 1) & (F.size("s") <= block)).select(F.inline(pairs))
    starts = F.sequence(F.lit(1), F.size("s"), F.lit(block))
    blocks = sets.filter(F.size("s") > block).select(key, F.posexplode(F.transform(starts, lambda i: F.slice("s", i, F.lit(block)))).alias("i", "part"))
    two = blocks.select(key, "i", "part").join(blocks.select(key, F.col("i").alias("j"), F.col("part").alias("other")), key).filter("i <= j").repartition(key, "i", "j")
    across = F.flatten(F.transform("part", lambda x: F.transform(F.filter("other", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return few.unionByName(two.select(F.inline(across))).groupBy("a", "b").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def elevation(tags: DataFrame) -> DataFrame:
    """(tag_id, elevation): freq x recency x max(1, degree), scaled so that the highest is 100 and none is below 1."""
    raw = tags.withColumn("raw", F.col("freq") * F.col("recency") * F.greatest(F.col("degree"), F.lit(1)))
    top = raw.agg(F.max("raw").alias("top"))
    return raw.crossJoin(F.broadcast(top)).select("tag_id", F.greatest(F.lit(1.0), F.round(F.col("raw") / F.col("top") * 100, 2)).alias("elevation"))  # one row


def surprising(edges: DataFrame, degree: DataFrame, least: int = 3, top: int = 20) -> DataFrame:
    """(a, b, novelty): the ``top`` edges by weight / (degree x degree) between nodes of at least ``least`` edges."""
    d = lambda end: degree.select(F.col("id").alias(end), F.col("degree").alias(f"d{end}"))
    joined = edges.join(d("a"), "a").join(d("b"), "b").filter((F.col("da") >= least) & (F.col("db") >= least))
    return joined.select("a", "b", F.round(F.col("n") / (F.col("da") * F.col("db")), 9).alias("novelty")).orderBy(F.desc("novelty"), "a", "b").limit(top)


def overlap(left: DataFrame, right: DataFrame, key: str, floor: float, of: str = "left") -> DataFrame:
    """(l, r, shared, ratio): items of two link tables by the keys that they share, over ``of`` (left, right or min) size."""
    size = lambda t, c: t.groupBy(c).agg(F.count_distinct(key).alias(f"n{c}"))
    met = left.select(key, "l").distinct().join(right.select(key, "r").distinct(), key).groupBy("l", "r").agg(F.count("*").alias("shared"))
    joined = met.join(size(left, "l"), "l").join(size(right, "r"), "r")
    base = {"left": F.col("nl"), "right": F.col("nr"), "min": F.least("nl", "nr")}[of]
    return joined.withColumn("ratio", F.round(F.col("shared") / base, 6)).filter(F.col("ratio") >= floor).select("l", "r", "shared", "ratio")


def set_jaccard(members: DataFrame, group: str, item: str, floor: float, top: int | None = None) -> DataFrame:
    """(a, b, jaccard) of groups whose sets of items overlap by ``floor`` or more.

    Counted through the groups of each item (inside one row), so groups without a common item never meet.
    """
    sizes = members.groupBy(group).agg(F.count_distinct(item).alias("n"))
    shared = cooccurrence(members, item, group)
    joined = shared.join(sizes.select(F.col(group).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(group).alias("b"), F.col("n").alias("nb")), "b")
    out = joined.select("a", "b", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("jaccard")).filter(F.col("jaccard") >= floor)
    return out.orderBy(F.desc("jaccard"), "a", "b").limit(top) if top else out


def implied_edges(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """(a, b, weight): tag edges summed between the regions that own the tags, over the largest; own pairs left out."""
    o = lambda end: owner.select(F.col("tag_id").alias(end), F.col("region").alias(f"r{end}"))
    joined = edges.join(o("a"), "a").join(o("b"), "b").filter("ra <> rb")
    total = joined.groupBy(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y")).agg(F.sum("n").alias("w"))
    top = total.agg(F.max("w").alias("top"))
    return total.crossJoin(F.broadcast(top)).select(F.col("x").alias("a"), F.col("y").alias("b"), F.round(F.col("w") / F.col("top"), 6).alias("weight"))  # one row


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of undirected (a, b, weight) edges, each in both directions."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def neighbours(seeds: DataFrame, edges: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """(seed, dst, rank): the first ``k`` neighbours of each seed by ``order``; at most k rows a seed leave the mappers."""
    met = both_ways(edges).join(seeds.select(F.col("id").alias("src")), "src")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(*order))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("src").alias("seed"), "dst", "rank")


def edge_gate(edges: DataFrame, floors: dict[str, float], least_weight: float = 0.4) -> DataFrame:
    floor = F.lit(0.5)
    for kind, value in floors.items():
        floor = F.when(F.col("type") == kind, value).otherwise(floor)
    return edges.filter((F.col("weight") >= least_weight) & (F.col("confidence") >= floor))


def weighted_mean_vectors(rows: DataFrame, group: str, vector: str, weight: Column, dim: int) -> DataFrame:
    """(group, mean): weighted mean of arrays of ``dim`` numbers, one aggregate a component, combined in the mappers."""
    sums = [F.sum(F.get(F.col(vector), F.lit(i)).cast("double") * weight) for i in range(dim)]
    return rows.groupBy(group).agg(F.array(*sums).alias("s"), F.sum(weight).alias("w")).select(group, F.transform("s", lambda x: x / F.col("w")).alias("mean"))


def context_vectors(nodes: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """(id, context): half a node's own vector, half its neighbours' weighted mean, at length one; without any, its own."""
    met = both_ways(edges).join(nodes.select(F.col("id").alias("dst"), "vector"), "dst")
    mean = weighted_mean_vectors(met, "src", "vector", F.col("weight"), dim)
    joined = nodes.join(mean, nodes.id == mean.src, "left")
    mixed = F.when(F.col("mean").isNull(), F.transform("vector", lambda x: x.cast("double"))).otherwise(F.zip_with("vector", "mean", lambda x, y: 0.5 * x.cast("double") + 0.5 * y))
    out = joined.select("id", mixed.alias("m")).withColumn("len", F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x)))
    return out.select("id", F.transform("m", lambda x: x / F.when(F.col("len") > 0, F.col("len")).otherwise(1.0)).alias("context"))


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, label) communities: each round a node takes its neighbours' heaviest label, the least at a tie.

    Ends when no label changes, or after ``rounds`` rounds (labels of a bipartite part may swap for ever). Stands in for
    Leiden communities, which the library leaves to an optional package; approximate by nature.
    """
    ways = both_ways(edges)
    labels = materialize(ways.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct(), "labels")
    for _ in range(rounds):
        votes = ways.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
        fresh = materialize(votes.groupBy(F.col("src").alias("id")).agg(F.max_by("label", F.struct("w", (-F.col("label")).alias("t"))).alias("label")), "labels")
        moved = fresh.join(labels.withColumnRenamed("label", "was"), "id").filter("label <> was")
        labels = fresh
        if moved.isEmpty():
            break
    return labels


def same_community_bump(edges: DataFrame, communities: DataFrame, bump: float = 0.1) -> DataFrame:
    """``edges`` (src, dst, weight) with ``bump`` more weight, 1 at most, where both ends are of one community."""
    of = lambda end: communities.select(F.col("id").alias(end), F.col("label").alias(f"__{end}"))
    joined = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    weight = F.when(F.col("__src") == F.col("__dst"), F.least(F.lit(1.0), F.col("weight") + bump)).otherwise(F.col("weight"))
    return joined.withColumn("weight", weight).select(*edges.columns)


def sibling_edges(edges: DataFrame, owner: DataFrame, closure: DataFrame) -> DataFrame:
    """(parent, a, b, weight): tag edges summed between the two children of their lowest common ancestor, over the largest of the parent.

    ``owner`` (tag_id, node_id) says where a tag is held, ``closure`` is trees.ancestors' table. Ends in one node, in nodes
    of one line, or without a common ancestor give none. Sums run over pairs of leaves before they meet the closure.
    """
    at = lambda end: owner.select(F.col("tag_id").alias(end), F.col("node_id").alias(f"n{end}"))
    leaves = edges.join(at("a"), "a").join(at("b"), "b").filter("na <> nb").groupBy("na", "nb").agg(F.sum("weight").alias("w"))
    up = lambda end: closure.select(F.col("node_id").alias(f"n{end}"), F.col("ancestor_id").alias("parent"), F.col("distance").alias(f"d{end}"))
    met = leaves.join(up("a"), "na").join(up("b"), ["nb", "parent"])
    lowest = met.groupBy("na", "nb").agg(F.min_by(F.struct("parent", "da", "db", "w"), F.struct("da", "db")).alias("m")).select("na", "nb", "m.*").filter("da > 0 and db > 0")
    child = lambda end: closure.select(F.col("node_id").alias(f"n{end}"), F.col("ancestor_id").alias(f"c{end}"), (F.col("distance") + 1).alias(f"d{end}"))
    named = lowest.join(child("a"), ["na", "da"]).join(child("b"), ["nb", "db"])
    total = named.groupBy("parent", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))
    top = total.groupBy("parent").agg(F.max("w").alias("top"))
    return total.join(top, "parent").select("parent", "a", "b", F.round(F.col("w") / F.col("top"), 6).alias("weight"))


def graph_view(regions: DataFrame, tags: DataFrame, links: DataFrame, signals: DataFrame, notes: DataFrame, note_tags: DataFrame, region_edges: DataFrame, tag_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the flat graph: typed projections of the tables, laid one below the other.

    regions (id, parent_id, label, centrality), tags (id, region_id, label, centrality), links (tag_id, other_id),
    signals (id, owner_id, home, label, severity), notes (id, region_id, label, primary_tag), note_tags (note_id, tag_id),
    region_edges and tag_edges (a, b, weight). A signal with several owners is one node with an edge from each.
    """
    lit = lambda v: F.lit(v)

    def node(rows, kind, home, layer, centrality):
        return rows.select(F.col("id"), lit(kind).alias("type"), "label", home.alias("home"), lit(layer).alias("layer"), centrality.cast("double").alias("centrality"))

    def edge(rows, src, dst, kind, weight, provenance, confidence):
        value = lambda v: v if isinstance(v, Column) else F.lit(v)
        return rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), lit(kind).alias("type"), value(weight).cast("double").alias("weight"), lit(provenance).alias("provenance"), value(confidence).cast("double").alias("confidence"))

    known = signals.groupBy("id").agg(F.min("label").alias("label"), F.min("home").alias("home"), F.max("severity").alias("severity"))
    counted = notes.join(note_tags.groupBy(F.col("note_id").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    nodes = [
        node(regions, "region", F.col("id"), 3, F.col("centrality")), node(tags, "tag", F.col("region_id"), 2, F.col("centrality")),
        node(known, "signal", F.col("home"), 2, F.col("severity")), node(counted, "note", F.col("region_id"), 0, F.coalesce("n", lit(0))),
    ]
    tagged = note_tags.join(notes.select(F.col("id").alias("note_id"), "primary_tag"), "note_id")
    primary = F.col("tag_id") == F.col("primary_tag")
    clipped = F.greatest(lit(0.3), F.least(lit(1.0), F.col("weight")))
    edges = [
        edge(regions.filter("parent_id IS NOT NULL"), "parent_id", "id", "contains", 1.0, "extracted", 1.0), edge(tags, "region_id", "id", "contains", 1.0, "extracted", 1.0),
        edge(links, "tag_id", "other_id", "linked-to", 0.5, "inferred", 0.5),
        edge(signals, "owner_id", "id", "has-signal", F.greatest(lit(0.35), F.least(lit(1.0), F.col("severity") / 100)), "extracted", 1.0),
        edge(tagged, "note_id", "tag_id", "belongs-to", F.when(primary, 1.0).otherwise(0.7), "extracted", F.when(primary, 1.0).otherwise(0.85)),
        edge(region_edges, "a", "b", "region-rel", F.col("weight"), "inferred", clipped), edge(tag_edges, "a", "b", "co-occurs", F.col("weight"), "inferred", clipped),
    ]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)
