"""What an agent asks of the knowledge graph: the survey of a map, and one node with its connections.

Nodes are (id, type, label, summary), edges (src, dst, weight) in either direction. Null labels match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.retrieval import _held

CANDIDATES = 8
CONNECTIONS = 15


def ends(edges: DataFrame) -> DataFrame:
    """(id, other, weight): each edge once from either end."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "weight").union(edges.select("dst", "src", "weight"))


def overview(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """(section, key, text, n): nodes of each type, the number of edges, every region with its summary, the top tags by degree.

    Summaries are one line of at most 200 characters. Tags without edges have degree 0; ties go by id.
    """
    counts = nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("type").alias("section"), F.col("type").alias("key"), F.lit("").alias("text"), "n")
    total = edges.agg(F.count("*").alias("n")).select(F.lit("edges"), F.lit("edges"), F.lit(""), "n")
    line = F.substring(F.regexp_replace(F.trim(F.coalesce("summary", F.lit(""))), "\n", " "), 1, 200)
    regions = nodes.filter("type = 'region'").select(F.lit("region"), "id", F.concat(F.coalesce("label", F.lit("")), F.lit(": "), line), F.lit(None).cast("long"))
    degree = ends(edges).groupBy("id").agg(F.sum("weight").alias("d"))
    tags = nodes.filter("type = 'tag'").select("id", "label").join(degree, "id", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    best = tags.orderBy(F.desc("d"), "id").limit(top).select(F.lit("tag"), "id", F.coalesce("label", F.lit("")), F.col("d").cast("long"))
    return counts.union(total).union(regions).union(best)


def resolutions(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, id, label, position, single) of each distinct trimmed reference (ref): the node it names, or its candidates.

    A reference names a node by its id, else by its label in any case, else by a part of a label. Where the best of these ways
    gives one node, that is it (single); where it gives more, the first CANDIDATES by id are listed. Blank references and those
    that name nothing have no row. References are a stated query set, counted before they are broadcast.
    """
    wanted = refs.select(F.trim("ref").alias("ref")).filter("ref <> ''").distinct()
    named = nodes.select("id", "label", F.lower("label").alias("low"))
    by_id = wanted.join(named.withColumn("ref", F.col("id")), "ref").select("ref", "id", "label", F.lit(0).alias("way"))
    by_label = wanted.withColumn("low", F.lower("ref")).join(named, "low").select("ref", "id", "label", F.lit(1))
    rest = wanted.join(by_id.union(by_label).select("ref").distinct(), "ref", "left_anti")
    part = named.join(_held(rest), F.col("low").contains(F.lower("ref"))).select("ref", "id", "label", F.lit(2))
    found = by_id.union(by_label).union(part)
    ways = found.groupBy("ref", "way").agg(F.count("*").alias("n")).groupBy("ref").agg(F.min_by(F.struct("way", "n"), "way").alias("best"))
    best = found.join(ways.select("ref", "best.way", "best.n"), ["ref", "way"])
    order = Window.partitionBy("ref").orderBy("id")
    ranked = best.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= CANDIDATES)
    return ranked.select("ref", "id", "label", F.col("position").cast("long").alias("position"), (F.col("n") == 1).alias("single"))


def explored(refs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref, kind, position, id, label, weight): a reference's node and its CONNECTIONS heaviest edges, or its candidates.

    kind is node, connection or candidate; weight is null but for connections, whose ties go by id.
    """
    told = resolutions(refs, nodes)
    heads = told.select("ref", F.when(F.col("single"), "node").otherwise("candidate").alias("kind"), "position", "id", "label", F.lit(None).cast("long").alias("weight"))
    near = told.filter("single").select("ref", "id").join(ends(edges), "id")
    order = Window.partitionBy("ref").orderBy(F.desc("weight"), "other")
    near = near.withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= CONNECTIONS)
    labels = nodes.select(F.col("id").alias("other"), "label")
    return heads.union(near.join(labels, "other", "left").select("ref", F.lit("connection"), "position", "other", "label", F.col("weight").cast("long")))
