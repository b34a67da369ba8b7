"""Workspace state from its logs: anchors that follow regions, memory items, visits and briefs.

A log is append-only: (key, at, op, fields ...), ``at`` a number or time that tells the entries of a key apart. State is what the
entries leave behind, so that applying a log again gives the same tables, and two logs can be laid one below the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEMORY_FIELDS = ["region_key", "title", "body", "kind"]


def memory_items(log: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(id, fields ..., created, updated) after create, update and delete entries (id, at, op, fields ...).

    An update changes the fields it names (not null). A create of an item that is there, and an update or a delete of one that is
    not, do nothing; after a delete an item can be created anew and begins empty. Two aggregations by id, each combined in
    the mappers; an item's entries are never gathered.
    """
    fields = fields or MEMORY_FIELDS
    rows = log.filter("id IS NOT NULL AND at IS NOT NULL")
    gone = rows.groupBy("id").agg(F.max(F.when(F.col("op") == "delete", F.col("at"))).alias("__gone"))
    later = rows.join(gone, "id").filter("__gone IS NULL OR at > __gone").drop("__gone")
    born = later.filter("op = 'create'").groupBy("id").agg(F.min("at").alias("created"))
    alive = later.join(born, "id").filter("at = created OR (op = 'update' AND at > created)")
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return alive.groupBy("id").agg(*map(last, fields), F.min("created").alias("created"), F.max("at").alias("updated"))


def memory_of(items: DataFrame, keys: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of the regions in ``keys`` (region_key), the newest first, at most ``limit``; ties by id."""
    found = items.join(keys.select("region_key").distinct(), "region_key", "left_semi").orderBy(F.desc("created"), "id")
    return found if limit is None else found.limit(limit)


def anchors(log: DataFrame) -> DataFrame:
    """(key, region_id, region_name, level, status, history, created, updated) after attach and orphan entries (key, at, op, region_id, region_name, level).

    An anchor keeps its key while the region behind it changes. Whenever it leaves a region for another or for none, the old id
    goes to the end of its history, once. An orphan keeps its last name and level; an entry that names the region it has
    already changes name and level only. An orphan entry for an anchor that was never attached does nothing.
    """
    order = Window.partitionBy("key").orderBy("at")
    rows = log.filter("key IS NOT NULL AND at IS NOT NULL").withColumn("region_id", F.when(F.col("op") == "attach", F.col("region_id")))
    first = rows.filter("op = 'attach'").groupBy("key").agg(F.min("at").alias("created"))
    rows = rows.join(first, "key").filter("at >= created").withColumn("__last", F.lead("at").over(order).isNull()).withColumn("__next", F.lead("region_id").over(order))
    left = rows.filter(~F.col("__last") & F.col("region_id").isNotNull() & ~F.col("region_id").eqNullSafe(F.col("__next"))).groupBy("key", "region_id").agg(F.min("at").alias("at"))
    history = left.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "region_id"))), lambda x: x["region_id"]).alias("history"))
    named = lambda c: F.max_by(F.when(F.col("op") == "attach", F.col(c)), F.when(F.col("op") == "attach", F.col("at"))).alias(c)
    now = rows.groupBy("key").agg(F.max_by("region_id", "at").alias("region_id"), named("region_name"), named("level"), F.min("created").alias("created"), F.max("at").alias("updated"))
    status = F.when(F.col("region_id").isNull(), "orphaned").otherwise("attached")
    empty = F.array().cast(history.schema["history"].dataType)
    return now.join(history, "key", "left").select("key", "region_id", "region_name", "level", status.alias("status"), F.coalesce("history", empty).alias("history"), "created", "updated")


def anchors_by_old_id(state: DataFrame) -> DataFrame:
    """(old_id, key): which anchor an id from an earlier compile leads to; of several the one created first, then by key."""
    return state.select(F.explode("history").alias("old_id"), "key", "created").groupBy("old_id").agg(F.min_by("key", F.struct("created", "key")).alias("key"))


def touched(stored: DataFrame, touches: DataFrame) -> DataFrame:
    """(region_key, at, previous): for every visit the one before it, from ``stored`` (region_key, at) or from the visits themselves.

    The last row of a key is what to store. Visits of one key at one time are one visit.
    """
    known = stored.groupBy("region_key").agg(F.max("at").alias("at")).withColumn("__new", F.lit(False))
    rows = known.unionByName(touches.select("region_key", "at").filter("at IS NOT NULL").distinct().withColumn("__new", F.lit(True)))
    previous = F.lag("at").over(Window.partitionBy("region_key").orderBy("at", "__new"))
    return rows.withColumn("previous", previous).filter("__new").select("region_key", "at", "previous")


def briefs(stored: DataFrame, puts: DataFrame, made: str = "created_at") -> DataFrame:
    """The brief of each region_key that was made last; at one time that of ``puts`` counts."""
    rows = stored.withColumn("__new", F.lit(0)).unionByName(puts.withColumn("__new", F.lit(1)))
    others = [c for c in stored.columns if c != "region_key"]
    best = rows.groupBy("region_key").agg(F.max_by(F.struct(*others), F.struct(made, "__new", *(F.col(c).cast("string") for c in others))).alias("b"))
    return best.select("region_key", "b.*")


def stale_briefs(state: DataFrame, generated: DataFrame) -> DataFrame:
    """(region_key) of regions whose brief was written for another map than ``generated`` (region_key, generated_at), or that have none."""
    joined = generated.join(state.select("region_key", "terrain_generated_at"), "region_key", "left")
    return joined.filter("terrain_generated_at IS NULL OR terrain_generated_at <> generated_at").select("region_key")
