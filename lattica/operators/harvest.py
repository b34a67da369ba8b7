"""Manifest, listing and activity-log operators: change detection, reconciliation, retention, change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_actions(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """(source_id, action, version, status, content_hash, modified) after an upsert of ``listing``; unlisted rows stay.

    Unchanged: the listed time is not after the stored one, or the hashes are equal; such a row turns active again at its
    version. A null listed value keeps the stored one. One full outer join on the key.
    """
    m, n = manifest.alias("m"), listing.alias("n")
    joined = m.join(n, F.col("m.source_id") == F.col("n.source_id"), "full_outer")
    stored, listed = F.col("m.source_id").isNotNull(), F.col("n.source_id").isNotNull()
    same = F.coalesce(F.col("n.modified") <= F.col("m.modified"), F.lit(False)) | F.coalesce(F.col("n.content_hash") == F.col("m.content_hash"), F.lit(False))
    action = F.when(~listed, "unlisted").when(~stored, "new").when(same, "unchanged").otherwise("updated")
    version = F.when(~stored, 1).when(action == "updated", F.coalesce("m.version", F.lit(1)) + 1).otherwise(F.col("m.version"))
    pick = lambda c: F.when(action.isin("new", "updated"), F.coalesce(f"n.{c}", f"m.{c}")).otherwise(F.col(f"m.{c}"))
    return joined.select(
        F.coalesce("m.source_id", "n.source_id").alias("source_id"), action.alias("action"), version.alias("version"),
        F.when(listed, "active").otherwise(F.col("m.status")).alias("status"), pick("content_hash").alias("content_hash"), pick("modified").alias("modified"),
    )


def apply_upsert(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """The rewritten manifest of upsert_actions(), without the action."""
    return upsert_actions(manifest, listing).drop("action")


def reconcile(manifest: DataFrame, listing: DataFrame, active_scopes: list[str] | None) -> DataFrame:
    """(source_id, outcome) of active rows that are listed no more: deleted, out_of_scope, or preserved (unknown scope)."""
    missing = manifest.filter("status = 'active'").join(listing.select("source_id"), "source_id", "left_anti")
    if active_scopes is None:
        outcome = F.lit("deleted")
    else:
        outcome = F.when(F.col("scope").isNull(), "preserved").when(F.col("scope").isin(active_scopes), "deleted").otherwise("out_of_scope")
    return missing.select("source_id", outcome.alias("outcome"))


def retention_due(manifest: DataFrame, changed: Column, as_of: Column, grace_days: int) -> DataFrame:
    """Rows deleted at the source whose status changed ``grace_days`` before ``as_of`` or earlier."""
    return manifest.filter((F.col("status") == "deleted_at_source") & (changed <= F.date_sub(as_of, grace_days)))


def latest_changes(log: DataFrame) -> DataFrame:
    """(source, id, change, ts) of each document: its last entry; an update stays new if the last other entry was new.

    Entries without a change are other actions. Order is ``pos``. One shuffle on (source, id), combined in the mappers.
    """
    entries = log.filter(F.col("change").isNotNull())
    out = entries.groupBy("source", "id").agg(
        F.max_by(F.struct("change", "ts"), "pos").alias("last"), F.max_by(F.when(F.col("change") != "updated", F.col("change")), F.when(F.col("change") != "updated", F.col("pos"))).alias("other"),
    )
    sticky = (F.col("last.change") == "updated") & F.coalesce(F.col("other") == "new", F.lit(False))
    return out.select("source", "id", F.when(sticky, "new").otherwise(F.col("last.change")).alias("change"), F.col("last.ts").alias("ts"))


def change_summary(changes: DataFrame) -> DataFrame:
    """Counts by (source, change), and over all sources (source null), in one pass."""
    return changes.groupingSets([["source", "change"], ["change"]], "source", "change").agg(F.count("*").alias("n"))


def daily_series(rows: DataFrame, day: Column, last: Column, days: int = 14) -> DataFrame:
    """(day, n) of the ``days`` days up to ``last``; days without rows count 0."""
    counts = rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    calendar = rows.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def run_status(completed: Column, failed: Column, errors: Column) -> Column:
    return F.when(completed.isNull(), "running").when((failed > 0) | (errors > 0), "failed").otherwise("complete")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """(user, start, end, n) of runs of events less than ``gap`` apart; the same call works on a stream with a watermark."""
    at = F.col(ts) if events.schema[ts].dataType.simpleString() == "timestamp" else F.col(ts).cast("timestamp")
    out = events.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def chain_links(rows: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    """(from_id, to_id): each row tied to the next of its group."""
    nxt = F.lead(id_col).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.select(F.col(id_col).alias("from_id"), nxt.alias("to_id")).filter("to_id is not null")


def chain_graph(rows: DataFrame, keys: list[str], order: list, id_col: str, most_rows: int = 200, most_links: int = 320) -> DataFrame:
    """(from_id, to_id) among the first ``most_rows`` rows by ``order``: each tied to the next one of its group, the first ``most_links`` ties.

    A page of a graph for display: the caps are what is asked for. Ties come group by group, the group of the first row first. Rows
    whose keys are null are a group like any other.
    """
    page = rows.orderBy(*order).limit(most_rows).withColumn("__at", F.row_number().over(Window.orderBy(*order)))  # most_rows rows
    group = Window.partitionBy(*keys)
    tied = page.select("__at", F.min("__at").over(group).alias("__first"), F.lag(id_col).over(group.orderBy("__at")).alias("from_id"), F.col(id_col).alias("to_id"))
    return tied.filter("from_id IS NOT NULL").orderBy("__first", "__at").limit(most_links).select("from_id", "to_id")


def append_messages(thread: DataFrame, fresh: DataFrame) -> DataFrame:
    """``thread`` with ``fresh`` (thread_id, created, text) added; seq goes on from each thread's largest."""
    top = thread.groupBy("thread_id").agg(F.max("seq").alias("top"))
    order = F.row_number().over(Window.partitionBy("thread_id").orderBy("created", "text"))
    added = fresh.withColumn("k", order).join(top, "thread_id", "left").select("thread_id", (F.coalesce("top", F.lit(-1)) + F.col("k")).alias("seq"), "created", "text")
    return thread.select("thread_id", "seq", "created", "text").unionByName(added)


def missing_keys(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """The distinct keys that a keyed cache does not hold yet: what an incremental run has to compute."""
    return wanted.select(key).distinct().join(cached.select(key), key, "left_anti")


def reharvest_one(manifest: DataFrame, fetched: DataFrame, source_id) -> DataFrame:
    """The manifest after one document was fetched again: its row upserted, all others as they are; an unknown id is added."""
    return upsert_actions(manifest, fetched.filter(F.col("source_id") == source_id))


def diagnostics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row about a built graph: nodes and edges, kinds of each, nodes without an edge, edges with a missing end, and the mean degree."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    known = nodes.select("id", "type").join(ends, "id", "full_outer")
    of_nodes = known.agg(
        F.count("type").alias("nodes"), F.count_distinct("type").alias("node_types"), F.count_if(F.col("type").isNotNull() & F.col("degree").isNull()).alias("isolated"),
        F.coalesce(F.sum(F.when(F.col("type").isNull(), F.col("degree"))), F.lit(0)).alias("dangling_ends"), F.round(F.sum("degree") / F.count("type"), 4).alias("mean_degree"))
    return of_nodes.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"), F.count_distinct("type").alias("edge_types"))))  # one row each
