"""Keyed stores as tables: metadata, scope snapshots, cluster assignments, vectors, compiled notes, chunk lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overwrite_metadata(manifest: DataFrame, updates: DataFrame, key: str = "source_id", column: str = "metadata") -> DataFrame:
    """``manifest`` with ``column`` replaced where ``updates`` (key, column) has the key, by null too; unknown keys change nothing."""
    fresh = updates.select(key, F.col(column).alias("__fresh"), F.lit(True).alias("__has")).dropDuplicates([key])
    joined = manifest.join(fresh, key, "left")
    return joined.withColumn(column, F.when(F.col("__has"), F.col("__fresh")).otherwise(F.col(column))).select(*manifest.columns)


def last_snapshots(snapshots: DataFrame, source: str = "source", at: str = "at") -> DataFrame:
    """(source, at, scope_id): the scope ids of each source's latest snapshot; rows (source, at, scope_id)."""
    last = snapshots.groupBy(source).agg(F.max(at).alias(at))
    return snapshots.join(last, [source, at], "left_semi").select(source, at, "scope_id").distinct()


def assignments(tree: DataFrame, members: DataFrame, run_id: Column) -> DataFrame:
    """(run_id, node_id, parent_id, depth, chunk_ids): a cluster tree as rows of one run; inner nodes have no chunks of their own."""
    own = members.groupBy("node_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    none = F.array().cast(own.schema["chunk_ids"].dataType)
    return tree.join(own, "node_id", "left").select(run_id.alias("run_id"), "node_id", "parent_id", F.col("level").alias("depth"), F.coalesce("chunk_ids", none).alias("chunk_ids"))


def replace_vectors(vectors: DataFrame, path: str, model: str, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """Write (id, model, dim, vector) over what ``path`` holds; empty vectors are not stored. Returns a reader."""
    rows = vectors.filter(F.size(vector) > 0).select(id_col, F.lit(model).alias("model"), F.size(vector).alias("dim"), F.col(vector).cast("array<float>").alias("vector"))
    rows.write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.schema(rows.schema).parquet(path)


def note_tables(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes without members, (cache_key, member_hash) rows) of notes (cache_key, ..., members array); repeated members are one."""
    return notes.drop("members"), notes.select("cache_key", F.explode(F.array_distinct("members")).alias("member_hash"))


def bump_drift(notes: DataFrame, origins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes with drift + 1 in the families of ``origins`` (origin_key), (origin_key, drift): the most in each of them)."""
    named = origins.select("origin_key", F.lit(1).alias("__bump")).distinct()
    bumped = notes.join(named, "origin_key", "left").withColumn("drift", F.col("drift") + F.coalesce("__bump", F.lit(0))).select(*notes.columns)
    return bumped, bumped.join(named.select("origin_key"), "origin_key", "left_semi").groupBy("origin_key").agg(F.max("drift").alias("drift"))


def chunks_by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks in the order that their ids were asked for: (pos, id, ...); unknown ids are left out, an id asked twice comes twice."""
    return ids.select("pos", "id").join(chunks, "id").select("pos", "id", *(c for c in chunks.columns if c != "id"))


def chunk_index(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_ids): each document's chunk ids in order."""
    return chunks.groupBy("doc_id").agg(F.array_sort(F.collect_set("id")).alias("chunk_ids"))


def chunk_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors by embedding hash; chunks without a hash or a stored vector are left out."""
    return chunks.join(vectors.dropDuplicates(["embedding_hash"]), "embedding_hash")


def note_key(doc_id: Column) -> Column:
    """A document's note id."""
    return F.concat(F.lit("n-"), F.substring(F.sha2(doc_id, 256), 1, 8))


def note_documents(chunks: DataFrame) -> DataFrame:
    """(note_id, doc_id) of every document that has a chunk."""
    return chunks.select(note_key(F.col("doc_id")).alias("note_id"), "doc_id").distinct()


def subtree_changes(changes: DataFrame, notes: DataFrame, closure: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """(changes (doc_id, ...) of notes below ``scope`` with note_id and region_id, one row with unmapped: changes of no known note)."""
    keyed = changes.withColumn("note_id", note_key(F.col("doc_id")))
    mapped = keyed.join(notes.select("note_id", "region_id"), "note_id", "left")
    below = closure.filter(F.col("ancestor_id") == scope).select(F.col("node_id").alias("region_id"))
    return mapped.join(below, "region_id", "left_semi"), mapped.agg(F.count_if(F.col("region_id").isNull()).alias("unmapped"))


def labelled(highlights: DataFrame, labels: DataFrame) -> DataFrame:
    """(kind, pos, id, label) of highlights (kind, ids array); ids without a label are left out."""
    listed = highlights.select("kind", F.posexplode("ids").alias("pos", "id"))
    return listed.join(labels.select("id", "label"), "id").select("kind", "pos", "id", "label")


def retire_sources(manifest: DataFrame, configured: list[str]) -> DataFrame:
    """``manifest`` with the active documents of sources that are no longer configured set to retired."""
    gone = (F.col("status") == "active") & ~F.coalesce(F.col("source").isin(configured), F.lit(False))
    return manifest.withColumn("status", F.when(gone, "retired").otherwise(F.col("status")))


def coverage(drawn: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(total, rendered, missing) of the keys that should be drawn; one row."""
    got = drawn.select(key).distinct().withColumn("__drawn", F.lit(True))
    joined = present.select(key).distinct().join(got, key, "left")
    return joined.agg(F.count("*").alias("total"), F.count("__drawn").alias("rendered"), F.count_if(F.col("__drawn").isNull()).alias("missing"))


def throughput(events: DataFrame, group: str, at: Column, size: Column, warm_up: float) -> DataFrame:
    """(group, events, per_second, bytes_per_second) of what came ``warm_up`` seconds or more after each group's first event."""
    seconds = at.cast("double")
    rows = events.select(group, seconds.alias("s"), size.alias("size"))
    start = rows.groupBy(group).agg(F.min("s").alias("first"))
    late = rows.join(start, group).filter(F.col("s") - F.col("first") >= warm_up)
    out = late.groupBy(group).agg(F.count("*").alias("events"), F.sum("size").alias("bytes"), (F.max("s") - F.min("first") - warm_up).alias("span"))
    rate = lambda n: F.when(F.col("span") > 0, F.round(F.col(n) / F.col("span"), 6))
    return out.select(group, "events", rate("events").alias("per_second"), rate("bytes").alias("bytes_per_second"))
