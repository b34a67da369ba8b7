"""Structured Streaming forms of the incremental harvest: landing folder, change feed, idle sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.operators.harvest import apply_upsert, sessions
from lattica.session import shared_dir


class ManifestTable:
    """A manifest kept as numbered Parquet versions: batch n reads version n and writes n + 1, so a batch that is run again
    after a failure gives the same table."""

    def __init__(self, spark: SparkSession, path: str, first: DataFrame):
        self.spark, self.path, self.schema = spark, path, first.schema
        first.write.mode("overwrite").parquet(f"{path}/v=0")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Of several listings of one document in a batch the latest counts."""
        latest = batch.groupBy("source_id").agg(F.max_by(F.struct(*batch.columns), "modified").alias("r")).select("r.*")
        old = self.read(batch_id)
        fresh = apply_upsert(old.select("source_id", "content_hash", "modified", "version", "status"), latest)
        kept = [c for c in self.schema.names if c not in fresh.columns]
        fresh.join(old.select("source_id", *kept), "source_id", "left").select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/v={batch_id + 1}")


def stream_upserts(landing: str, schema: str, manifest: ManifestTable, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Apply every file that lands in the folder to the manifest, exactly once; stops when none is left."""
    files = manifest.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return files.writeStream.foreachBatch(manifest.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Idle-gap sessions of a stream; events later than ``late`` are dropped by the watermark."""
    return sessions(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), gap=gap)


def stream_change_counts(log: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(start, source, change, n) by event-time window."""
    rows = log.filter(F.col("change").isNotNull()).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), "source", "change").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "source", "change", "n")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over all that is there now into a Parquet table of the shared folder, and read that."""
    import uuid

    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
