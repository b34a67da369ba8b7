"""Changes since a boundary, kept by a stateful stream: each source's last boundary and what changed after it.

A boundary is an event of its own (a compile that ended, a client that looked). The state of a source is its last boundary and the
changes after it, each under its time and id in RocksDB, so that a boundary that comes late still leaves the right ones. Every
batch gives the sources it touched a row for each kind of change; a timer in event time closes sources that stay silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OUT = "source string, boundary timestamp, change string, n long, closed boolean"


class SinceBoundary(StatefulProcessor):
    """Rows (source, ts, event_id, change), change null for a boundary, to rows of OUT."""

    def __init__(self, silence_ms: int = 0):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.boundary = handle.getValueState("boundary", "ts timestamp")
        self.changes = handle.getMapState("changes", "ts timestamp, event_id long", "change string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.boundary.get()[0] if self.boundary.exists() else None
        newest = None
        for part in rows:
            marks = part[part["change"].isna()]
            if len(marks):
                latest = marks["ts"].max().to_pydatetime()
                last = latest if last is None else max(last, latest)
            for ts, event, change in part[part["change"].notna()][["ts", "event_id", "change"]].itertuples(index=False):
                if last is None or ts.to_pydatetime() > last:
                    self.changes.updateValue((ts.to_pydatetime(), int(event)), (change,))
            newest = part["ts"].max() if newest is None else max(newest, part["ts"].max())
        if last is not None:
            self.boundary.update((last,))
            for old in [k for k in self.changes.keys() if k[0] <= last]:
                self.changes.removeKey(old)
        if self.silence_ms and newest is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(newest.timestamp() * 1000) + self.silence_ms)
        yield self.told(key, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.told(key, self.boundary.get()[0] if self.boundary.exists() else None, True)

    def told(self, key, last, closed: bool) -> pd.DataFrame:
        counts: dict[str | None, int] = {}
        for (change,) in self.changes.values():
            counts[change] = counts.get(change, 0) + 1
        rows = [(key[0], last, c, n, closed) for c, n in sorted(counts.items())] or [(key[0], last, None, 0, closed)]
        return pd.DataFrame(rows, columns=["source", "boundary", "change", "n", "closed"]).astype({"boundary": "datetime64[ns]"})


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def changes_since(events: DataFrame, late: str = "1 hour", silence_ms: int = 0) -> DataFrame:
    """The stream (source, boundary, change, n, closed) of ``events`` (source, ts, event_id, change): the state after each batch.

    A source has a row a kind of change after its last boundary, or one row with a null kind and 0 if there is none; without a
    boundary all its changes count. Changes at the boundary's own time belong before it; an event that is given twice counts
    once. Rows with a null source are one source; rows without a time are left out. With ``silence_ms`` a source
    without an event for so long is told once more, closed, when the watermark passes that time; its state stays. Only then
    are events that come more than ``late`` after newer ones left out.
    """
    use_rocksdb(events.sparkSession)
    timed = events.filter("ts IS NOT NULL")
    timed = timed.withWatermark("ts", late) if silence_ms else timed
    return timed.groupBy("source").transformWithStateInPandas(SinceBoundary(silence_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime" if silence_ms else "None")


def run_since(events: DataFrame, path: str, silence_ms: int = 0) -> StreamingQuery:
    """Run over all that is there into ``path``, each batch's rows under its number; a later run goes on from the checkpoint.

    Every batch's progress has the observed metrics of "events": rows, boundaries and the latest time.
    """
    seen = events.observe("events", F.count("*").alias("rows"), F.count(F.when(F.col("change").isNull(), 1)).alias("boundaries"), F.max("ts").alias("latest"))

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/batch_no={number}")

    writer = changes_since(seen, silence_ms=silence_ms).writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def standing(spark: SparkSession, path: str) -> DataFrame:
    """(source, boundary, change, n) after the last batch of each source."""
    rows = spark.read.schema(OUT + ", batch long").parquet(f"{path}/rows").filter("NOT closed")
    last = rows.groupBy(F.col("source").alias("of")).agg(F.max("batch").alias("latest"))
    return rows.join(last, F.col("source").eqNullSafe(F.col("of")) & (F.col("batch") == F.col("latest"))).select("source", "boundary", "change", "n")
