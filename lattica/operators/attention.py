"""Attention signals: merging, scoring, calibration, diverse trimming and action items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.columns import attention_level, due_bucket, norm_title

#: Weight, floor and rank order of each kind.
WEIGHTS = {"risk": 0.48, "todo": 0.34, "open_question": 0.24, "decision": 0.12, "recent_change": 0.10, "owner": 0.06}
FLOORS = {"risk": 4, "todo": 3, "open_question": 2, "decision": 2, "owner": 1, "recent_change": 1}
BUCKETS = ["overdue", "due_soon", "upcoming", "no_date", "probably_abandoned"]


def by_kind(values: dict, default) -> Column:
    out = F.lit(default)
    for kind, value in values.items():
        out = F.when(F.col("kind") == kind, F.lit(value)).otherwise(out)
    return out


def kind_rank() -> Column:
    return by_kind({k: i for i, k in enumerate(FLOORS)}, 9)


def merge_signals(signals: DataFrame, group: str = "region_id") -> DataFrame:
    """One row for each (group, kind, normalised title): the first signal's id, title and status, the largest severity, the
    earliest deadline, the first owner there is, all notes and chunks. ``seq`` is the order of the signals."""
    return signals.withColumn("norm", norm_title(F.col("title"))).groupBy(group, "kind", "norm").agg(
        F.min("seq").alias("seq"), *(F.min_by(c, "seq").alias(c) for c in ("id", "title", "status")), F.max("severity").alias("severity"),
        F.min_by("owner", F.when(F.col("owner").isNotNull(), F.col("seq"))).alias("owner"), F.min("due_date").alias("due_date"),
        F.array_sort(F.collect_set("note_id")).alias("note_ids"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"),
    )


def attention_scores(merged: DataFrame, contexts: DataFrame, group: str = "region_id") -> DataFrame:
    """(group, raw): the five most severe open signals of a kind count with 1, 1/1.65, 1/2.3, ...; thin regions are damped.

    ``contexts`` has (group, n): how many chunks a group holds.
    """
    open_ = merged.filter("status <> 'resolved'")
    rank = F.row_number().over(Window.partitionBy(group, "kind").orderBy(F.desc("severity"), "seq")) - 1
    top = open_.withColumn("rank", rank).filter("rank < 5")
    total = top.groupBy(group).agg(F.sum(F.col("severity") * by_kind(WEIGHTS, 0.1) / (1 + F.col("rank") * 0.65)).alias("total"))
    chunks = open_.select(group, F.explode("chunk_ids").alias("c")).groupBy(group).agg(F.count_distinct("c").alias("chunks"))
    damped = F.least(F.lit(1.0), F.greatest(F.lit(0.35), F.sqrt(F.col("chunks") / F.col("n"))))
    joined = contexts.join(total, group, "left").join(chunks, group, "left")
    return joined.select(group, F.round(F.coalesce(F.col("total") * damped, F.lit(0.0)), 2).alias("raw"))


def calibrate(scores: DataFrame, group: str = "region_id", population: list[str] | None = None) -> DataFrame:
    """(group, score, level): positive raw scores stretched from their 10th to their 90th percentile onto 0 to 100.

    Each ``population`` is stretched on its own. Two rows of bounds are joined back, so nothing is sorted globally.
    """
    keys = population or []
    bounds = scores.filter("raw > 0").groupBy(*keys).agg(F.percentile("raw", F.array(F.lit(0.1), F.lit(0.9))).alias("p"))
    joined = scores.join(F.broadcast(bounds), keys, "left") if keys else scores.crossJoin(F.broadcast(bounds))  # one row of bounds
    low, high = F.col("p")[0], F.col("p")[1]
    stretched = F.when(high - low < 1e-6, 65.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (F.col("raw") - low) / F.when(high - low >= 1e-6, high - low))))
    value = F.when(F.col("raw") > 0, stretched).otherwise(0.0)
    return joined.select(group, *keys, F.round(value, 2).alias("score"), attention_level(value).alias("level"))


def diverse_trim(merged: DataFrame, limit: int = 12, group: str = "region_id") -> DataFrame:
    """The ``limit`` signals of each group: first each kind's floor in kind order, then by rank. pos is the order."""
    ranked = [kind_rank(), F.col("status") == "resolved", F.desc("severity"), F.lower("title"), F.col("seq")]
    place = F.row_number().over(Window.partitionBy(group).orderBy(*ranked))
    within = F.row_number().over(Window.partitionBy(group, "kind").orderBy(*ranked))
    marked = merged.withColumn("place", place).withColumn("floor", within <= by_kind(FLOORS, 0))
    pos = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("floor"), "place"))
    return marked.withColumn("pos", pos).filter(F.col("pos") <= limit)


def action_items(signals: DataFrame, statuses: DataFrame, today: Column) -> DataFrame:
    """Open todos with their bucket, days to go and the user's status (unverified without one), with a total order."""
    todos = signals.filter("kind = 'todo' and status = 'open'").withColumn("bucket", due_bucket(F.col("due_date"), today)).withColumn("days", F.datediff("due_date", today))
    joined = todos.join(statuses, "id", "left").withColumn("user_status", F.coalesce("user_status", F.lit("unverified")))
    rank = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    return joined.select("id", "title", "region_id", "severity", "due_date", "bucket", "days", "user_status", rank.cast("int").alias("bucket_rank"))


def count_all(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(column, n) for every one of ``values``, 0 where there is no row."""
    keys = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return keys.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
