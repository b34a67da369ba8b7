"""Positions and running sums over a whole table, without a window in one task.

Rows are dealt to range partitions and sorted in each; a partition's rows are counted (or summed), the few totals give every
partition its offset, and within a partition a row's place is known. Only one row a partition leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import materialize


def _dealt(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with __at: the range partition in its upper bits, the row's place in it in the lower 33."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.select("*", *(o.alias(f"__o{i}") for i, o in enumerate(_bare(order))))
    keys = [_like(order[i], F.col(f"__o{i}")) for i in range(len(order))]
    placed = named.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    return materialize(placed.select(*rows.columns, "__at"), "ranked")


def _bare(order: list[Column]) -> list[Column]:
    return [o[0] if isinstance(o, tuple) else o for o in order]


def _like(order, column: Column) -> Column:
    return getattr(column, order[1])() if isinstance(order, tuple) else column.asc()


def positions(rows: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """``rows`` with their position, from one, by ``order``: columns, or (column, "desc" or another sort method's name).

    Rows that tie in ``order`` stand in any order; give a key that tells them apart.
    """
    dealt = _dealt(rows, order)
    part = F.shiftright("__at", 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row a partition
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = dealt.withColumn("__part", part).join(F.broadcast(before.drop("__n")), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__at", "__before")


def running(rows: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """``rows`` with running sums by ``order``: name -> the column that is summed, the row's own value included.

    As ``order`` is expected to tell the rows apart, no two of them share a place.
    """
    dealt = _dealt(rows, order).withColumn("__part", F.shiftright("__at", 33))
    totals = dealt.groupBy("__part").agg(*(F.sum(c).alias(f"__s_{n}") for n, c in sums.items()))  # one row a partition
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__part", *(F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums))
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(F.broadcast(before), "__part").select(*dealt.columns, *((F.col(f"__b_{n}") + F.sum(c).over(within)).alias(n) for n, c in sums.items()))
    return out.drop("__part", "__at")
