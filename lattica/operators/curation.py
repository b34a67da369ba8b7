"""A short list of todos: in their order, readable, so many a bucket, and none like one already picked."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import materialize

#: How many of a bucket are picked, and by how many days a picked one may be overdue.
CAPS = {"overdue": 5, "due_soon": 10, "upcoming": 3}
OVERDUE_DAYS = 3
#: A text is like another at this ratio of matching characters, or this share of the smaller word set.
RATIO, SHARED = 0.6, 0.75
#: Rows that are decided at once.
STEP = 64


def todo_text(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)^\s*todo:\s*", ""))


def readable(text: Column) -> Column:
    return F.char_length(text).between(4, 80) & text.rlike(r"^[\p{L}\p{N}]")


def alike(text: str, picked: str) -> bool:
    """Whether a todo repeats one that is picked already."""
    text, picked = text.lower(), picked.lower()
    x, y = set(re.findall("[a-z0-9]+", text)), set(re.findall("[a-z0-9]+", picked))
    if x and y and len(x & y) >= SHARED * min(len(x), len(y)):
        return True
    match = SequenceMatcher(None, text, picked)
    return match.real_quick_ratio() >= RATIO and match.quick_ratio() >= RATIO and match.ratio() >= RATIO


def curated(items: DataFrame, order: str, caps: dict[str, int] | None = None, overdue_days: int = OVERDUE_DAYS, step: int = STEP) -> DataFrame:
    """The rows of ``items`` (title, bucket, days, ...) that a reader of the list in ``order`` would pick, with their text.

    A row is passed over if its bucket has no cap or is full, if its text is not readable, if it is overdue by more than
    ``overdue_days``, or if it is like one picked before it; one that is only like a row that was passed over is picked. Decided
    in rounds: the first ``step`` rows that are open are settled against each other, which makes their picks final; whatever is like
    one of them, or belongs to a bucket that is full now, is closed for all rows at once. The first open row is always picked, so
    there are at most as many rounds as the caps allow picks. ``order`` tells rows apart; rows without it, or of a null title
    or bucket, are passed over. An empty table gives none.
    """
    caps = dict(CAPS if caps is None else caps)
    days = F.coalesce(F.col("days"), F.lit(0))
    rows = items.withColumn("text", todo_text(F.col("title")))
    rows = rows.filter(readable(F.col("text")) & F.col("bucket").isin(list(caps)) & F.col(order).isNotNull() & ~((F.col("bucket") == "overdue") & (days < -overdue_days)))
    rows = materialize(rows, "todos")
    open_, picked, taken = rows.select(order, "text", "bucket"), [], dict.fromkeys(caps, 0)
    while True:
        open_ = open_.filter(F.col("bucket").isin([b for b, n in taken.items() if n < caps[b]]))
        batch = open_.orderBy(order).limit(step).collect()
        if not batch:
            break
        new = []
        for row in batch:
            if taken[row.bucket] < caps[row.bucket] and not any(alike(row.text, p.text) for p in new):
                new.append(row)
                taken[row.bucket] += 1
        picked += new
        texts = [r.text for r in new]

        @F.pandas_udf("boolean")
        def repeats(column: pd.Series) -> pd.Series:
            return column.map(lambda t: any(alike(t, p) for p in texts))  # noqa: B023

        open_ = materialize(open_.filter(F.col(order) > batch[-1][order]).filter(~repeats("text")), "todos")
    kind = items.schema[order].dataType.simpleString()
    chosen = items.sparkSession.createDataFrame([(r[order],) for r in picked], f"`{order}` {kind}")  # as many as the caps allow
    return rows.join(F.broadcast(chosen), order, "left_semi")
