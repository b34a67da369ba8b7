"""Quality rules: fixed base rules, then a hashed n-gram likelihood ratio with one threshold for every document.

A text's tokens are its words and its runs of punctuation; unigrams and bigrams of them are hashed into BUCKETS buckets.
The target multinomial counts the trusted documents, the raw multinomial all documents. A text's verdict is the mean over
its n-grams of log(target / raw). The threshold is read off a histogram of the labelled documents' verdicts: among the
bin edges, that with the least (rejected good, weighed GOOD_WEIGHT) + (kept bad), the lowest at a tie.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import SLICE, arrow_map, small, utf8
from lattica.llm.hashing import BASE, Spans, mix, powers, runs
from lattica.session import materialize

#: Folds of the labelled rows that choose the threshold, and that nothing is learnt from.
CUT_FOLD, HELD_OUT = 3, 2
BUCKETS = 1 << 16
GOOD_WEIGHT = 3.0
BINS = 400
SPAN = 8.0
WINDOW = 8
#: Fixed values of the contract.
SYMBOLS = "[#*$%&|<>]"
SPACES = r"[\x20\x09-\x0D]"

SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
KIND = np.array([0 if SPACE[b] else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.int8)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the row each belongs to."""
    starts, ends = runs(KIND[data], offsets)
    hashes = Spans(data).of(starts, ends)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    same = rows[1:] == rows[:-1]
    pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:])[same] if len(hashes) else hashes
    buckets = (np.concatenate([hashes, pairs]) >> np.uint64(48)).astype(np.int64) % BUCKETS
    return buckets, np.concatenate([rows, rows[1:][same]])


def count_ngrams(docs: DataFrame, text_col: str, trusted_col: str) -> DataFrame:
    """(bucket, raw, target): exact sums over all rows, at most BUCKETS rows for each record batch before the shuffle."""

    def run(batch: pa.RecordBatch) -> dict:
        buckets, rows = ngrams(*utf8(batch.column(0)))
        trusted = np.asarray(batch.column(1).fill_null(0)).astype(np.int64)
        raw = np.bincount(buckets, minlength=BUCKETS)
        target = np.bincount(buckets[trusted[rows] == 1], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        return {"bucket": at, "raw": raw[at], "target": target[at]}

    parts = arrow_map(docs.select(text_col, trusted_col), run, "bucket long, raw long, target long", text=0, limit=4 * SLICE)
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(counts: DataFrame) -> np.ndarray:
    """log(target / raw) for every bucket, each count with one added; at most BUCKETS rows reach the driver."""
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counts.toLocalIterator():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside WINDOW-word windows that occur twice or more in the text, the first ones included."""
    if len(hashes) < WINDOW:
        return 0
    window = np.zeros(len(hashes) - WINDOW + 1, dtype=np.uint64)
    for k, p in enumerate(powers(BASE, WINDOW)):
        window += hashes[k : len(hashes) - WINDOW + 1 + k] * p
    _, where, n = np.unique(window, return_inverse=True, return_counts=True)
    again = n[where] > 1
    if not again.any():
        return 0
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def base_rules(docs: DataFrame, ratio: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """The contract's counts and the mean log ratio of every row; a null text has no words."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    symbols = re.compile(SYMBOLS)
    worded = re.compile("[^\x20\x09-\x0d]")

    def run(batch: pa.RecordBatch) -> dict:
        data, offsets = utf8(batch.column(1))
        n = len(offsets) - 1
        buckets, rows = ngrams(data, offsets)
        total = np.bincount(rows, weights=shared.value[buckets], minlength=n)
        verdict = total / np.maximum(np.bincount(rows, minlength=n), 1)
        starts, ends = runs((~SPACE[data]).astype(np.int8), offsets)
        words = Spans(data).of(starts, ends)
        of = np.searchsorted(offsets, starts, side="right") - 1
        bounds = np.searchsorted(of, np.arange(n + 1))
        points = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data])])
        chars = points[offsets[1:]] - points[offsets[:-1]]
        repeats = [repeated_words(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        n_symbols, n_dups = [], []
        for text in batch.column(1).to_pylist():
            lines = [x for x in (text or "").split("\n") if worded.search(x)]
            n_symbols.append(len(symbols.findall(text or "")))
            n_dups.append(len(lines) - len(set(lines)))
        return {id_col: batch.column(0), "n_words": np.diff(bounds), "word_chars": chars, "n_symbols": n_symbols, "n_dup_lines": n_dups, "n_repeat_words": repeats, "verdict": verdict}

    schema = f"{id_col} long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, verdict double"
    out = arrow_map(docs.select(F.col(id_col).cast("long"), text_col), run, schema, text=1)
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def fold(id_col: str):
    """0 to 3 by the CRC of the id: what a labelled row is used for."""
    return F.crc32(F.col(id_col).cast("string")) % 4


def threshold(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> float:
    """The cut with the least weighted error on the labelled rows of CUT_FOLD that the base rules pass; -SPAN without bad rows."""
    rows = scored.filter(~F.col("base_failed")).join(labels.filter(fold(id_col) == CUT_FOLD).select(id_col, quality_col), id_col)
    bin_ = F.floor((F.greatest(F.least("verdict", F.lit(SPAN - 1e-9)), F.lit(-SPAN)) + SPAN) / (2 * SPAN) * BINS).cast("int")
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for r in rows.groupBy(bin_.alias("bin")).agg(F.count(F.when(F.col(quality_col) == 1, 1)).alias("good"), F.count(F.when(F.col(quality_col) == 0, 1)).alias("bad")).collect():  # at most BINS rows
        good[r.bin], bad[r.bin] = r.good, r.bad
    below = lambda v: np.concatenate([[0], np.cumsum(v)])
    cost = GOOD_WEIGHT * below(good) + bad.sum() - below(bad)
    return float(-SPAN + 2 * SPAN * np.argmin(cost) / BINS)


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """Base counts, base_failed, verdict and kept for every row.

    Null and empty texts have no words and fail the base rules. Repeated rows each get a row and count each time; rows
    with a null id or label belong to the raw corpus only; an empty table gives an empty result. Good rows of the folds 0 and 1
    are the trusted target, those of CUT_FOLD choose the threshold, those of HELD_OUT are not looked at.
    """
    trusted = labels.filter((F.col(quality_col) == 1) & ~fold(id_col).isin(CUT_FOLD, HELD_OUT)).select(id_col).distinct().withColumn("trusted", F.lit(1))
    marked = docs.select(id_col, text_col).join(small(trusted), id_col, "left")
    ratio = log_ratio(count_ngrams(marked, text_col, "trusted"))
    scored = materialize(base_rules(docs, ratio, id_col, text_col), "quality")
    cut = threshold(scored, small(labels.filter(F.col(quality_col).isNotNull()).select(id_col, quality_col)), id_col, quality_col)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("verdict") >= cut))
