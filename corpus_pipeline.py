"""The corpus pipeline: five stages, each an operator of lattica.llm, over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. A stage's rows are written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, decontaminate, linededup, simhash, toxicity
from lattica.llm.common import small
from lattica.llm.queries import tokenizer
from lattica.session import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model scores at the threshold or above."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return model.drop_toxic(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line but the first of its class goes; so do documents of which no word is left that had some."""
    worded = lambda c: F.coalesce(F.col(c).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.withColumn("__had_words", worded("text"))
    left = linededup.drop_duplicate_lines(marked).filter(worded("text") | ~F.col("__had_words"))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest doc_id.

    A document is its doc_id: rows that repeat one id with one text stay or go together, rows with a null id stay.
    """
    found = simhash.near_duplicates(docs).filter("doc_id <> component").select("doc_id")
    return docs.join(small(materialize(found, "near-copies")), "doc_id", "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the benchmark contaminates."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every document left."""
    out = bpe.encode(docs, *tokenizer())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", encode),
]

#: SQL can express neither the toxicity model nor the fingerprints; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
