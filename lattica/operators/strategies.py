"""Exchangeable steps: chunkers by source type, feature extractors, embedders and namers, each a function of DataFrames.

A strategy takes rows and returns rows, so Spark plans the whole dispatch as one union of filtered branches. Python functions
of Arrow batches (pandas UDFs) are as welcome inside a strategy as column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Strategy = Callable[[DataFrame], DataFrame]


class Registry:
    """Strategies by key, with one for every other key."""

    def __init__(self, default: Strategy):
        self.default, self.known = default, {}

    def register(self, key: str, strategy: Strategy) -> None:
        self.known[key] = strategy

    def apply(self, rows: DataFrame, by: str = "source_type") -> DataFrame:
        """Each row through its key's strategy, null and unknown keys through the default; strategies return equal columns."""
        branches = [strategy(rows.filter(F.col(by) == key)) for key, strategy in self.known.items()]
        rest = rows.filter(~F.coalesce(F.col(by).isin(list(self.known)), F.lit(False))) if self.known else rows
        return reduce(DataFrame.unionByName, [*branches, self.default(rest)])


def by_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, content): a chunk a line with anything in it."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.posexplode(lines).alias("pos", "content"))


def by_words(size: int) -> Strategy:
    """Chunks of ``size`` words, separated by single blanks."""

    def run(docs: DataFrame) -> DataFrame:
        words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
        held = docs.select("doc_id", words.alias("w")).filter(F.size("w") > 0)
        starts = F.sequence(F.lit(1), F.size("w"), F.lit(size))
        return held.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(size)), " "))).alias("pos", "content"))

    return run


def by_headings(most: int, least: int) -> Strategy:
    """Sections under their heading; sections of over ``most`` characters are cut into windows that overlap by ``least``."""

    def run(docs: DataFrame) -> DataFrame:
        parts = F.filter(F.split("text", r"(?m)^(?=#{1,6}\s)"), lambda x: F.trim(x) != "")
        sections = docs.select("doc_id", F.posexplode(parts).alias("section", "s"))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("s") - least), F.lit(most - least))
        cut = sections.select("doc_id", "section", F.posexplode(F.transform(starts, lambda i: F.substr("s", i, F.lit(most)))).alias("part", "content"))
        order = F.array_sort(F.collect_list(F.struct("section", "part", "content")))
        return cut.groupBy("doc_id").agg(order.alias("c")).select("doc_id", F.posexplode("c").alias("pos", "x")).select("doc_id", "pos", "x.content")

    return run


def extract_features(chunks: DataFrame, extractor: Callable[[Column], Column], content: str = "content") -> DataFrame:
    """``chunks`` with ``features``: whatever struct the extractor makes of the content, a column expression or a pandas UDF."""
    return chunks.withColumn("features", extractor(F.col(content)))


def embed(chunks: DataFrame, embedder: Callable[[Column], Column], content: str = "content") -> DataFrame:
    """``chunks`` with ``vector``; each distinct content is embedded once."""
    texts = chunks.select(F.col(content).alias("__content")).distinct().withColumn("vector", embedder(F.col("__content")))
    return chunks.join(texts, chunks[content] == texts["__content"], "left").drop("__content")


def name_groups(members: DataFrame, group: str, terms: str, namer: Callable[[Column], Column], most: int = 12) -> DataFrame:
    """(group, name): the namer's text for each group's ``most`` commonest terms, ties by the term; counted with map-side combining."""
    counts = members.select(group, F.explode(terms).alias("term")).groupBy(group, "term").agg(F.count("*").alias("n"))
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "term"))), 1, most), lambda x: x["term"])
    return counts.groupBy(group).agg(top.alias("terms")).select(group, namer(F.col("terms")).alias("name"))
