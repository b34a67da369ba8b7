"""Documents as chunks: heading sections with ids, hashes, breadcrumbs and references, small ones merged, large ones sharded.

Sections are found per document; merging is one left fold over a document's own array, so nothing but the grouping by document
is shuffled, and a document's chunks are as large together as its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.columns import content_hash, mentions, short_hash, urls
from lattica.operators.texts import sections, words_of

#: Words below which a chunk is merged into the next, above which it is sharded, and of a shard.
LEAST, MOST, TARGET = 120, 1400, 900


def breadcrumbs(ancestors: Column, title: Column) -> Column:
    """Titles of the ancestors from the top down, then the document's own unless it is among them."""
    above = F.filter(F.transform(F.coalesce(ancestors, F.array().cast("array<struct<id:string,title:string>>")), lambda a: a["title"]), lambda t: F.coalesce(t != "", F.lit(False)))
    return F.when(F.array_contains(above, title), above).otherwise(F.concat(above, F.array(title)))


def merged(chunks: Column, least: int) -> Column:
    """An array of chunk structs in which each one of fewer than ``least`` words has taken up the next, with its references."""
    none = F.lit(None)
    start = F.struct(F.filter(chunks, lambda c: F.lit(False)).alias("done"), F.when(none.cast("boolean"), F.get(chunks, F.lit(0))).alias("pending"))

    def joined(a: Column, b: Column) -> Column:
        content = F.concat(a["content"], F.lit("\n\n"), b["content"])
        union = lambda c: F.array_union(a[c], b[c]).alias(c)
        return F.struct(a["id"].alias("id"), union("path"), content.alias("content"), union("urls"), union("mentions"))

    def step(state: Column, chunk: Column) -> Column:
        pending, done = state["pending"], state["done"]
        return (
            F.when(pending.isNull(), F.struct(done.alias("done"), chunk.alias("pending")))
            .when(F.size(words_of(pending["content"])) < least, F.struct(done.alias("done"), joined(pending, chunk).alias("pending")))
            .otherwise(F.struct(F.array_append(done, pending).alias("done"), chunk.alias("pending")))
        )

    return F.aggregate(chunks, start, step, lambda s: F.when(s["pending"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["pending"])))


def document_chunks(docs: DataFrame, least: int = LEAST, most: int = MOST, target: int = TARGET) -> DataFrame:
    """(id, doc_id, pos, path, breadcrumbs, content, content_hash, n_words, urls, mentions) of documents (doc_id, title, ancestors, text).

    Every section under a heading is a chunk whose id comes from the document, its number and its content. A chunk of fewer than
    ``least`` words is merged into the next one and keeps its own id; both headings and references are united in order. One of
    more than ``most`` words becomes shards of ``target`` words, numbered from 1 behind its id. Null and blank texts have no
    chunks; documents under one id would be taken for one, so ids have to differ.
    """
    parts = sections(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), "doc_id", "text").filter(F.col("content").rlike(r"\S"))
    parts = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "path", F.regexp_replace("content", r"^\s+|\s+$", "").alias("content")))).alias("s"))

    def made(part: Column, number: Column) -> Column:
        content = part["content"]
        key = F.concat_ws(":", "doc_id", number.cast("string"), content_hash(content))
        return F.struct(F.concat(F.lit("chunk_"), short_hash(key, 20)).alias("id"), part["path"].alias("path"), content.alias("content"), urls(content).alias("urls"), mentions(content).alias("mentions"))

    rows = parts.select("doc_id", F.transform("s", made).alias("s")).select("doc_id", F.posexplode(merged(F.col("s"), least)).alias("pos", "c"))
    words = words_of(F.col("c.content"))
    rows = rows.withColumn("w", words).withColumn("large", F.size("w") > most)
    starts = F.when(F.col("large"), F.sequence(F.lit(1), F.size("w"), F.lit(target))).otherwise(F.array(F.lit(1)))
    cut = rows.select("doc_id", "pos", "c", "w", "large", F.posexplode(starts).alias("k", "start"))
    text = F.when(F.col("large"), F.array_join(F.slice("w", F.col("start"), F.lit(target)), " ")).otherwise(F.col("c.content"))
    n_words = F.when(F.col("large"), F.least(F.lit(target), F.size("w") - F.col("start") + 1)).otherwise(F.size("w"))
    number = F.when(F.col("large"), F.concat(F.lit("_"), (F.col("k") + 1).cast("string"))).otherwise("")
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), breadcrumbs(F.col("ancestors"), F.col("title")).alias("breadcrumbs"))
    out = cut.select(F.concat("c.id", number).alias("id"), "doc_id", "pos", "k", F.col("c.path").alias("path"), text.alias("content"), content_hash(text).alias("content_hash"), n_words.alias("n_words"), F.col("c.urls").alias("urls"), F.col("c.mentions").alias("mentions"))
    return out.join(named, "doc_id").select("id", "doc_id", "pos", "k", "path", "breadcrumbs", "content", "content_hash", "n_words", "urls", "mentions")
