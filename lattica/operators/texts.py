"""Text table functions: sections, chunks, features, signal lines, hash embeddings and threads."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lattica.functions.columns import clean_markdown, content_hash, first_sentences, short_hash, truncate_words

#: Words that name nothing, for tags and entities, and those that a task line is not told by.
STOPWORDS = "about after also and are because been being but can could for from has have into not our that the their then there this with will would your".split()
TASK_STOPWORDS = "a an and the to of for in on by with at from is be it this that me my our we i you he she they them his her".split()
#: What makes a line a signal, in the order in which the kinds are tried.
NAME_TO = r"^\s*(?:[-*]\s*)?([A-Z][A-Za-z0-9_.-]+)\s+to\s+([a-z][^\n]{8,})"
OPEN_Q = r"(?i)\b(open question|question|clarify|confirm|double-check|tbd|unknown|need to know|whether|should we|can we|do we)\b"
RISK = (
    r"(?i)\b(risk|blocker|blocked|concern|issue|problem|delay|delayed|unsatisfied|struggle|fails?|failure|regression|losing|contingent|unacceptable|missing|"
    r"poorly calibrated|not yet confirmed|slow procurement)\b"
)
ACTION = r"(?i)\b(action item|next step|todo|follow up|prepare|send|schedule|finali[sz]e|address|ensure|need to|must|should|owner|due|by end of|by may|by jun|by q[1-4])\b"
DECISION = r"(?i)\b(decision|decided|approved|chosen|selected|will use|we use|do not use|must not use|plan is|agreed|committed)\b"
OWNER = r"\b(?:owner|action owner|assigned to)\s*[:=-]\s*([A-Z][A-Za-z0-9_.-]+(?:\s+[A-Z][A-Za-z0-9_.-]+){0,2})"
URGENT = r"(?i)\b(critical|urgent|asap|blocker|losing|failed|must|before the end|by end of|renewal|contract|customer|legal|sla|regression)\b"
RESOLVED = r"(?i)\b(done|resolved|closed|shipped|deployed|completed|fixed|approved)\b"
SEVERITY = {"risk": 70, "todo": 55, "open_question": 50, "decision": 35, "owner": 25}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != "")


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1400, size: int = 900) -> DataFrame:
    """(id, shard, n_words, content_hash, content): texts over ``limit`` words in shards of ``size``, others whole.

    One row's array of words is sliced in place; nothing is shuffled.
    """
    w = docs.select(id_col, words_of(F.col(text_col)).alias("w"), F.col(text_col).alias("whole"))
    n = F.size("w")
    starts = F.when(n > limit, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array(F.lit(0)))
    cut = w.select(id_col, "whole", "w", n.alias("n"), F.posexplode(starts).alias("shard", "start"))
    content = F.when(F.col("n") > limit, F.array_join(F.slice("w", F.col("start") + 1, F.lit(size)), " ")).otherwise(F.col("whole"))
    n_words = F.when(F.col("n") > limit, F.least(F.lit(size), F.col("n") - F.col("start"))).otherwise(F.col("n"))
    return cut.select(id_col, "shard", n_words.alias("n_words"), content_hash(content).alias("content_hash"), content.alias("content"))


def merged_sizes(sizes: Column, least: int) -> Column:
    """Word counts after each run below ``least`` is merged into what follows: one left fold over the array."""
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(None).cast("int").alias("pending"))
    step = lambda a, n: (
        F.when(a["pending"].isNull(), F.struct(a["done"].alias("done"), n.alias("pending")))
        .when(a["pending"] < least, F.struct(a["done"].alias("done"), (a["pending"] + n).alias("pending")))
        .otherwise(F.struct(F.array_append(a["done"], a["pending"]).alias("done"), n.alias("pending")))
    )
    return F.aggregate(sizes, start, step, lambda a: F.when(a["pending"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["pending"])))


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section, path, content): headings ``#`` to ``######`` open sections; the path holds one title a level above."""
    part = docs.select(id_col, F.posexplode(F.split(F.col(text_col), r"(?m)(?=^#{1,6}\s+\S)")).alias("raw_pos", "content")).filter(F.trim("content") != "")
    level = F.char_length(F.regexp_extract("content", r"^(#{1,6})\s", 1))
    title = F.trim(F.regexp_extract("content", r"^#{1,6}\s+([^\n]*)", 1))
    part = part.withColumn("level", level).withColumn("title", F.when(F.col("level") > 0, title))
    order = Window.partitionBy(id_col).orderBy("raw_pos").rowsBetween(Window.unboundedPreceding, 0)
    # the last heading of each level counts unless a heading of a level above came later
    slots = []
    for k in range(1, 7):
        mark = F.when(F.col("level") == k, F.struct("raw_pos", "title"))
        above = F.max(F.when((F.col("level") > 0) & (F.col("level") < k), F.col("raw_pos"))).over(order)
        seen = F.last(mark, ignorenulls=True).over(order)
        slots.append(F.when(seen["raw_pos"] >= F.coalesce(above, F.lit(-1)), seen["title"]))
    path = F.filter(F.array(*slots), lambda x: x.isNotNull())
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy("raw_pos")) - 1
    return part.select(id_col, nth.alias("section"), path.alias("path"), F.trim("content").alias("content"))


def top_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """(id, word, n, rank): the commonest words of 4 letters or more that are no stop words; first seen first at a tie."""
    found = F.regexp_extract_all(F.lower(clean_markdown(F.col(text_col))), F.lit(r"(?U)\b[a-z][a-z0-9-]{3,}\b"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(STOPWORDS))
    counted = docs.select(id_col, F.posexplode(kept).alias("pos", "word")).groupBy(id_col, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= k).select(id_col, "word", "n", "rank")


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 15) -> DataFrame:
    """(id, entity, n, rank): runs of up to four capitalised words, stop words trimmed off both ends."""
    found = F.regexp_extract_all(clean_markdown(F.col(text_col)), F.lit(r"(?U)\b[A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*){0,3}\b"), F.lit(0))
    stop = "(?:" + "|".join(STOPWORDS) + ")"
    trimmed = F.transform(found, lambda e: F.trim(F.regexp_replace(F.regexp_replace(e, rf"(?i)^(?:{stop}\s+)*(?:{stop}$)?", ""), rf"(?i)(?:\s+{stop})+$", "")))
    kept = F.filter(trimmed, lambda e: F.char_length(e) > 2)
    counted = docs.select(id_col, F.posexplode(kept).alias("pos", "entity")).groupBy(id_col, "entity").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= k).select(id_col, "entity", "n", "rank")


def summaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    clean = docs.select(id_col, clean_markdown(F.col(text_col)).alias("c"))
    confidence = F.when(F.size(F.split("c", " ")) < 80, 0.55).otherwise(0.7)
    return clean.select(id_col, first_sentences(F.col("c")).alias("summary"), confidence.alias("confidence"))


def candidate_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line): trimmed lines of ten characters or more; table rows go, lines over 360 are split by sentence."""
    raw = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "raw"))
    line = raw.select(id_col, "line_no", F.regexp_replace("raw", r"^[ \-*\t]+|[ \-*\t]+$", "").alias("line")).filter((F.char_length("line") >= 10) & ~F.col("line").rlike(r"^\|(.*\|)?$"))
    part = F.when(F.char_length("line") > 360, F.split("line", r"(?<=[.!?])\s+")).otherwise(F.array("line"))
    out = line.select(id_col, "line_no", F.posexplode(part).alias("part", "p")).select(id_col, "line_no", "part", F.trim("p").alias("line")).filter(F.char_length("line") >= 10)
    return out


def line_kind(line: Column) -> Column:
    return (
        F.when(line.rlike(NAME_TO), "todo").when(line.endswith("?") | line.rlike(OPEN_Q), "open_question").when(line.rlike(RISK), "risk")
        .when(line.rlike(ACTION), "todo").when(line.rlike(DECISION), "decision")
    )


def line_owner(line: Column) -> Column:
    owner = F.regexp_replace(F.regexp_extract(line, OWNER, 1), r"^[ .,:;]+|[ .,:;]+$", "")
    return F.coalesce(F.nullif(owner, F.lit("")), F.nullif(F.regexp_extract(line, NAME_TO, 1), F.lit("")))


def line_severity(kind: Column, line: Column, status: Column) -> Column:
    base = F.lit(0)
    for name, value in SEVERITY.items():
        base = F.when(kind == name, value).otherwise(base)
    base = base + F.when(line.rlike(URGENT), 18).otherwise(0) - F.when(status == "resolved", 25).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), base + F.when(F.lower(line).rlike("customer|contract"), 6).otherwise(0)))


def signal_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, part, kind, owner, status, severity, title, signal_id) of every line that is a signal."""
    lines = candidate_lines(docs, id_col, text_col).withColumns({"owner": line_owner(F.col("line")), "k": line_kind(F.col("line"))})
    kind = F.coalesce("k", F.when(F.col("owner").isNotNull(), "owner"))
    lines = lines.withColumn("kind", kind).filter("kind is not null").withColumn("status", F.when(F.col("line").rlike(RESOLVED), "resolved").otherwise("open"))
    title = truncate_words(F.regexp_replace(F.regexp_replace("line", r"[*_`]+", ""), r"\s+", " "), 96)
    sid = F.concat(F.lit("signal."), F.col("kind"), F.lit("."), short_hash(F.concat_ws("|", "kind", F.col(id_col).cast("string"), "line"), 12))
    return lines.select(id_col, "line_no", "part", "kind", "owner", "status", line_severity(F.col("kind"), F.col("line"), F.col("status")).alias("severity"), title.alias("title"), sid.alias("signal_id"))


def hash_embedding(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = 64) -> DataFrame:
    """(id, slot, value) of each text's sparse hash embedding: tokens to signed slots, at length one, six decimals.

    A token's slot is the first four bytes of its SHA-256, its sign the parity of the fifth. Tokens are counted first, so
    each distinct token of a text is hashed once.
    """
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(?U)\b[a-z0-9][a-z0-9-]{2,}\b"), F.lit(0))
    tokens = docs.select(id_col, F.explode(found).alias("t")).groupBy(id_col, "t").agg(F.count("*").alias("n")).withColumn("h", F.sha2("t", 256))
    slot = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = tokens.select(id_col, slot.alias("slot"), (sign * F.col("n")).alias("v")).groupBy(id_col, "slot").agg(F.sum("v").alias("v"))
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(id_col)).cast("double"))
    return sums.withColumn("len", length).filter("v <> 0").select(id_col, "slot", F.round(F.col("v") / F.col("len"), 6).alias("value"))


class _Text(HTMLParser):
    """Text of HTML: dropped subtrees, line breaks, a new line at the end of each block outside verbatim tags.

    Tags nest as they are written; one that is never closed ends with the tag around it.
    """

    #: Fixed values of the format.
    DROP = {"script", "style", "ac:parameter"}
    BLOCK = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}
    VERBATIM = {"pre", "code"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "br" and not self.DROP & set(self.open):
            self.out.append("\n")
        if tag not in self.VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        while tag in self.open:
            last = self.open.pop()
            if last in self.BLOCK and not (self.DROP | self.VERBATIM) & set(self.open):
                self.out.append("\n")
            if last == tag:
                break

    def handle_data(self, data):
        if not self.DROP & set(self.open):
            self.out.append(data)

    def text(self, html: str) -> str:
        self.feed(html)
        self.close()
        for tag in self.open[::-1]:
            self.handle_endtag(tag)
        return "".join(self.out)


def html_text(html: str | None) -> str | None:
    import re

    if html is None:
        return None
    return re.sub(r"\n{3,}", "\n\n", _Text().text(html)).strip("\n")


@F.pandas_udf(StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(html_text)


def threads(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, n_messages, n_roles, first_role, last_text, n_chars, markdown): each thread as one row, its turns in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "role", "text")))
    out = turns.groupBy(key).agg(
        F.count("*").alias("n_messages"), F.count_distinct("role").alias("n_roles"), F.min_by("role", order).alias("first_role"), F.max_by("text", order).alias("last_text"),
        F.sum(F.char_length("text")).alias("n_chars"), listed.alias("l"),
    )
    return out.withColumn("markdown", F.array_join(F.transform("l", lambda m: F.concat(F.lit("**"), m["role"], F.lit(":** "), m["text"])), "\n\n")).drop("l")
