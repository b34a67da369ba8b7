"""Mail payloads of any nesting as part rows, their best text and their markdown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lattica.operators.texts import html_to_text
from lattica.session import materialize

#: One part; what it holds stays JSON, so that a level is parsed at a time and no depth is assumed.
PART = "mimeType string, filename string, headers array<struct<name: string, value: string>>, body struct<data: string, attachmentId: string>, parts array<string>"


def mime_parts(payloads: DataFrame, id_col: str = "id", payload: str = "payload") -> DataFrame:
    """(id, path, mime, filename, charset, data, attachment_id) of every part of JSON payloads, the root's path empty.

    Paths compare as arrays do, a part before those inside it, so they give the depth-first order. A payload that does not
    parse has no parts.
    """
    none = F.array().cast("array<int>")
    level, out = payloads.select(F.col(id_col).alias("id"), none.alias("path"), F.col(payload).alias("json")), None
    while True:
        read = materialize(level.select("id", "path", F.from_json("json", PART).alias("p")).filter("p.mimeType IS NOT NULL OR p.parts IS NOT NULL OR p.body IS NOT NULL"), "parts")
        kind = F.get(F.filter(F.col("p.headers"), lambda h: F.lower(h["name"]) == "content-type"), F.lit(0))["value"]
        charset = F.regexp_extract(kind, r"""charset\s*=\s*"?([A-Za-z0-9._-]+)""", 1)
        rows = read.select("id", "path", F.lower(F.coalesce("p.mimeType", F.lit(""))).alias("mime"), F.coalesce("p.filename", F.lit("")).alias("filename"), F.lower(F.coalesce(charset, F.lit(""))).alias("charset"), F.col("p.body.data").alias("data"), F.col("p.body.attachmentId").alias("attachment_id"))
        out = rows if out is None else out.unionByName(rows)
        inner = read.select("id", "path", F.posexplode("p.parts").alias("i", "json"))
        level = inner.select("id", F.concat("path", F.array("i")).alias("path"), "json")
        if inner.isEmpty():
            return out


#: Charsets that Spark decodes itself, all others are left to Python's codecs.
LATIN, UTF = ["iso-8859-1", "latin-1", "latin1"], ["", "utf-8", "utf8", "us-ascii", "ascii"]


@F.pandas_udf(StringType())
def _by_codec(raw: pd.Series, charset: pd.Series) -> pd.Series:
    def one(data, name):
        try:
            return bytes(data).decode(name, "replace")
        except LookupError:  # nobody knows that charset
            return bytes(data).decode("utf-8", "replace")

    return pd.Series([None if d is None else one(d, n) for d, n in zip(raw, charset)], dtype="object")


def decoded(data: Column, charset: Column) -> Column:
    """URL-safe base64 as text by the part's own charset; UTF-8 if it names none or an unknown one. Invalid bytes are replaced.

    UTF-8 and Latin-1 stay in the JVM; only parts of other charsets go to Python.
    """
    raw = F.unbase64(F.translate(F.coalesce(data, F.lit("")), "-_", "+/"))
    plain = F.when(charset.isin(LATIN), F.decode(raw, "ISO-8859-1")).otherwise(F.make_valid_utf8(raw.cast("string")))
    other = ~charset.isin(LATIN + UTF)
    return F.when(other, _by_codec(F.when(other, raw), charset)).otherwise(plain)


def best_text(parts: DataFrame) -> DataFrame:
    """(id, mime, text): the first plain part in depth-first order if it has text, else the first HTML part's; else none."""
    texts = parts.filter(F.col("mime").isin("text/plain", "text/html")).select("id", "path", "mime", decoded(F.col("data"), F.col("charset")).alias("text"))
    first = texts.withColumn("n", F.row_number().over(Window.partitionBy("id", "mime").orderBy("path"))).filter("n = 1 AND text <> ''")
    return first.groupBy("id").agg(F.max_by(F.struct("mime", "text"), "mime").alias("b")).select("id", "b.mime", "b.text")  # "text/plain" is the greater


def mail_markdown(parts: DataFrame) -> DataFrame:
    """(id, markdown) of each payload: its best text, HTML as text, then a line for each attachment in depth-first order."""
    files = F.filter(F.array_sort(F.collect_list(F.struct("path", "filename", "attachment_id"))), lambda p: p["attachment_id"].isNotNull())
    lines = F.transform(files, lambda p: F.concat(F.lit("[attachment: "), F.when(p["filename"] == "", "(unnamed)").otherwise(p["filename"]), F.lit("]")))
    found = parts.groupBy("id").agg(lines.alias("files")).join(best_text(parts), "id", "left")
    body = F.regexp_replace(F.when(F.col("mime") == "text/html", html_to_text(F.col("text"))).otherwise(F.coalesce("text", F.lit(""))), r"^\n+|\n+$", "")
    pieces = F.filter(F.array(body, F.array_join("files", "\n")), lambda x: x != "")
    return found.select("id", F.regexp_replace(F.array_join(pieces, "\n\n"), r"\n{3,}", "\n\n").alias("markdown"))
