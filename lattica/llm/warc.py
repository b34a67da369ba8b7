"""WARC archives with revisit records for repeated payloads.

Only headers (digest, id) are shuffled: they are grouped by payload digest with map-side combining, so a digest that a third
of all rows share is a few rows for each task. The payloads go from the scan into the archive without a shuffle. Archives are
written by Spark's own text writer (a record a line, the line's end being the two line breaks that end a record), which
commits whole tasks; files are gzipped and hold at most RECORDS_PER_FILE records. Readers go by Content-Length.
"""

from __future__ import annotations

import gzip
import hashlib
import base64
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import small
from lattica.session import materialize

RECORDS_PER_FILE = 4_096
LARGE, FILE_BYTES = 1 << 18, 1 << 30
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the formats.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = "\r\n"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits are eight groups of five, each four base32 characters."""
    hex_ = F.sha1(payload)
    chars = []
    for i in range(8):
        group = F.conv(F.substring(hex_, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            chars.append(F.substr(F.lit(BASE32), F.shiftright(group, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*chars)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, uri, payload, digest, n_bytes): null html is the empty payload, a null url stands as urn:page:<id>."""
    uri = F.regexp_replace(F.coalesce(F.col(url_col), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("none")))), r"[\s\x00-\x1f]", "")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    out = pages.select(F.col(id_col).cast("long").alias("page_id"), uri.alias("uri"), payload.alias("payload"))
    return out.withColumns({"digest": payload_digest(F.col("payload")), "n_bytes": F.octet_length("payload").cast("long")})


def resolve_revisits(recs: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds original, the page_id that a record revisits, and original_uri; both null for responses.

    Of equal payloads of at least ``min_bytes`` the largest page_id is the response. Rows with a null page_id and rows that
    repeat that page_id are responses too.
    """
    shared = (
        recs.filter(F.col("n_bytes") >= min_bytes).groupBy("digest")
        .agg(F.max_by(F.struct("page_id", "uri"), "page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
        .select("digest", F.col("first.page_id").alias("original"), F.col("first.uri").alias("original_uri"))
    )
    shared = small(materialize(shared, "payloads"))
    revisit = (F.col("page_id") != F.col("original")) & (F.col("n_bytes") >= min_bytes)
    joined = recs.join(shared, "digest", "left")
    return joined.withColumns({c: F.when(revisit, F.col(c)) for c in ("original_uri", "original")})


def write_warc(recs: DataFrame, path: str, date: str = DATE) -> None:
    """Write a response or revisit record for each row of resolve_revisits(), with fresh headers.

    A file is read back as one value, so it stays under FILE_BYTES of payload: RECORDS_PER_FILE records of at most
    LARGE bytes, and as few larger ones as the largest of all demands. Rows with one page_id and one payload are one capture
    and share a record id.
    """
    http = F.lit(BREAK.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "]))
    http = F.concat(http, F.col("n_bytes").cast("string"), F.lit(BREAK * 2))
    revisit = F.col("original").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload").cast("string")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        BREAK, F.lit("WARC/1.1"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _uuid(F.col("page_id").cast("string"), F.col("digest"))), F.lit(f"WARC-Date: {date}"),
        line("WARC-Target-URI", F.col("uri")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, line("WARC-Refers-To", _uuid(F.col("original").cast("string"), F.col("digest")))),
        F.when(revisit, line("WARC-Refers-To-Target-URI", F.col("original_uri"))), F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        line("X-Page-ID", F.col("page_id").cast("string")), F.lit("Content-Type: application/http;msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    lines = recs.select("n_bytes", F.concat(head, F.lit(BREAK * 2), block).alias("value"))
    most = recs.agg(F.coalesce(F.max("n_bytes"), F.lit(0))).first()[0]
    for part, rows, records in (("small", F.col("n_bytes") <= LARGE, RECORDS_PER_FILE), ("large", F.col("n_bytes") > LARGE, max(1, FILE_BYTES // max(most, 1)))):
        if part == "small" or most > LARGE:
            writer = lines.filter(rows).select("value").write.option("lineSep", BREAK * 2).option("compression", "gzip")
            writer.option("maxRecordsPerFile", records).text(f"{path}/{part}")


def parse_warc(content: bytes):
    """(headers, block) of each record of a gzipped or plain archive, read through its Content-Length."""
    stream = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream)) if content[:2] == b"\x1f\x8b" else stream
    while True:
        version = stream.readline()
        if not version:
            return
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        headers = {}
        while text := stream.readline().strip():
            name, _, value = text.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives under ``path``; n_bytes and found are measured on a response's payload."""
    schema = "page_id long, record_type string, record_id string, uri string, digest string, refers string, n_bytes long, found string" + ", payload binary" * payloads
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse_warc(content.as_py()):
                    kind = h.get("warc-type")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    rows.append({
                        "page_id": int(h["x-page-id"]) if "x-page-id" in h else None, "record_type": kind, "record_id": h.get("warc-record-id"), "uri": h.get("warc-target-uri"),
                        "digest": h.get("warc-payload-digest", "").removeprefix("sha1:"), "refers": h.get("warc-refers-to"), "n_bytes": None if payload is None else len(payload),
                        "found": None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(), "payload": payload,
                    })
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=fields)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(run, schema)


def join_revisits(recs: DataFrame) -> DataFrame:
    """Each record of read_warc() with the page_id and payload size of the response that it revisits, if it does."""
    target = recs.filter("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("n_bytes").alias("target_bytes"))
    revisits = recs.filter("record_type = 'revisit'")
    needed = target.join(small(revisits.select("refers").distinct()), "refers", "left_semi").dropDuplicates(["refers"])
    joined = revisits.join(small(needed), "refers", "left").withColumn("n_bytes", F.col("target_bytes")).drop("target_bytes")
    return recs.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(joined)
