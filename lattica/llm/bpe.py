"""Byte-level BPE: overlapping chunk encoding, and decoding by concatenating raw bytes.

A text longer than CHUNK characters is cut into chunks that overlap by OVERLAP characters. The chunks are spread over the
cluster and pre-tokenised in parallel. Two neighbours are stitched at the first pre-token boundary that both have inside
their overlap: whatever follows a boundary depends on the text to its right only, so from there on the right chunk's
pre-tokens are those of the whole text. Then the pieces between the stitches are encoded, and their ids put in order. A text
with an overlap without such a boundary (one endless pre-token) is encoded as a single chunk.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map

CHUNK = 32_768
OVERLAP = 1_024
#: Pieces whose ids a Python worker remembers before it starts anew.
REMEMBERED = 150_000


class Encoder:
    """The ids of pre-tokens under a rank file, each remembered as (ids, bytes it decodes to, ids as text)."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.table = {v: k for k, v in ranks.items()}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[bytes, bytes, str]] = {}

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def piece(self, text: str) -> tuple[bytes, bytes, str]:
        if (found := self.known.get(text)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            ids = self.bpe._encode_single_piece(text)  # one match of the pattern
            found = (np.array(ids, dtype="<i4").tobytes(), self.decode(ids), ",".join(map(str, ids)))
            if len(text) < 200:
                self.known[text] = found
        return found

    def encode(self, pieces: list[str]) -> tuple[bytes, bytes, str]:
        known, piece = self.known.get, self.piece
        got = [known(p) or piece(p) for p in pieces]
        return b"".join([g[0] for g in got]), b"".join([g[1] for g in got]), ",".join([g[2] for g in got])

    def pieces(self, text: str, start: int = 0, end: int | None = None) -> list[str]:
        """The pre-tokens of the whole text that lie in [start, end), both of them boundaries."""
        if start == 0 and end is None:
            return self.pattern.findall(text)
        end = len(text) if end is None else end
        out = []
        for m in self.pattern.finditer(text, start):
            if m.end() > end:
                break
            out.append(m.group())
        return out

    def boundaries(self, text: str, low: int, high: int) -> list[int]:
        """Ends of pre-tokens in (low, high), as far as the text goes on after them."""
        return [m.end() for m in self.pattern.finditer(text) if low < m.end() < high]


@functools.cache
def encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


def ids_column(parts: list[bytes]) -> pa.Array:
    sizes = np.array([len(p) // 4 for p in parts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def _encoded(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode [low, high) of each row's text (null: its ends); the rows' other columns stay."""
    keys = [c for c in rows.columns if c not in ("text", "low", "high")]

    def run(batch: pa.RecordBatch) -> dict:
        enc = encoder(ranks_path, pattern)
        got = [enc.encode(enc.pieces(t or "", a or 0, b)) for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "low", "high")))]
        return {c: batch.column(c) for c in keys} | {"ids": ids_column([g[0] for g in got]), "decoded": [g[1] for g in got], "ids_text": [g[2] for g in got]}

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    return arrow_map(rows, run, f"{schema}, ids array<int>, decoded binary, ids_text string", text=rows.columns.index("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids array<int>, decoded binary, ids_text) for every row.

    Null and empty texts have no ids; repeated rows each get a row, null ids stay; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ends = (F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    brief = rows.filter(F.char_length("text") <= chunk)
    long = rows.filter(F.char_length("text") > chunk).withColumn("uid", F.monotonically_increasing_id())
    stitched = _stitched(long, ranks_path, pattern, chunk, overlap)
    whole = stitched.filter("loose and chunk = 0").join(long.select("uid", F.col("text").alias("all")), "uid")
    one = brief.select("id", "text", *ends).unionByName(whole.select("id", F.col("all").alias("text"), *ends))
    pieces = _encoded(stitched.filter("not loose").select("uid", "id", "chunk", "text", "low", "high"), ranks_path, pattern)
    joined = pieces.groupBy("uid", "id").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids", "decoded", "ids_text"))).alias("part"))
    joined = joined.select(
        "id", F.flatten("part.ids").alias("ids"),
        F.array_join(F.transform("part", lambda p: p["decoded"].cast("string")), "").cast("binary").alias("decoded"),
        F.array_join("part.ids_text", ",").alias("ids_text"),
    )
    out = _encoded(one, ranks_path, pattern).unionByName(joined)
    return out.withColumnRenamed("id", id_col)


def _stitched(long: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Chunks of long texts with the range [low, high) each one encodes; loose: a text without all its stitches."""

    def cut(batches):
        for batch in batches:
            for uid, id_, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "id", "text"))):
                for k, at in enumerate(range(0, len(text), chunk)):
                    last = at + chunk >= len(text)
                    yield pa.RecordBatch.from_pylist([{"uid": uid, "id": id_, "chunk": k, "last": last, "text": text[at : at + chunk + overlap]}], schema=fields)

    id_type = long.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"uid long, id {id_type}, chunk int, last boolean, text string"
    fields = to_arrow_schema(_parse_datatype_string(schema))
    chunks = long.select("uid", "id", "text").mapInArrow(cut, schema).repartition("uid", "chunk")

    def tokenise(batch: pa.RecordBatch) -> dict:
        enc = encoder(ranks_path, pattern)
        heads, tails = [], []
        for text, k, last in zip(*(batch.column(c).to_pylist() for c in ("text", "chunk", "last"))):
            at = k * chunk
            found = np.array(enc.boundaries(text, 0, len(text)), dtype=np.int64)
            heads.append((found[found < overlap] + at).astype(np.int32) if k else [])
            tails.append([] if last else (found[found >= chunk] + at).astype(np.int32))
        return {c: batch.column(c) for c in ("uid", "id", "chunk", "last", "text")} | {"heads": heads, "tails": tails}

    marked = arrow_map(chunks, tokenise, f"{schema}, heads array<int>, tails array<int>")
    order = Window.partitionBy("uid").orderBy("chunk")
    sync = F.array_min(F.array_intersect("tails", F.lead("heads").over(order)))
    marked = marked.withColumn("sync", sync).withColumn("from", F.lag("sync").over(order))
    loose = F.max(F.col("sync").isNull() & ~F.col("last")).over(Window.partitionBy("uid"))
    return marked.select(
        "uid", "id", "chunk", "text", loose.alias("loose"),
        (F.coalesce("from", F.lit(0)) - F.when(F.col("chunk") > 0, F.col("chunk") * chunk).otherwise(0)).alias("low"),
        F.when(~F.col("last"), F.col("sync") - F.col("chunk") * chunk).alias("high"),
    )


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
