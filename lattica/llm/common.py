"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: A side is broadcast only if it has at most so many rows and bytes, both measured.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Bytes of text that are handled at once as arrays, and rows of text that cross to Python at once.
SLICE = 1 << 18
TEXT_ROWS = 4_000


def width(name: str, kind: DataType) -> Column:
    """The bytes of a value: 8 of a plain one, the UTF-8 length of a string, the JSON text's of anything nested."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(F.col(name)), F.lit(0)).cast("long")
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(name)))), F.lit(0)).cast("long")
    return F.lit(8).cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is measured to have at most ``rows`` rows and ``size`` bytes, else unchanged (a shuffle join)."""
    total = sum((width(f.name, f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(total), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, text: int | None = None, limit: int = SLICE) -> DataFrame:
    """mapInArrow with one function from a record batch to a dict of columns.

    ``text`` is the position of a column of texts: then a batch is handed over in slices of at most ``limit`` bytes of them (a
    longer text alone), so that arrays of one number a byte stay small. Spark reads the size of its own batches from the session
    when the query runs, so the session's setting is lowered to TEXT_ROWS rows, and stays so, unless it is lower already.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    if text is not None:
        few_texts_at_once(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, limit) if text is not None else [whole]:
                if batch.num_rows:
                    cols = fn(batch)
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def few_texts_at_once(spark: SparkSession) -> None:
    """Lower the session's rows a batch to TEXT_ROWS, unless they are fewer already."""
    batches = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batches)) <= TEXT_ROWS:
        spark.conf.set(batches, str(TEXT_ROWS))


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column back to back, and n+1 offsets; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])
