"""A paged source as a Python data source: one partition a page cursor, filters and columns handed down to the pages.

A remote listing gives its rows page by page, each behind a cursor, and takes simple filters so that it need not send what nobody
wants. Here a folder of Parquet files stands for the listing: a cursor is (file, row group, first row), known from the files' footers
before anything is read; pages are read by different tasks, in any order and again after a failure. Filters that the source
understands are applied by it (whole pages are passed over by the footers' statistics) and leave Spark's plan; the others stay.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith,
)
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from lattica.session import materialize

COMPARED = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class Page(InputPartition):
    """A cursor: so many rows of a file's row group, from one row on."""

    def __init__(self, file: str, group: int, start: int, rows: int):
        super().__init__((file, group, start, rows))
        self.file, self.group, self.start, self.rows = file, group, start, rows


class PagedSource(DataSource):
    """``format("paged")`` with the options path and page_rows."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def files(self) -> list[str]:
        top = Path(self.options["path"].removeprefix("file://"))
        return sorted(str(f) for f in top.rglob("*.parquet")) if top.is_dir() else [str(top)]

    def schema(self) -> StructType:
        return from_arrow_schema(pq.read_schema(self.files()[0]), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.files(), schema, int(self.options.get("page_rows", "10000")))


class PagedReader(DataSourceReader):
    def __init__(self, files: list[str], schema: StructType, page_rows: int):
        self.files, self.columns, self.page_rows = files, schema.names, page_rows
        self.taken: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps those on plain columns that a page can answer, and gives the others back."""
        for f in filters:
            if self.understood(f):
                self.taken.append(f)
            else:
                yield f

    def understood(self, f: Filter) -> bool:
        if isinstance(f, Not):
            return isinstance(f.child, (EqualTo, In, IsNull, StringStartsWith)) and self.understood(f.child)
        known = isinstance(f, (*COMPARED, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith))
        return known and len(f.attribute) == 1 and f.attribute[0] in self.columns

    def partitions(self) -> list[Page]:
        pages = []
        for file in self.files:
            meta = pq.read_metadata(file)
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                if not any(self.excluded(f, group) for f in self.taken):
                    pages += [Page(file, g, at, min(self.page_rows, group.num_rows - at)) for at in range(0, group.num_rows, self.page_rows)]
        return pages

    def excluded(self, f: Filter, group: pq.RowGroupMetaData) -> bool:
        """Whether the statistics of a row group say that no row of it passes."""
        if not isinstance(f, (*COMPARED, In)):
            return False
        column = next((group.column(k) for k in range(group.num_columns) if group.column(k).path_in_schema == f.attribute[0]), None)
        stats = column.statistics if column else None
        if stats is None or not stats.has_min_max:
            return False
        low, high = stats.min, stats.max
        values = f.value if isinstance(f, In) else [f.value]
        try:
            if isinstance(f, (EqualTo, In)):
                return all(v is None or v < low or v > high for v in values)
            return {GreaterThan: lambda v: high <= v, GreaterThanOrEqual: lambda v: high < v, LessThan: lambda v: low >= v, LessThanOrEqual: lambda v: low > v}[type(f)](values[0])
        except TypeError:  # statistics of another type than the literal
            return False

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        rows = pq.ParquetFile(page.file).read_row_group(page.group, columns=self.columns).slice(page.start, page.rows)
        for f in self.taken:
            rows = rows.filter(self.mask(f, rows))
        yield from rows.select(self.columns).to_batches()

    def mask(self, f: Filter, rows: pa.Table) -> pa.ChunkedArray:
        """Rows that pass; null, as in SQL, does not."""
        if isinstance(f, Not):
            return pc.invert(self.mask(f.child, rows)) if isinstance(f.child, IsNull) else pc.and_kleene(pc.invert(self.mask(f.child, rows)), pc.is_valid(rows[f.child.attribute[0]]))
        column = rows[f.attribute[0]]
        if isinstance(f, IsNull):
            return pc.is_null(column)
        if isinstance(f, IsNotNull):
            return pc.is_valid(column)
        if isinstance(f, StringStartsWith):
            return pc.starts_with(column, f.value)
        if isinstance(f, In):
            return pc.is_in(column, pa.array([v for v in f.value if v is not None], column.type))
        if f.value is None:
            return pc.is_null(column) if isinstance(f, EqualNullSafe) else pa.chunked_array([pa.nulls(len(rows), pa.bool_())])
        value = pa.scalar(f.value.replace(tzinfo=None) if isinstance(f.value, datetime.datetime) and getattr(column.type, "tz", 1) is None else f.value)
        test = {"==": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}[COMPARED.get(type(f), "==")]
        return test(column, value.cast(column.type) if not isinstance(f.value, float) else value)


def scan(spark: SparkSession, path: str, page_rows: int = 10_000) -> DataFrame:
    """The rows behind a paged source, for one query only.

    Spark 4.1 keeps what was pushed down with the source that ``load`` made, not with the query: a second query on the same
    DataFrame, or a self-join of it, would read with the filters of another. So every query takes a scan of its own; ``fetch``
    does that.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").option("page_rows", str(page_rows)).load(path)


def fetch(spark: SparkSession, path: str, where: Column | None = None, columns: list[str] | None = None, page_rows: int = 10_000) -> DataFrame:
    """The rows of a paged source that pass ``where``, landed in a table of the shared folder and read from there.

    Pages are asked once, however often the result is used. Conditions on plain columns that are joined by AND go down to the pages,
    the others are Spark's. A folder without files raises; files have to be readable by Python. Turns on Spark's push-down into
    Python sources for the session.
    """
    rows = scan(spark, path, page_rows)
    rows = rows if where is None else rows.filter(where)
    return materialize(rows if columns is None else rows.select(*columns), "pages")
