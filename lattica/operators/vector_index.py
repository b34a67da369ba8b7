"""An inverted-file index over vectors: coarse centres, their lists in slices, approximate probes and exact searches.

Vectors are brought to length one; a cosine of c is then a distance of sqrt(2 - 2c). Every vector is in the list of its nearest
centre with its distance to it (rho). By the triangle inequality a query at distance d from a centre can be within r of
members with |d - rho| <= r only. Lists are cut into slices of neighbouring rho and bounded size, and neighbouring slices are
a block of bounded bytes: this range picks the blocks that a query goes to, and in them the lists.

Approximate search looks into the lists of a query's nearest centres. Exact search takes the k-th score found that way as its
radius and looks into every list that the range allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lattica.operators.ranking import positions
from lattica.session import materialize

#: Centres are learnt from at most so many rows; there are at most so many of them; rows of a slice; rounds of learning.
SAMPLE, LISTS, SLICE, ROUNDS = 100_000, 4_096, 4_096, 4
#: Bytes of a block of slices as a matrix, which a task holds; queries that meet it at once.
BLOCK_BYTES, TILE = 64 << 20, 512
#: Scores are rounded to six digits, so a search looks a little farther than its radius.
SLACK = 2e-6


class Index(NamedTuple):
    """``centres`` as rows of a matrix, ``near`` and ``far`` the least and the largest rho of each list, ``rows`` (list, slice, id, vector, rho), ``slices`` (list, slice, least, most)."""

    centres: np.ndarray
    near: np.ndarray
    far: np.ndarray
    rows: DataFrame
    slices: DataFrame


def codes_of(ids: pa.Array, names: pa.Array) -> np.ndarray:
    """The place of each id among ``names`` (its first), -1 of one that is not there, -2 of null."""
    place = pc.fill_null(pc.index_in(ids.cast(names.type), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), -2, place)


class Best:
    """The ``k`` best (score, id) of each of ``n`` queries among all rows added; not-a-number is above all, ties go by id."""

    def __init__(self, n: int, k: int, kind: pa.DataType):
        self.k, self.least, self.kind = k, np.full(n, -np.inf), kind
        self.row, self.key, self.ids, self.waiting = [], [], [], 0

    def add(self, score: np.ndarray, fits: np.ndarray, ids: pa.Array) -> None:
        row, col = np.nonzero(fits & ~(score < self.least[:, None]))  # not-a-number is not less
        if len(row):
            key = score[row, col]
            self.row.append(row)
            self.key.append(np.where(np.isnan(key), np.inf, key))
            self.ids.append(ids.take(pa.array(col)).cast(self.kind))
            self.waiting += len(row)
            if self.waiting > 2 * self.k * len(self.least):
                self.cut()

    def cut(self) -> None:
        """Only the best stay; what is worse than a query's k-th is not taken any more."""
        if not self.row:
            return
        row, key, ids = np.concatenate(self.row), np.concatenate(self.key), pa.chunked_array(self.ids).combine_chunks()
        rank = np.empty(len(ids), dtype=np.int64)
        rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((rank, -key, row))
        row, key = row[order], key[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        kept = nth < self.k
        last = nth == self.k - 1
        self.least[row[last]] = key[last]
        self.row, self.key, self.ids = [row[kept]], [key[kept]], [ids.take(pa.array(order[kept]))]
        self.waiting = int(kept.sum())

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        self.cut()
        if not self.row:
            return np.zeros(0, dtype=np.int64), np.zeros(0), pa.array([], self.kind)
        return self.row[0], np.where(np.isinf(self.key[0]), np.nan, self.key[0]), self.ids[0]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _distances(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((units**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * units @ centres.T, 0.0))


def usable(vectors: DataFrame, vector: str, size: int) -> DataFrame:
    """Without vectors of another length, with null or non-finite parts, or of length zero: they are like no other."""
    whole = (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.coalesce(whole, F.lit(False))).filter(F.exists(vector, lambda x: x != 0))


def _assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` (..., vector) with list and rho: the nearest centre, the first at a tie, and the distance to it."""
    fields = to_arrow_schema(rows.schema)
    out = pa.schema([*fields, ("list", pa.int32()), ("rho", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column("vector"), centres.shape[1]), centres)
                best = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).cast(f.type) for f in fields), pa.array(best.astype(np.int32)), pa.array(d[np.arange(len(d)), best])], schema=out)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", list int, rho double")


def _learnt(rows: DataFrame, lists: int, size: int, sample: int, rounds: int) -> np.ndarray:
    """Centres by rounds of spherical k-means over at most ``sample`` rows, those with the least hashes of their ids."""
    some = materialize(rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample), "index-sample")
    first = some.orderBy(F.xxhash64("id"), "id").limit(lists).collect()  # lists rows
    centres = np.array([r.vector for r in first], dtype=np.float64).reshape(-1, size)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    for _ in range(rounds):
        near = _assigned(some, centres)
        means = near.groupBy("list").agg(F.array(*(F.avg(F.get("vector", F.lit(i)).cast("double")) for i in range(size))).alias("mean")).collect()
        for k, mean in means:
            if (length := np.linalg.norm(mean)) > 0:
                centres[k] = np.array(mean) / length
    return centres


def build(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", size: int | None = None, lists: int | None = None, sample: int = SAMPLE, slice_rows: int = SLICE, rounds: int = ROUNDS) -> Index:
    """An index of every usable vector (``usable``) of the commonest length, or of ``size``.

    There are ``lists`` lists, by default the square root of the rows, at most LISTS. The centres are held by the driver: they are
    bounded by LISTS, not by the rows. Repeated rows are in it as often as they are given.
    """
    size = size or (vectors.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first() or [1])[0]
    rows = materialize(usable(vectors, vector, size).select(F.col(id_col).alias("id"), F.col(vector).alias("vector")), "index-vectors")
    lists = lists or min(LISTS, max(1, round(math.sqrt(rows.count()))))
    centres = _learnt(rows, lists, size, sample, rounds)
    if not len(centres):
        centres = np.zeros((1, size))
    placed = positions(_assigned(rows, centres), [F.col("list"), F.col("rho"), F.col("id")])
    placed = materialize(placed.withColumn("slice", F.floor((F.col("pos") - 1) / slice_rows).cast("long")).drop("pos"), "index-rows")
    slices = materialize(placed.groupBy("list", "slice").agg(F.min("rho").alias("least"), F.max("rho").alias("most")), "index-slices")
    near, far = np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
    for k, least, most in slices.groupBy("list").agg(F.min("least"), F.max("most")).collect():
        near[k], far[k] = least, most
    return Index(centres, near, far, placed, slices)


def _blocks(index: Index, queries: DataFrame, probes: int | None, bounds: list[tuple[int, int, float, float]]) -> DataFrame:
    """``queries`` (query_id, q, reach) once for each block that has rows they may meet, with their nearest list and the lists they look into.

    ``bounds`` are (block, list, least, most) in order. With ``probes`` a query's lists are the nearest that have rows, else all,
    and ``lists`` is null; a block is met if one of its lists has members within reach.
    """
    fields = to_arrow_schema(queries.schema)
    out = pa.schema([*fields, ("block", pa.int32()), ("list", pa.int32()), ("lists", pa.list_(pa.int32()))])
    centres, far = index.centres, index.far
    block, at_list, least, most = (np.array(x) for x in zip(*bounds, strict=True)) if bounds else (np.zeros(0, dtype=int),) * 4
    starts = np.flatnonzero(np.diff(block, prepend=-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if len(block) else 0, 1024):
                part = batch.slice(at, 1024)
                d = _distances(_matrix(part.column("q"), centres.shape[1]), centres)
                reach = part.column("reach").to_numpy(zero_copy_only=False)[:, None]
                open_ = (d[:, at_list] - most <= reach) & (least - d[:, at_list] <= reach)
                lists = [None] * len(d)
                if probes is not None:
                    near = np.argsort(np.where(far[None, :] >= 0, d, np.inf), axis=1, kind="stable")[:, :probes]
                    taken = np.zeros(d.shape, dtype=bool)
                    np.put_along_axis(taken, near, True, axis=1)
                    open_ &= taken[:, at_list]
                    lists = list(near.astype(np.int32))
                row, k = np.nonzero(np.logical_or.reduceat(open_, starts, axis=1))
                met = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*(met.column(f.name).cast(f.type) for f in fields), pa.array(block[starts[k]].astype(np.int32)), pa.array(d.argmin(axis=1)[row].astype(np.int32)), pa.array([lists[r] for r in row], pa.list_(pa.int32()))], schema=out)

    return queries.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema) + ", block int, list int, lists array<int>")


def _dealt(index: Index, n_queries: int) -> tuple[int, int]:
    """(blocks of rows, parts of queries): as few as memory and cores allow, as rows go to every part and queries to every block."""
    n, cells = index.rows.count(), 3 * index.rows.sparkSession.sparkContext.defaultParallelism
    least = math.ceil(8 * index.centres.shape[1] * n / BLOCK_BYTES)
    blocks = max(1, least, min(math.ceil(n / SLICE), math.ceil(math.sqrt(cells * n / max(n_queries, 1)))))
    return blocks, max(1, min(math.ceil(n_queries / SLICE), math.ceil(cells / blocks)))


def _met(index: Index, queries: DataFrame, probes: int | None, floor: float, k: int | None = None) -> DataFrame:
    """(query_id, id, score) of pairs at ``floor`` or more that lists and rho leave; score is the cosine, at six digits.

    Neighbouring slices are a block, which a task holds as one matrix; queries are dealt to parts, and those of a part that may
    meet a block stream by it, TILE at once. So a vector is shuffled once a block or part, not once a slice. With ``k`` a query
    takes its k best others of a block, ties by id, and none under its own id.
    """
    blocks, parts = _dealt(index, queries.count())
    slices = (index.slices.agg(F.max("slice")).first()[0] or 0) + 1
    width = math.ceil(slices / blocks)
    block = F.floor(F.col("slice") / width).cast("int")
    bounds = index.slices.groupBy(block.alias("block"), "list").agg(F.min("least"), F.max("most")).orderBy("block", "list").collect()  # lists and blocks
    asked = _blocks(index, queries, probes, [tuple(r) for r in bounds])
    q, v = asked.schema["q"].dataType, index.rows.schema["vector"].dataType
    one = (lambda c: F.col(c)) if q == v else (lambda c: F.transform(c, lambda x: x.cast("double")))
    null = lambda frame, c: F.lit(None).cast(frame.schema[c].dataType).alias(c)
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    mine = index.rows.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), block.alias("block"), F.lit(0).alias("side"), "list", "rho", "id", null(asked, "query_id"), one("vector").alias("v"), null(asked, "lists"))
    theirs = asked.select(part.alias("part"), "block", F.lit(1).alias("side"), "list", F.col("reach").alias("rho"), null(index.rows, "id"), "query_id", one("q").alias("v"), "lists")
    both = mine.unionByName(theirs).repartition(min(2 * blocks * parts, 2_000), "part", "block").sortWithinPartitions("part", "block", "side", "list", "rho")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {index.rows.schema['id'].dataType.simpleString()}, score double"
    fields, centres = to_arrow_schema(_parse_datatype_string(kinds)), index.centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "block", "side")], axis=1) if batch.num_rows else np.zeros((0, 3))
            starts = [*np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1] if len(keys) else []
            for at, to in zip([0, *starts], [*starts, len(keys)], strict=True):
                if at == to:
                    continue
                if tuple(keys[at, :2]) != cell:
                    cell, rows, held = tuple(keys[at, :2]), [], None
                some = batch.slice(at, to - at)
                if not keys[at, 2]:
                    rows.append(some)
                elif held or rows:
                    held = held or _Block(rows, centres)
                    for tile in range(0, some.num_rows, TILE):
                        yield from held.meet(some.slice(tile, TILE), floor, k, fields)

    return both.mapInArrow(run, kinds)


class _Block:
    """The rows of a block as one matrix, in order of list and rho."""

    def __init__(self, rows: list[pa.RecordBatch], centres: np.ndarray):
        take = lambda c: pa.chunked_array([b.column(c) for b in rows])
        size = centres.shape[1]
        self.units = np.concatenate([_matrix(b.column("v"), size) for b in rows])
        self.ids = take("id").combine_chunks()
        rho, lists = take("rho").to_numpy(), take("list").to_numpy()
        self.lists, self.starts, self.nth = np.unique(lists, return_index=True, return_inverse=True)
        self.ends = np.append(self.starts[1:], len(lists))
        self.centres, self.least, self.most = centres[self.lists], rho[self.starts], rho[self.ends - 1]
        rows.clear()

    def meet(self, asked: pa.RecordBatch, floor: float, k: int | None, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Pairs of a tile of queries with the lists that any of them may look into."""
        q, reach, names = _matrix(asked.column("v"), self.units.shape[1]), asked.column("rho").to_numpy(zero_copy_only=False)[:, None], asked.column("query_id")
        d = _distances(q, self.centres)
        open_ = (d - self.most <= reach) & (self.least - d <= reach)
        probed = asked.column("lists").null_count == 0
        if probed:
            taken = np.zeros(open_.shape, dtype=bool)
            lists = asked.column("lists")
            query, value = np.repeat(np.arange(len(q)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(self.lists, value), len(self.lists) - 1)
            here = self.lists[at] == value
            taken[query[here], at[here]] = True
            open_ &= taken
        wanted = np.flatnonzero(np.repeat(open_.any(axis=0), self.ends - self.starts))
        best, own = Best(len(q), k, fields.field("id").type) if k is not None else None, codes_of(names, names)
        for at in range(0, len(wanted), SLICE):
            to = wanted[at : at + SLICE]
            near = slice(to[0], to[-1] + 1) if to[-1] - to[0] + 1 == len(to) else to
            score = np.round(np.clip(q @ self.units[near].T, -1, 1), 6)
            fits = score >= floor
            if probed:
                fits &= open_[:, self.nth[near]]
            ids = self.ids.take(pa.array(to))
            if best is not None:
                codes = codes_of(ids, names)
                same = np.flatnonzero(codes >= 0)
                fits[:, same] &= own[:, None] != codes[None, same]
                best.add(score, fits, ids)
            else:
                row, col = np.nonzero(fits)
                if len(row):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(row)).cast(fields.field("query_id").type), ids.take(pa.array(col)), pa.array(score[row, col])], schema=fields)
        if best is not None:
            row, score, ids = best.rows()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(row)).cast(fields.field("query_id").type), ids, pa.array(score)], schema=fields)


def reach(score: Column) -> Column:
    """The distance of two vectors of length one with that cosine, and a little more."""
    return F.sqrt(F.greatest(2 - 2 * score, F.lit(0.0)) + SLACK) + SLACK


def _asked(queries: DataFrame, id_col: str, vector: str, size: int) -> DataFrame:
    return usable(queries, vector, size).select(F.col(id_col).alias("query_id"), F.col(vector).alias("q"))


def within(index: Index, queries: DataFrame, floor: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score): all rows with a cosine of ``floor`` or more to each query; exact. ``floor`` is above zero.

    There may be any number of queries. Rows and queries that are not ``usable`` have no pairs; a query meets its own row too.
    """
    if floor <= 0:
        raise ValueError("an index finds cosines above zero")
    asked = _asked(queries, id_col, vector, index.centres.shape[1]).withColumn("reach", reach(F.lit(float(floor))))
    return _met(index, asked, None, floor)


def nearest(index: Index, queries: DataFrame, k: int, floor: float, probes: int | None = None, id_col: str = "vec_id", vector: str = "embedding", start: int = 4) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best rows under another id with a cosine of ``floor`` or more, ties by id.

    Exact without ``probes``: the ``start`` nearest lists give a k-th score, which bounds where better rows can be. With
    ``probes`` only so many lists are looked into (``calibrate`` says how many it takes).
    """
    if floor <= 0:
        raise ValueError("an index finds cosines above zero")
    asked = materialize(_asked(queries, id_col, vector, index.centres.shape[1]).withColumn("reach", reach(F.lit(float(floor)))), "index-queries")
    first = _ranked(_met(index, asked, probes or start, floor, k), k)
    if probes is not None:
        return first
    known = first.groupBy("query_id").agg(F.max("rank").alias("n"), F.min("score").alias("s")).filter(F.col("n") == k).select("query_id", reach(F.col("s")).alias("closer"))
    asked = asked.join(materialize(known, "index-radius"), "query_id", "left").select("query_id", "q", F.least("reach", "closer").alias("reach"))
    return _ranked(_met(index, asked, None, floor, k), k)


def _ranked(met: DataFrame, k: int) -> DataFrame:
    good = met.filter(F.col("query_id") != F.col("id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return good.withColumn("rank", rank).filter(F.col("rank") <= k)


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """The share of ``wanted`` (query_id, id) that is in ``found``; 1 if nothing is wanted."""
    n = wanted.count()
    return wanted.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count() / n if n else 1.0


def calibrate(index: Index, queries: DataFrame, k: int, floor: float, target: float = 0.95, asked: int = 200, id_col: str = "vec_id", vector: str = "embedding") -> int:
    """The least power of two of probes with which at least ``target`` of the exact results of ``asked`` queries are found.

    The queries are those with the least hashes of their ids; the bound is on what is measured, not on what is searched.
    """
    some = materialize(queries.orderBy(F.xxhash64(id_col), id_col).limit(asked), "index-asked")
    wanted = materialize(nearest(index, some, k, floor, id_col=id_col, vector=vector), "index-wanted")
    probes = 1
    while probes < len(index.centres) and recall(nearest(index, some, k, floor, probes, id_col, vector), wanted) < target:
        probes *= 2
    return min(probes, len(index.centres))
