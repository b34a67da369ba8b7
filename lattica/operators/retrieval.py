"""Vectors and retrieval: searches, centroids, memberships, reranking and budgets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lattica.functions.columns import cosine, dot, norm
from lattica.operators import vector_index
from lattica.operators.ranking import running
from lattica.session import materialize

#: A stated set of queries or centroids is held by every task only up to so many rows; beyond, an index is searched.
QUERY_ROWS = 20_000
#: Rows and queries that meet as two matrices at once, and rows that are worth a task of their own.
TILE, TASK_ROWS = 1_024, 4_096
#: Results that are broadcast at most.
FOUND_ROWS = 1_000_000


def _held(side: DataFrame) -> DataFrame:
    """``side`` for a nested-loop join with all rows: a stated query set, checked to be small."""
    if side.limit(QUERY_ROWS + 1).count() > QUERY_ROWS:
        raise ValueError(f"more than {QUERY_ROWS} queries at once: search them in blocks")
    return F.broadcast(side)


def _many(side: DataFrame, floor: float) -> bool:
    """Whether ``side`` is too large to be held; an index serves then, if the floor is above zero."""
    return floor > 0 and side.limit(QUERY_ROWS + 1).count() > QUERY_ROWS


def search(vectors: DataFrame, queries: DataFrame, k: int, floor: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): for each of a set of queries the ``k`` best other rows at ``floor`` or more.

    The queries go to the vectors (``best_scored``). More than QUERY_ROWS queries are searched in an index, with the same result.
    """
    if _many(queries, floor):
        return vector_index.nearest(vector_index.build(vectors, id_col, vector), queries, k, floor, id_col=id_col, vector=vector)
    scored = best_scored(vectors, queries, k, floor, True, id_col, vector)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly to as many tasks as they are worth, four a core at most: a file may be one task however much work its rows are."""
    return rows.repartition(max(1, min(math.ceil(rows.count() / TASK_ROWS), 4 * rows.sparkSession.sparkContext.defaultParallelism)))


def candidates(vectors: DataFrame, queries: DataFrame, cap: int = 40, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, semantic): each query's ``cap`` best rows by cosine, ties by id; its own row counts as any other."""
    scored = best_scored(vectors, queries, cap, None, False, id_col, vector)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= cap).select("query_id", "id", F.col("score").alias("semantic"))


def best_scored(vectors: DataFrame, queries: DataFrame, k: int, floor: float | None, others: bool, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score): cosines at six digits, at ``floor`` or more; of each task's rows a query's ``k`` best, ties by id.

    The queries are a stated set (QUERY_ROWS). They are sent to every task once and meet its rows as matrices, TILE by TILE;
    a task keeps k rows a query. ``others`` leaves out rows under the query's own id and null ids. As in ``cosine``, an empty
    or zero vector, one with a null part or one of another length scores 0; a score that is not a number is above all others.
    """
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector).alias("q"))
    if asked.limit(QUERY_ROWS + 1).count() > QUERY_ROWS:
        raise ValueError(f"more than {QUERY_ROWS} queries at once: search them in blocks")
    rows = spread(vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v")))
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    out, held = to_arrow_schema(_parse_datatype_string(kinds)), asked.toArrow().combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held.column("query_id").combine_chunks()
        own = vector_index.codes_of(names, names)
        tiles = [(at, own[at : at + TILE], _parts(held.column("q").slice(at, TILE))) for at in range(0, held.num_rows, TILE)]
        best = [vector_index.Best(len(codes), k, out.field("id").type) for _, codes, _ in tiles]
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                ids, mine = batch.column("id").slice(at, TILE), _parts(batch.column("v").slice(at, TILE))
                codes = vector_index.codes_of(ids, names)
                for b, (_, asked_codes, theirs) in zip(best, tiles, strict=True):
                    score = _scores(theirs, mine)
                    fits = np.ones(score.shape, dtype=bool) if floor is None else (score >= floor) | np.isnan(score)
                    if others:
                        fits &= (asked_codes[:, None] != codes[None, :]) & (codes >= -1)[None, :] & (asked_codes >= 0)[:, None]
                    b.add(score, fits, ids)
        for b, (at, _, _) in zip(best, tiles, strict=True):
            row, score, ids = b.rows()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(row + at)).cast(out.field("query_id").type), ids, pa.array(score)], schema=out)

    return rows.mapInArrow(run, kinds)


def _parts(column: pa.ChunkedArray | pa.Array) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, places, vectors, norms) of the vectors of each length; those that are null, empty or have a null part are in none."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = whole.flatten(), np.cumsum(sizes)
    bad = np.searchsorted(ends, np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)), side="right")
    sizes_ok = sizes.copy()
    sizes_ok[bad] = 0
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    found = []
    for size in np.unique(sizes_ok[sizes_ok > 0]):
        at = np.flatnonzero(sizes_ok == size)
        units = values if len(at) == len(sizes) else values[((ends[at] - size)[:, None] + np.arange(size)[None, :]).ravel()]
        units = units.reshape(-1, size)
        with np.errstate(all="ignore"):
            found.append((int(size), at, units, np.sqrt((units * units).sum(axis=1))))
    return found + [(0, np.arange(len(sizes)), np.zeros((0, 0)), np.zeros(0))]


def _scores(asked: list, rows: list) -> np.ndarray:
    """The cosines of all queries (down) with all rows (across), at six digits."""
    out, by_size = np.zeros((len(asked[-1][1]), len(rows[-1][1]))), {size: part for size, *part in rows[:-1]}
    with np.errstate(all="ignore"):
        for size, at, units, norms in asked[:-1]:
            if size in by_size:
                to, theirs, lengths = by_size[size]
                product = norms[:, None] * lengths[None, :]
                score = np.round(np.where(product == 0, 0.0, (units @ theirs.T) / product), 6) + 0.0  # + 0.0: no -0.0
                out[np.ix_(at, to)] = score
    return out


def dominant_size(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(size, n) of the commonest vector length, the least at a tie."""
    return vectors.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1)


def centroids(vectors: DataFrame, group: str, dim: int, vector: str = "embedding") -> DataFrame:
    """(group, centroid, n): means of the members brought to length one."""
    sums = F.array(*(F.avg(F.get(F.col(vector), F.lit(i)).cast("double")) for i in range(dim)))
    means = vectors.groupBy(group).agg(sums.alias("m"), F.count("*").alias("n"))
    return means.select(group, F.transform("m", lambda x: x / F.when(norm(F.col("m")) > 0, norm(F.col("m"))).otherwise(1.0)).alias("centroid"), "n")


def coherence(vectors: DataFrame, group: str, dim: int, vector: str = "embedding") -> DataFrame:
    """(group, n, coherence): mean pairwise cosine in closed form, (|sum of unit vectors|^2 - n) / (n (n - 1)); n = 1 gives 1."""
    unit = vectors.select(group, F.transform(vector, lambda x: x.cast("double") / norm(F.col(vector))).alias("u"))
    sums = unit.groupBy(group).agg(F.array(*(F.sum(F.get("u", F.lit(i))) for i in range(dim))).alias("s"), F.count("*").alias("n"))
    square = F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)
    return sums.select(group, "n", F.when(F.col("n") > 1, F.round((square - F.col("n")) / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1)), 6)).otherwise(1.0).alias("coherence"))


def memberships(vectors: DataFrame, centres: DataFrame, floor: float, id_col: str = "vec_id", vector: str = "embedding", home: str = "label") -> DataFrame:
    """(id, region, weight): weight 1 for the home region, the cosine for every other centre at ``floor`` or more.

    More than QUERY_ROWS centres are found through an index of them.
    """
    if _many(centres, floor):
        size = vectors.agg(F.max(F.size(vector))).first()[0]
        near = vector_index.within(vector_index.build(centres, home, "centroid", size), vectors, floor, id_col, vector)
        own = vectors.select(F.col(id_col).alias("query_id"), F.col(home).alias("own"))
        others = near.join(own, "query_id").filter(~F.col("id").eqNullSafe(F.col("own"))).select(F.col("query_id").alias("id"), F.col("id").alias("region"), F.col("score").alias("weight"))
        at_home = own.join(centres.select(F.col(home).alias("own")), "own").select(F.col("query_id").alias("id"), F.col("own").alias("region"), F.lit(1.0).alias("weight"))
        return others.unionByName(at_home)
    c = _held(centres.select(F.col(home).alias("region"), "centroid"))
    near = F.round(cosine(F.col(vector), F.col("centroid")), 6)
    joined = vectors.crossJoin(c).select(F.col(id_col).alias("id"), "region", F.when(F.col("region") == F.col(home), 1.0).otherwise(near).alias("weight"))
    return joined.filter(F.col("weight") >= floor)


def best_centre(vectors: DataFrame, centres: DataFrame, floor: float, id_col: str = "vec_id", vector: str = "embedding", name: str = "label") -> DataFrame:
    """(id, region, score): each vector's best centre above ``floor``, else region null (unassigned)."""
    c = _held(centres.select(F.col(name).alias("region"), "centroid"))
    scored = vectors.crossJoin(c).select(F.col(id_col).alias("id"), "region", F.round(cosine(F.col(vector), F.col("centroid")), 6).alias("score"))
    best = scored.groupBy("id").agg(F.max_by(F.struct("region", "score"), F.struct("score", (-F.col("region")).alias("t"))).alias("b"))
    return best.select("id", F.when(F.col("b.score") > floor, F.col("b.region")).alias("region"), F.col("b.score").alias("score"))


def centre_pairs(centres: DataFrame, floor: float, top: int, name: str = "label") -> DataFrame:
    """(a, b, score): pairs of centres at ``floor`` or more, the ``top`` best: candidates for a merge.

    The centroids have length one. More than QUERY_ROWS of them are joined through an index.
    """
    if _many(centres, floor):
        met = vector_index.within(vector_index.build(centres, name, "centroid"), centres, floor, name, "centroid").filter("query_id < id")
        return met.select(F.col("query_id").alias("a"), F.col("id").alias("b"), "score").orderBy(F.desc("score"), "a", "b").limit(top)
    l, r = centres.select(F.col(name).alias("a"), F.col("centroid").alias("x")), _held(centres.select(F.col(name).alias("b"), F.col("centroid").alias("y")))
    return l.join(r, F.col("a") < F.col("b")).select("a", "b", F.round(dot(F.col("x"), F.col("y")), 6).alias("score")).filter(F.col("score") >= floor).orderBy(F.desc("score"), "a", "b").limit(top)


def rerank(candidates: DataFrame, personal: bool, cap: int = 40, keep: int = 15, floor: float = 0.08, least: int = 3) -> DataFrame:
    """(query_id, id, score, rank): 0.55 semantic + 0.15 recency + 0.10 centrality over its maximum + 0.20 affinity.

    Without affinity the first three are divided by 0.80. Of a query's ``cap`` best by semantics the ``keep`` best stay,
    those below ``floor`` only among the first ``least``.
    """
    by_meaning = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("semantic"), "id"))
    capped = candidates.withColumn("m", by_meaning).filter(F.col("m") <= cap)
    top = F.max("centrality").over(Window.partitionBy("query_id"))
    base = 0.55 * F.col("semantic") + 0.15 * F.col("recency") + 0.10 * F.when(top > 0, F.col("centrality") / F.when(top > 0, top)).otherwise(0.0)
    scored = capped.withColumn("score", F.round(base + 0.20 * F.col("affinity") if personal else base / 0.80, 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ranked = scored.withColumn("rank", rank)
    return ranked.filter((F.col("rank") <= keep) & ((F.col("rank") <= least) | (F.col("score") >= floor))).select("query_id", "id", "score", "rank")


def within_budget(items: DataFrame, group: str, order: list[Column], text: str, per_item: str, each: int, budget: int) -> DataFrame:
    """Rows of a group as far as a running character budget goes: ``each`` rows an item, the row on the border cut short."""
    nth = F.row_number().over(Window.partitionBy(group, per_item).orderBy(*order))
    kept = items.withColumn("nth", nth).filter(F.col("nth") <= each)
    before = F.coalesce(F.sum(F.char_length(text)).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = kept.withColumn("before", before).filter(F.col("before") < budget)
    return kept.withColumn(text, F.substr(F.col(text), F.lit(1), (budget - F.col("before")).cast("int"))).drop("nth", "before")


def mean_ranks(counts: DataFrame, value: str) -> DataFrame:
    """``counts`` (value, n, ...) with rank: the mean rank of each value's rows, by range partitions."""
    return running(counts, [F.col(value)], {"__to": "n"}).withColumn("rank", F.col("__to") - F.col("n") + (F.col("n") + 1) / 2).drop("__to")


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve of (score, positive): the rank sum, ties at their mean rank; one row.

    Scores are counted by value first, and ranks run over the distinct scores in range partitions' order.
    """
    counts = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum(F.col("positive").cast("long")).alias("p"))
    s = mean_ranks(counts, "score").agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return s.select(F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")), 6).alias("auc"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """(threshold, accuracy): the least cut with the best accuracy of score >= cut; one row."""
    counts = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum(F.col("positive").cast("long")).alias("p")).withColumn("q", F.col("n") - F.col("p"))
    at = running(counts, [(F.col("score"), "desc")], {"tp": "p", "fp": "q"})
    total = scored.agg(F.count("*").alias("all"), F.sum(F.col("positive").cast("long")).alias("pos"))
    right = (F.col("tp") + F.col("all") - F.col("pos") - F.col("fp")) / F.col("all")
    return at.crossJoin(F.broadcast(total)).select(F.col("score").alias("threshold"), F.round(right, 6).alias("accuracy")).orderBy(F.desc("accuracy"), "threshold").limit(1)  # one row


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns with mean ranks at ties; one row. Ranks come from counts by value."""
    def ranked(c: str) -> DataFrame:
        return mean_ranks(rows.groupBy(c).agg(F.count("*").alias("n")), c).select(c, F.col("rank").alias(f"r_{c}"))

    return rows.join(ranked(x), x).join(ranked(y), y).agg(F.round(F.corr(f"r_{x}", f"r_{y}"), 6).alias("rho"))


def hit_rate(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(questions, hits, rate, mean_first_rank) of ranked results (query_id, id, rank) against (query_id, id) wanted; one row.

    A question is hit if any wanted id is among its results; its first rank is the best of those.
    """
    found = materialize(found.select("query_id", "id", "rank"), "found")
    if found.count() <= FOUND_ROWS:
        found = F.broadcast(found)  # a few rows a question; what is wanted may be many times the questions
    asked = wanted.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.min("rank").alias("first"))
    return asked.agg(F.count("*").alias("questions"), F.count("first").alias("hits"), F.round(F.count("first") / F.count("*"), 6).alias("rate"), F.round(F.avg("first"), 6).alias("mean_first_rank"))


def blend(context: Column, raw: Column, share: float = 0.7) -> Column:
    """``share`` of the context vector and the rest of the raw one; either alone if the other is missing."""
    return F.coalesce(F.zip_with(context, raw, lambda x, y: share * x + (1 - share) * y), context, raw)
