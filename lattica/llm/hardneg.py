"""Hard negatives: exact inner products of quantised vectors, with an orthogonal rotation that discards most pairs early.

The rows' second moments give an orthogonal basis, ordered by how much of the vectors' length falls into it. In that basis a
score is a sum over components: after the leading ones the rest is at most the product of the two remaining norms, so partial
products plus this bound plus a slack for rounding tell which pairs cannot matter. They are dropped stage by stage; what is
left is computed again from the integers, so the basis decides nothing but speed.

Rows and anchors are packed into blocks of bounded size and every block of rows meets every block of anchors: anchors are the
stated query set. A task keeps the best rows of each anchor that it has seen, so that what is shuffled does not grow with the
pairs. Rows with equal vectors and labels are one class: only its smallest ids can be among the first of any list.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import small
from lattica.session import materialize

POSITIVES = 5
NEGATIVES = 3
#: Rows and anchors of a block at most, the bytes of its vectors at most, rows of a
#: block that are compared at once, and bytes of pairs whose integers are multiplied at once.
ROWS, ANCHORS = 8_192, 1_024
BLOCK_BYTES = 8 << 20
TILE = 512
PAIR_BYTES = 8 << 20
#: Shares of the components after which pairs are looked at and discarded.
STAGES = (0.25, 0.5, 0.75)
LOWEST = np.iinfo(np.int64).min


def quantised(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, q): floor(256 x) of every component, without rows that have a null or non-finite part; equal rows once."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(vector, lambda x: F.floor(256 * x.cast("double")).cast("long"))
    kept = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(finite)
    return kept.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled.alias("q")).distinct()


@contextlib.contextmanager
def few_rows(spark, n: int = 4):
    """Rows are blocks in here, so an Arrow batch has few of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def basis(rows: DataFrame, size: int) -> np.ndarray:
    """Orthogonal directions as columns, the one with the largest second moment first.

    The moments are size * size sums over all rows: each task adds up its own, Spark adds the tasks'.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            q = matrix(batch.column("q"), size).astype(np.float64)
            total += q.T @ q
        yield pa.RecordBatch.from_pydict({"sums": [total.ravel()]}, schema=pa.schema([("sums", pa.list_(pa.float64()))]))

    parts = rows.select("q").mapInArrow(moments, "sums array<double>")
    sums = parts.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(size * size)
    for at, x in sums:
        total[at] = x
    total = total.reshape(size, size)
    scale = max(np.abs(total).max(initial=0.0), 1.0)
    return np.linalg.eigh(total / scale)[1][:, ::-1].copy()


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists as the rows of an int64 matrix, short ones filled with zeros."""
    lengths = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), size), dtype=np.int64)
    out[np.arange(size) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def blocks(rows: DataFrame, size: int, most: int, prefix: str) -> DataFrame:
    """Rows packed into blocks: one row a block, the columns as raw bytes (id, known, label, q and, if there, scores)."""
    most = max(1, min(most, BLOCK_BYTES // (8 * max(size, 1))))
    more = ["scores"] if "scores" in rows.columns else []
    fields = pa.schema([(f"{prefix}no", pa.string())] + [(f"{prefix}{c}", pa.binary()) for c in ["id", "known", "label", "q", *more]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        held: list[pa.RecordBatch] = []

        def flush(whole: pa.Table) -> pa.RecordBatch:
            batch = whole.combine_chunks().to_batches()[0]
            ids = batch.column("id")
            cols = {"no": uuid.uuid4().hex, "id": ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(), "known": ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), "label": batch.column("label").to_numpy(zero_copy_only=False).tobytes(), "q": matrix(batch.column("q"), size).tobytes()}
            if more:
                cols["scores"] = matrix(batch.column("scores"), POSITIVES + 1).tobytes()
            return pa.RecordBatch.from_pylist([{f"{prefix}{k}": v for k, v in cols.items()}], schema=fields)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= most:
                whole = pa.Table.from_batches(held)
                yield flush(whole.slice(0, most))
                held = whole.slice(most).to_batches()
        if sum(b.num_rows for b in held):
            yield flush(pa.Table.from_batches(held))

    return rows.mapInArrow(pack, f"{prefix}no string, " + ", ".join(f"{f.name} binary" for f in list(fields)[1:]))


class Block:
    """A block's rows with their rotated components and the norms that are left after each stage."""

    def __init__(self, row: dict, prefix: str, size: int, directions: np.ndarray):
        get = lambda c, kind: np.frombuffer(row[f"{prefix}{c}"], dtype=kind)
        self.id, self.known, self.label = get("id", np.int64), get("known", bool), get("label", np.int64)
        self.q = get("q", np.int64).reshape(-1, size)
        self.y = self.q @ directions
        self.ends = sorted({max(1, round(size * s)) for s in STAGES}) if size else []
        square = self.y**2
        self.rest = [np.sqrt(square[:, e:].sum(axis=1)) for e in self.ends]
        self.norm = np.sqrt(square.sum(axis=1))
        if f"{prefix}scores" in row:
            n = len(self.id)
            scores = get("scores", np.int64).reshape(n, -1)
            self.low = np.array([[min(max(-(-s // 2), LOWEST), -LOWEST - 1) for s in r] for r in scores.tolist()], dtype=np.int64).reshape(n, -1)
            self.high = np.array([[min(max(95 * s // 100, LOWEST), -LOWEST - 1) for s in r] for r in scores.tolist()], dtype=np.int64).reshape(n, -1)


def scores(a: Block, r: Block, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores of pairs of rows, and which have equal vectors; some pairs at a time, as their vectors are copied."""
    step = max(1, PAIR_BYTES // (8 * max(a.q.shape[1], 1)))
    score, equal = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
    for k in range(0, len(rows), step):
        x, y = a.q[rows[k : k + step]], r.q[cols[k : k + step]]
        score[k : k + step], equal[k : k + step] = products(x, y), (x == y).all(axis=1)
    return score, equal


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices; what a long cannot hold ends at its limits."""
    most = (int(np.abs(a.astype(np.float64)).max(initial=0)) + 1) * (int(np.abs(b.astype(np.float64)).max(initial=0)) + 1) * max(a.shape[1], 1)
    if most < 1 << 62:
        return np.einsum("ij,ij->i", a, b)
    whole = [sum(x * y for x, y in zip(r, s)) for r, s in zip(a.tolist(), b.tolist())]
    return np.array([min(max(w, LOWEST), -LOWEST - 1) for w in whole], dtype=np.int64)


class Best:
    """The first k rows of each slot (an anchor, or an anchor and a band): highest score, then smallest id, null ids last."""

    def __init__(self, slots: int, k: int):
        self.k, self.least = k, np.full(slots, -np.inf)
        self.rows: dict[str, np.ndarray] = {c: np.zeros(0, t) for c, t in (("slot", np.int64), ("score", np.int64), ("id", np.int64), ("known", bool), ("own", bool))}

    def add(self, **new: np.ndarray) -> None:
        if not len(new["slot"]):
            return
        all_ = {c: np.concatenate([self.rows[c], new[c]]) for c in self.rows}
        order = np.lexsort((all_["id"], ~all_["known"], -(all_["score"].astype(np.float64)), all_["slot"]))
        # floats order all but the largest scores; those that differ beyond are put right below
        order = order if np.abs(all_["score"].astype(np.float64)).max() < 2**53 else np.array(sorted(range(len(order)), key=lambda i: (all_["slot"][i], -int(all_["score"][i]), not all_["known"][i], all_["id"][i])))
        slot = all_["slot"][order]
        first = np.searchsorted(slot, slot)
        keep = order[np.arange(len(slot)) - first < self.k]
        self.rows = {c: v[keep] for c, v in all_.items()}
        slots, counts = np.unique(self.rows["slot"], return_counts=True)
        full = np.isin(self.rows["slot"], slots[counts == self.k])
        np.minimum.at(least := np.full(len(self.least), np.inf), self.rows["slot"][full], self.rows["score"][full].astype(np.float64))
        self.least = np.where(np.isinf(least), -np.inf, least)


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """Of each row; -inf where it has fewer columns."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return -np.partition(-values, k - 1, axis=1)[:, k - 1]


def survivors(a: Block, r: Block, tile: slice, wanted: np.ndarray, floor: np.ndarray, k: int, low: np.ndarray | None = None, high: np.ndarray | None = None, limit: np.ndarray | None = None):
    """Pairs (anchor, row of the block) of a tile that can be among the k best wanted ones of their anchor.

    ``floor``: scores below cannot matter. With bands, rows must be able to lie in [low, high], and ``limit`` is the least upper
    end: the k-th best lower bound among rows certainly below it is a floor for every band.
    """
    columns = np.arange(tile.start, tile.stop)
    alive = wanted
    partial = np.zeros(alive.shape)
    slack = 64 * (a.q.shape[1] + 1) * np.finfo(np.float64).eps * a.norm[:, None] * r.norm[None, columns] + 1e-9
    begun = 0
    for stage, end in enumerate(a.ends):
        partial += a.y[:, begun:end] @ r.y[columns, begun:end].T
        begun = end
        bound = a.rest[stage][:, None] * r.rest[stage][None, columns] + slack
        sure = alive if limit is None else alive & (partial + bound <= limit[:, None])
        floor = np.maximum(floor, kth_largest(np.where(sure, partial - bound, -np.inf), k))
        alive = alive & (partial + bound >= floor[:, None])
        if low is not None:
            alive &= (partial + bound >= low[:, None]) & (partial - bound <= high[:, None])
        stay = alive.any(axis=0)
        if not stay.all():
            columns, alive, partial, slack = columns[stay], alive[:, stay], partial[:, stay], slack[:, stay]
        if not len(columns):
            break
    rows, cols = np.nonzero(alive)
    return rows, columns[cols]


def scan(pairs: DataFrame, size: int, directions: np.ndarray, bands: bool) -> DataFrame:
    """(cls, slot, score, id, known, own) from pairs of blocks: each task's best rows of every anchor class.

    Without bands the POSITIVES + 1 best of the same label (an anchor may be among them), else for each positive's score the
    NEGATIVES best of another label in its band.
    """
    k = NEGATIVES if bands else POSITIVES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: dict[str, tuple[Block, Best]] = {}
        last: tuple[str, Block | None] = ("", None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["a_no"] not in anchors:
                    a = Block(row, "a_", size, directions)
                    anchors[row["a_no"]] = a, Best(len(a.id) * (a.low.shape[1] if bands else 1), k)
                if last[0] != row["r_no"]:
                    last = row["r_no"], Block(row, "r_", size, directions)
                compare(*anchors[row["a_no"]], last[1])
        for a, best in anchors.values():
            width = a.low.shape[1] if bands else 1
            yield pa.RecordBatch.from_pydict({"cls": a.id[best.rows["slot"] // width], "slot": best.rows["slot"] % width, **{c: best.rows[c] for c in ("score", "id", "known", "own")}}, schema=fields)

    def compare(a: Block, best: Best, r: Block) -> None:
        for at in range(0, len(r.id), TILE):
            tile = slice(at, min(at + TILE, len(r.id)))
            same = a.label[:, None] == r.label[None, tile]
            if not bands:
                rows, cols = survivors(a, r, tile, same, best.least, k)
                score, equal = scores(a, r, rows, cols)
                fits = score >= best.least[rows]
                rows, cols, score, equal = rows[fits], cols[fits], score[fits], equal[fits]
                best.add(slot=rows, score=score, id=r.id[cols], known=r.known[cols], own=equal)
                continue
            width = a.low.shape[1]
            real = a.low <= a.high
            high = np.where(real, a.high, LOWEST).max(axis=1).astype(np.float64)
            limit = np.where(real, a.high, -LOWEST - 1).min(axis=1).astype(np.float64)
            low = np.where(real, a.low, -LOWEST - 1).min(axis=1).astype(np.float64)
            floor = np.where(real, best.least.reshape(-1, width), np.inf).min(axis=1)
            rows, cols = survivors(a, r, tile, ~same & real.any(axis=1)[:, None], np.where(np.isinf(floor), -np.inf, floor), k, low, high, limit)
            score, _ = scores(a, r, rows, cols)
            for slot in range(width):
                fits = (score >= a.low[rows, slot]) & (score <= a.high[rows, slot]) & (score >= best.least[rows * width + slot])
                i, j = rows[fits], cols[fits]
                best.add(slot=i * width + slot, score=score[fits], id=r.id[j], known=r.known[j], own=np.zeros(len(i), bool))

    fields = pa.schema([("cls", pa.int64()), ("slot", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("known", pa.bool_()), ("own", pa.bool_())])
    return pairs.mapInArrow(run, "cls long, slot long, score long, id long, known boolean, own boolean")


def first(found: DataFrame, k: int) -> DataFrame:
    """The k first rows of each (cls, slot) as an array best."""
    ranked = found.withColumn("__n", F.row_number().over(Window.partitionBy("cls", "slot").orderBy(F.desc("score"), F.desc("known"), "id"))).filter(F.col("__n") <= k)
    row = F.struct("__n", "score", F.when(F.col("known"), F.col("id")).alias("id"), "own")
    return ranked.groupBy("cls", "slot").agg(F.array_sort(F.collect_list(row)).alias("best"))


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (id, label, q) of ``quantised``.

    ``is_anchor`` is a condition on id. Positives are the first five other rows of the anchor's label, by score and then id; for
    each, the first three rows of other labels with half to 95 % of its score are returned. A null id is no anchor and comes last
    among equal scores. Two rows under one id are two rows. Vectors that are shorter than the longest are filled with zeros.
    Components and scores that no long can hold end at its limits. Rows of an anchor without positives, or of a positive without
    negatives in its band, do not appear; an empty table gives none.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "hardneg-rows")
    size = rows.agg(F.max(F.size("q"))).first()[0] or 0
    copies = Window.partitionBy("label", "q").orderBy(F.asc_nulls_last("id"))
    offered = rows.withColumn("__n", F.row_number().over(copies)).filter(F.col("__n") <= POSITIVES + 1).drop("__n")
    anchors = rows.filter(F.col("id").isNotNull() & is_anchor)
    classes = materialize(anchors.select("label", "q").distinct().withColumn("id", F.monotonically_increasing_id()), "hardneg-classes")
    directions = basis(rows, size)
    with few_rows(spark, 4):
        offered = materialize(blocks(offered, size, ROWS, "r_"), "hardneg-blocks")

        def against(queries: DataFrame, bands: bool) -> DataFrame:
            packed = materialize(blocks(queries, size, ANCHORS, "a_"), "hardneg-anchors")
            pairs = offered.crossJoin(small(packed))  # blocks against blocks of the stated queries
            return materialize(first(materialize(scan(pairs, size, directions, bands), "hardneg-found"), NEGATIVES if bands else POSITIVES + 1), "hardneg-best")

        positives = against(classes, False).select(F.col("cls").alias("id"), "best")
        wanted = classes.join(positives, "id").withColumn("scores", F.transform("best", lambda b: b["score"]))
        # bands of equal scores are one: distinct scores, padded with one whose band is empty
        padded = F.concat(F.array_distinct("scores"), F.array_repeat(F.lit(-100).cast("long"), POSITIVES + 1))
        wanted = materialize(wanted.withColumn("scores", F.slice(padded, 1, POSITIVES + 1)), "hardneg-wanted")
        negatives = against(wanted.select("id", "label", "q", "scores"), True)
    bands = negatives.groupBy("cls").agg(F.collect_list(F.struct("slot", "best")).alias("bands")).withColumnRenamed("cls", "id")
    known = wanted.join(bands, "id").select("label", "q", F.col("best").alias("__best"), "scores", "bands")
    mine = anchors.select(F.col("id").alias("anchor_id"), "label", "q").join(known, ["label", "q"])
    others = F.slice(F.filter("__best", lambda b: ~(b["own"] & F.coalesce(b["id"] == F.col("anchor_id"), F.lit(False)))), 1, POSITIVES)
    each = mine.select("anchor_id", "scores", "bands", F.explode(others).alias("p"))
    slot = F.array_position("scores", F.col("p.score")) - 1
    each = each.select("anchor_id", "p", F.explode(F.filter("bands", lambda b: b["slot"] == slot)).alias("band"))
    each = each.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode("band.best").alias("at", "n"))
    return each.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
