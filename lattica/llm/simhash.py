"""SimHash near-duplicates found with pivot distance tables.

A document's fingerprint has 64 bits from its 3-word shingles. Two fingerprints link at a Hamming distance of 2 or less. The search precomputes each fingerprint's distances to many reference fingerprints (pivots); by the triangle
inequality two linked fingerprints differ by at most 2 in every such coordinate. The pivots are the zero word, the
masks of 32 two-bit blocks and 16 pseudo-random words. A flipped bit moves a mask coordinate (taken relative to the zero
pivot) of its own block only, so over five groups of blocks two linked fingerprints keep every coordinate of at least three
groups: the ten triples of groups give ten equi-join keys made of coordinates, and no pair is missed. Pairs that meet are
discarded by the largest coordinate difference over the random pivots and the survivors are verified bit by bit.

A cell with more than ``dense`` fingerprints is not paired. Its members go to one exact linear step: fingerprints are within
distance 2 exactly if they share a word at distance 1 or less, so each member sends its 65 such words and ties itself to the
least member of each. No group is ever expanded into all pairs and nothing is dropped.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map
from lattica.operators.components import connected_components
from lattica.session import materialize

BITS = np.array([[(b >> i) & 1 for i in range(8)] for b in range(256)], dtype=np.int64)
MASKS = [3 << (2 * i) for i in range(32)]
RANDOM = [xxhash.xxh64_intdigest(f"pivot {i}".encode(), seed=42) for i in range(16)]
GROUPS = [range(32)[g::5] for g in range(5)]
TABLES = [sorted(b for g in chosen for b in GROUPS[g]) for chosen in combinations(range(5), 3)]
RADIUS = 2
DENSE = 32


def fingerprint(text: str | None) -> int:
    """64 bits: each is 1 if set in over half of the XXH64 values (seed 42) of the shingles; no words give 0."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(words, words[1:], words[2:]))) if len(words) > 2 else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=len(shingles))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for every row; null and empty texts have fingerprint zero."""

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return {id_col: batch.column(0), "fp": fps.view(np.int64)}

    return arrow_map(docs.select(F.col(id_col).cast("long"), text_col), run, f"{id_col} long, fp long", text=1)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, far: distances to the random pivots, keys: ten cell keys from the mask pivots' coordinates)."""

    def run(batch: pa.RecordBatch) -> dict:
        fp = np.asarray(batch.column(0)).view(np.uint64)
        zero = _popcount(fp)
        near = np.stack([(zero + 2 - _popcount(fp ^ np.uint64(m))) // 2 for m in MASKS], axis=1)
        far = np.stack([_popcount(fp ^ np.uint64(p)) for p in RANDOM], axis=1).astype(np.int8)
        keys = np.stack([(near[:, t] @ (3 ** np.arange(len(t)))) * 10 + k for k, t in enumerate(TABLES)], axis=1)
        return {"fp": batch.column(0), "far": list(far), "keys": list(keys)}

    return arrow_map(fps.select("fp"), run, "fp long, far array<tinyint>, keys array<long>")


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b) between distinct fingerprints, enough for the classes of all links at distance 2 or less.

    Every linked pair that meets in a cell of at most ``dense`` members is there itself; pairs of dense cells are there
    through a chain of links (see the module's text).
    """
    table = materialize(pivot_table(fps.select("fp").distinct()), "pivots")
    cells = table.select("fp", "far", F.explode("keys").alias("cell"))
    counts = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(cells.join(counts, "cell"), "cells")
    few = shared.filter(F.col("n") <= dense)
    near = F.forall(F.zip_with("far", "far_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), lambda d: d <= RADIUS)
    pairs = (
        few.select("cell", F.col("fp").alias("a"), "far")
        .join(few.select("cell", F.col("fp").alias("b"), F.col("far").alias("far_b")), "cell")
        .filter((F.col("a") < F.col("b")) & near)
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
        .select("a", "b").distinct()
    )
    hot = shared.filter(F.col("n") > dense).select("fp").distinct()
    words = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    ball = hot.select("fp", F.explode(words).alias("word"))
    least = ball.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("word", "b")
    stars = ball.join(least, "word").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, dense: int = DENSE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links, the row's own included.

    Null or empty texts have fingerprint zero and link like any other; repeated rows each get a row; an empty table gives
    an empty result; other columns are ignored. Rows with a null id get the component of their fingerprint.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    first = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    edges = links(first, dense)
    ends = (
        edges.join(first.select(F.col("fp").alias("a"), F.col("first").alias("src")), "a")
        .join(first.select(F.col("fp").alias("b"), F.col("first").alias("dst")), "b")
    )
    parts = connected_components(ends)
    named = first.join(parts, F.col("first") == F.col("node"), "left").select("fp", F.coalesce("component", "first").alias("component"))
    return prints.join(named, "fp").select(id_col, "fp", "component")
