"""Density clusters, fuzzy label merging and one-to-one re-attachment."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.components import connected_components
from lattica.session import materialize

#: A group is clustered in one task up to so many rows; larger ones are cut first.
GROUP_ROWS = 4_000


def density_labels(x: np.ndarray, min_size: int = 5, min_samples: int = 3) -> np.ndarray:
    """HDBSCAN labels, -1 for noise: mutual reachability, minimum spanning tree, condensed tree, excess of mass."""
    n = len(x)
    if n < min_size:
        return np.full(n, -1)
    square = (x**2).sum(1)
    d = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0))
    core = np.sort(d, axis=1)[:, min(min_samples, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    best, parent, done, edges, now = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), [], 0
    for _ in range(n - 1):  # Prim
        done[now] = True
        closer = ~done & (reach[now] < best)
        best[closer], parent[closer] = reach[now][closer], now
        now = int(np.where(done, np.inf, best).argmin())
        edges.append((best[now], parent[now], now))
    root, size, kids, height = list(range(n)), [1] * n, {}, {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for w, a, b in sorted(edges):  # single linkage tree, nodes n, n + 1, ...
        a, b = find(a), find(b)
        node = len(root)
        root.append(node)
        size.append(size[a] + size[b])
        kids[node], height[node], root[a], root[b] = (a, b), w, node, node

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            k = todo.pop()
            todo.extend(kids[k]) if k in kids else out.append(k)
        return out

    # condensed tree: a cluster lives on through splits of which one side is too small
    clusters, todo = [], [(len(root) - 1, 0.0, -1)]
    while todo:
        node, birth, above = todo.pop()
        me, mass, lost, born = len(clusters), 0.0, [], []
        clusters.append([node, above, 0.0, []])
        while True:
            if node not in kids:
                break
            level = 1 / max(height[node], 1e-12)
            big = [k for k in kids[node] if size[k] >= min_size]
            if len(big) == 2:
                mass += size[node] * (level - birth)
                born = [(k, level, me) for k in big]
                break
            small = [k for k in kids[node] if size[k] < min_size]
            for k in small:
                mass += size[k] * (level - birth)
                lost += points(k)
            if not big:
                break
            node = big[0]
        clusters[me][2] = mass
        todo += born
    children = {i: [j for j, c in enumerate(clusters) if c[1] == i] for i in range(len(clusters))}
    chosen, total = [False] * len(clusters), [0.0] * len(clusters)
    for i in range(len(clusters) - 1, -1, -1):
        below = sum(total[j] for j in children[i])
        chosen[i] = i != 0 and (not children[i] or clusters[i][2] >= below)
        total[i] = max(clusters[i][2], below) if i else below
    labels, todo, k = np.full(n, -1), list(children[0]), 0
    while todo:
        i = todo.pop(0)
        if chosen[i]:
            labels[points(clusters[i][0])] = k
            k += 1
        else:
            todo += children[i]
    return labels


def bisected(vectors: DataFrame, group: str, id_col: str = "vec_id", vector: str = "embedding", limit: int = GROUP_ROWS, rounds: int = 40) -> DataFrame:
    """``vectors`` with __part: 0 for groups of at most ``limit`` rows; larger ones are cut in two again and again.

    Each cut goes through a part's mean at right angles to a drawn direction, so neighbours mostly stay together; equal
    vectors always do, until nothing but the id can tell them apart.
    """
    now = vectors.withColumn("__part", F.lit(0).cast("long"))
    for k in range(rounds):
        sizes = now.groupBy(group, "__part").agg(F.count("*").alias("__n"))
        large = sizes.filter(F.col("__n") > limit)
        if large.isEmpty():
            return now
        draw = F.transform(vector, lambda x, i: x.cast("double") * (F.pmod(F.xxhash64(F.lit(k), i), F.lit(2001)) - 1000))
        side = F.aggregate(draw, F.lit(0.0), lambda s, x: s + x)
        placed = materialize(now.join(large.select(group, "__part", F.lit(True).alias("__large")), [group, "__part"], "left").withColumn("__side", side), "bisected")
        middle = placed.filter("__large").groupBy(group, "__part").agg(F.avg("__side").alias("__middle"), (F.max("__side") == F.min("__side")).alias("__flat"))
        joined = placed.join(middle, [group, "__part"], "left")
        right = F.when(F.col("__flat"), F.pmod(F.xxhash64(F.lit(k), id_col), F.lit(2))).otherwise((F.col("__side") > F.col("__middle")).cast("long"))
        part = F.when(F.col("__large"), 2 * F.col("__part") + 1 + right).otherwise(F.col("__part"))
        now = materialize(joined.withColumn("__part", part).select(*vectors.columns, "__part"), "bisected")
    return now


def density_clusters(vectors: DataFrame, group: str, id_col: str = "vec_id", vector: str = "embedding", min_size: int = 5, min_samples: int = 3, limit: int = GROUP_ROWS) -> DataFrame:
    """(group, id, cluster): clusters inside each group, -1 for noise, numbered from zero.

    A group of over ``limit`` rows is cut into parts first (``bisected``), and each part is clustered alone: approximate
    beyond that size, as a distance table of a whole group fits no task.
    """
    parts = bisected(vectors.select(group, id_col, vector), group, id_col, vector, limit)
    kind, key_kind = vectors.schema[group].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id_col)
        labels = density_labels(np.stack(rows[vector].to_numpy()).astype(float), min_size, min_samples)
        return pd.DataFrame({group: key[0], "__part": key[1], id_col: rows[id_col], "__label": labels})

    found = parts.groupBy(group, "__part").applyInPandas(run, f"{group} {kind}, __part long, {id_col} {key_kind}, __label int")
    found = materialize(found, "density")
    named = found.filter("__label >= 0").select(group, "__part", "__label").distinct()
    number = F.row_number().over(Window.partitionBy(group).orderBy("__part", "__label")) - 1  # clusters of a group, each of min_size rows or more
    joined = found.join(named.withColumn("__number", number), [group, "__part", "__label"], "left")
    return joined.select(group, id_col, F.coalesce("__number", F.lit(-1)).alias("cluster"))


def recursive_split(vectors: DataFrame, group: str, dim: int, id_col: str = "vec_id", vector: str = "embedding", most: int = 30, tight: float = 0.75, depth: int = 4) -> DataFrame:
    """(id, node, depth): every row's leaf; a node of over ``most`` rows with a mean cosine of ``tight`` or less is split.

    One pass a depth over all nodes at once. Noise goes to a node of its own; a node that gives fewer than two clusters stays.
    """
    from lattica.operators.retrieval import coherence

    now = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col(group).cast("string").alias("node"))
    done = None
    for level in range(depth):
        now = materialize(now, "nodes")
        measured = coherence(now, "node", dim, "v")
        wide = materialize(measured.filter((F.col("n") > most) & (F.col("coherence") <= tight)).select("node"), "wide")
        leaf = now.join(wide, "node", "left_anti").select("id", "node", F.lit(level).alias("depth"))
        parts = materialize(density_clusters(now.join(wide, "node", "left_semi"), "node", "id", "v"), "parts")
        several = parts.filter("cluster >= 0").groupBy("node").agg(F.count_distinct("cluster").alias("k")).filter("k > 1").select("node")
        kept = parts.join(several, "node", "left_anti").select("id", "node", F.lit(level).alias("depth"))
        done = leaf.unionByName(kept) if done is None else done.unionByName(leaf).unionByName(kept)
        named = parts.join(several, "node", "left_semi").select("id", F.concat_ws("/", "node", F.when(F.col("cluster") < 0, "rest").otherwise(F.col("cluster").cast("string"))).alias("node"))
        if named.isEmpty():
            return done
        now = now.drop("node").join(named, "id")
    return done.unionByName(now.select("id", "node", F.lit(depth).alias("depth")))


def normal_label(label: Column) -> Column:
    """Lower case, link brackets off, punctuation and white space to one blank, a leading "the" off."""
    out = F.lower(F.regexp_replace(F.trim(label), r"^\[\[(.+?)\]\]$", "$1"))
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s-]+", " "), r"\s+", " "))
    return F.regexp_replace(out, "^the ", "")


def canonical_labels(labels: DataFrame, label: str = "label", floor: float = 0.85) -> DataFrame:
    """(label, canonical): labels alike after normalising, or with a matching ratio of ``floor`` or more, get the longest one.

    Candidates share a 3-letter piece. With a share of ``floor`` letters matched, at most 2 * (1 - floor) of them are not, and
    each of those spoils two pieces; so two forms share floor - 4 * (1 - floor) of their pieces less two, and each form is filed
    under its rarest ones only, as many as must hold a shared one. A common piece joins only forms that have hardly a rarer one.
    """
    keyed = labels.select(F.col(label).alias("label"), normal_label(F.col(label)).alias("form")).filter("form <> ''").distinct()
    forms = keyed.select("form").distinct().withColumn("id", F.xxhash64("form"))
    pieces = forms.select("id", "form", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("form") - 2)), lambda i: F.substr("form", i, F.lit(3))))).alias("piece"))
    counted = pieces.join(pieces.groupBy("piece").agg(F.count("*").alias("df")), "piece")
    by_rarity = counted.groupBy("id", "form").agg(F.array_sort(F.collect_list(F.struct("df", "piece"))).alias("p"))
    # M of the two lengths' mean match; the unmatched letters and block borders cost two pieces each
    shared = F.floor(F.char_length("form") * (floor - 4 * (1 - floor)) - 2).cast("int")
    enough = F.size("p") - F.greatest(shared, F.lit(1)) + 1
    pieces = by_rarity.select("id", "form", F.explode(F.slice("p", F.lit(1), F.greatest(enough, F.lit(1)))).alias("x")).select("id", "form", "x.piece")
    left, right = pieces.select("piece", F.col("id").alias("a"), F.col("form").alias("fa")), pieces.select("piece", F.col("id").alias("b"), F.col("form").alias("fb"))
    most = 2 * F.least(F.char_length("fa"), F.char_length("fb")) / (F.char_length("fa") + F.char_length("fb"))
    pairs = left.join(right, "piece").filter((F.col("fa") < F.col("fb")) & (most >= floor)).select("a", "b", "fa", "fb").distinct()

    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(a=a, b=b).ratio() for a, b in zip(x, y)], dtype=float)

    parts = connected_components(pairs.filter(ratio("fa", "fb") >= floor), "a", "b")
    grouped = keyed.join(forms, "form").join(parts, F.col("id") == F.col("node"), "left").withColumn("g", F.coalesce("component", "id"))
    best = grouped.groupBy("g").agg(F.max_by("label", F.struct(F.char_length("label"), "label")).alias("canonical"))
    return grouped.join(best, "g").select("label", "canonical")


def greedy_matches(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(a, b, score) of a one-to-one matching: the best pair first, then the best of what is left, and so on.

    Each round takes all pairs that are the best of both their ends; these are what the greedy order takes as well, so a
    few joins replace a sort of all pairs in one place. Ties: the least a, then the least b.
    """
    left, taken = materialize(pairs.select("a", "b", "score"), "match"), None
    for _ in range(rounds):
        order = F.struct((-F.col("score")).alias("s"), "a", "b")
        best_a = left.groupBy("a").agg(F.min(order).alias("o")).select("o.a", "o.b")
        best_b = left.groupBy("b").agg(F.min(order).alias("o")).select("o.a", "o.b")
        both = materialize(left.join(best_a, ["a", "b"], "left_semi").join(best_b, ["a", "b"], "left_semi"), "match")
        taken = both if taken is None else taken.union(both)
        left = materialize(left.join(both.select("a"), "a", "left_anti").join(both.select("b"), "b", "left_anti"), "match")
        if left.isEmpty():
            return taken
    raise RuntimeError("matching did not end")
