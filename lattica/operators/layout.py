"""The map: hex grid, warped nearest-region ownership, neighbours, diffusion, and 2-D positions of regions.

Hexes are rows; regions are few and held beside them. Only the k x k matrix of region centroids is solved in one place.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.ranking import positions
from lattica.operators.retrieval import _held
from lattica.session import materialize

#: Axial offsets of the six neighbours; how far beyond its radius a region reaches.
NEIGHBOURS = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)]
OUTER = 1.15


def hex_grid(spark: SparkSession, extent: float, apothem: float) -> DataFrame:
    """(q, r, x, z) of a pointy-top axial grid that covers [-extent, extent] both ways."""
    qs, rs = math.ceil(extent / (2 * apothem)) + 2, math.ceil(extent / (math.sqrt(3) * apothem)) + 2
    rows = spark.range(-rs, rs + 1).select(F.col("id").cast("int").alias("r")).select("r", F.explode(F.sequence(F.lit(-qs), F.lit(qs))).alias("q"))
    x, z = (2 * F.col("q") + F.col("r")) * apothem, F.col("r") * (math.sqrt(3) * apothem)
    return rows.select("q", "r", x.alias("x"), z.alias("z")).filter((F.abs("x") <= extent) & (F.abs("z") <= extent))


def warp(x: Column, z: Column, amplitude: float) -> tuple[Column, Column]:
    """Three octaves of sines, the borders' wiggle. Its numbers are fixed values."""
    s, c = F.sin, F.cos
    dx = s(0.045 * x) * c(0.038 * z) + 0.55 * s(0.11 * x + 1.0) * s(0.09 * z + 0.5) + 0.30 * c(0.18 * x) * s(0.21 * z)
    dz = c(0.052 * x + 0.7) * s(0.041 * z) + 0.55 * c(0.115 * z) * s(0.097 * x + 1.2) + 0.30 * c(0.16 * z) * s(0.20 * x)
    return x + amplitude * dx, z + amplitude * dz


def own_hexes(grid: DataFrame, regions: DataFrame, amplitude: float, reach: float | None = None, cutoff: bool = True) -> DataFrame:
    """(q, r, x, z, region): the region whose warped centre is nearest to the warped hex, null at sea.

    ``regions`` has (region, cx, cz, radius), few rows. A region claims hexes within reach x radius only, and within OUTER x
    radius of its warped centre; ties go to the least region.
    """
    wx, wz = warp(F.col("x"), F.col("z"), amplitude)
    vx, vz = warp(F.col("cx"), F.col("cz"), amplitude)
    held = _held(regions.withColumns({"vx": vx, "vz": vz}))
    pairs = grid.withColumns({"wx": wx, "wz": wz}).crossJoin(held)
    d2 = (F.col("wx") - F.col("vx")) ** 2 + (F.col("wz") - F.col("vz")) ** 2
    if reach is not None:
        d2 = F.when((F.col("x") - F.col("cx")) ** 2 + (F.col("z") - F.col("cz")) ** 2 <= (F.col("radius") * reach) ** 2, d2)
    best = pairs.withColumn("d2", d2).groupBy("q", "r", "x", "z").agg(F.min(F.when(F.col("d2").isNotNull(), F.struct("d2", "region", "radius"))).alias("b"))
    inside = F.col("b.d2") <= (F.col("b.radius") * OUTER) ** 2 if cutoff else F.lit(True)
    return best.select("q", "r", "x", "z", F.when(inside, F.col("b.region")).alias("region"))


def region_footprints(owned: DataFrame) -> DataFrame:
    """(region, hexes, cx, cz, radius): centroid of the owned hexes and the distance of the farthest."""
    mean = owned.filter("region is not null").groupBy("region").agg(F.count("*").alias("hexes"), F.avg("x").alias("cx"), F.avg("z").alias("cz"))
    far = owned.join(mean, "region").groupBy("region").agg(F.max(F.hypot(F.col("x") - F.col("cx"), F.col("z") - F.col("cz"))).alias("radius"))
    return mean.join(far, "region")


def bounds(regions: DataFrame) -> DataFrame:
    return regions.agg(
        F.min(F.col("cx") - F.col("radius")).alias("min_x"), F.max(F.col("cx") + F.col("radius")).alias("max_x"), F.min(F.col("cz") - F.col("radius")).alias("min_z"), F.max(F.col("cz") + F.col("radius")).alias("max_z")
    )


def neighbour_pairs(hexes: DataFrame) -> DataFrame:
    """(q, r, nq, nr) of hexes that touch: six shifted copies joined by equality."""
    steps = F.array(*(F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr")) for a, b in NEIGHBOURS))
    shifted = hexes.select("q", "r", F.inline(steps)).select("q", "r", (F.col("q") + F.col("dq")).alias("nq"), (F.col("r") + F.col("dr")).alias("nr"))
    return shifted.join(hexes.select(F.col("q").alias("nq"), F.col("r").alias("nr")), ["nq", "nr"]).select("q", "r", "nq", "nr")


def diffuse(heights: DataFrame, rounds: int, rate: float = 0.5) -> DataFrame:
    """(q, r, height, pinned): each round an unpinned hex moves by ``rate`` towards its neighbours' mean height."""
    pairs = materialize(neighbour_pairs(heights), "hex-neighbours")
    now = heights.select("q", "r", "height", "pinned")
    for k in range(rounds):
        mean = pairs.join(now.select(F.col("q").alias("nq"), F.col("r").alias("nr"), F.col("height").alias("h")), ["nq", "nr"]).groupBy("q", "r").agg(F.avg("h").alias("mean"))
        moved = F.when(F.col("pinned") | F.col("mean").isNull(), F.col("height")).otherwise(F.col("height") + rate * (F.col("mean") - F.col("height")))
        now = now.join(mean, ["q", "r"], "left").select("q", "r", moved.alias("height"), "pinned")
        now = materialize(now, "heights") if k % 5 == 4 or k == rounds - 1 else now
    return now


#: Regions that one map can hold.
MAP_REGIONS = 2_000


def semantic_positions(centres: DataFrame, radius: float = 120.0, name: str = "region") -> DataFrame:
    """(region, x, z): classical scaling of the centroids' cosine distances, the largest region at the origin.

    ``centres`` has (region, centroid, n): the regions of one map, at most MAP_REGIONS of them (a dense table of their
    distances is 32 MB then); a larger map is laid out level by level.
    """
    if centres.count() > MAP_REGIONS:
        raise ValueError(f"more than {MAP_REGIONS} regions on one map: lay them out level by level")
    rows = sorted(centres.select(name, "centroid", "n").collect())  # k regions
    if not rows:
        return centres.select(name, F.lit(0.0).alias("x"), F.lit(0.0).alias("z"))
    vectors = np.array([r[1] for r in rows])
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    distance = 1 - np.clip(vectors @ vectors.T, -1, 1)
    np.fill_diagonal(distance, 0)
    centring = np.eye(len(rows)) - 1 / len(rows)
    values, basis = np.linalg.eigh(-0.5 * centring @ distance**2 @ centring)
    top = [i for i in np.argsort(values)[::-1] if values[i] > 1e-10][:2]
    points = np.zeros((len(rows), 2))
    points[:, : len(top)] = basis[:, top] * np.sqrt(values[top])
    points -= points[max(range(len(rows)), key=lambda i: (rows[i][2], rows[i][0]))]
    for axis in range(2):  # a fixed sign: the farthest point of an axis lies on its positive side
        if points[np.abs(points[:, axis]).argmax(), axis] < 0:
            points[:, axis] *= -1
    points *= radius / max(np.hypot(*points.T).max(), 1e-12)
    return centres.sparkSession.createDataFrame([(r[0], round(float(x), 3), round(float(z), 3)) for r, (x, z) in zip(rows, points)], f"{name} {centres.schema[name].dataType.simpleString()}, x double, z double")


def _hex_id() -> Column:
    return (F.col("q") + (1 << 20)).cast("long") * (1 << 21) + F.col("r") + (1 << 20)


def patches(owned: DataFrame) -> DataFrame:
    """(q, r, region, patch, size): connected patches of hexes with one owner (null is the sea), named by their least hex."""
    from lattica.operators.components import connected_components

    keyed = owned.select("q", "r", "region", _hex_id().alias("id"))
    near = neighbour_pairs(owned).join(keyed.select("q", "r", F.col("region").alias("x"), F.col("id").alias("a")), ["q", "r"])
    near = near.join(keyed.select(F.col("q").alias("nq"), F.col("r").alias("nr"), F.col("region").alias("y"), F.col("id").alias("b")), ["nq", "nr"]).filter(F.col("x").eqNullSafe(F.col("y")))
    parts = connected_components(near, "a", "b")
    named = keyed.join(parts, F.col("id") == F.col("node"), "left").withColumn("patch", F.coalesce("component", "id"))
    sizes = named.groupBy("patch").agg(F.count("*").alias("size"))
    return named.join(sizes, "patch").select("q", "r", "region", "patch", "size")


def clean_islands(owned: DataFrame, max_exclave: int, max_lake: int) -> DataFrame:
    """(q, r, region): small patches cut off from their region's largest, and small lakes, go to their commonest neighbour.

    A lake is a patch of sea that touches no edge of the grid. Ties go to the least region; an exclave in open sea sinks.
    """
    p = materialize(patches(owned), "patches")
    main = p.filter("region is not null").groupBy("region").agg(F.max_by("patch", F.struct("size", (-F.col("patch")).alias("t"))).alias("patch")).select("patch")
    pairs = materialize(neighbour_pairs(owned), "hex-neighbours")
    edge = p.join(pairs.groupBy("q", "r").agg(F.count("*").alias("n")).filter("n = 6"), ["q", "r"], "left_anti").filter("region is null").select("patch").distinct()
    exclave = p.filter((F.col("region").isNotNull()) & (F.col("size") <= max_exclave)).join(main, "patch", "left_anti")
    lake = p.filter(F.col("region").isNull() & (F.col("size") <= max_lake)).join(edge, "patch", "left_anti")
    small = exclave.unionByName(lake).select("q", "r", "patch")
    around = small.join(pairs, ["q", "r"]).join(p.select(F.col("q").alias("nq"), F.col("r").alias("nr"), F.col("region").alias("other"), F.col("patch").alias("beside")), ["nq", "nr"]).filter("patch <> beside")
    votes = around.filter("other is not null").groupBy("patch", "other").agg(F.count("*").alias("n"))
    new = votes.groupBy("patch").agg(F.max_by("other", F.struct("n", (-F.col("other")).alias("t"))).alias("new"))
    moved = small.join(new, "patch", "left").select("q", "r", "new", F.lit(True).alias("moved"))
    return owned.join(moved, ["q", "r"], "left").select("q", "r", F.when(F.col("moved"), F.col("new")).otherwise(F.col("region")).alias("region"))


def rings(hexes: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """(q, r, claim, ring): seeds (q, r, claim) grow one ring of unclaimed neighbours a round; the least claim wins a hex.

    With the sea as seed it is the distance to the shore; with tags as seeds the tags' clusters.
    """
    pairs = materialize(neighbour_pairs(hexes), "hex-neighbours")
    done = materialize(seeds.groupBy("q", "r").agg(F.min("claim").alias("claim")).withColumn("ring", F.lit(0)), "rings")
    for k in range(1, rounds + 1):
        front = done.filter(F.col("ring") == k - 1)
        reached = pairs.join(front.select("q", "r", "claim"), ["q", "r"]).groupBy(F.col("nq").alias("q"), F.col("nr").alias("r")).agg(F.min("claim").alias("claim"))
        fresh = reached.join(done.select("q", "r"), ["q", "r"], "left_anti").withColumn("ring", F.lit(k))
        done = materialize(done.unionByName(fresh), "rings")
        if done.filter(F.col("ring") == k).isEmpty():
            break
    return done


def balanced_owners(grid: DataFrame, regions: DataFrame, amplitude: float, rounds: int = 12, rate: float = 0.35) -> DataFrame:
    """(q, r, region): a power diagram whose shares follow the regions' ``weight``; one nested-loop pass a round.

    ``regions`` has (region, cx, cz, weight). Each round a region's offset moves with the gap between its wanted and its owned
    share of hexes; the shares are k numbers. The hexes' scale sets the step.
    """
    wx, wz = warp(F.col("x"), F.col("z"), amplitude)
    vx, vz = warp(F.col("cx"), F.col("cz"), amplitude)
    placed = materialize(grid.select("q", "r", wx.alias("wx"), wz.alias("wz")), "placed")
    held = regions.select("region", vx.alias("vx"), vz.alias("vz"), (F.col("weight") / regions.agg(F.sum("weight")).first()[0]).alias("want"))
    total = placed.count()
    step = placed.agg(F.max("wx") - F.min("wx")).first()[0] or 1.0
    offsets = held.select("region", F.lit(0.0).alias("offset"))
    for _ in range(rounds):
        pairs = placed.crossJoin(_held(held.join(offsets, "region")))
        d2 = (F.col("wx") - F.col("vx")) ** 2 + (F.col("wz") - F.col("vz")) ** 2 - F.col("offset")
        owners = materialize(pairs.groupBy("q", "r").agg(F.min_by("region", F.struct(d2, "region")).alias("region")), "owners")
        share = owners.groupBy("region").agg((F.count("*") / total).alias("have"))
        gap = held.join(offsets, "region").join(share, "region", "left").select("region", (F.col("offset") + rate * step * step * (F.col("want") - F.coalesce("have", F.lit(0.0)))).alias("offset"))
        offsets = materialize(gap, "offsets")
    return owners


#: Fixed value: radians by which a hash moves a node on its ring at most.
JITTER = 0.4


def ring_positions(nodes: DataFrame, radius: float = 120.0, id_col: str = "id") -> DataFrame:
    """(id, x, z): nodes around a disc in the order of their ids, on three rings, each angle moved by a little of the id's hash."""
    count = nodes.select(id_col).distinct().count()
    placed = positions(nodes.select(id_col).distinct(), [F.col(id_col)])
    index = F.col("pos") - 1
    share = F.conv(F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 4), 16, 10).cast("double") / 65535
    angle = 2 * math.pi * index / max(count, 1) + share * JITTER
    ring = radius * (0.45 + 0.45 * ((index % 3) / 2 if count > 3 else F.lit(0.4)))
    return placed.select(id_col, F.round(F.cos(angle) * ring, 3).alias("x"), F.round(F.sin(angle) * ring, 3).alias("z"))


def rescale_centres(regions: DataFrame, radius_k: float = 1.0, fill: float = 0.5, stretch: float = 1.0) -> DataFrame:
    """``regions`` (level, x, z, tag_count, ...) with all centres scaled alike, so that the top level's spread fits a disc of its areas over ``fill``.

    Fewer than two top regions, or all in one place, stay as they are.
    """
    top = regions.filter("level = 0")
    middle = top.agg(F.avg("x").alias("mx"), F.avg("z").alias("mz"))  # one row
    spread = top.crossJoin(F.broadcast(middle)).agg(
        F.count("*").alias("n"), F.max(F.hypot(F.col("x") - F.col("mx"), F.col("z") - F.col("mz"))).alias("extent"),
        F.sum(radius_k * radius_k * F.greatest(F.col("tag_count"), F.lit(1))).alias("area"))  # one row
    scale = F.when((F.col("n") > 1) & (F.col("extent") >= 1e-6), F.sqrt(F.col("area") / fill) / F.col("extent") * stretch).otherwise(1.0)
    return regions.crossJoin(F.broadcast(spread.select(scale.alias("__scale")))).withColumn("x", F.col("x") * F.col("__scale")).withColumn("z", F.col("z") * F.col("__scale")).drop("__scale")
