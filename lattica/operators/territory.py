"""Who owns which hex of a map, level by level: nested diagrams, growth of leaves that came off badly, places for tags.

Hexes are rows (q, r, x, z, ...), regions a tree. Every step is an equi-join on a region or on neighbouring hexes; a level, a
growth round or a placing round handles all regions at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.components import connected_components
from lattica.operators.layout import NEIGHBOURS, _hex_id, neighbour_pairs, own_hexes, warp
from lattica.session import materialize

#: A child's hexes may differ from its share by this part of it, or by one.
TOLERANCE = 0.05


def _divided(cells: DataFrame, children: DataFrame, weight: str) -> DataFrame:
    """(q, r, parent, region): the child with the least distance less its weight; ties go to the least region."""
    d2 = (F.col("wx") - F.col("vx")) ** 2 + (F.col("wz") - F.col("vz")) ** 2 - F.col(weight)
    met = cells.join(children.select("parent", "region", "vx", "vz", weight), "parent")
    return met.groupBy("q", "r", "parent").agg(F.min_by("region", F.struct(d2.alias("d"), "region")).alias("region"))


def subdivide(cells: DataFrame, children: DataFrame, amplitude: float, hex_area: float, rounds: int, tolerance: float = TOLERANCE) -> DataFrame:
    """(q, r, region) for cells (q, r, x, z, parent): every parent's cells divided among its children, all parents at once.

    ``children`` has (region, parent, cx, cz, weight). With no rounds a cell goes to the child whose warped centre is nearest. Each
    round counts the cells, moves a child's additive weight by its missing or surplus hexes (by less and less once that
    overshoots) until all children of the parent have their share of ``weight``; the best division seen stays. A round writes
    one row a child.
    """
    wx, wz = warp(F.col("x"), F.col("z"), amplitude)
    vx, vz = warp(F.col("cx"), F.col("cz"), amplitude)
    placed = materialize(cells.select("q", "r", "parent", wx.alias("wx"), wz.alias("wz")), "cells")
    family = Window.partitionBy("parent")
    share = F.greatest(F.col("weight").cast("double"), F.lit(1.0))
    have = placed.groupBy("parent").agg(F.count("*").alias("cells"))
    state = children.join(have, "parent").select("region", "parent", vx.alias("vx"), vz.alias("vz"), (share / F.sum(share).over(family) * F.col("cells")).alias("target"))
    nothing = F.lit(0.0)
    state = materialize(state.select("*", nothing.alias("w"), nothing.alias("best"), F.lit(1.0).alias("rate"), F.lit(float("inf")).alias("error"), F.lit(False).alias("done")), "children")
    for _ in range(rounds):
        counts = _divided(placed, state.filter("NOT done"), "w").groupBy("parent", "region").agg(F.count("*").alias("n"))
        missing = F.col("target") - F.coalesce("n", F.lit(0))
        seen = state.join(counts, ["parent", "region"], "left").withColumn("miss", missing)
        seen = seen.withColumn("total", F.round(F.sum(F.abs("miss")).over(family), 6))
        seen = seen.withColumn("even", F.min((F.abs("miss") <= F.greatest(F.lit(1.0), tolerance * F.col("target"))).cast("int")).over(family) == 1)
        live = ~F.col("done")
        rate = F.when(live & (F.col("total") > F.col("error")), 0.7 * F.col("rate")).otherwise(F.col("rate"))
        next_ = seen.select(
            "region", "parent", "vx", "vz", "target",
            F.when(live & ~F.col("even"), F.col("w") + rate * F.col("miss") * hex_area).otherwise(F.col("w")).alias("w"),
            F.when(live & (F.col("total") < F.col("error")), F.col("w")).otherwise(F.col("best")).alias("best"),
            rate.alias("rate"), F.when(live, F.least("total", "error")).otherwise(F.col("error")).alias("error"), (F.col("done") | F.col("even")).alias("done"))
        state = materialize(next_, "children")
        if state.filter("NOT done").isEmpty():
            break
    return _divided(placed, state, "best").select("q", "r", "region")


def nested_owners(grid: DataFrame, regions: DataFrame, warps: list[float], apothem: float, reach: float | None = None, rounds: int = 0) -> DataFrame:
    """(q, r, x, z, owners): the regions that own a hex from the top down to a leaf; null at sea.

    ``regions`` has (region, parent, level, cx, cz, radius, weight), parent null on level 0. The top level is ``own_hexes``: regions
    reach a little beyond their radius, the rest is sea. Below, a parent's cells are divided among its children and nobody else
    (``subdivide``), so a child's cells lie in its parent's and children leave none of it over. ``warps`` gives each level's
    amplitude, its last one serves deeper levels. A region whose parent does not exist takes no part, as it has no cells.
    """
    top = regions.filter("level = 0").select("region", "cx", "cz", "radius")
    owned = materialize(own_hexes(grid, top, warps[0], reach), "owned").withColumn("owners", F.when(F.col("region").isNotNull(), F.array("region")))
    area = 2 * math.sqrt(3) * apothem**2
    depth = regions.agg(F.max("level")).first()[0] or 0
    for level in range(1, depth + 1):
        children = materialize(regions.filter(F.col("level") == level).select("region", "parent", "cx", "cz", "weight"), "level")
        inside = owned.withColumnRenamed("region", "parent").join(children.select("parent").distinct(), "parent", "left_semi")
        found = subdivide(inside, children, warps[min(level, len(warps) - 1)], area, rounds).withColumnRenamed("region", "child")
        below = owned.join(found, ["q", "r"], "left")
        owned = materialize(below.select("q", "r", "x", "z", F.coalesce("child", "region").alias("region"), F.when(F.col("child").isNull(), F.col("owners")).otherwise(F.concat("owners", F.array("child"))).alias("owners")), "owned")
    return owned.select("q", "r", "x", "z", "owners")


#: The six neighbours in the order in which one goes around a hex.
AROUND = [(1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)]


def _ends_of_arcs(owned: DataFrame) -> DataFrame:
    """(q, r, arcs): around an owned hex, how many runs of hexes of its own region there are; one run: it can go without a break."""
    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("dq"), F.lit(b).alias("dr")) for k, (a, b) in enumerate(AROUND)))
    land = owned.filter("region IS NOT NULL").select("q", "r", "region")
    near = land.select("q", "r", "region", F.inline(steps)).select("region", F.col("q").alias("aq"), F.col("r").alias("ar"), "k", (F.col("q") + F.col("dq")).alias("q"), (F.col("r") + F.col("dr")).alias("r"))
    same = near.join(land, ["q", "r", "region"]).groupBy(F.col("aq").alias("q"), F.col("ar").alias("r")).agg(F.collect_set("k").alias("ks"))
    arcs = sum((F.when(F.array_contains("ks", k) & ~F.array_contains("ks", (k + 1) % 6), 1).otherwise(0) for k in range(6)), F.lit(0))
    return same.select("q", "r", F.when(F.size("ks") == 6, 1).otherwise(arcs).alias("arcs"))


def _keeps_whole(owned: DataFrame, chosen: DataFrame) -> DataFrame:
    """Of hexes (q, r, donor) those without which their donor has no more patches than with them."""
    chosen = materialize(chosen.withColumn("case", F.monotonically_increasing_id()), "cases")
    land = owned.filter("region IS NOT NULL").select("q", "r", F.col("region").alias("donor"), _hex_id().alias("hex"))
    touching = neighbour_pairs(owned).filter("(q, r) < (nq, nr)")
    ties = touching.join(land, ["q", "r"]).join(land.select(F.col("q").alias("nq"), F.col("r").alias("nr"), F.col("donor").alias("other"), F.col("hex").alias("next")), ["nq", "nr"]).filter("donor = other")
    case = chosen.select("case", "donor", _hex_id().alias("gone"))
    with_ = ties.join(case, "donor").select("case", "hex", "next", "gone")
    number = land.join(case, "donor").select("case", "hex", "gone")

    def patches(links: DataFrame, nodes: DataFrame) -> DataFrame:
        key = lambda c: F.xxhash64("case", c)
        parts = connected_components(links.select(key("hex").alias("a"), key("next").alias("b")), "a", "b")
        named = nodes.select("case", key("hex").alias("node")).join(parts, "node", "left")
        return named.groupBy("case").agg(F.count_distinct(F.coalesce("component", "node")).alias("n"))

    before = patches(with_, number).withColumnRenamed("n", "before")
    after = patches(with_.filter("hex <> gone AND next <> gone"), number.filter("hex <> gone")).withColumnRenamed("n", "after")
    return chosen.join(before, "case").join(after, "case").filter("after <= before").drop("before", "after", "case")


def grow_squeezed(owned: DataFrame, leaves: DataFrame, rounds: int = 500) -> DataFrame:
    """``owned`` (q, r, x, z, region) in which leaves with fewer hexes than they need have taken some from others.

    ``leaves`` has (region, need, cx, cz, weight). A hex can be taken from a region that keeps its own need and no more patches than
    it has, never from one that is short itself. A leaf without any hex is seeded with the one nearest to its centre that can be
    taken, sea included; then it takes neighbours of its hexes, the nearest to its centre first, land only. In a round every
    short leaf asks for one hex; a hex goes to the leaf of more weight if none is there yet, else to the nearest centre, and a donor
    gives one hex a round, so no two gifts can add up to a break. Rounds go on until nobody can be given anything: then a leaf
    is short only if no donor beside it can give. Hexes whose loss might break their donor are looked at only if no other is left.
    """
    need = leaves.select("region", F.col("need").cast("long").alias("need"))
    now = materialize(owned.select("q", "r", "x", "z", "region"), "owned")
    pairs = materialize(neighbour_pairs(owned), "hex-neighbours")
    for _ in range(rounds):
        counts = now.filter("region IS NOT NULL").groupBy("region").agg(F.count("*").alias("n"))
        short = leaves.join(counts, "region", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < need")
        short = materialize(short.select(F.col("region").alias("taker"), "n", "cx", "cz", F.col("weight").cast("double").alias("weight")), "short")
        if short.isEmpty():
            break
        spare = counts.join(need, "region", "left").filter("n - 1 >= coalesce(need, 0)").select(F.col("region").alias("donor"))
        spare = spare.join(short.select(F.col("taker").alias("donor")), "donor", "left_anti")
        arcs = _ends_of_arcs(now)
        d2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("z") - F.col("cz")) ** 2
        land = now.filter("region IS NOT NULL").withColumnRenamed("region", "donor").join(spare, "donor").join(arcs, ["q", "r"], "left").select("q", "r", "x", "z", "donor", F.coalesce("arcs", F.lit(0)).alias("arcs"))
        offered = materialize(land.unionByName(now.filter("region IS NULL").select("q", "r", "x", "z", F.lit(None).cast(now.schema["region"].dataType).alias("donor"), F.lit(1).alias("arcs"))), "offered")
        from lattica.operators.retrieval import _held

        seeds = offered.crossJoin(_held(short.filter("n = 0"))).withColumn("d2", d2)
        edge = pairs.join(now.select("q", "r", F.col("region").alias("taker")), ["q", "r"]).join(short.filter("n > 0"), "taker").select(F.col("nq").alias("q"), F.col("nr").alias("r"), "taker", "cx", "cz", "weight").distinct()
        grown = offered.filter("donor IS NOT NULL").join(edge, ["q", "r"]).withColumn("d2", d2)
        cols = ["q", "r", "donor", "arcs", "taker", "weight", "d2"]
        asked = seeds.select(*cols, F.lit(True).alias("seed")).unionByName(grown.select(*cols, F.lit(False).alias("seed")))
        asked = materialize(asked.filter("donor IS NULL OR donor <> taker"), "asked")
        safe = asked.filter("arcs <= 1")
        if safe.isEmpty():
            loose = asked.filter("arcs > 1").select("q", "r", "donor").distinct()
            if loose.isEmpty():
                break
            safe = asked.join(_keeps_whole(now, loose).select("q", "r"), ["q", "r"], "left_semi")
        first = lambda by, *order: Window.partitionBy(*by).orderBy(*order)
        one = safe.withColumn("k", F.row_number().over(first(["taker"], "d2", "q", "r"))).filter("k = 1")
        won = one.withColumn("k", F.row_number().over(first(["q", "r"], F.desc("seed"), F.when(F.col("seed"), -F.col("weight")).otherwise(F.col("d2")), "d2", "taker"))).filter("k = 1")
        given = won.withColumn("k", F.when(F.col("donor").isNull(), 1).otherwise(F.row_number().over(first(["donor"], F.desc("seed"), "d2", "taker")))).filter("k = 1")
        given = materialize(given.select("q", "r", "taker"), "given")
        if given.isEmpty():
            break
        now = materialize(now.join(given, ["q", "r"], "left").select("q", "r", "x", "z", F.coalesce("taker", "region").alias("region")), "owned")
    return now


def tag_depth(elevation: Column, key: Column, jitter: float = 0.06) -> Column:
    """How far out from its leaf's centre a tag wants to stand, 0.05 to 0.78 of the radius: the higher the nearer, moved by its hash."""
    share = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 4), 16, 10).cast("double") / 65535
    return F.greatest(F.lit(0.05), F.least(F.lit(0.78), 0.78 - 0.58 * elevation / 100 + (2 * share - 1) * jitter))


def place_tags(owned: DataFrame, leaves: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag_id, region, q, r): a hex of its leaf for every tag, no two in one.

    ``owned`` (q, r, x, z, region), ``leaves`` (region, cx, cz, radius), ``tags`` (tag_id, region, elevation, depth). The tags of a leaf choose
    one after the other, the highest first and then by id, among the hexes left, the one whose distance from the centre over
    the radius is nearest to the tag's depth (then the least q, r). That order is kept by rounds for all leaves at once: each tag
    without a hex asks for its best one that no tag before it holds; a hex is held by the first of those who ask, and whom that
    turns out asks again. Tags beyond the number of hexes, and those of leaves without any, get none. The most tags of a leaf
    bound the rounds; few are needed, as only tags that want the same hex meet.
    """
    depth = F.hypot(F.col("x") - F.col("cx"), F.col("z") - F.col("cz")) / F.greatest(F.col("radius"), F.lit(1e-6))
    hexes = materialize(owned.join(leaves.select("region", "cx", "cz", "radius"), "region").select("region", "q", "r", F.round(depth, 9).alias("at")), "hexes")
    order = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("elevation"), "tag_id"))
    room = hexes.groupBy("region").agg(F.count("*").alias("room"))
    asking = tags.withColumn("turn", order).join(room, "region").filter("turn <= room").select("tag_id", "region", "turn", F.round(F.col("depth"), 9).alias("depth"))
    asking = materialize(asking, "tags")
    kept = None
    while True:
        free = hexes.withColumn("holder", F.lit(None).cast("int")) if kept is None else hexes.join(kept.select("region", "q", "r", F.col("turn").alias("holder")), ["region", "q", "r"], "left")
        idle = asking if kept is None else asking.join(kept.select("region", "turn"), ["region", "turn"], "left_anti")
        wish = F.struct(F.round(F.abs(F.col("at") - F.col("depth")), 9).alias("gap"), "q", "r")
        new = idle.join(free, "region").filter("holder IS NULL OR turn < holder").groupBy("region", "turn").agg(F.min(wish).alias("w")).select("region", "turn", "w.q", "w.r")
        new = materialize(new, "wishes")
        if new.isEmpty():
            break
        all_ = new if kept is None else new.unionByName(kept)
        kept = materialize(all_.groupBy("region", "q", "r").agg(F.min("turn").alias("turn")).select("region", "turn", "q", "r"), "places")
    if kept is None:
        return asking.select("tag_id", "region", F.lit(None).cast("int").alias("q"), F.lit(None).cast("int").alias("r")).limit(0)
    return asking.join(kept, ["region", "turn"]).select("tag_id", "region", "q", "r")
