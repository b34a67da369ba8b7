"""Communities of a weighted graph by modularity: local moves, refinement and aggregation, over edge tables.

One level goes as follows. Nodes move to the neighbouring community with the largest gain, in rounds; each round puts the
communities in a random order and moves go upwards only, so that no two communities swap members, and the round counts only if
modularity rose. Where it did not, only moves that are the best of both communities they touch are made: those touch disjoint
pairs of communities, so their gains add up exactly. Then every community is refined: its
nodes begin alone and join well-connected parts of it that they have an edge to. The parts are the nodes of the next level, which
starts from the communities found. When nothing moves any more, communities are split where they hang together by no edge.

A round is some joins and aggregations on node and community ids, in two written tables. The driver sees a few sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lattica.operators.components import connected_components
from lattica.session import materialize

#: Gains are compared at so many digits, as sums of doubles differ in the last ones with the order of their rows.
DIGITS = 9


class Level:
    """One level's graph: ``edges`` (src, dst, w) both ways without loops; ``total`` is 2m, ``loops`` what lies inside of nodes."""

    def __init__(self, edges: DataFrame, loops: float, total: float, resolution: float):
        self.edges, self.loops, self.total, self.resolution = edges, loops, total, resolution

    def votes(self, members: DataFrame) -> tuple[DataFrame, float]:
        """(id, comm, w, own, k, size): the weight between each node and each community next to it, its own always among them.

        ``size`` is the community's strength without the node. With it comes the modularity, observed while the table is written.
        """
        near = self.edges.join(members.select(F.col("id").alias("dst"), "comm"), "dst").select(F.col("src").alias("id"), "comm", "w")
        near = near.unionByName(members.select("id", "comm", F.lit(0.0).alias("w"))).groupBy("id", "comm").agg(F.sum("w").alias("w"))
        sizes = members.groupBy("comm").agg(F.sum("k").alias("strength"))
        joined = near.join(sizes, "comm").join(members.select("id", "k", F.col("comm").alias("own")), "id")
        at_home = F.col("comm") == F.col("own")
        seen = Observation()
        told = joined.observe(seen, F.sum(F.when(at_home, F.col("w"))).alias("inner"), F.sum(F.when(at_home, F.col("k") * F.col("strength"))).alias("square"))
        size = F.col("strength") - F.when(at_home, F.col("k")).otherwise(0.0)
        votes = materialize(told.select("id", "comm", "w", "own", "k", size.alias("size")), "votes")
        return votes, ((seen.get["inner"] or 0.0) + self.loops) / self.total - self.resolution * (seen.get["square"] or 0.0) / self.total**2

    def value(self) -> Column:
        """What a community of ``votes`` is worth to the node, as weight."""
        return F.round(F.col("w") - self.resolution * F.col("k") * F.col("size") / self.total, DIGITS)


def _coin(community: Column, turn: int) -> Column:
    return F.xxhash64(community, F.lit(turn))


def _moves(level: Level, votes: DataFrame, turn: int) -> DataFrame:
    """(id, own, best, gain, free): of nodes that gain by moving the best community, and the best that this turn allows, if any."""
    scored = votes.withColumn("value", level.value()).withColumn("tie", -F.col("comm"))
    away = F.col("comm") != F.col("own")
    allowed = away & (_coin(F.col("own"), turn) < _coin(F.col("comm"), turn))
    row = F.struct("value", "tie", "comm")
    each = scored.groupBy("id", "own").agg(F.max(F.when(~away, F.col("value"))).alias("stay"), F.max(F.when(away, row)).alias("any"), F.max(F.when(allowed, row)).alias("free"))
    alone = F.struct(F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("tie"), F.xxhash64("id", "own", F.lit(turn)).alias("comm"))  # a community of its own
    better = lambda c: F.when(F.col(f"{c}.value") > 0, F.col(c)).otherwise(alone)
    each = each.select("id", "own", "stay", better("any").alias("any"), better("free").alias("free"))
    gain = lambda c: F.col(f"{c}.value") - F.col("stay")
    return each.select("id", "own", F.col("any.comm").alias("best"), gain("any").alias("gain"), F.when(gain("free") > 0, F.col("free.comm")).alias("free")).filter("gain > 0")


def _disjoint(moves: DataFrame) -> DataFrame:
    """Moves that are the first, by gain and then id, of all that touch either of their communities."""
    order = F.struct("gain", (-F.col("id")).alias("tie"))
    ends = moves.select(F.explode(F.array("own", "best")).alias("comm"), order.alias("order")).groupBy("comm").agg(F.max("order").alias("top"))
    at = lambda c: ends.select(F.col("comm").alias(c), F.col("top").alias(f"top_{c}"))
    both = moves.withColumn("order", order).join(at("own"), "own").join(at("best"), "best")
    return both.filter("order = top_own AND order = top_best").select("id", F.col("best").alias("to"), F.lit(True).alias("wants"))


def _moved(members: DataFrame, moves: DataFrame) -> tuple[DataFrame, int, int]:
    """Members after moves (id, to, wants), how many nodes want to move, and how many do."""
    seen = Observation()
    told = members.join(moves, "id", "left").observe(seen, F.count("wants").alias("wanted"), F.count("to").alias("moved"))
    out = materialize(told.select("id", F.coalesce("to", "comm").alias("comm"), "k", "loop"), "members")
    return out, seen.get["wanted"], seen.get["moved"]


def local_moves(level: Level, members: DataFrame, rounds: int, least_gain: float) -> tuple[DataFrame, float, bool]:
    """Members after the moves, their modularity, and whether any node moved."""
    votes, now = level.votes(members)
    changed, stalled = False, 0
    for turn in range(rounds):
        moves = _moves(level, votes, turn)
        fresh, wanted, moved = _moved(members, moves.select("id", F.col("free").alias("to"), F.lit(True).alias("wants")))
        if not wanted:
            break
        fresh_votes, after = level.votes(fresh) if moved else (votes, now)
        if after <= now:
            fresh, _, _ = _moved(members, _disjoint(moves))
            fresh_votes, after = level.votes(fresh)
        stalled = stalled + 1 if after - now < least_gain else 0
        if after > now:
            members, votes, now, changed = fresh, fresh_votes, after, True
        if stalled == 2:
            break
    return members, now, changed


def refine(level: Level, members: DataFrame, rounds: int) -> DataFrame:
    """(id, part, comm, k, loop): parts of the communities, each one connected.

    A node joins a part only while it is alone, only over an edge, and only if node and part are well connected to the rest of
    their community. In a round nodes on heads of a coin look for a part, the others can be joined.
    """
    inner = level.edges.join(members.select(F.col("id").alias("src"), F.col("comm").alias("c")), "src").join(members.select(F.col("id").alias("dst"), F.col("comm").alias("d")), "dst").filter("c = d")
    inner = materialize(inner.select("src", "dst", "w"), "inner")
    whole = members.groupBy("comm").agg(F.sum("k").alias("all"))
    parts = members.join(whole, "comm").select("id", F.col("id").alias("part"), "comm", "k", "loop", "all")
    turn = 0
    for _ in range(rounds):
        ends = inner.join(parts.select(F.col("id").alias("src"), F.col("part").alias("p")), "src").join(parts.select(F.col("id").alias("dst"), F.col("part").alias("q")), "dst")
        between = ends.filter("p <> q").groupBy("p", "q").agg(F.sum("w").alias("w"))
        out = between.groupBy("p").agg(F.sum("w").alias("out"))
        about = parts.groupBy("part").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.first("all").alias("all")).join(out, F.col("part") == F.col("p")).drop("p")
        about = about.filter(F.col("out") >= level.resolution * F.col("k") * (F.col("all") - F.col("k")) / level.total - 1e-9)
        side = lambda end: about.select(F.col("part").alias(end), F.col("k").alias(f"k{end}"), F.col("n").alias(f"n{end}"))  # noqa: B023, E731
        gain = F.round(F.col("w") - level.resolution * F.col("kp") * F.col("kq") / level.total, DIGITS)
        chances = materialize(between.join(side("p").filter("np = 1"), "p").join(side("q"), "q").select("p", "q", "nq", gain.alias("gain")).filter("gain > 0"), "chances")
        if chances.isEmpty():
            break
        joins = None
        while joins is None or joins.isEmpty():  # some coin lets one of them through
            turn += 1
            heads = lambda end: _coin(F.col(end), turn) % 2 == 0  # noqa: B023, E731
            allowed = chances.filter(heads("p") & ((F.col("nq") > 1) | ~heads("q")))
            joins = allowed.groupBy("p").agg(F.max_by("q", F.struct("gain", (-F.col("q")).alias("tie"))).alias("to"))
        parts = materialize(parts.join(joins, F.col("part") == F.col("p"), "left").select("id", F.coalesce("to", "part").alias("part"), "comm", "k", "loop", "all"), "parts")
    return parts.drop("all")


def _pass(both: DataFrame, members: DataFrame, total: float, resolution: float, rounds: int, levels: int, least_gain: float) -> tuple[DataFrame, float]:
    """(id, community) and its modularity after moves, refinement and aggregation, level by level, from ``members`` on."""
    names = members.select("id", F.col("id").alias("node"))  # of the first level's nodes: the node that they are in
    inside = 0.0
    for _ in range(levels):
        level = Level(both, inside, total, resolution)
        members, now, changed = local_moves(level, members, rounds, least_gain)
        found = materialize(names.join(members.select(F.col("id").alias("node"), "comm"), "node").select("id", "node", F.col("comm").alias("community")), "found")
        if not changed and inside:
            break
        parts = refine(level, members, rounds)
        n, m = parts.agg(F.count("*"), F.count_distinct("part")).first()
        if n == m:
            break
        part = lambda end, name: parts.select(F.col("id").alias(end), F.col("part").alias(name))  # noqa: B023, E731
        lifted = materialize(both.join(part("src", "p"), "src").join(part("dst", "q"), "dst").groupBy("p", "q").agg(F.sum("w").alias("w")), "lifted")
        both = lifted.filter("p <> q").select(F.col("p").alias("src"), F.col("q").alias("dst"), "w")
        loops = lifted.filter("p = q").select(F.col("p").alias("part"), F.col("w").alias("inside"))
        nodes = parts.groupBy("part").agg(F.first("comm").alias("comm"), F.sum("k").alias("k"), F.sum("loop").alias("loop")).join(loops, "part", "left")
        members = materialize(nodes.select(F.col("part").alias("id"), "comm", "k", (F.col("loop") + F.coalesce("inside", F.lit(0.0))).alias("loop")), "members")
        inside = members.agg(F.sum("loop")).first()[0] or 0.0
        names = materialize(found.join(part("node", "p"), "node").select("id", F.col("p").alias("node")), "names")
    return found.select("id", "community"), now


def leiden(edges: DataFrame, resolution: float = 1.0, passes: int = 2, rounds: int = 60, levels: int = 10, least_gain: float = 1e-6) -> DataFrame:
    """(id, community) of undirected weighted edges (a, b, weight); a community is named by its least node.

    Repeated edges add up; loops, null ends and weights that are not above zero are ignored; a node without an edge does not
    appear, an empty table gives no rows. ``resolution`` above one gives smaller communities. Local moves of a level end when no node
    gains by moving, when two rounds running raise modularity by less than ``least_gain``, or after ``rounds`` rounds. A pass goes
    through all levels; the next one starts with single nodes in the communities found, and so can take apart what was joined
    too early. At most ``passes`` are made, fewer if one gains less than ``least_gain``. Every community is connected. The result
    depends on the edges alone, not on their order or partitions, up to gains that tie beyond nine digits.
    """
    good = edges.filter("a <> b AND weight > 0").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("weight").cast("double").alias("w"))
    both = good.unionByName(good.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
    both = materialize(both, "edges")
    total = both.agg(F.sum("w")).first()[0]
    if not total:
        return both.select(F.col("src").alias("id"), F.col("dst").alias("community"))
    single = materialize(both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).select("id", F.col("id").alias("comm"), "k", F.lit(0.0).alias("loop")), "members")
    found, now = _pass(both, single, total, resolution, rounds, levels, least_gain)
    for _ in range(passes - 1):
        members = materialize(single.drop("comm").join(found, "id").select("id", F.col("community").alias("comm"), "k", "loop"), "members")
        again, after = _pass(both, members, total, resolution, rounds, levels, least_gain)
        if after - now < least_gain:
            break
        found, now = again, after
    at = lambda end, name: found.select(F.col("id").alias(end), F.col("community").alias(name))  # noqa: B023, E731
    kept = both.filter("src < dst").join(at("src", "c"), "src").join(at("dst", "d"), "dst").filter("c = d")
    whole = connected_components(kept, "src", "dst")
    return found.select("id").join(whole, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(communities, modularity) of a partition (id, community) of undirected edges (a, b, weight); one row."""
    at = lambda end, name: communities.select(F.col("id").alias(end), F.col("community").alias(name))
    ends = edges.filter("a <> b AND weight > 0").join(at("a", "c"), "a").join(at("b", "d"), "b").select("c", "d", "weight")
    per = ends.select("c", "weight", F.when(F.col("c") == F.col("d"), F.col("weight")).otherwise(0.0).alias("inner")).unionByName(ends.select(F.col("d").alias("c"), "weight", F.lit(0.0).alias("inner")))
    sums = per.groupBy("c").agg(F.sum("weight").alias("k"), F.sum("inner").alias("i"))
    out = sums.agg(F.count("*").alias("communities"), F.sum("k").alias("t"), F.sum("i").alias("i"), F.sum(F.col("k") * F.col("k")).alias("s"))
    return out.select("communities", F.round(2 * F.col("i") / F.col("t") - resolution * F.col("s") / (F.col("t") * F.col("t")), 6).alias("modularity"))
