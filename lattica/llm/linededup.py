"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Two lines link at an edit distance of at most TAU = 1. A line of length l is split into TAU + 1 = 2 segments; an edit leaves
one of them whole, so two linked lines share a segment. The segments are a length-aware index: a line of length n is filed
under l = n, and probes l = n - 1 with the substrings that stand where the shorter line's segments would; lines of one key
(l, dropped range, what is kept left and right of it) are candidates. Candidates are verified by a banded bit-parallel edit
distance.

A key with more than DENSE lines is not paired. Its lines agree outside the dropped range, so the range is split into two
segments in turn, again and again; lines that differ in different places part on the way. A range of one character (or
none, for an inserted one) leaves only true links, which become a star around the least line. So nothing is capped, and no
group is expanded into all its pairs.

Exact copies are merged beforehand by a 128-bit hash, with map-side combining. Lines under MIN_CHARS characters link to exact
copies only; those go like all others, but lines without a letter or digit always stay. A line is known as doc_id * 2**LINE_BITS + line number, so the least of a class is its first occurrence.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import BROADCAST_ROWS, small
from lattica.operators.components import connected_components
from lattica.session import materialize, shared_dir

TAU = 1
DENSE = 6
MIN_CHARS = 20
LINE_BITS = 24
#: Lines that make up a share of 1 / HOT_SHARE of all rows are spread over so many keys.
HOT_SHARE, SALTS = 1_000, 16


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line) for every \\n-separated line; null texts have none, empty ones one empty line."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))


def node_id() -> Column:
    """A line's number; fails for ids and line numbers that do not fit it."""
    fits = (F.col("doc_id") >= 0) & (F.col("doc_id") < (1 << 63 - LINE_BITS)) & (F.col("line_no") < (1 << LINE_BITS))
    wrong = F.raise_error(F.lit(f"ids must be 0 to 2**{63 - LINE_BITS} - 1, and texts have at most 2**{LINE_BITS} lines")).cast("long")
    return F.when(F.coalesce(fits, F.lit(True)), F.col("doc_id") * (1 << LINE_BITS) + F.col("line_no")).otherwise(wrong)


def key(l: Column, low: Column, high: Column) -> Column:
    """What a line of length l (or l + 1) keeps around the dropped range [low, high) of length class l."""
    return F.xxhash64(F.left("line", low), F.right("line", l - high), l, low, high)


def first_keys() -> list[Column]:
    """The keys of both length classes that a line belongs to, dropping the second or the first segment."""
    out = []
    for less in (0, 1):
        l = F.char_length("line") - less
        half = F.floor(l / 2).cast("int")
        out += [key(l, half, l), key(l, F.lit(0), half)]
    return out


def distinct_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, node, copies, n, k0..k3): one row for each different line; node is its first occurrence."""
    n = F.char_length("line")
    keyed = lines(docs, id_col, text_col).select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), node_id().alias("node"), n.alias("n"),
        *(F.when(n >= min_chars, k).alias(f"k{i}") for i, k in enumerate(first_keys())),
    )
    # equal lines have equal keys, so any of them will do
    return keyed.groupBy("h1", "h2").agg(F.min("node").alias("node"), F.count("*").alias("copies"), *(F.max(c).alias(c) for c in ("n", "k0", "k1", "k2", "k3")))


def banded_distance(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of two strings whose lengths differ by at most ``tau``, if it is at most ``tau``; else more than that.

    One step a character of ``b``: the 2 * tau + 1 cells around the diagonal are the bits of one word; PM has the matches of
    the band's characters of ``a``, VP and VN the vertical differences of +1 and -1.
    """
    width, mask = 2 * tau + 1, (1 << (2 * tau + 1)) - 1
    n, m = F.char_length(a), F.char_length(b)

    def step(left: Column, right: Column, n: Column, s: Column, i: Column) -> Column:
        pm = sum((F.when(F.get(left, i - tau + d) == F.get(right, i), 1 << d).otherwise(0) for d in range(width)), F.lit(0))
        vp, vn = s["vp"], s["vn"]
        d0 = ((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(F.lit(mask))
        hp = vn.bitwiseOR(F.lit(mask).bitwiseXOR(d0.bitwiseOR(vp)))
        hn = d0.bitwiseAND(vp)
        diagonal = 1 - F.shiftright(d0, width - 1)
        at = F.greatest(width - 2 - (i - (n - tau)), F.lit(0))
        bit = lambda v: F.call_function("shiftright", v, at).bitwiseAND(F.lit(1))
        change = F.when(i < n - tau, diagonal).otherwise(bit(hp) - bit(hn))
        down = F.shiftright(d0, 1)
        return F.struct(
            hn.bitwiseOR(F.lit(mask).bitwiseXOR(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["dist"] + change).alias("dist"),
        )

    start = F.struct(F.lit(mask ^ ((1 << tau) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(tau).alias("dist"))
    # the characters are split once: a lambda's variable holds them
    held = F.array(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), n.alias("n"), m.alias("m")))
    walk = lambda h: F.aggregate(F.sequence(F.lit(0), h["m"] - 1), start, lambda s, i: step(h["a"], h["b"], h["n"], s, i), lambda s: s["dist"])
    return F.when((n <= tau) | (m == 0), F.levenshtein(a, b)).otherwise(F.transform(held, walk)[0])


def _pairs(filed: DataFrame) -> DataFrame:
    """(a, b): pairs of lines of one key, one of them of the key's length; only keys with at most DENSE lines come here.

    Two lines of length l + 1 are left to the keys of their own length.
    """
    left, right = filed.select("key", "l", F.col("node").alias("a"), F.col("n").alias("na")), filed.select("key", F.col("node").alias("b"), F.col("n").alias("nb"))
    return left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") == F.col("l"))).select("a", "b")


def _star(filed: DataFrame) -> DataFrame:
    """(a, b): each line of a key tied to the key's least line."""
    least = filed.groupBy("key").agg(F.min("node").alias("a"))
    return filed.join(least, "key").filter("node <> a").select("a", F.col("node").alias("b"))


def _inserted(filed: DataFrame) -> DataFrame:
    """(a, b): the one line of length l that a key with an empty range can have, with each line that has a character more."""
    short = filed.filter("n = l").select("key", F.col("node").alias("s"))
    return filed.filter("n > l").join(short, "key").select(F.least("s", "node").alias("a"), F.greatest("s", "node").alias("b"))


def _counted(filed: DataFrame, name: str) -> DataFrame:
    """The rows whose key at least two lines have, with the number of them."""
    sizes = filed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    return materialize(filed.join(sizes, "key"), name)


def links(docs: DataFrame, unlike: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(a, b) between different lines, enough for the classes of all links; (node, n_links) with the exact number of them.

    Lines of equal length that differ in one place share one range of one character and no other, so a dense key of that
    kind counts its lines less one for each of them; all other links are told pair by pair.
    """
    l0, l1 = F.col("n"), F.col("n") - 1
    h0, h1 = F.floor(l0 / 2).cast("int"), F.floor(l1 / 2).cast("int")
    ranges = [(l0, h0, l0), (l0, F.lit(0), h0), (l1, h1, l1), (l1, F.lit(0), h1)]
    cells = F.array(*(F.struct(F.col(f"k{i}").alias("key"), l.alias("l"), low.alias("low"), high.alias("high")) for i, (l, low, high) in enumerate(ranges)))
    filed = unlike.filter("k0 is not null").select("node", "n", F.inline(cells))
    shared = _counted(filed, "line-keys")
    wanted = shared.select("node").distinct()
    wanted = wanted.select(F.shiftright("node", LINE_BITS).alias("doc_id"), F.col("node").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int").alias("line_no"))
    texts = materialize(lines(docs, id_col, text_col).join(small(materialize(wanted, "wanted")), ["doc_id", "line_no"]).select(node_id().alias("node"), "line").dropDuplicates(["node"]), "line-texts")
    root, level, spark = f"{shared_dir(docs.sparkSession)}/line-links-{uuid.uuid4().hex}", 0, docs.sparkSession

    def note(kind: str, rows: DataFrame, n: str = "0L") -> DataFrame:
        return rows.selectExpr(f"'{kind}' AS kind", "a", "b", f"{n} AS n")

    # each level's findings are one small table, so that no plan grows with the number of levels
    note("maybe", _pairs(shared.filter(F.col("size") <= DENSE))).write.parquet(f"{root}/level=0")
    hot = materialize(shared.filter(F.col("size") > DENSE).select("node", "n", "l", "low", "high").join(texts, "node"), "hot")
    while not hot.isEmpty():
        level += 1
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.when(F.col("high") - F.col("low") > 1, F.array(F.struct(F.col("low").alias("low"), mid.alias("high")), F.struct(mid.alias("low"), F.col("high").alias("high"))))
        points = F.array(F.struct(F.col("low").alias("low"), F.col("low").alias("high")), F.struct(F.col("high").alias("low"), F.col("high").alias("high")))
        parts = hot.select("node", "n", "line", "l", F.explode(F.coalesce(halves, points)).alias("part")).select("node", "n", "line", "l", "part.low", "part.high")
        split = _counted(parts.withColumn("key", key(F.col("l"), F.col("low"), F.col("high"))).distinct(), "hot-keys")
        dense = split.filter(F.col("size") > DENSE)
        # a range of one character: the lines of length l differ in it alone; an empty range: in one inserted character
        single, empty = dense.filter("high = low + 1 and n = l"), dense.filter("high = low")
        sizes = single.groupBy("key").agg((F.count("*") - 1).alias("more"))
        counted = single.join(sizes, "key").select(F.col("node").alias("a"), F.col("node").alias("b"), "more")
        found = note("maybe", _pairs(split.filter(F.col("size") <= DENSE))).union(note("star", _star(single))).union(note("star", _star(empty)))
        found.union(note("link", _inserted(empty))).union(note("count", counted, "more")).write.parquet(f"{root}/level={level}")
        hot = materialize(dense.filter("high > low").select("node", "n", "l", "low", "high", "line"), "hot")
    found = spark.read.schema("kind string, a long, b long, n long, level int").parquet(root)
    few = found.filter("kind = 'maybe'").select("a", "b").distinct()
    named = few.join(texts.select(F.col("node").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("line").alias("line_b")), "b")
    true = named.filter(banded_distance(F.col("line_a"), F.col("line_b"), TAU) <= TAU).select("a", "b")
    pairs = materialize(true.union(found.filter("kind = 'link'").select("a", "b")).distinct(), "line-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n"))
    degree = ends.union(found.filter("kind = 'count'").select("a", "n")).groupBy("node").agg(F.sum("n").alias("n_links"))
    return pairs.union(found.filter("kind = 'star'").select("a", "b")), degree


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, node, copies, n, first, n_links): each different line, its first occurrence, its class's, its links."""
    unlike = materialize(distinct_lines(docs, id_col, text_col, min_chars), "unlike")
    edges, degree = links(docs, unlike, id_col, text_col)
    parts = materialize(connected_components(edges, "a", "b").join(degree, "node", "left"), "line-classes")
    joined = unlike.join(small(parts.withColumnRenamed("node", "line_node")), F.col("node") == F.col("line_node"), "left")
    return joined.select("h1", "h2", "node", "copies", "n", F.coalesce("component", "node").alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, n_chars, first_doc_id, first_line_no, copies, n_links, kept) for every line of every document.

    first_* is the first line of its class (itself for a line alone), copies the number of equal lines, n_links the number
    of different lines within TAU edits. kept: it is that first line, or has no letter and no digit. Null texts have no lines;
    rows with a null id keep their lines, in no class; ids are 0 to 2**39 - 1 (others raise an error), and rows that repeat an
    id hold repeated lines. Other columns are ignored.

    Lines with a share of 1 / HOT_SHARE of all lines or more are at most HOT_SHARE; their rows are dealt to SALTS keys.
    """
    classes = materialize(line_classes(docs, id_col, text_col, min_chars), "classes").drop("n")
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.broadcast(classes.filter(F.col("copies") * HOT_SHARE >= max(total, SALTS * HOT_SHARE)).select("h1", "h2", F.lit(True).alias("hot")))
    salted = classes.join(hot, ["h1", "h2"], "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    found = lines(docs, id_col, text_col).select(
        "doc_id", "line_no", F.char_length("line").alias("n_chars"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), (~F.col("line").rlike(r"[\p{L}\p{N}]")).alias("bare"))
    found = found.join(hot, ["h1", "h2"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    joined = found.join(salted, ["h1", "h2", "salt"])
    own = F.coalesce("first", node_id())
    return joined.select(
        "doc_id", "line_no", "n_chars", F.shiftright(own, LINE_BITS).alias("first_doc_id"), own.bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int").alias("first_line_no"), "copies", "n_links",
        (F.coalesce(own == node_id(), F.lit(True)) | F.col("bare")).alias("kept"),
    )


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with every line but the first of its class taken out of the texts; all rows and columns stay.

    A document whose lines all stand earlier is left with its lines without a letter or digit, or an empty text.
    """
    gone = materialize(near_duplicate_lines(docs, id_col, text_col, min_chars).filter("not kept").select("doc_id", "line_no"), "lost-lines")
    lost = gone.groupBy(F.col("doc_id").alias(id_col)).agg(F.collect_set("line_no").alias("__lost"))
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        lost = F.broadcast(lost)  # at most BROADCAST_ROWS line numbers in all
    joined = docs.join(lost, id_col, "left")
    listed = F.split(F.col(text_col), "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size(listed) - 1), F.col("__lost"))
    text = F.when(F.col("__lost").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(keep, lambda i: F.get(listed, i)), "\n"))
    return joined.withColumn(text_col, text).select(*docs.columns)
