"""Serving-side operators: restrictions, seeds, cards, keyed stores, caches, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.display import bound, cron_day, cron_fields, cron_fires_at, cron_next, cron_takes


# Graph restriction and retrieval seeds --------------------------------------------------------------------------------


def restrict_nodes(nodes: DataFrame, edges: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the excluded notes: edges that touch one go, signals all of whose sources are excluded too.

    ``nodes`` (id, type, source_note_ids), ``edges`` (src, dst, ...), ``excluded`` (id).
    """
    listed = nodes.filter("type = 'signal' and size(source_note_ids) > 0").select("id", F.explode("source_note_ids").alias("note"))
    alive = listed.join(excluded.select(F.col("id").alias("note")), "note", "left_anti").select("id").distinct()
    dead = nodes.filter("type = 'signal' and size(source_note_ids) > 0").join(alive, "id", "left_anti").select("id")
    gone = excluded.select("id").union(dead).distinct()
    kept = nodes.join(gone, "id", "left_anti")
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return kept, left


def touching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an edge still touches."""
    return nodes.join(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "id", "left_semi")


def top_seeds(scored: DataFrame, group: str, k: int, score: str = "score", floor: float = 0.0) -> DataFrame:
    """(group, id, score, rank): the ``k`` best above ``floor`` of each group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), "id"))
    return scored.filter(F.col(score) > floor).withColumn("rank", rank).filter(F.col("rank") <= k).select(group, "id", score, "rank")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the first by ``order``, which stays the order of the result."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def query_mentions(text: Column) -> Column:
    """@handles, [[links]] and capitalised phrases of a question; of names alike but for case the first."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(r"@([A-Za-z0-9_.-]+)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)+)"), F.lit(1)),
    )
    return F.aggregate(F.transform(found, lambda x: F.trim(x)), F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))


def citations(answer: Column, valid: Column) -> Column:
    """The valid [cN] marks of an answer, each once in the order of its first place."""
    return F.array_intersect(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(c\d+)\]"), F.lit(1))), valid)


def contains_either(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention, id) where a label holds the mention or the mention the label, case aside; mentions are a stated query set.

    Labels and mentions meet through the words that they share, so only a pair with a common word is compared.
    """
    words = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), r"\W+")))
    m, e = mentions.select("mention", words(F.col("mention")).alias("w")), entities.select("id", "label", words(F.col("label")).alias("w"))
    met = m.filter("w <> ''").join(e, "w").select("mention", "id", "label").distinct()
    low, name = F.lower("mention"), F.lower("label")
    return met.filter(F.contains(name, low) | F.contains(low, name)).select("mention", "id")


def resolve_nodes(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, id): by id, else by label, else by a label that holds the words; the least id of the best way."""
    by_id = wanted.join(nodes.select(F.col("id").alias("ref"), "id"), "ref").select("ref", "id", F.lit(0).alias("way"))
    by_label = wanted.withColumn("k", F.lower("ref")).join(nodes.select(F.lower("label").alias("k"), "id"), "k").select("ref", "id", F.lit(1))
    part = contains_either(wanted.select(F.col("ref").alias("mention")), nodes).select(F.col("mention").alias("ref"), "id", F.lit(2))
    return by_id.union(by_label).union(part).groupBy("ref").agg(F.min_by("id", F.struct("way", "id")).alias("id"))


# Cards, counts and highlights -----------------------------------------------------------------------------------------


def region_cards(closure: DataFrame, signals: DataFrame) -> DataFrame:
    """(node_id, risks, todos, questions, decisions, severity) of the open signals under each node.

    Signals are summed by their own region first; the closure multiplies those few rows only.
    """
    kinds = {"risks": "risk", "todos": "todo", "questions": "open_question", "decisions": "decision"}
    own = signals.filter("status = 'open'").groupBy("region_id").agg(*(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()), F.max("severity").alias("severity"))
    return closure.join(own, F.col("node_id") == F.col("region_id")).groupBy(F.col("ancestor_id").alias("node_id")).agg(*(F.sum(n).alias(n) for n in kinds), F.max("severity").alias("severity"))


def counts_outer(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """(key, n_left, n_right): two tables' row counts by key, zero where one has none."""
    l, r = left.groupBy(key).agg(F.count("*").alias(names[0])), right.groupBy(key).agg(F.count("*").alias(names[1]))
    return l.join(r, key, "full_outer").select(key, *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def mode_first(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value): the commonest value, the one seen first at a tie."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(group).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("f"))).alias(value))


def highlights(tags: DataFrame, cross: DataFrame, top: int = 10) -> DataFrame:
    """(kind, tag_id): hubs (highest degree), bridges (an edge to another region), trending (most recent), isolated (no edge)."""
    pick = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), "tag_id")
    hubs = tags.filter("degree > 0").orderBy(F.desc("degree"), "tag_id").limit(top)
    trending = tags.orderBy(F.desc("recency"), "tag_id").limit(top)
    bridges = tags.join(cross.select("tag_id").distinct(), "tag_id", "left_semi")
    return pick("hub", hubs).union(pick("bridge", bridges)).union(pick("trending", trending)).union(pick("isolated", tags.filter("degree = 0")))


def promote_entities(mentions: DataFrame, least: int = 2, top: int = 30, synthesised: int = 3) -> DataFrame:
    """(label, type, notes, synthesise): entities of ``least`` notes or more; the ``top`` with ``synthesised`` or more get a text."""
    counted = mentions.groupBy("label", "type").agg(F.count_distinct("note_id").alias("notes")).filter(F.col("notes") >= least)
    best = counted.filter(F.col("notes") >= synthesised).orderBy(F.desc("notes"), "label", "type").limit(top).select("label", "type", F.lit(True).alias("s"))
    return counted.join(best, ["label", "type"], "left").select("label", "type", "notes", F.coalesce("s", F.lit(False)).alias("synthesise"))


def topology_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(hash) of a graph whatever the order of its rows; one row.

    The rows' SHA-256 values are added up in eight pieces of 32 bits, so mappers combine them and no task holds a list.
    """
    rows = nodes.select(F.sha2(F.col("id").cast("string"), 256).alias("h")).union(edges.select(F.sha2(F.concat_ws(">", "src", "dst"), 256)))
    piece = lambda i: F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).cast("string")
    return rows.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *(piece(i) for i in range(8))), 256).alias("hash"))


# Keyed stores and caches ----------------------------------------------------------------------------------------------


def upsert_latest(stored: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stored and fresh rows, one a key: the latest by ``order``."""
    both = stored.unionByName(fresh)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), order).alias("r")).select("r.*")


def insert_missing(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Stored rows and the fresh ones of new keys."""
    return stored.unionByName(fresh.dropDuplicates([key]).join(stored.select(key), key, "left_anti").select(*stored.columns))


def stamp(stored: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored rows with the fresh values of ``columns``; a null or missing fresh value keeps the old one."""
    f = fresh.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return stored.join(f, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*stored.columns)


def similar_notes(cached: DataFrame, wanted: DataFrame, floor: float = 0.9, max_drift: int = 3) -> DataFrame:
    """(want, cache_key, overlap): for each wanted note the best cached one of its kind by the Jaccard of their member hashes.

    ``cached`` (cache_key, kind, drift, member_hash) and ``wanted`` (want, kind, member_hash) have a row a member. Ties go to
    the least key; notes carried on more than ``max_drift`` times are left out.
    """
    c = cached.filter(F.col("drift") <= max_drift)
    size = lambda f, k: f.groupBy(k).agg(F.count_distinct("member_hash").alias(f"n_{k}"))
    met = c.select("cache_key", "kind", "member_hash").distinct().join(wanted.select("want", "kind", "member_hash").distinct(), ["kind", "member_hash"])
    n = met.groupBy("want", "cache_key").agg(F.count("*").alias("n")).join(size(c, "cache_key"), "cache_key").join(size(wanted, "want"), "want")
    scored = n.withColumn("overlap", F.round(F.col("n") / (F.col("n_want") + F.col("n_cache_key") - F.col("n")), 6)).filter(F.col("overlap") >= floor)
    best = scored.groupBy("want").agg(F.min_by(F.struct("cache_key", "overlap"), F.struct((-F.col("overlap")).alias("o"), "cache_key")).alias("b"))
    return best.select("want", "b.cache_key", "b.overlap")


def cache_key(version: str, kind: Column, node: Column, members: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(version), kind, node, F.array_join(F.array_sort(members), "|")), 256)


# Sheets and paging ----------------------------------------------------------------------------------------------------


def numeric_first(column: str) -> list[Column]:
    """Order of cells: numbers by value, then texts."""
    return [F.expr(f"try_cast({column} AS double)").asc_nulls_last(), F.col(column)]


def find_cells(cells: DataFrame, needle: str, text: str = "cell") -> DataFrame:
    """Rows whose cell holds ``needle``, with the offsets of all matches, overlapping ones too."""
    n = F.lit(needle.lower())
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text) - len(needle) + 1)), lambda i: F.substr(F.lower(text), i, F.lit(len(needle))) == n)
    return cells.filter(F.contains(F.lower(text), n)).withColumn("at", starts)


def nearest_scope(closure: DataFrame, scope: DataFrame) -> DataFrame:
    """(node_id, scope_id): the nearest ancestor, the node itself included, that is in scope."""
    met = closure.join(scope.select(F.col("scope_id").alias("ancestor_id")), "ancestor_id")
    return met.groupBy("node_id").agg(F.min_by("ancestor_id", "distance").alias("scope_id"))


def checkbox_done(content: Column, draft: Column, stopwords: list[str]) -> Column:
    """True if the task-list line that shares half or more of its words with ``draft`` is ticked; the first best line counts. The pattern of a task box is a fixed value."""
    words = lambda t: F.filter(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))), lambda w: (F.char_length(w) > 1) & ~w.isin(stopwords))
    box = r"^\s*(?:(?:[-*+]|\d+[.)])\s*)?\[([ xX])\]\s*(.+)$"
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(box))
    scored = F.transform(F.transform(lines, lambda x: F.struct(words(F.regexp_extract(x, box, 2)).alias("w"), (F.lower(F.regexp_extract(x, box, 1)) == "x").alias("done"))),
                         lambda s: F.struct(F.when(F.size(s["w"]) > 0, F.size(F.array_intersect(s["w"], words(draft))) / F.size(s["w"])).otherwise(0.0).alias("o"), s["done"].alias("done")))
    best = F.aggregate(scored, F.struct(F.lit(0.0).alias("o"), F.lit(False).alias("done")), lambda a, s: F.when(s["o"] > a["o"], s).otherwise(a))
    return (best["o"] >= 0.5) & best["done"]


def missed_fires(schedules: DataFrame, now: Column, lookback_days: int) -> DataFrame:
    """(id, cron, last, missed): the first minute after the last completed run, or in the lookback, at which a schedule fired by ``now``; else null.

    A line's fields are parsed once, its first fire is told from the days of the lookback that it takes and its least hour and minute.
    Only where the time zone's offset changes in between, the minutes are tried one by one. A line that does not parse never fires.
    """
    floor = F.greatest(F.coalesce("last", now - F.make_dt_interval(F.lit(lookback_days))), now - F.make_dt_interval(F.lit(lookback_days)))
    begin = F.date_trunc("minute", floor) + F.make_dt_interval(mins=F.lit(1))
    known = F.struct(cron_fields(F.col("cron")).alias("c"), begin.alias("begin"), now.alias("now"))
    return schedules.withColumn("missed", bound(known, lambda s: F.when(s["c"].isNotNull() & (s["begin"] <= s["now"]), F.when(_one_offset(s["begin"], s["now"]), _by_fields(s)).otherwise(_by_minutes(s)))))


def _one_offset(begin: Column, end: Column) -> Column:
    """Whether the session's time zone keeps one offset between two times."""
    offset = lambda t: F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t) - F.unix_seconds(t)
    return (offset(begin) == offset(end)) & F.forall(F.sequence(begin, end, F.make_dt_interval(hours=F.lit(24))), lambda t: offset(t) == offset(begin))


def _by_minutes(s: Column) -> Column:
    return F.get(F.filter(F.sequence(s["begin"], s["now"], F.make_dt_interval(mins=F.lit(1))), lambda t: cron_fires_at(s["c"], t)), F.lit(0))


def _by_fields(s: Column) -> Column:
    """The first fire from ``begin`` to ``now``, by ``begin``'s minute of the day and whole days from it."""
    c, begin = s["c"], s["begin"]
    hour, minute, today = F.hour(begin), F.minute(begin), F.to_date(begin)
    at = lambda h, m: F.when(h.isNotNull() & m.isNotNull(), h * 60 + m)
    earliest = cron_next(c["minute"], F.lit(0), 59)
    in_hour = F.when(cron_takes(c["hour"], hour), at(hour, cron_next(c["minute"], minute, 59)))
    first = F.coalesce(in_hour, at(cron_next(c["hour"], hour + 1, 23), earliest))  # of the day that begin is in
    whole = at(cron_next(c["hour"], F.lit(0), 23), earliest)
    later = F.get(F.filter(F.sequence(F.date_add(today, 1), F.date_add(F.to_date(s["now"]), 1)), lambda d: cron_day(c, d)), F.lit(0))
    ahead = F.coalesce(F.when(cron_day(c, today), first), whole + 1440 * F.datediff(later, today)) - hour * 60 - minute
    fire = begin + F.make_dt_interval(mins=ahead.cast("int"))
    return F.when(fire <= s["now"], fire)
