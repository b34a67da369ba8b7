"""Stores, flat graph, payloads, schedules, ranks and splits on odd rows, each against a plain rule."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import display
from lattica.operators import clustering, graph, ranking, retrieval, serve, stores, strategies, trees
from lattica.sources import connectors, mail


def test_positions_and_running_sums(spark):
    rng = random.Random(1)
    values = [(i, rng.choice([None, 1, 2, 3]), rng.randrange(50)) for i in range(500)]
    rows = spark.createDataFrame(values, "id long, k int, v long")
    order = sorted(values, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = {r.id: r.pos for r in ranking.positions(rows, [(F.col("k"), "desc_nulls_last"), F.col("id")]).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}
    sums = {r.id: r.s for r in ranking.running(rows, [F.col("id")], {"s": "v"}).collect()}
    total = 0
    for i, _, v in values:
        total += v
        assert sums[i] == total
    assert ranking.positions(rows.limit(0), [F.col("id")]).count() == 0


def test_auc_of_ties_and_one_class(spark):
    rows = spark.createDataFrame([(1, True), (1, False), (2, True), (0, False)], "score int, positive boolean")
    assert retrieval.auc(rows).first().auc == 0.875
    assert retrieval.spearman(spark.createDataFrame([(1, 10), (2, 20), (3, 25)], "a int, b int"), "a", "b").first().rho == 1.0


@pytest.mark.parametrize("block", [200, 3])
def test_cooccurrence_by_blocks(spark, block):
    links = spark.createDataFrame([(k, t) for k in range(3) for t in range(10 - k)] + [(9, 1)], "note_id int, tag_id int")
    got = {(r.a, r.b): r.n for r in graph.cooccurrence(links, block=block).collect()}
    assert got == {(a, b): sum(1 for k in range(3) if b < 10 - k) for a in range(10) for b in range(a + 1, 10)}


def test_communities_end_at_a_fixed_point(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (4, 5, 1.0), (5, 6, 1.0), (4, 6, 1.0)], "a long, b long, weight double")
    got = {r.id: r.label for r in graph.label_propagation(edges).collect()}
    assert len({got[1], got[2], got[3]}) == 1 and len({got[4], got[5], got[6]}) == 1 and got[1] != got[4]


def test_groups_beyond_the_limit_are_cut(spark):
    rng = random.Random(2)
    rows = [(i, 0, [float(i % 2) * 9 + rng.random(), float(i // 2 % 2) * 9 + rng.random()]) for i in range(60)] + [(100 + i, 1, [0.0, 0.0]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, g int, embedding array<double>")
    parts = clustering.bisected(frame, "g", limit=25).groupBy("g", "__part").count().collect()
    assert all(r["count"] <= 25 for r in parts) and sum(r["count"] for r in parts) == 100
    found = clustering.density_clusters(frame, "g", limit=45).collect()
    assert len(found) == 100 and len({(r.g, r.cluster) for r in found if r.cluster >= 0}) >= 2
    leaves = clustering.recursive_split(frame.filter("g = 0").withColumn("embedding", F.transform("embedding", lambda x: x - 4.5)), "g", 2).collect()
    assert len(leaves) == 60 and len({r.node for r in leaves}) >= 2


def test_canonical_labels_keep_every_close_pair(spark):
    from difflib import SequenceMatcher

    rng = random.Random(3)
    words = ["quarterly planning", "customer onboarding", "release calendar", "incident review"]
    labels = sorted({"".join(c if rng.random() > 0.04 else rng.choice("xyz") for c in w) for w in words for _ in range(12)} | {"a", "ab"})
    got = {r.label: r.canonical for r in clustering.canonical_labels(spark.createDataFrame([(x,) for x in labels], "label string")).collect()}
    for a in labels:
        for b in labels:
            if a < b and SequenceMatcher(a=a, b=b).ratio() >= 0.85:
                assert got[a] == got[b]


def test_mime_nesting_and_odd_payloads(spark):
    deep = '{"mimeType":"text/plain","body":{"data":"ZGVlcA=="}}'
    for _ in range(5):
        deep = '{"mimeType":"multipart/mixed","parts":[' + deep + "]}"
    latin = '{"mimeType":"text/plain","headers":[{"name":"content-type","value":"text/plain; charset=ISO-8859-1"}],"body":{"data":"4fo"}}'
    rows = [(1, deep), (2, latin), (3, "not json"), (4, None), (5, '{"mimeType":"image/png","body":{"attachmentId":"x"}}')]
    parts = mail.mime_parts(spark.createDataFrame(rows, "id long, payload string"))
    assert {r.id: r.text for r in mail.best_text(parts).collect()} == {1: "deep", 2: "áú"}
    assert {r.id: r.markdown for r in mail.mail_markdown(parts).collect()} == {1: "deep", 2: "áú", 5: "[attachment: (unnamed)]"}


def test_cron_lines(spark):
    lines = [("*/15 9-10 * * 0-4", "2024-03-04 09:30:00", True), ("*/15 9-10 * * 0-4", "2024-03-04 09:31:00", False), ("0 0 1 1,7 *", "2024-07-01 00:00:00", True), ("0 0 1 1,7 *", "2024-06-01 00:00:00", False), ("5/10 * * * *", "2024-06-01 03:25:00", True), ("nonsense", "2024-06-01 03:25:00", False)]
    frame = spark.createDataFrame([(c, t, w) for c, t, w in lines], "cron string, at string, want boolean")
    assert frame.filter(display.cron_fires(F.col("cron"), F.col("at").cast("timestamp")) != F.col("want")).count() == 0
    schedules = spark.createDataFrame([(1, "0 6 * * *", None), (2, "bad line", None)], "id int, cron string, last timestamp")
    got = {r.id: r.missed for r in serve.missed_fires(schedules, F.lit("2024-03-05 10:30:00").cast("timestamp"), 2).collect()}
    assert str(got[1]) == "2024-03-04 06:00:00" and got[2] is None


def test_stores_on_unknown_null_and_repeated_keys(spark):
    manifest = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "source_id long, metadata string")
    updates = spark.createDataFrame([(2, None), (7, "x"), (None, "y")], "source_id long, metadata string")
    assert {r.source_id: r.metadata for r in stores.overwrite_metadata(manifest, updates).collect()} == {1: "a", 2: None, None: "c"}
    chunks = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("b", "d1")], "id string, doc_id string")
    assert [list(r.chunk_ids) for r in stores.chunk_index(chunks).collect()] == [["a", "b"]]
    ids = spark.createDataFrame([(0, "b"), (1, "zz"), (2, "a")], "pos int, id string")
    assert [(r.pos, r.id) for r in stores.chunks_by_ids(chunks.distinct(), ids).orderBy("pos").collect()] == [(0, "b"), (2, "a")]


def test_registry_and_walks(spark):
    docs = spark.createDataFrame([(1, "x", "a\n\nb"), (2, None, "one two three"), (3, "y", ""), (4, "x", None)], "doc_id long, source string, text string")
    registry = strategies.Registry(strategies.by_words(2))
    registry.register("x", strategies.by_lines)
    assert sorted((r.doc_id, r.pos, r.content) for r in registry.apply(docs, "source").collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "one two"), (2, 1, "three")]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent_id string, node_id string")
    assert {(r.node_id, r.depth) for r in trees.walk_down(edges, spark.createDataFrame([("a",)], "node_id string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_issue_without_fields(spark):
    rows = spark.createDataFrame([('{"key":"A-1"}',), ('{"key":"A-2","fields":{"summary":"say \\"hi\\""}}',)], "j string").select(F.from_json("j", connectors.ISSUE).alias("i")).select("i.*")
    got = {r.source_id: r.markdown for r in connectors.issue_markdown(rows).collect()}
    assert got["A-1"] == '---\nkey: "A-1"\n---\n# A-1\n\n## Description\n(no description)\n'
    assert 'summary: "say \\"hi\\""' in got["A-2"] and "# A-2 — say \"hi\"" in got["A-2"]


def _pairs_scored(df, ask):
    """Every (query_id, id, cosine) by the column expression, row by row."""
    from lattica.functions.columns import cosine

    q = ask.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return [(r.query_id, r.id, r.s) for r in df.crossJoin(q).select("query_id", F.col("vec_id").alias("id"), F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("s")).collect()]


def test_search_meets_queries_as_matrices(spark, monkeypatch):
    """Odd vectors, repeated ids and ties score as by the column expression, and no plan pairs rows with queries one by one."""
    monkeypatch.setattr(retrieval, "TILE", 16)
    monkeypatch.setattr(retrieval, "TASK_ROWS", 50)
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(150)]
    rows += [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 2.0]), (204, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (7, [1.0, 0.0, 1.0]), (7, [0.0, 1.0, 1.0]), (210, [float("nan"), 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = df.filter("vec_id % 10 = 0 or vec_id > 199 or vec_id = 7")
    number = lambda s: (0, 0.0) if s != s else (1, -s)
    scored = _pairs_scored(df, ask)
    for floor, found in ((0.0, retrieval.search(df, ask, 5, 0.0)), (0.4, retrieval.search(df, ask, 5, 0.4))):
        want = []
        for a in {a for a, _, _ in scored}:
            mine = sorted((number(s), i) for b, i, s in scored if b == a and i is not None and i != a and (s != s or s >= floor))
            want += [(a, i, n, round(-s, 6) if known else None) for n, ((known, s), i) in enumerate(mine[:5], 1)]
        got = [(r.query_id, r.id, r.rank, None if r.score != r.score else r.score) for r in found.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    kept = {}
    for r in retrieval.candidates(df, ask, 9).collect():
        kept.setdefault(r.query_id, []).append((number(r.semantic), -1 if r.id is None else r.id))
    assert {a: sorted(v) for a, v in kept.items()} == {a: sorted((number(s), -1 if i is None else i) for b, i, s in scored if b == a)[:9] for a in kept} and len(kept) == len({a for a, _, _ in scored})
    for made in (retrieval.search(df, ask, 5, 0.0), retrieval.candidates(df, ask, 9)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "MapInArrow" in plan


def test_hit_rate_deals_out_no_wanted_rows(spark):
    """What is wanted, many rows a question, stays where it is: the results go to it."""
    wanted = spark.createDataFrame([(q, i) for q in range(4) for i in range(30)] * 2 + [(9, None)], "query_id long, id long")
    found = spark.createDataFrame([(0, 5, 2), (0, 6, 3), (1, 99, 1), (2, 7, 1), (8, 1, 1)], "query_id long, id long, rank int")
    rate = retrieval.hit_rate(found, wanted)
    assert tuple(rate.first()) == (5, 2, 0.4, 1.5)
    plan = rate._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "Australia/Lord_Howe"])
def test_missed_fires_are_told_from_the_fields(spark, zone):
    """Against every minute tried, with odd lines, seconds, future runs and a change of the zone's offset; the plan makes no minutes by itself in UTC."""
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    lines = ["* * * * *", "0 6 * * *", "30 2 * * *", "*/15 9-10 * * 0-4", "5/10 23 * * *", "59 23 31 3 *", "0 0 1 4 *", "7,9-11/2,50 */5 * 3,4 6", "61 * * * *", "* 24 * * *", "0 0 * * 7", "1,x * * * *", "*/0 * * * *", "*/x 1 * * *", "a b c d e", "1 2 3", "", None, "0 0 5/2147483647 * *", "45-10 3 * * *", " 10  2 * *  * "]
    rng, zoned = random.Random(4), ZoneInfo(zone)
    now = {"UTC": datetime(2024, 3, 5, 10, 30), "Europe/Berlin": datetime(2024, 3, 31, 4, 30), "Australia/Lord_Howe": datetime(2024, 4, 7, 1, 0)}[zone].replace(tzinfo=timezone.utc)
    rows = [(n * 100 + i, line, None if i == 0 else int(now.timestamp()) + 90 - rng.randrange(60 * 60 * 60)) for n, line in enumerate(lines) for i in range(5)]

    def takes(field, value, low):
        for part in field.split(","):
            span, _, step = part.partition("/")
            begin, end = (low, 1 << 20) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[1]) if "-" in span else 1 << 20 if step else int(span))
            if begin <= value <= end and (value - begin) % int(step or 1) == 0:
                return True
        return False

    def plain(line, last):
        if line in (None, "", "1 2 3", "a b c d e", "*/0 * * * *", "*/x 1 * * *", "1,x * * * *"):
            return None
        floor = (now.astimezone(zoned) - timedelta(days=2)).astimezone(timezone.utc)  # days of the calendar, as Spark's intervals
        t = max(floor, datetime.fromtimestamp(last, timezone.utc) if last else floor).replace(second=0) + timedelta(minutes=1)
        while t <= now:
            w = t.astimezone(zoned)
            if all(takes(f, v, low) for f, v, low in zip(line.split(), (w.minute, w.hour, w.day, w.month, w.weekday()), (0, 0, 1, 1, 0))):
                return int(t.timestamp())
            t += timedelta(minutes=1)
        return None

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame(rows, "id int, cron string, s long").withColumn("last", F.timestamp_seconds("s"))
        missed = serve.missed_fires(frame, F.timestamp_seconds(F.lit(int(now.timestamp()))), 2)
        got = {r.id: r.missed for r in missed.select("id", F.unix_seconds("missed").alias("missed")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {i: plain(line, s) for i, line, s in rows}
    assert len(set(got.values())) > 12


def test_missed_fires_work_grows_with_the_rows_only(spark):
    """A lookback of 400 days takes about as long as one of two: no minutes are made."""
    import time

    rows = spark.range(3000).select(F.col("id"), F.concat((F.col("id") % 60).cast("string"), F.lit(" 3 29 2 *")).alias("cron"), F.lit(None).cast("timestamp").alias("last"))
    began = time.time()
    out = serve.missed_fires(rows, F.lit("2025-02-27 10:30:00").cast("timestamp"), 400).agg(F.count("missed").alias("n")).first()
    assert out.n == 3000 and time.time() - began < 40
