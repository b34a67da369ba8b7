"""Operators of the knowledge base on small tables with known answers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lattica.functions import columns as C
from lattica.operators import attention, clustering, graph, harvest, layout, retrieval, texts, trees
from lattica.operators.components import connected_components
from lattica.sources import connectors, files

ANCHOR = dt.date(2026, 4, 15)
#: Phrases at the anchor and the deadline that they mean.
DEADLINES = """
due 2026-05-01 -> 2026-05-01
ship by 2026-05 -> 2026-05-31
finalize by April 30 -> 2026-04-30
by Apr 30th -> 2026-04-30
due 30 April -> 2026-04-30
deadline March 1 -> 2027-03-01
send it by January 5, 2027 -> 2027-01-05
by end of April -> 2026-04-30
wrap up by February -> 2027-02-28
commit by Q3 -> 2026-09-30
target Q1 2027 -> 2027-03-31
by q2 -> 2026-06-30
remind me in 1 week -> 2026-04-22
in two weeks -> 2026-04-29
within 3 days -> 2026-04-18
in a month -> 2026-05-15
tomorrow -> 2026-04-16
get it done today -> 2026-04-15
by end of week -> 2026-04-19
end of the month -> 2026-04-30
by EOD -> 2026-04-15
eow -> 2026-04-19
by end of quarter -> 2026-06-30
end of year -> 2026-12-31
next week -> 2026-04-26
next month -> 2026-05-31
by Friday -> 2026-04-17
due Monday -> 2026-04-20
by Wednesday -> 2026-04-22
next Friday -> 2026-04-24
by Friday, April 30 -> 2026-04-30
no deadline here -> 
ticket 2024-8934 blocked -> 
see JIRA-2026-1234 -> 
ref 12026-05-01 is not a date -> 
due 2026-13-01 -> 
in 99999999999 days -> 
in 5000000 weeks -> 
in 999999999 months -> 
due Q3 0000 -> 
"""


def test_deadlines(spark):
    cases = [line.split(" -> ") for line in DEADLINES.strip("\n").split("\n")]
    rows = [(t, ANCHOR, e.strip()) for t, e in cases] + [("", ANCHOR, ""), (None, ANCHOR, ""), ("due 2026-05-01", None, "2026-05-01"), ("Q3 2026", None, "2026-09-30"), ("in 1 week", None, ""), ("by Friday", None, ""), ("by April 30", None, "")]
    got = spark.createDataFrame(rows, "text string, anchor date, want string").withColumn("due", C.resolve_deadline(F.col("text"), F.col("anchor"))).collect()
    assert [(r.text, r.anchor, str(r.due or "")) for r in got] == rows


def test_upsert_actions(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    old = spark.createDataFrame([(1, "a", t(1), 1, "active"), (2, "b", t(5), 3, "deleted_at_source"), (3, "c", t(1), 2, "active"), (4, "d", t(1), 1, "active")], "source_id int, content_hash string, modified timestamp, version int, status string")
    new = spark.createDataFrame([(1, "a", t(9)), (2, "x", t(5)), (3, "y", t(2)), (5, "z", t(1)), (6, None, None)], "source_id int, content_hash string, modified timestamp")
    got = {r.source_id: (r.action, r.version, r.status, r.content_hash) for r in harvest.upsert_actions(old, new).collect()}
    assert got == {1: ("unchanged", 1, "active", "a"), 2: ("unchanged", 3, "active", "b"), 3: ("updated", 3, "active", "y"), 4: ("unlisted", 1, "active", "d"), 5: ("new", 1, "active", "z"), 6: ("new", 1, "active", None)}


def test_sticky_new(spark):
    log = [(1, "s", 1, "new"), (2, "s", 1, "updated"), (1, "s", 2, "new"), (2, "s", 2, "deleted"), (3, "s", 2, "updated"), (4, "s", 3, None)]
    got = harvest.latest_changes(spark.createDataFrame(log, "pos int, source string, id int, change string").withColumn("ts", F.lit(None).cast("timestamp"))).collect()
    assert {r.id: r.change for r in got} == {1: "new", 2: "updated"}


def test_calibration(spark):
    raw = [410, 300, 220, 180, 130, 95, 70, 60, 55, 50]
    got = attention.calibrate(spark.createDataFrame([(str(r), float(r)) for r in raw] + [("zero", 0.0)], "region_id string, raw double")).collect()
    by = {r.region_id: (r.score, r.level) for r in got}
    scores = [by[str(r)][0] for r in raw]
    assert scores == sorted(scores, reverse=True) and by["zero"] == (0.0, "none")
    levels = [by[str(r)][1] for r in raw]
    assert levels.count("critical") <= 5 and len(set(levels)) >= 3


def test_diverse_trim_keeps_floors(spark):
    rows = [(i, f"s{i}", "r", kind, f"t{i}", 90 - i, "open") for i, kind in enumerate(["risk"] * 10 + ["todo"] * 5 + ["decision"] * 3 + ["owner"])]
    got = attention.diverse_trim(spark.createDataFrame(rows, "seq int, id string, region_id string, kind string, title string, severity int, status string"), 12).orderBy("pos").collect()
    kinds = [r.kind for r in got]
    assert len(got) == 12 and kinds[:4] == ["risk"] * 4 and kinds.count("todo") == 3 and kinds.count("decision") == 2 and "owner" in kinds


@pytest.mark.parametrize(("days", "bucket"), [(-91, "probably_abandoned"), (-90, "overdue"), (-1, "overdue"), (0, "due_soon"), (7, "due_soon"), (8, "upcoming"), (None, "no_date")])
def test_buckets(spark, days, bucket):
    due = None if days is None else ANCHOR + dt.timedelta(days=days)
    row = spark.createDataFrame([(due, ANCHOR)], "due date, today date").select(C.due_bucket(F.col("due"), F.col("today")).alias("b"), C.deadline_boost(F.col("due"), F.col("today")).alias("n")).first()
    assert row.b == bucket and row.n == {"overdue": 25, "due_soon": 15}.get(bucket, 0)


def test_tree(spark):
    nodes = spark.createDataFrame([("root", None, "R"), ("a", "root", "A"), ("b", "root", "B"), ("c", "a", "C"), ("other", None, "O")], "node_id string, parent_id string, name string")
    closure = trees.ancestors(nodes)
    assert {(r.node_id, r.ancestor_id) for r in closure.collect() if r.distance} == {("a", "root"), ("b", "root"), ("c", "a"), ("c", "root")}
    assert {r.node_id: r.path for r in trees.paths(nodes, closure).collect()}["c"] == "R > A > C"


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 7)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, 7: 5}
    assert connected_components(edges.limit(0)).count() == 0


def test_cosine_rules(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [round(r.c, 6) for r in frame.select(C.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.707107, 0.0, 0.0, 0.0]


def test_merge_tiny_fold(spark):
    frame = spark.createDataFrame([([50, 200, 30, 40, 100],), ([],), ([500],), ([10],)], "s array<int>")
    assert [list(r.m) for r in frame.select(texts.merged_sizes(F.col("s"), 120).alias("m")).collect()] == [[250, 170], [], [500], [10]]


def test_sections_and_signal_lines(spark):
    text = "intro\n# One\nbody\n### Deep\nx\n## Two\ny\n# Three\nz"
    got = texts.sections(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("section").collect()
    assert [list(r.path) for r in got] == [[], ["One"], ["One", "Deep"], ["One", "Two"], ["Three"]]
    lines = "- Dana to clarify the renewal risk before Friday\n- Risk: it may cause losing the contract renewal\n- Should we expose this to all of them?\n- Decision: do not use the old branch\n| a | table | row |\nshort\nowner: Kim Lee"
    got = texts.signal_lines(spark.createDataFrame([(1, lines)], "id int, t string"), "id", "t").orderBy("line_no").collect()
    assert [(r.kind, r.owner) for r in got] == [("todo", "Dana"), ("risk", None), ("open_question", None), ("decision", None), ("todo", "Kim Lee")]
    assert got[1].severity == 94


def test_html():
    assert texts.html_text("<p>a<b>b</b><br>c</p><script>x</script><pre>  k\n</pre><p>d") == "ab\nc\n  k\n\nd".replace("\n\nd", "\nd")
    assert texts.html_text(None) is None


def test_density_clusters():
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (12, 4)) for c in (0, 3, 6)] + [rng.uniform(-20, 20, (3, 4)) + 40])
    labels = clustering.density_labels(x)
    assert len(set(labels[:36]) - {-1}) == 3 and all(len(set(labels[k : k + 12])) == 1 for k in (0, 12, 24))
    moved = rng.permutation(len(x))
    again = clustering.density_labels(x[moved])
    assert {frozenset(np.flatnonzero(labels == k)) for k in set(labels) - {-1}} == {frozenset(moved[np.flatnonzero(again == k)]) for k in set(again) - {-1}}
    assert (clustering.density_labels(x[:4]) == -1).all()


def test_greedy_matching(spark):
    pairs = [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.4), ("c", "y", 0.5), ("d", "y", 0.5)]
    got = {(r.a, r.b) for r in clustering.greedy_matches(spark.createDataFrame(pairs, "a string, b string, score double")).collect()}
    assert got == {("a", "x"), ("c", "y")}


def test_canonical_labels(spark):
    rows = [("Project Phoenix",), ("the project phoenix",), ("Project Phoenixx",), ("[[Alpha]]",), ("alpha",), ("Zebra",)]
    got = {r.label: r.canonical for r in clustering.canonical_labels(spark.createDataFrame(rows, "label string")).collect()}
    assert got["Project Phoenix"] == got["Project Phoenixx"] == got["the project phoenix"] == "the project phoenix"
    assert got["alpha"] == "[[Alpha]]" and got["Zebra"] == "Zebra"


def test_grid_and_positions(spark):
    grid = layout.hex_grid(spark, 20.0, 2.0)
    assert grid.count() == grid.select("q", "r").distinct().count() and grid.filter("abs(x) > 20 or abs(z) > 20").isEmpty()
    regions = spark.createDataFrame([(1, -8.0, 0.0, 9.0), (2, 8.0, 0.0, 9.0)], "region int, cx double, cz double, radius double")
    owned = layout.own_hexes(grid, regions, 0.0)
    assert {r.region for r in owned.collect()} == {1, 2, None}
    centres = spark.createDataFrame([("a", [1.0, 0.0], 9), ("b", [0.0, 1.0], 3), ("c", [0.7, 0.7], 2)], "region string, centroid array<double>, n int")
    got = {r.region: (r.x, r.z) for r in layout.semantic_positions(centres, 100.0).collect()}
    assert got["a"] == (0.0, 0.0) and max(abs(v) for p in got.values() for v in p) <= 100.001


def test_label_propagation_and_context(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (8, 9, 1.0)], "a int, b int, weight double")
    got = {r.id: r.label for r in graph.label_propagation(edges).collect()}
    assert got[1] == got[2] == got[3] and {got[8], got[9]} <= {8, 9}
    nodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (5, [1.0, 0.0])], "id int, vector array<double>")
    got = {r.id: [round(x, 6) for x in r.context] for r in graph.context_vectors(nodes, edges, 2).collect()}
    assert got[1] == [0.707107, 0.707107] and got[5] == [1.0, 0.0]


def test_budget(spark):
    rows = [(1, i, "n", "x" * 30) for i in range(5)]
    got = retrieval.within_budget(spark.createDataFrame(rows, "g int, k int, item string, text string"), "g", [F.col("k")], "text", "item", 3, 70).collect()
    assert sorted(len(r.text) for r in got) == [10, 30, 30]


def test_vault(spark, tmp_path):
    vault = tmp_path / "vault"
    (vault / "sub").mkdir(parents=True)
    (vault / ".hidden").mkdir()
    (vault / "a.md").write_text("---\ntitle: First note\ntags: [x, '#y']\n---\nBody ![[pic.txt]]")
    (vault / "sub" / "b.md").write_text("no header")
    (vault / "sub" / "pic.txt").write_text("p")
    (vault / ".hidden" / "c.md").write_text("h")
    (vault / "draft-d.md").write_text("d")
    found = files.scan_folders(spark, {"v": str(vault)}, ignore=["^draft-"])
    notes = {r.source_id: r for r in files.list_notes(found).collect()}
    assert set(notes) == {"a.md", "sub/b.md", "sub/pic.txt"}
    assert notes["a.md"].title == "First note" and list(notes["a.md"].tags) == ["x", "y"] and notes["a.md"].body == "Body ![[pic.txt]]"
    assert notes["sub/b.md"].title == "b" and list(notes["sub/b.md"].container) == ["sub"]
    assert {r.format: r.n for r in files.count_formats(found).collect()} == {"md": 2, "txt": 1}
    assert [r.target for r in files.attachments(files.list_notes(found), found).collect()] == ["pic.txt"]


def test_log_and_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    entries = spark.createDataFrame([("harvested", "s", "1", "new", dt.datetime(2024, 1, 1))], "action string, source string, id string, change string, ts timestamp")
    files.append_log(entries, path)
    files.append_log(entries, path)
    (tmp_path / "log" / "bad.json").write_text("{not json\n")
    assert files.read_log(spark, path, F.lit("2023-01-01").cast("timestamp"), ["harvested"]).count() == 2
    assert files.read_log(spark, path, actions=["skipped"]).isEmpty()
    rows = spark.createDataFrame([("a", 1, [1.0]), ("b", 2, [2.0])], "source_type string, k int, embedding array<double>")
    files.write_store(rows, f"file://{tmp_path}/store")
    files.write_store(rows.filter("k = 1").withColumn("k", F.lit(7)), f"file://{tmp_path}/store")
    assert sorted(r.k for r in spark.read.parquet(f"file://{tmp_path}/store").collect()) == [2, 7]
    for _ in range(2):
        files.publish(rows, f"file://{tmp_path}/map")
    assert spark.read.json(f"file://{tmp_path}/map").columns == ["k", "source_type"]


def test_connectors(spark, tmp_path):
    def read(payload, schema):
        path = tmp_path / "payload.json"
        path.write_text(json.dumps(payload))
        return connectors.read_payloads(spark, f"file://{path}", schema)

    page = {"id": "7", "title": "T", "status": "current", "space": {"key": "K"}, "version": {"when": "2024-01-01T00:00:00Z", "number": 3}, "ancestors": [{"id": "1", "title": "Top"}], "_links": {"webui": "/x"}}
    row = connectors.pages(read({"results": [page]}, connectors.PAGES)).first()
    assert (row.source_id, row.space, row.version, list(row.container), row.parent_id) == ("7", "K", 3, ["Top"], "1")
    adf = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "hi"}]}, {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "x"}]}]}]}]}
    issue = {"id": "1", "key": "A-1", "fields": {"summary": "S", "status": {"name": "Open"}, "project": {"key": "A"}, "updated": "2024-02-01T10:00:30Z", "issuetype": {"name": "Bug"}, "labels": ["l"], "description": json.dumps(adf)}}
    issues = connectors.issues(read({"issues": [issue]}, connectors.ISSUES))
    assert issues.filter(connectors.issue_filter(["A"], F.lit("2024-02-01 10:00:45").cast("timestamp"))).count() == 1 and issues.filter(connectors.issue_filter(["B"], None)).isEmpty()
    assert issues.select(connectors.adf_text(F.col("description")).alias("t")).first().t == "hi\n- x"
    mail = {"id": "t", "snippet": "s", "messages": [
        {"internalDate": "1704067260000", "labelIds": ["B"], "payload": {"headers": [{"name": "Subject", "value": "Re: hi"}, {"name": "From", "value": "Bo <bo@x.org>"}, {"name": "To", "value": "al@x.org, cy@x.org"}], "parts": [{"mimeType": "text/plain", "body": {"data": "aGVsbG8="}}]}},
        {"internalDate": "1704067200000", "labelIds": ["A"], "payload": {"headers": [{"name": "Subject", "value": "hi"}, {"name": "From", "value": "al@x.org"}, {"name": "To", "value": "bo@x.org"}], "body": {"data": "Zmlyc3Q="}}},
    ]}
    row = connectors.mail_threads(read(mail, connectors.MAIL)).first()
    assert (row.subject, row.from_addr, row.message_count, row.first_at, list(row.labels)) == ("Re: hi", "bo@x.org", 2, "2024-01-01T00:00:00Z", ["A", "B"])
    assert row.markdown == "### al@x.org\n\nfirst\n\n### Bo <bo@x.org>\n\nhello" and list(row.to_addrs) == ["bo@x.org", "al@x.org", "cy@x.org"]
    messages = spark.createDataFrame([("c", "1.0", None, "u", "root", [("ok", 2)]), ("c", "2.0", "1.0", "v", "reply", None), ("c", "1.0", None, "u", "root", [("ok", 2)])], connectors.MESSAGES)
    names = spark.createDataFrame([("u", "Uma")], "user string, name string")
    row = connectors.chat_threads(messages, names).first()
    assert (row.reply_count, list(row.participants), row.reactions, row.markdown) == (1, ["Uma", "v"], 2, "**Uma:** root\n\n**v:** reply")
    assert connectors.thread_starters(messages).count() == 1 and connectors.channel_days(messages).first().n_messages == 2


def test_plugin_source(spark):
    connectors.register_plugin(spark, "demo", lambda options: [[{"source_id": "1", "title": options["title"]}], [{"source_id": "2", "title": "b"}]])
    got = connectors.read_plugin(spark, "demo", ["demo"], title="a")
    assert {(r.source_id, r.title) for r in got.collect()} == {("1", "a"), ("2", "b")}
    assert connectors.read_plugin(spark, "demo", [], title="a").isEmpty()


def test_entry_and_oracles_match_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_code_envelopes(spark, tmp_path):
    item = {"number": 3, "title": "T", "body": "B", "state": "closed", "user": {"login": "u"}, "labels": [{"name": "l"}], "updated_at": "2024-01-02T00:00:00Z", "merged_at": "2024-01-02T00:00:00Z", "additions": 4, "deletions": 1, "pull_request": {"url": "x"}}
    payload = {"repo": "o/r", "item": item, "comments": [{"user": {"login": "v"}, "body": "ok"}], "reviews": [{"user": {"login": "w"}, "state": "APPROVED"}]}
    (tmp_path / "e.json").write_text(json.dumps(payload))
    rows = connectors.code_envelopes(connectors.read_payloads(spark, f"file://{tmp_path}/e.json", connectors.ENVELOPES))
    r = rows.first()
    assert (r.source_id, r.kind, r.approvals, r.merged, r.changed_lines, list(r.participants)) == ("o/r#3", "pr", 1, True, 5, ["u", "v"])
    assert r.markdown == "# T\n\nB\n\n**v:** ok"


def test_block_trees(spark):
    text = lambda s, **a: [{"plain_text": s, "annotations": a}]
    blocks = [
        {"type": "heading_1", "heading_1": {"rich_text": text("Top")}}, {"type": "to_do", "to_do": {"checked": True, "rich_text": text("did", bold=True)}, "children": [{"type": "paragraph", "paragraph": {"rich_text": text("under")}}]},
        {"type": "table", "table": {}, "children": [{"table_row": {"cells": [text("a"), text("b")]}}, {"table_row": {"cells": [text("1"), text("2")]}}]}, {"type": "image", "image": {"external": {"url": "http://i"}}},
    ]
    props = {"Name": {"type": "title", "title": text("N")}, "Tags": {"type": "multi_select", "multi_select": [{"name": "x"}, {"name": "y"}]}, "Due": {"type": "date", "date": {"start": "2024-01-01"}}, "Empty": {"type": "select", "select": None}, "Sum": {"type": "rollup", "rollup": {"type": "number", "number": 4}}}
    frame = spark.createDataFrame([(json.dumps(blocks), json.dumps(props)), ("oops", None)], "b string, p string")
    got = frame.select(connectors.blocks_markdown(F.col("b")).alias("m"), connectors.block_attachments(F.col("b")).alias("a"), connectors.properties(F.col("p")).alias("p")).collect()
    assert got[0].m == "# Top\n- [x] **did**\n  under\n| a | b |\n| --- | --- |\n| 1 | 2 |\n[image](http://i)" and list(got[0].a) == ["http://i"]
    assert got[0].p == {"Name": "N", "Tags": "x, y", "Due": "2024-01-01", "Sum": "4"}
    assert got[1].m is None and got[1].p is None
    rows = spark.createDataFrame([("db", "B", {"k": "2"}), ("db", "A", {})], "db string, title string, p map<string, string>")
    assert connectors.rows_markdown(rows, "db", "title", "p", ["k"]).first().markdown == "| title | k |\n| --- | --- |\n| A |  |\n| B | 2 |"


def test_table_segments_and_mentions(spark):
    from lattica.operators import compile as K

    text = "one two three\n| a | b |\n| c | d |\nfour five\nsix\nseven"
    got = spark.createDataFrame([(text,), ("",)], "t string").select(K.table_segments(F.col("t"), 3).alias("s")).collect()
    assert [list(x) for x in got[0].s] == [["one two three"], ["| a | b |", "| c | d |", "four five"], ["six", "seven"]] and [list(x) for x in got[1].s] == [[""]]
    assert spark.createDataFrame([("a\n[child_page] x\nb",)], "t string").select(K.drop_lines(F.col("t"), r"^\[child_").alias("t")).first().t == "a\nb"
    rows = spark.createDataFrame([(1, "<@U1> and <@U9>: see <https://x.org|this> in <#C1|dev> &lt;b&gt;"), (2, "plain"), (3, None)], "id int, text string")
    got = {r.id: r.text for r in K.rewrite_mentions(rows, spark.createDataFrame([("U1", "Uma")], "user string, name string")).collect()}
    assert got == {1: "@Uma and @U9: see [this](https://x.org) in #dev <b>", 2: "plain", 3: None}


def test_xhtml_markdown():
    from lattica.sources.xhtml import markdown

    page = (
        '<h2>Plan</h2><p>A <strong>bold</strong> <a href="u">link</a><br/>x</p><ul><li>one<ul><li>two</li></ul></li><li>three</li></ul><ol><li>a</li><li>b</li></ol>'
        '<table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td><p>2</p></td></tr></table>'
        '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[x = 1 < 2]]></ac:plain-text-body></ac:structured-macro>'
        '<ac:structured-macro ac:name="info"><ac:rich-text-body><p>careful</p></ac:rich-text-body></ac:structured-macro>'
        '<p><ac:structured-macro ac:name="status"><ac:parameter ac:name="title">Done</ac:parameter></ac:structured-macro> <ac:structured-macro ac:name="jira"><ac:parameter ac:name="key">A-1</ac:parameter></ac:structured-macro> '
        '<ac:link><ri:user ri:display-name="Uma"/></ac:link> <ac:image ac:alt="pic"><ri:attachment ri:filename="p.png"/></ac:image> <ac:emoticon ac:name="smile"/></p><p>open'
    )
    want = [
        "## Plan", "", "A **bold** [link](u)", "x", "", "- one", "  - two", "- three", "", "1. a", "2. b", "", "| h | i |", "| --- | --- |", "| 1 | 2 |", "", "```py", "x = 1 < 2", "```", "", "> ℹ️", "> careful", "",
        "[STATUS: Done] [A-1](https://w/browse/A-1) @Uma ![pic](p.png) :smile:", "", "open",
    ]
    assert markdown(page, "https://w/").split("\n") == want
    assert markdown(None) is None and markdown("") == ""


def test_event_and_day_markdown(spark):
    rows = [("e", "Sync", "confirmed", dt.datetime(2024, 1, 1, 9), 30, "o@x.org", ["a@x.org"], False)]
    frame = spark.createDataFrame(rows, "source_id string, title string, status string, begin timestamp, minutes long, organizer string, attendees array<string>, all_day boolean")
    assert connectors.event_markdown(frame).first().markdown == "# Sync\n\n**When:** 2024-01-01 09:00 – 09:30\n**Organizer:** o@x.org\n**Attendees:**\n- a@x.org"
    messages = spark.createDataFrame([("dev", "60.0", None, "u", "root\nline", None), ("dev", "120.0", "60.0", "v", "", None), ("dev", "180.0", None, "u", "x" * 200, None)], connectors.MESSAGES)
    got = connectors.channel_day_markdown(messages, spark.createDataFrame([("u", "Uma")], "user string, name string")).first().markdown.split("\n")
    assert got[0] == "# dev — 1970-01-01 (3 messages, 2 people)" and sorted(got[2:]) == sorted(["- **00:01 Uma**: root line", "  - **00:02 v**: (no text)", "- **00:03 Uma**: " + "x" * 139 + "…"])


def test_islands_rings_and_shares(spark):
    grid = layout.hex_grid(spark, 20.0, 2.0).cache()
    hexes = [(r.q, r.r) for r in grid.collect()]
    away = lambda a, b: max(abs(a[0] - b[0]), abs(a[1] - b[1]), abs(a[0] + a[1] - b[0] - b[1]))
    owner = {h: 1 if h[0] + h[1] / 2 < 0 else 2 for h in hexes}
    owner[(-3, 0)] = 2  # an exclave
    owner[(3, 0)] = None  # a lake
    for h in hexes:
        if away(h, (0, 0)) >= 5:
            owner[h] = None
    frame = spark.createDataFrame([(q, r, owner[q, r]) for q, r in hexes], "q int, r int, region int")
    got = {(r.q, r.r): r.region for r in layout.clean_islands(frame, 2, 2).collect()}
    assert got == owner | {(-3, 0): 1, (3, 0): 2}
    seeds = spark.createDataFrame([(0, 0, 7)], "q int, r int, claim int")
    got = {(r.q, r.r): r.ring for r in layout.rings(grid, seeds, 3).collect()}
    assert got == {h: away(h, (0, 0)) for h in hexes if away(h, (0, 0)) <= 3}
    regions = spark.createDataFrame([(1, -5.0, 0.0, 3.0), (2, 5.0, 0.0, 1.0)], "region int, cx double, cz double, weight double")
    owned = layout.balanced_owners(grid, regions, 0.0)
    share = owned.filter("region = 1").count() / len(hexes)
    assert owned.count() == len(hexes) and 0.65 < share < 0.85
