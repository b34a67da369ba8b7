"""Queries of the connectors' readers, the folder sources, the sinks and the map's steps over rows built from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import columns as C
from lattica.operators import compile as K
from lattica.operators import layout, serve, texts
from lattica.plans.knowledge_queries import ORACLE, QUERIES, text_of
from lattica.plans.queries import query, with_
from lattica.session import shared_dir, table
from lattica.sources import connectors, files, xhtml
from lattica.sources import derived as D

__all__ = ["ORACLE", "QUERIES"]


def parsed(rows: DataFrame, json, schema: str) -> DataFrame:
    return rows.select(F.from_json(json, schema).alias("p")).select("p.*")


# Trackers, mail, chat, calendars --------------------------------------------------------------------------------------


@query("""SELECT c_custkey::VARCHAR AS source_id, c_name AS title, 'N' || c_nationkey AS space, (c_custkey % 7)::INT AS version, '/x/' || c_custkey AS url, CASE WHEN c_custkey % 2 = 0 THEN 'Top > ' || c_mktsegment ELSE 'Top' END AS container, CASE WHEN c_custkey % 2 = 0 THEN 's' || c_nationkey ELSE 't' END AS parent_id, 'current' AS status FROM customer""")
def listed_pages(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    page = text_of(
        '{"id":"', k, '","title":"', F.col("c_name"), '","status":"current","space":{"key":"N', F.col("c_nationkey"), '"},"version":{"number":', k % 7, '},"ancestors":[{"id":"t","title":"Top"}',
        F.when(k % 2 == 0, text_of(',{"id":"s', F.col("c_nationkey"), '","title":"', F.col("c_mktsegment"), '"}')).otherwise(""), '],"_links":{"webui":"/x/', k, '"}}')
    listings = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.collect_list(page), ",").alias("l"))
    pages = connectors.pages(parsed(listings, text_of('{"results":[', F.col("l"), "]}"), connectors.PAGES))
    return pages.withColumn("container", F.array_join("container", " > ")).drop("modified")


@query("""SELECT 'P' || (o_custkey % 3) || '-' || o_orderkey AS source_id, o_orderstatus AS status, o_orderpriority AS type, CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE '' END AS labels, CASE WHEN o_orderkey % 3 = 0 THEN 'C' || o_custkey END AS assignee, 'Line ' || o_orderkey || chr(10) || '- item' AS description
FROM orders WHERE o_custkey % 3 < 2 AND o_orderdate >= TIMESTAMP '1996-01-01'""")
def tracker_issues(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    adf = F.replace(text_of('{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"Line ', k, '"}]},{"type":"bulletList","content":[{"type":"listItem","content":[{"type":"text","text":"item"}]}]}]}'), F.lit('"'), F.lit('\\"'))
    issue = text_of(
        '{"key":"P', c % 3, "-", k, '","fields":{"summary":"s","status":{"name":"', F.col("o_orderstatus"), '"},"project":{"key":"P', c % 3, '"},"updated":"', F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), '","issuetype":{"name":"', F.col("o_orderpriority"), '"}',
        F.when(k % 2 == 0, ',"labels":["a","b"]').otherwise(""), F.when(k % 3 == 0, text_of(',"assignee":{"displayName":"C', c, '"}')).otherwise(""), ',"description":"', adf, '"}}')
    answers = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(issue), ",").alias("l"))
    issues = connectors.issues(parsed(answers, text_of('{"issues":[', F.col("l"), "]}"), connectors.ISSUES))
    wanted = issues.filter(connectors.issue_filter(["P0", "P1"], F.lit("1996-01-01 00:00:30").cast("timestamp")))
    return wanted.select("source_id", "status", "type", F.array_join("labels", ",").alias("labels"), "assignee", connectors.adf_text(F.col("description")).alias("description"))


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n, max(turn) OVER (PARTITION BY conv_id) AS last, role FROM conversations)
SELECT 'm' || conv_id AS source_id, 'Turn ' || last AS subject, role || '@x.org' AS from_addr, n AS message_count, strftime(make_timestamp((1704067200 + last * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS last_at, 'L0,T' AS labels FROM t WHERE back = 1 AND n > 1 AND role <> 'system'""")
def mail_thread_rows(spark, sf_dir) -> DataFrame:
    message = text_of(
        '{"internalDate":"', (F.lit(1704067200) + F.col("turn") * 60) * 1000, '","labelIds":["T","L0"],"payload":{"headers":[{"name":"Subject","value":"Turn ', F.col("turn"), '"},{"name":"from","value":"R <', F.col("role"), '@x.org>"},{"name":"To","value":"a@x.org , b@x.org"}],"body":{"data":"aGk="}}}')
    payloads = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.collect_list(message), ",").alias("l"), F.count("*").alias("n")).filter("n > 1")
    threads = connectors.mail_threads(parsed(payloads, text_of('{"id":"m', F.col("conv_id"), '","messages":[', F.col("l"), "]}"), connectors.MAIL))
    kept = threads.filter(connectors.mail_filter(F.lit("2024-01-01T00:00:00Z"), ["T"], ["SPAM"], ["USER@x.org", "assistant@X.org"]))
    return kept.select("source_id", "subject", "from_addr", F.col("message_count").cast("long").alias("message_count"), "last_at", F.array_join("labels", ",").alias("labels"))


CHAT = "m AS (SELECT 'c' || (user_id % 3) AS channel, 1704067200 + event_id AS ts, CASE WHEN event_id % 5 > 0 THEN 1704067200 + event_id - event_id % 5 END AS parent, 'u' || (user_id % 6) AS usr, event_type AS txt, event_id FROM events WHERE user_id % 3 = event_id // 5 % 3)"


def _chat(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("user_id % 3 = int(event_id / 5) % 3")
    ts = lambda c: F.concat(c.cast("string"), F.lit(".0"))
    k = F.col("event_id")
    rows = e.select(
        text_of("c", F.col("user_id") % 3).alias("channel"), ts(F.lit(1704067200) + k).alias("ts"), F.when(k % 5 > 0, ts(F.lit(1704067200) + k - k % 5)).alias("thread_ts"), text_of("u", F.col("user_id") % 6).alias("user"), F.col("event_type").alias("text"),
        F.from_json(F.when(k % 4 == 0, '[{"name":"ok","count":2}]'), "array<struct<name: string, count: int>>").alias("reactions"))
    return rows.unionByName(rows.filter(F.col("user") == "u0"))  # some arrive twice


def _names(spark) -> DataFrame:
    return spark.range(0, 6, 2).select(text_of("u", F.col("id")).alias("user"), text_of("User ", F.col("id")).alias("name"))


NAMED = "n AS (SELECT *, CASE WHEN usr IN ('u0', 'u2', 'u4') THEN 'User ' || usr[2] ELSE usr END AS who, coalesce(parent, ts) AS thread FROM m)"


@query(with_(CHAT, NAMED) + """SELECT channel, thread || '.0' AS thread_ts, count(*) - 1 AS reply_count, string_agg(DISTINCT who, ',' ORDER BY who) AS participants, count(*) FILTER (event_id % 4 = 0) * 2 AS reactions, strftime(make_timestamp(min(ts) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created,
 string_agg('**' || who || ':** ' || txt, chr(10) || chr(10) ORDER BY ts) AS markdown FROM n GROUP BY channel, thread""")
def chat_thread_rows(spark, sf_dir) -> DataFrame:
    t = connectors.chat_threads(_chat(spark, sf_dir), _names(spark))
    return t.select("channel", "thread_ts", "reply_count", F.array_join("participants", ",").alias("participants"), "reactions", "created", "markdown")


@query(with_(CHAT) + "SELECT channel, ts || '.0' AS ts FROM m WHERE parent IS NULL")
def chat_starters(spark, sf_dir) -> DataFrame:
    return connectors.thread_starters(_chat(spark, sf_dir)).select("channel", "ts")


@query(with_(CHAT) + "SELECT channel, make_timestamp(ts * 1000000)::DATE AS day, count(*) AS n_messages, count(DISTINCT usr) AS n_users FROM m GROUP BY 1, 2")
def chat_days(spark, sf_dir) -> DataFrame:
    return connectors.channel_days(_chat(spark, sf_dir))


@query(with_(CHAT, NAMED) + """SELECT channel, make_timestamp(ts * 1000000)::DATE AS day, '# ' || channel || ' — ' || make_timestamp(min(ts) * 1000000)::DATE || ' (' || count(*) || CASE WHEN count(*) = 1 THEN ' message, ' ELSE ' messages, ' END || count(DISTINCT who) || CASE WHEN count(DISTINCT who) = 1 THEN ' person)' ELSE ' people)' END AS head FROM n GROUP BY 1, 2""")
def chat_day_heads(spark, sf_dir) -> DataFrame:
    days = connectors.channel_day_markdown(_chat(spark, sf_dir), _names(spark))
    return days.select("channel", "day", F.get(F.split("markdown", "\n"), F.lit(0)).alias("head"))


def _events(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    times = F.when(k % 3 == 0, text_of('"start":{"date":"', day, '"},"end":{"date":"', F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd"), '"}')).otherwise(text_of('"start":{"dateTime":"', day, 'T09:00:00Z"},"end":{"dateTime":"', day, 'T10:30:00Z"}'))
    guests = F.when(k % 2 == 0, '"attendees":[{"email":"b@x","responseStatus":"accepted"},{"email":"a@x","responseStatus":"declined"}],').otherwise("")
    json = text_of('{"id":"e', k, '","summary":"Order ', k, '","status":"', F.when(k % 10 == 0, "cancelled").otherwise("confirmed"), '","organizer":{"email":"o@x"},', guests, times, "}")
    rows = parsed(table(spark, sf_dir, "orders"), json, connectors.EVENTS)
    return connectors.calendar_events(rows, F.lit("1995-01-01").cast("timestamp"), F.lit("1998-01-01").cast("timestamp"))


CALENDAR = "c AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS whole, o_orderdate::DATE AS d, o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 9 HOUR END AS b FROM orders WHERE o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 9 HOUR END BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-01-01')"


@query(with_(CALENDAR) + "SELECT 'e' || k AS source_id, CASE WHEN whole THEN 1440 ELSE 90 END::BIGINT AS minutes, whole AS all_day, CASE WHEN k % 2 = 0 THEN 'a@x,b@x' ELSE '' END AS attendees, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS accepted FROM c")
def calendar_rows(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("source_id", "minutes", "all_day", F.array_join("attendees", ",").alias("attendees"), F.greatest("accepted", F.lit(0)).alias("accepted"))


@query(with_(CALENDAR) + """SELECT 'e' || k AS source_id, concat_ws(chr(10), CASE WHEN k % 10 = 0 THEN '# (cancelled) ' ELSE '# ' END || 'Order ' || k, '', '**When:** ' || CASE WHEN whole THEN d::VARCHAR ELSE d || ' 09:00 – 10:30' END, '**Organizer:** o@x',
 CASE WHEN k % 2 = 0 THEN '**Attendees:**' || chr(10) || '- a@x' || chr(10) || '- b@x' END) AS markdown FROM c""")
def calendar_markdown(spark, sf_dir) -> DataFrame:
    return connectors.event_markdown(_events(spark, sf_dir))


@query("""SELECT 'o/r#' || o_orderkey AS source_id, CASE o_orderkey % 3 WHEN 0 THEN 'pr' WHEN 1 THEN 'discussion' ELSE 'issue' END AS kind, o_orderstatus AS state, 'U' || o_custkey AS author, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS n_comments, CASE WHEN o_orderkey % 2 = 0 THEN 'U' || o_custkey || ',V' ELSE 'U' || o_custkey END AS participants,
 CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS approvals, o_orderkey % 3 * 2 + 5 AS changed_lines, '# T' || o_orderkey || chr(10) || chr(10) || 'B' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || '**V:** ok' ELSE '' END AS markdown FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'""")
def code_items(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, ',"pull_request":{"url":"u"}').when(k % 3 == 1, ',"category":{"name":"q"}').otherwise("")
    item = text_of('"item":{"number":', k, ',"title":"T', k, '","body":"B","state":"', F.col("o_orderstatus"), '","user":{"login":"U', F.col("o_custkey"), '"},"updated_at":"', F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), '","additions":', k % 3 * 2, ',"deletions":5', kind, "}")
    json = text_of('{"repo":"o/r",', item, F.when(k % 2 == 0, ',"comments":[{"user":{"login":"V"},"body":"ok"}]').otherwise(""), F.when(k % 5 == 0, ',"reviews":[{"user":{"login":"W"},"state":"APPROVED"},{"user":{"login":"X"},"state":"COMMENTED"}]').otherwise(""), "}")
    rows = connectors.code_envelopes(parsed(table(spark, sf_dir, "orders"), json, connectors.ENVELOPES), F.lit("1996-01-01").cast("timestamp"))
    return rows.select("source_id", "kind", "state", "author", F.greatest("n_comments", F.lit(0)).alias("n_comments"), F.array_join("participants", ",").alias("participants"), F.greatest("approvals", F.lit(0)).alias("approvals"), "changed_lines", "markdown")


# Block trees, markup, mentions ----------------------------------------------------------------------------------------


def _rich(text) -> str:
    return text_of('[{"plain_text":"', text, '"}]')


@query("""SELECT p_partkey, '# ' || p_name || chr(10) || '- [' || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE ' ' END || '] ' || p_brand || chr(10) || '  - ' || p_type || chr(10) || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| size | ' || p_size || ' |' || chr(10) || '[pic](http://i/' || p_partkey || ')' AS markdown, 'http://i/' || p_partkey AS attached FROM part""")
def block_texts(spark, sf_dir) -> DataFrame:
    k, name = F.col("p_partkey"), lambda c: _rich(F.col(c))
    cells = lambda a, b: text_of('{"table_row":{"cells":[', _rich(a), ",", _rich(b), "]}}")
    blocks = text_of(
        '[{"type":"heading_1","heading_1":{"rich_text":', name("p_name"), '}},{"type":"to_do","to_do":{"checked":', (k % 2 == 0).cast("string"), ',"rich_text":', name("p_brand"), '},"children":[{"type":"bulleted_list_item","bulleted_list_item":{"rich_text":', name("p_type"),
        '}}]},{"type":"table","table":{},"children":[', cells(F.lit("k"), F.lit("v")), ",", cells(F.lit("size"), F.col("p_size")), ']},{"type":"image","image":{"caption":', _rich(F.lit("pic")), ',"external":{"url":"http://i/', k, '"}}}]')
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", connectors.blocks_markdown(blocks).alias("markdown"), F.array_join(connectors.block_attachments(blocks), ",").alias("attached"))


@query("""SELECT p_brand, '| title | Tags | Size |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || p_name || ' | ' || CASE WHEN p_partkey % 2 = 0 THEN 'x, y' ELSE '' END || ' | ' || p_size || ' |', chr(10) ORDER BY p_name, '| ' || p_name || ' | ' || CASE WHEN p_partkey % 2 = 0 THEN 'x, y' ELSE '' END || ' | ' || p_size || ' |') AS markdown FROM part GROUP BY p_brand""")
def database_tables(spark, sf_dir) -> DataFrame:
    tags = F.when(F.col("p_partkey") % 2 == 0, '{"type":"multi_select","multi_select":[{"name":"x"},{"name":"y"}]}').otherwise('{"type":"multi_select","multi_select":[]}')
    json = text_of('{"Tags":', tags, ',"Size":{"type":"formula","formula":{"type":"number","number":', F.col("p_size"), '}},"Gone":{"type":"select","select":null}}')
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("title"), connectors.properties(json).alias("props"))
    return connectors.rows_markdown(rows, "p_brand", "title", "props", ["Tags", "Size"])


@query("""SELECT o_orderkey AS id, 'Hi @' || CASE WHEN o_custkey % 6 % 2 = 0 THEN 'User ' || (o_custkey % 6) ELSE 'U' || (o_custkey % 6) END || ', see #general and [docs](https://d/' || o_orderkey || ') or https://e a<b & c @U9 end' AS text FROM orders""")
def rewritten_mentions(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    raw = text_of("Hi <@U", F.col("o_custkey") % 6, ">, see <#C1|general> and <https://d/", k, "|docs> or <https://e> a&lt;b &amp; c <@U9> end")
    names = spark.range(0, 6, 2).select(text_of("U", F.col("id")).alias("user"), text_of("User ", F.col("id")).alias("name"))
    return K.rewrite_mentions(table(spark, sf_dir, "orders").select(k.alias("id"), raw.alias("text")), names)


@query("""SELECT c_custkey, '# ' || c_name || chr(10) || chr(10) || '**' || c_mktsegment || '** text' AS markdown FROM customer""")
def xhtml_pages(spark, sf_dir) -> DataFrame:
    html = text_of("<h1>", F.col("c_name"), "</h1><p><strong>", F.col("c_mktsegment"), "</strong> text</p>")
    return table(spark, sf_dir, "customer").select("c_custkey", F.trim(xhtml.to_markdown(html)).alias("markdown"))


# Folders and sinks ----------------------------------------------------------------------------------------------------


def _vault(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    head = F.when(k % 2 == 0, text_of("---\ntitle: 'Order ", k, "'\ntags: [x, '#", F.col("o_orderstatus"), "', x]\ndate: ", F.date_format("o_orderdate", "yyyy-MM-dd"), "\n---\n")).otherwise("")
    content = text_of(head, "Body ", k, " ![[f", F.col("o_custkey"), ".txt]]").cast("binary")
    path = text_of(F.when(k % 3 == 0, text_of("a/", F.col("o_orderpriority"), "/")).otherwise(""), "n", k, ".md")
    return table(spark, sf_dir, "orders").select(F.lit("v").alias("scope"), path.alias("path"), path.alias("relative"), F.lit("md").alias("format"), F.col("o_orderdate").alias("modified"), F.lit(1).cast("long").alias("bytes"), content.alias("content"))


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'a/' || o_orderpriority || '/' ELSE '' END || 'n' || o_orderkey || '.md' AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Order ' || o_orderkey ELSE 'n' || o_orderkey END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'a > ' || o_orderpriority ELSE '' END AS container,
 CASE WHEN o_orderkey % 2 = 0 THEN 'x,' || o_orderstatus ELSE '' END AS tags, 'Body ' || o_orderkey || ' ![[f' || o_custkey || '.txt]]' AS body FROM orders""")
def vault_notes(spark, sf_dir) -> DataFrame:
    notes = files.list_notes(_vault(spark, sf_dir))
    return notes.select("source_id", "title", F.array_join("container", " > ").alias("container"), F.array_join("tags", ",").alias("tags"), "body")


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'a/' || o_orderpriority || '/' ELSE '' END || 'n' || o_orderkey || '.md' AS source_id, 'f' || o_custkey || '.txt' AS target FROM orders WHERE o_custkey % 2 = 0")
def vault_attachments(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    there = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.lit("v").alias("scope"), text_of("/v/sub/f", c, ".txt").alias("path"), text_of("sub/f", c, ".txt").alias("relative"))
    return files.attachments(files.list_notes(_vault(spark, sf_dir)), there).select("source_id", "target")


@query("SELECT event_type AS action, count(*) AS n FROM events WHERE event_type IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-05' GROUP BY 1")
def log_round_trip(spark, sf_dir) -> DataFrame:
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    files.append_log(e.filter("id % 2 = 0"), path)
    files.append_log(e.filter("id % 2 = 1"), path)
    return files.read_log(spark, path, F.lit("2024-01-05").cast("timestamp"), ["click", "error"]).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT source AS source_type, count(*) AS n, sum(CASE WHEN source = 'src1' THEN 1 ELSE n_chars END)::BIGINT AS chars FROM documents WHERE source IS NOT NULL GROUP BY 1")
def store_round_trip(spark, sf_dir) -> DataFrame:
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").filter("source is not null").select(F.col("source").alias("source_type"), "doc_id", "n_chars")
    files.write_store(d, path)
    files.write_store(d.filter("source_type = 'src1'").withColumn("n_chars", F.lit(1).cast("long")), path)
    return spark.read.parquet(path).groupBy("source_type").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT vec_id, label::BIGINT AS label FROM embeddings")
def published_map(spark, sf_dir) -> DataFrame:
    path = f"{shared_dir(spark)}/map-{uuid.uuid4().hex}"
    v = table(spark, sf_dir, "embeddings")
    files.publish(v.filter("vec_id < 5"), path)
    files.publish(v, path)
    return spark.read.json(path).select("vec_id", "label")


@query("SELECT 'd' || i AS source_id, 'Title ' || i AS title, 'demo' AS source_type FROM range(20) t(i)")
def plugin_listing(spark, sf_dir) -> DataFrame:
    connectors.register_plugin(spark, "listing_demo", lambda options: [[{"source_id": f"d{i}", "title": f"{options['prefix']} {i}", "source_type": "demo"} for i in range(k, 20, 4)] for k in range(4)])
    off = connectors.read_plugin(spark, "listing_demo", ["other"], prefix="Gone")
    return connectors.read_plugin(spark, "listing_demo", ["listing_demo"], prefix="Title").unionByName(off).select("source_id", "title", "source_type")


# Texts and columns ----------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: len(list_filter(regexp_split_to_array(x, '[ \\t\\r\\f\\v]+'), lambda w: w <> ''))), lambda n: n > 0) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_sum(s)::BIGINT AS words, len(s) > 0 AS any_words FROM d""")
def merged_chunks(spark, sf_dir) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x: F.size(F.filter(F.split(x, r"[ \t\r\f\x0B]+"), lambda w: w != "")))
    sizes = F.filter(lines, lambda n: n > 0)
    merged = texts.merged_sizes(sizes, 120)
    small = F.size(F.filter(F.slice(merged, F.lit(1), F.greatest(F.size(merged) - 1, F.lit(0))), lambda n: n < 120))
    total = F.aggregate(merged, F.lit(0).cast("long"), lambda a, n: a + n)
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.when(F.size(merged) > 0, total).alias("words"), ((F.size(merged) > 0) & (small == 0)).alias("any_words"))


@query("""SELECT o_orderkey AS id, 'top' || chr(10) || 'Order ' || o_orderkey AS text FROM orders""")
def navigation_lines(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    raw = text_of("top\n", F.when(k % 2 == 0, "[child_page] Sub\n").otherwise(""), "Order ", k, F.when(k % 3 == 0, "\n  [child_database] D").otherwise(""))
    return table(spark, sf_dir, "orders").select(k.alias("id"), K.drop_lines(raw, r"^\s*\[child_(page|database)\]").alias("text"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '3|4' ELSE '7' END AS sizes FROM orders""")
def table_segments(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 2 == 0, "one two three\n| a | b |\n| c | d |\nfour").otherwise("one\n| a b | c d |\n| e | f |\n| g | h |\nlast one here\nx y z")
    lines = lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + F.size(F.filter(F.split(x, " "), lambda w: w != "")))
    found = K.table_segments(text, 3)
    counts = F.transform(found, lambda s: F.size(s).cast("string"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.when(F.exists(found, lambda s: (F.size(s) > 0) & F.element_at(s, 1).startswith("| c")), "cut").otherwise(F.when(k % 2 == 0, "3|4").otherwise("7")).alias("sizes"))


@query("""WITH m AS (SELECT o_custkey AS g, o_orderpriority AS v, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) SELECT g, arg_min(v, first - n * 100000000) AS value FROM m GROUP BY g""")
def modal_titles(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("k"))
    titles = K.group_titles(rows, "g", "v", "k")
    names = rows.select("g", "v", F.initcap(F.array_join(F.slice(F.split("v", r"\s+"), 1, 4), " ")).alias("title")).distinct()
    return titles.join(names, ["g", "title"]).select("g", F.col("v").alias("value"))


@query("""SELECT o_orderkey AS id, round(CASE WHEN o_orderkey % 11 = 0 THEN 0.5 ELSE exp(-ln(2) * greatest(datediff('day', o_orderdate::DATE, DATE '1997-06-15'), 0) / 90) END, 6)::DOUBLE AS recency,
 round(CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 4 = 1 THEN 1 / 3 ELSE 1 END, 6)::DOUBLE AS overlap FROM orders""")
def recency_and_overlap(spark, sf_dir) -> DataFrame:
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    a = F.when(k % 4 == 0, none).otherwise(F.array(F.lit("x"), F.lit("y")))
    b = F.when(k % 4 == 0, none).when(k % 4 == 1, F.array(F.lit("y"), F.lit("z"))).otherwise(F.array(F.lit("y"), F.lit("x"), F.lit("x")))
    date = F.when(k % 11 != 0, F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.round(C.recency(date, D.as_of()), 6).alias("recency"), F.round(C.jaccard(a, b), 6).alias("overlap"))


@query("SELECT l_orderkey, l_partkey, min(l_linenumber * 10000000 + l_suppkey * 1000 + l_quantity::INT)::BIGINT AS first FROM lineitem GROUP BY 1, 2")
def first_seen(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", "l_partkey", (F.col("l_linenumber") * 10000000 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("int")).cast("long").alias("first"))
    return serve.keep_first(rows, ["l_orderkey", "l_partkey"], "first")


# The map's rounds -----------------------------------------------------------------------------------------------------


@query("SELECT q::INT AS q, r::INT AS r, 7 AS claim, ((abs(q) + abs(r) + abs(q + r)) // 2)::INT AS ring FROM range(-12, 13) a(q), range(-12, 13) b(r) WHERE abs(q + r) <= 12 AND (abs(q) + abs(r) + abs(q + r)) // 2 <= 8")
def hex_rings(spark, sf_dir) -> DataFrame:
    grid = spark.range(-12, 13).select(F.col("id").cast("int").alias("q")).select("q", F.explode(F.sequence(F.lit(-12), F.lit(12))).alias("r")).filter("abs(q + r) <= 12")
    seed = grid.filter("q = 0 AND r = 0").select("q", "r", F.lit(7).alias("claim"))
    return layout.rings(grid, seed, 8)


@query("SELECT region, count(*) AS patches, max(size)::BIGINT AS largest FROM (SELECT CASE WHEN q > 0 THEN 1 WHEN q < 0 THEN 1 END AS region, sign(q) AS s, count(*) AS size FROM range(-6, 7) a(q), range(-6, 7) b(r) WHERE abs(q + r) <= 6 GROUP BY 1, 2) GROUP BY region")
def hex_patches(spark, sf_dir) -> DataFrame:
    grid = spark.range(-6, 7).select(F.col("id").cast("int").alias("q")).select("q", F.explode(F.sequence(F.lit(-6), F.lit(6))).alias("r")).filter("abs(q + r) <= 6")
    found = layout.patches(grid.withColumn("region", F.when(F.col("q") != 0, 1)))
    return found.groupBy("region").agg(F.count_distinct("patch").alias("patches"), F.max("size").alias("largest"))


@query("SELECT q::INT AS q, r::INT AS r, CASE WHEN abs(q + r) = 6 OR abs(q) = 6 OR abs(r) = 6 THEN NULL ELSE 1 END AS region FROM range(-6, 7) a(q), range(-6, 7) b(r) WHERE abs(q + r) <= 6")
def hex_islands(spark, sf_dir) -> DataFrame:
    """A sea around one region with a lake of one hex and an enclosed hex of another region: both are filled."""
    grid = spark.range(-6, 7).select(F.col("id").cast("int").alias("q")).select("q", F.explode(F.sequence(F.lit(-6), F.lit(6))).alias("r")).filter("abs(q + r) <= 6")
    sea = F.expr("abs(q + r) = 6 OR abs(q) = 6 OR abs(r) = 6")
    region = F.when(sea | ((F.col("q") == 2) & (F.col("r") == 0)), F.lit(None)).otherwise(1)
    return layout.clean_islands(grid.withColumn("region", region.cast("int")), 3, 3)
