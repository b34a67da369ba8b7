"""One query for each operator over the driver's tables, with its DuckDB twin. (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import columns as C
from lattica.operators import attention, graph, harvest, retrieval, texts, trees
from lattica.session import materialize, table
from lattica.sources import derived as D

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that DuckDB answers alike."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# Scans, filters, manifest and log -------------------------------------------------------------------------------------

UPSERT = """u AS (SELECT coalesce(m.source_id, n.source_id) AS source_id,
  CASE WHEN n.source_id IS NULL THEN 'unlisted' WHEN m.source_id IS NULL THEN 'new' WHEN n.modified <= m.modified OR n.content_hash = m.content_hash THEN 'unchanged' ELSE 'updated' END AS action,
  m.version AS v, m.status AS s, m.content_hash AS mh, n.content_hash AS nh, n.source_id IS NOT NULL AS listed FROM manifest m FULL OUTER JOIN listing n ON m.source_id = n.source_id)"""


@query(with_(D.MANIFEST_SQL, D.LISTING_SQL, UPSERT) + """SELECT source_id, action, CASE action WHEN 'new' THEN 1 WHEN 'updated' THEN v + 1 ELSE v END AS version, CASE WHEN listed THEN 'active' ELSE s END AS status,
  CASE WHEN action IN ('new', 'updated') THEN nh ELSE mh END AS content_hash FROM u""")
def manifest_upsert(spark, sf_dir) -> DataFrame:
    return harvest.upsert_actions(D.manifest(spark, sf_dir), D.listing(spark, sf_dir)).drop("modified")


SCOPES = ["src0", "src1", "src2", "src4", "src5", "src6", "src7"]


@query(with_(D.MANIFEST_SQL, D.LISTING_SQL) + """SELECT source_id, CASE WHEN scope IS NULL THEN 'preserved' WHEN scope IN ('src0','src1','src2','src4','src5','src6','src7') THEN 'deleted' ELSE 'out_of_scope' END AS outcome
  FROM manifest WHERE status = 'active' AND source_id NOT IN (SELECT source_id FROM listing)""")
def manifest_reconcile(spark, sf_dir) -> DataFrame:
    return harvest.reconcile(D.manifest(spark, sf_dir), D.listing(spark, sf_dir), SCOPES)


@query(with_(D.MANIFEST_SQL) + "SELECT source, status, count(*) AS n, sum(raw_bytes)::BIGINT AS raw_bytes, max(version) AS version, count(DISTINCT scope) AS scopes FROM manifest GROUP BY source, status")
def manifest_stats(spark, sf_dir) -> DataFrame:
    m = D.manifest(spark, sf_dir)
    return m.groupBy("source", "status").agg(F.count("*").alias("n"), F.sum("raw_bytes").alias("raw_bytes"), F.max("version").alias("version"), F.count_distinct("scope").alias("scopes"))


@query(with_(D.MANIFEST_SQL) + "SELECT source_id, source FROM manifest WHERE status = 'deleted_at_source' AND modified::DATE <= DATE '2024-01-05' - 2")
def retention_due(spark, sf_dir) -> DataFrame:
    return harvest.retention_due(D.manifest(spark, sf_dir), F.to_date("modified"), F.lit("2024-01-05").cast("date"), 2).select("source_id", "source")


@query(with_(D.MANIFEST_SQL) + "SELECT source_id, source, version FROM manifest WHERE (scope IS NULL OR scope < 'src2') AND version < 3 AND status IN ('active', 'out_of_scope')")
def version_filters(spark, sf_dir) -> DataFrame:
    m = D.manifest(spark, sf_dir)
    return m.filter((F.col("scope").isNull() | (F.col("scope") < "src2")) & (F.col("version") < 3) & F.col("status").isin("active", "out_of_scope")).select("source_id", "source", "version")


@query(with_(D.LOG_SQL) + """SELECT source, id, CASE WHEN arg_max(change, pos) = 'updated' AND arg_max(change, pos) FILTER (change <> 'updated') = 'new' THEN 'new' ELSE arg_max(change, pos) END AS change
  FROM log WHERE change IS NOT NULL GROUP BY source, id""")
def latest_changes(spark, sf_dir) -> DataFrame:
    return harvest.latest_changes(D.log(spark, sf_dir)).drop("ts")


@query(with_(D.LOG_SQL, "latest AS (SELECT source, id, CASE WHEN arg_max(change, pos) = 'updated' AND arg_max(change, pos) FILTER (change <> 'updated') = 'new' THEN 'new' ELSE arg_max(change, pos) END AS change FROM log WHERE change IS NOT NULL GROUP BY source, id)")
       + "SELECT source, change, count(*) AS n FROM latest GROUP BY GROUPING SETS ((source, change), (change))")
def change_summary(spark, sf_dir) -> DataFrame:
    return harvest.change_summary(harvest.latest_changes(D.log(spark, sf_dir)))


@query(with_(D.LOG_SQL, "latest AS (SELECT id, count(*) AS n FROM log WHERE change IS NOT NULL GROUP BY id)") + """SELECT id, n, c_name AS author, coalesce(c_mktsegment, 'unknown') AS space FROM latest LEFT JOIN customer ON id = c_custkey""")
def changes_with_authors(spark, sf_dir) -> DataFrame:
    counts = D.log(spark, sf_dir).filter("change is not null").groupBy("id").agg(F.count("*").alias("n"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("author"), "c_mktsegment")
    return counts.join(customer, "id", "left").select("id", "n", "author", F.coalesce("c_mktsegment", F.lit("unknown")).alias("space"))


@query(with_(D.LOG_SQL) + "SELECT pos, source, action, id FROM log WHERE action = 'error' AND source IN ('src1', 'src2') ORDER BY ts DESC, pos DESC LIMIT 100 OFFSET 50")
def audit_page(spark, sf_dir) -> DataFrame:
    rows = D.log(spark, sf_dir).filter((F.col("action") == "error") & F.col("source").isin("src1", "src2"))
    return rows.orderBy(F.desc("ts"), F.desc("pos")).offset(50).limit(100).select("pos", "source", "action", "id")


@query(with_(D.LOG_SQL) + """, days AS (SELECT unnest(range(DATE '2024-01-30' - 13, DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day)
SELECT day, count(pos) AS n FROM days LEFT JOIN log ON ts::DATE = day AND change = 'new' GROUP BY day""")
def daily_series(spark, sf_dir) -> DataFrame:
    rows = D.log(spark, sf_dir).filter("change = 'new'")
    return harvest.daily_series(rows, F.to_date("ts"), F.lit("2024-01-30").cast("date"))


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderpriority LIKE '1%' OR o_totalprice < 50000 THEN 'failed' ELSE 'complete' END AS status FROM orders""")
def run_statuses(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    completed = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    failed, errors = F.col("o_orderpriority").startswith("1").cast("int"), (F.col("o_totalprice") < 50000).cast("int")
    return o.select(F.col("o_orderkey").alias("run_id"), harvest.run_status(completed, failed, errors).alias("status"))


@query("""SELECT source, max(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END) AS last_harvest, count(*) AS runs FROM (SELECT 'src' || (o_custkey % 10) AS source, * FROM orders) GROUP BY source""")
def last_harvest(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("source", F.concat(F.lit("src"), (F.col("o_custkey") % 10).cast("string")))
    return o.groupBy("source").agg(F.max(F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))).alias("last_harvest"), F.count("*").alias("runs"))


@query("SELECT source, lang, count(*) AS n FROM documents WHERE lower(text) LIKE '%the%' GROUP BY source, lang")
def document_search(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.filter(F.lower("text").contains("the")).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("""SELECT doc_id AS from_id, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS to_id FROM documents QUALIFY to_id IS NOT NULL""")
def document_chain(spark, sf_dir) -> DataFrame:
    return harvest.chain_links(table(spark, sf_dir, "documents"), ["source", "lang"], ["doc_id"], "doc_id")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts)::TIMESTAMP AS start, max(ts)::TIMESTAMP + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def idle_sessions(spark, sf_dir) -> DataFrame:
    return harvest.sessions(table(spark, sf_dir, "events"))


@query("""SELECT DISTINCT sha256(text) AS h FROM documents WHERE source <> 'src3' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src3')""")
def incremental_missing(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h"))
    return harvest.missing_keys(d.filter("source <> 'src3'"), d.filter("source = 'src3'"), "h")


@query("""SELECT stage, sum(v) AS total, count(*) AS n FROM (SELECT event_type AS stage, event_id % 1000 AS v FROM events) GROUP BY ROLLUP (stage)""")
def usage_ledger(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("event_id") % 1000).alias("v"))
    return e.rollup("stage").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


@query("""SELECT conv_id AS thread_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS seq, turn AS created, text FROM conversations""")
def thread_append(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("created"), "text")
    old = t.filter("created < 3").withColumn("seq", F.row_number().over(Window.partitionBy("thread_id").orderBy("created", "text")) - 1)
    return harvest.append_messages(old, t.filter("created >= 3")).select("thread_id", F.col("seq").cast("long").alias("seq"), "created", "text")


# Attention ------------------------------------------------------------------------------------------------------------

MERGED = """merged AS (SELECT region_id, kind, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS norm, min(seq) AS seq, arg_min(id, seq) AS id, arg_min(title, seq) AS title, arg_min(status, seq) AS status, max(severity) AS severity,
  arg_min(owner, seq) FILTER (owner IS NOT NULL) AS owner, min(due_date) AS due_date, list_sort(list(DISTINCT note_id)) AS note_ids, list_sort(list(DISTINCT chunk_id)) AS chunk_ids FROM signals GROUP BY ALL)"""
MERGED = MERGED.replace("GROUP BY ALL", "GROUP BY 1, 2, 3")
SCORED = """contexts AS (SELECT region_id, count(DISTINCT note_id) AS n FROM signals GROUP BY region_id),
top AS (SELECT *, row_number() OVER (PARTITION BY region_id, kind ORDER BY severity DESC, seq) - 1 AS rank FROM merged WHERE status <> 'resolved'),
total AS (SELECT region_id, sum(severity * CASE kind WHEN 'risk' THEN 0.48 WHEN 'todo' THEN 0.34 WHEN 'open_question' THEN 0.24 WHEN 'decision' THEN 0.12 WHEN 'recent_change' THEN 0.10 ELSE 0.06 END::DOUBLE / (1 + rank * 0.65::DOUBLE)) AS total FROM top WHERE rank < 5 GROUP BY region_id),
chunks AS (SELECT region_id, count(DISTINCT c) AS chunks FROM (SELECT region_id, unnest(chunk_ids) AS c FROM merged WHERE status <> 'resolved') GROUP BY region_id),
scores AS (SELECT region_id, round(coalesce(total * least(1.0::DOUBLE, greatest(0.35::DOUBLE, sqrt(chunks / n))), 0), 2) AS raw FROM contexts LEFT JOIN total USING (region_id) LEFT JOIN chunks USING (region_id))"""


@query(with_(D.SIGNALS_SQL, MERGED) + "SELECT region_id, kind, norm, id, title, status, severity, owner, due_date, len(note_ids) AS n_notes, array_to_string(chunk_ids, ',') AS chunk_ids FROM merged")
def attention_merge(spark, sf_dir) -> DataFrame:
    m = attention.merge_signals(D.signals(spark, sf_dir))
    return m.select("region_id", "kind", "norm", "id", "title", "status", "severity", "owner", "due_date", F.size("note_ids").cast("long").alias("n_notes"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


def _scores(spark, sf_dir) -> DataFrame:
    s = D.signals(spark, sf_dir)
    return attention.attention_scores(attention.merge_signals(s), s.groupBy("region_id").agg(F.count_distinct("note_id").alias("n")))


@query(with_(D.SIGNALS_SQL, MERGED, SCORED) + "SELECT region_id, raw FROM scores")
def attention_score(spark, sf_dir) -> DataFrame:
    return _scores(spark, sf_dir)


@query(with_(D.SIGNALS_SQL, MERGED, SCORED, "b AS (SELECT quantile_cont(raw::DOUBLE, 0.1::DOUBLE) AS lo, quantile_cont(raw::DOUBLE, 0.9::DOUBLE) AS hi FROM scores WHERE raw > 0)",
             "v AS (SELECT region_id, CASE WHEN raw <= 0 THEN 0 WHEN hi - lo < 1e-6 THEN 65 ELSE greatest(0, least(100, 100 * (raw - lo) / (hi - lo))) END::DOUBLE AS v FROM scores, b)")
       + "SELECT region_id, round(v, 2) AS score, CASE WHEN v >= 80 THEN 'critical' WHEN v >= 55 THEN 'high' WHEN v >= 30 THEN 'medium' WHEN v > 0 THEN 'low' ELSE 'none' END AS level FROM v")
def attention_calibrate(spark, sf_dir) -> DataFrame:
    return attention.calibrate(_scores(spark, sf_dir))


@query(with_(D.SIGNALS_SQL, MERGED, """r AS (SELECT *, CASE kind WHEN 'risk' THEN 0 WHEN 'todo' THEN 1 WHEN 'open_question' THEN 2 WHEN 'decision' THEN 3 WHEN 'owner' THEN 4 ELSE 5 END AS kr FROM merged)""",
             """p AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY kr, status = 'resolved', severity DESC, lower(title), seq) AS place,
  row_number() OVER (PARTITION BY region_id, kind ORDER BY kr, status = 'resolved', severity DESC, lower(title), seq) <= [4, 3, 2, 2, 1, 1][kr + 1] AS floor FROM r)""".replace("'owner' THEN 4 ELSE 5", "'owner' THEN 4 ELSE 5"),
             "o AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY floor DESC, place) AS pos FROM p)") + "SELECT region_id, pos, id, kind, severity FROM o WHERE pos <= 12")
def diverse_trim(spark, sf_dir) -> DataFrame:
    return attention.diverse_trim(attention.merge_signals(D.signals(spark, sf_dir))).select("region_id", F.col("pos").cast("long").alias("pos"), "id", "kind", "severity")


STATUSES = "statuses AS (SELECT id, CASE WHEN seq % 2 = 0 THEN 'confirmed' ELSE 'dismissed' END AS user_status FROM signals WHERE seq % 9 = 0)"
BUCKET = """CASE WHEN due_date IS NULL THEN 'no_date' WHEN due_date - today < -90 THEN 'probably_abandoned' WHEN due_date - today < 0 THEN 'overdue' WHEN due_date - today <= 7 THEN 'due_soon' ELSE 'upcoming' END"""


def _items(spark, sf_dir) -> DataFrame:
    s = D.signals(spark, sf_dir)
    statuses = s.filter("seq % 9 = 0").select("id", F.when(F.col("seq") % 2 == 0, "confirmed").otherwise("dismissed").alias("user_status"))
    return attention.action_items(s, statuses, D.as_of())


@query(with_(D.SIGNALS_SQL, STATUSES) + f"""SELECT id, title, region_id, severity, due_date, {BUCKET} AS bucket, due_date - today AS days, coalesce(user_status, 'unverified') AS user_status
  FROM signals LEFT JOIN statuses USING (id) WHERE kind = 'todo' AND status = 'open'""")
def action_items(spark, sf_dir) -> DataFrame:
    return _items(spark, sf_dir).drop("bucket_rank").withColumn("days", F.col("days").cast("long"))


@query(with_(D.SIGNALS_SQL, f"i AS (SELECT {BUCKET} AS bucket FROM signals WHERE kind = 'todo' AND status = 'open')") + "SELECT bucket, count(i.bucket) AS n FROM (SELECT unnest(['overdue','due_soon','upcoming','no_date','probably_abandoned']) AS bucket) LEFT JOIN i USING (bucket) GROUP BY bucket")
def action_item_counts(spark, sf_dir) -> DataFrame:
    return attention.count_all(_items(spark, sf_dir), "bucket", attention.BUCKETS)


@query(with_(D.SIGNALS_SQL, f"i AS (SELECT *, {BUCKET} AS bucket FROM signals WHERE kind = 'todo' AND status = 'open')") + """SELECT id, bucket, due_date, severity FROM i
  ORDER BY list_position(['overdue','due_soon','upcoming','no_date','probably_abandoned'], bucket), coalesce(due_date, DATE '9999-12-31'), severity DESC, lower(title), id LIMIT 50""")
def action_items_page(spark, sf_dir) -> DataFrame:
    ordered = _items(spark, sf_dir).orderBy("bucket_rank", F.coalesce("due_date", F.lit("9999-12-31").cast("date")), F.desc("severity"), F.lower("title"), "id")
    return ordered.limit(50).select("id", "bucket", "due_date", "severity")


@query(with_(D.SIGNALS_SQL) + """SELECT id, severity + CASE WHEN status = 'resolved' OR due_date IS NULL OR due_date - today < -90 THEN 0 WHEN due_date - today < 0 THEN 25 WHEN due_date - today <= 7 THEN 15 ELSE 0 END AS boosted FROM signals""")
def deadline_boost(spark, sf_dir) -> DataFrame:
    boost = F.when(F.col("status") != "resolved", C.deadline_boost(F.col("due_date"), D.as_of())).otherwise(0)
    return D.signals(spark, sf_dir).select("id", (F.col("severity") + boost).alias("boosted"))


@query(with_(D.SIGNALS_SQL, MERGED, SCORED) + "SELECT region_id, raw FROM scores WHERE raw > 0 ORDER BY raw DESC, region_id LIMIT 8")
def top_burning(spark, sf_dir) -> DataFrame:
    return _scores(spark, sf_dir).filter("raw > 0").orderBy(F.desc("raw"), "region_id").limit(8)


# Trees and timelines --------------------------------------------------------------------------------------------------

CLOSURE = """RECURSIVE_MARK closure AS (SELECT node_id, node_id AS ancestor_id, 0 AS distance FROM tree UNION ALL
  SELECT c.node_id, t.parent_id, distance + 1 FROM closure c JOIN tree t ON c.ancestor_id = t.node_id WHERE t.parent_id IS NOT NULL)"""


def rec(*ctes: str) -> str:
    return with_(*ctes).replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_MARK ", "")


@query(rec(D.TREE_SQL, CLOSURE) + "SELECT node_id, ancestor_id, distance FROM closure")
def tree_closure(spark, sf_dir) -> DataFrame:
    return trees.ancestors(D.tree(spark, sf_dir))


@query(rec(D.TREE_SQL, CLOSURE) + "SELECT node_id, string_agg(t.name, ' > ' ORDER BY distance DESC) AS path, max(distance) AS depth FROM closure JOIN tree t ON ancestor_id = t.node_id GROUP BY ALL".replace("SELECT node_id", "SELECT closure.node_id"))
def tree_paths(spark, sf_dir) -> DataFrame:
    t = D.tree(spark, sf_dir)
    return trees.paths(t, trees.ancestors(t))


@query(rec(D.TREE_SQL, CLOSURE, D.NOTES_SQL) + "SELECT ancestor_id AS node_id, count(*) AS n_notes, min(created) AS first_seen, max(coalesce(updated, created)) AS last_touched FROM closure JOIN notes ON region_id = node_id GROUP BY ancestor_id")
def timeline_index(spark, sf_dir) -> DataFrame:
    return trees.subtree_counts(trees.ancestors(D.tree(spark, sf_dir)), D.notes(spark, sf_dir))


@query(with_(D.NOTES_SQL) + """SELECT region_id, cutoff, count(*) FILTER (created <= cutoff) AS born, count(*) FILTER (created <= cutoff AND created > cutoff - 30) AS recent
  FROM notes, (SELECT unnest([DATE '1995-01-01', DATE '1997-06-15']) AS cutoff) GROUP BY region_id, cutoff""")
def timeline_windows(spark, sf_dir) -> DataFrame:
    cutoffs = spark.sql("SELECT explode(array(date'1995-01-01', date'1997-06-15')) AS cutoff")
    return trees.created_windows(D.notes(spark, sf_dir), cutoffs, "region_id")


@query(with_(D.NOTES_SQL) + "SELECT note_id FROM notes WHERE created > DATE '1996-12-31'")
def as_of_excluded(spark, sf_dir) -> DataFrame:
    return D.notes(spark, sf_dir).filter(F.col("created") > F.lit("1996-12-31").cast("date")).select("note_id")


@query("""WITH p AS (SELECT source AS a, source || '/' || lang AS b FROM documents) SELECT a AS prefix, 1 AS depth, count(*) AS n FROM p GROUP BY a UNION ALL SELECT b, 2, count(*) FROM p GROUP BY b""")
def sources_tree(spark, sf_dir) -> DataFrame:
    return trees.prefix_counts(table(spark, sf_dir, "documents"), F.array("source", "lang")).select("prefix", (F.col("depth") + 1).alias("depth"), "n")


@query(with_(D.SIGNALS_SQL, "owned AS (SELECT id AS signal_id, region_id AS owner_id, 1 AS depth, 0 AS is_tag FROM signals UNION ALL SELECT id, 'r' || n_regionkey, 0, 0 FROM signals JOIN nation ON region_id = 'n' || n_nationkey UNION ALL SELECT id, 'tag' || (note_id % 50), 2, 1 FROM signals WHERE seq % 4 = 0)")
       + "SELECT signal_id, arg_max(owner_id, is_tag * 10 + depth) AS owner_id FROM owned GROUP BY signal_id")
def signal_owner(spark, sf_dir) -> DataFrame:
    s = D.signals(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("region_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    owned = (
        s.select(F.col("id").alias("signal_id"), F.col("region_id").alias("owner_id"), F.lit(1).alias("depth"), F.lit(0).alias("is_tag"))
        .union(s.join(nation, "region_id").select("id", "parent", F.lit(0), F.lit(0)))
        .union(s.filter("seq % 4 = 0").select("id", F.concat(F.lit("tag"), (F.col("note_id") % 50).cast("string")), F.lit(2), F.lit(1)))
    )
    return trees.deepest_owner(owned)


# Tags and graph -------------------------------------------------------------------------------------------------------

PAIRS = "pairs AS (SELECT x.tag_id AS a, y.tag_id AS b, count(*) AS n FROM note_tags x JOIN note_tags y ON x.note_id = y.note_id AND x.tag_id < y.tag_id GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY 1, 2")
STRONG = "strong AS (SELECT * FROM pairs WHERE n * 1225 > (SELECT sum(n) FROM pairs))"
DEGREE = "degree AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM strong UNION ALL SELECT b FROM strong) GROUP BY id)"


def _pairs(spark, sf_dir) -> DataFrame:
    return graph.cooccurrence(D.note_tags(spark, sf_dir))


def _strong(spark, sf_dir) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.crossJoin(F.broadcast(p.agg(F.sum("n").alias("all")))).filter(F.col("n") * 1225 > F.col("all")).select("a", "b", "n")  # one row


@query(with_(D.NOTE_TAGS_SQL, PAIRS) + "SELECT a, b, n FROM pairs")
def tag_cooccurrence(spark, sf_dir) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(with_(D.NOTE_TAGS_SQL, PAIRS, STRONG, DEGREE, """t AS (SELECT tag_id, count(*) AS freq, (1 + tag_id % 9) / 10.0::DOUBLE AS recency FROM note_tags GROUP BY tag_id)""",
             "r AS (SELECT tag_id, freq * recency * greatest(coalesce(degree, 0), 1) AS raw FROM t LEFT JOIN degree ON tag_id = id)") + "SELECT tag_id, greatest(1.0, round(raw / max(raw) OVER () * 100, 2))::DOUBLE AS elevation FROM r")
def tag_elevation(spark, sf_dir) -> DataFrame:
    t = D.note_tags(spark, sf_dir).groupBy("tag_id").agg(F.count("*").alias("freq")).withColumn("recency", (1 + F.col("tag_id") % 9) / 10.0)
    d = graph.degrees(_strong(spark, sf_dir)).withColumnRenamed("id", "tag_id")
    return graph.elevation(t.join(d, "tag_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))))


@query(with_(D.NOTE_TAGS_SQL, PAIRS, STRONG, DEGREE) + """SELECT a, b, round(n / (x.degree * y.degree), 9) AS novelty FROM strong JOIN degree x ON a = x.id JOIN degree y ON b = y.id
  WHERE x.degree >= 3 AND y.degree >= 3 ORDER BY novelty DESC, a, b LIMIT 20""")
def surprising_edges(spark, sf_dir) -> DataFrame:
    s = _strong(spark, sf_dir)
    return graph.surprising(s, graph.degrees(s))


@query(with_(D.NOTE_TAGS_SQL, PAIRS, STRONG, "owner AS (SELECT DISTINCT tag_id, tag_id % 7 AS region FROM note_tags)",
             "w AS (SELECT least(x.region, y.region) AS a, greatest(x.region, y.region) AS b, sum(n) AS w FROM strong JOIN owner x ON a = x.tag_id JOIN owner y ON b = y.tag_id WHERE x.region <> y.region GROUP BY 1, 2)")
       + "SELECT a, b, round(w / max(w) OVER (), 6)::DOUBLE AS weight FROM w")
def implied_region_edges(spark, sf_dir) -> DataFrame:
    owner = D.note_tags(spark, sf_dir).select("tag_id").distinct().withColumn("region", F.col("tag_id") % 7)
    return graph.implied_edges(_strong(spark, sf_dir), owner)


MENTION = "mention AS (SELECT o_custkey AS entity, o_orderkey AS note_id FROM orders)"


@query(with_(D.NOTE_TAGS_SQL, MENTION, "x AS (SELECT entity % 40 AS l, tag_id AS r, count(DISTINCT note_id) AS shared FROM mention JOIN note_tags USING (note_id) GROUP BY 1, 2)", "nr AS (SELECT tag_id AS r, count(*) AS n FROM note_tags GROUP BY 1)")
       + "SELECT l, r, shared, round(shared / n, 6) AS ratio FROM x JOIN nr USING (r) WHERE round(shared / n, 6) >= 0.03")
def entity_tag_overlap(spark, sf_dir) -> DataFrame:
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note_id"), (F.col("o_custkey") % 40).alias("l"))
    return graph.overlap(left, D.note_tags(spark, sf_dir).withColumnRenamed("tag_id", "r"), "note_id", 0.03, "right")


@query(with_("m AS (SELECT DISTINCT c_nationkey AS g, l_partkey % 2000 AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)", "s AS (SELECT g, count(*) AS n FROM m GROUP BY g)",
             "p AS (SELECT x.g AS a, y.g AS b, count(*) AS n FROM m x JOIN m y ON x.item = y.item AND x.g < y.g GROUP BY 1, 2)")
       + "SELECT a, b, round(p.n / (x.n + y.n - p.n), 6) AS jaccard FROM p JOIN s x ON a = x.g JOIN s y ON b = y.g WHERE round(p.n / (x.n + y.n - p.n), 6) >= 0.2 ORDER BY jaccard DESC, a, b LIMIT 20")
def region_jaccard(spark, sf_dir) -> DataFrame:
    l, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    m = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("g"), (F.col("l_partkey") % 2000).alias("item"))
    return graph.set_jaccard(m, "g", "item", 0.2, 20)


@query(with_(D.NOTE_TAGS_SQL, PAIRS, STRONG, "w AS (SELECT a AS src, b AS dst, n FROM strong UNION ALL SELECT b, a, n FROM strong)") + """SELECT src AS seed, dst, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rank FROM w) WHERE rank <= 5""")
def neighbour_walk(spark, sf_dir) -> DataFrame:
    edges = _strong(spark, sf_dir).withColumnRenamed("n", "weight")
    seeds = D.note_tags(spark, sf_dir).select(F.col("tag_id").alias("id")).distinct()
    return graph.neighbours(seeds, edges, 5, [F.desc("weight"), F.col("dst")]).withColumn("rank", F.col("rank").cast("long"))


@query(with_(D.NOTE_TAGS_SQL) + """SELECT note_id, tag_id FROM (SELECT note_id, tag_id, row_number() OVER (PARTITION BY note_id ORDER BY freq DESC, tag_id) AS r FROM note_tags JOIN (SELECT tag_id, count(*) AS freq FROM note_tags GROUP BY 1) USING (tag_id)) WHERE r = 1""")
def primary_tag(spark, sf_dir) -> DataFrame:
    t = D.note_tags(spark, sf_dir)
    freq = t.groupBy("tag_id").agg(F.count("*").alias("freq"))
    return t.join(freq, "tag_id").groupBy("note_id").agg(F.max_by("tag_id", F.struct("freq", (-F.col("tag_id")).alias("t"))).alias("tag_id"))


@query(with_(D.NOTE_TAGS_SQL) + "SELECT note_id, tag_id, 'left' AS side FROM note_tags WHERE tag_id % 10 = 3 AND note_id % 2 = 0")
def link_consistency(spark, sf_dir) -> DataFrame:
    t = D.note_tags(spark, sf_dir)
    return trees.one_sided(t, t.filter("not (tag_id % 10 = 3 and note_id % 2 = 0)"), ["note_id", "tag_id"])


# Vectors and retrieval ------------------------------------------------------------------------------------------------

COS = "list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])"


@query(f"""SELECT query_id, id, score, rank FROM (SELECT y.vec_id AS query_id, x.vec_id AS id, round({COS}, 6) AS score, row_number() OVER (PARTITION BY y.vec_id ORDER BY round({COS}, 6) DESC, x.vec_id) AS rank
  FROM embeddings x JOIN embeddings y ON y.vec_id % 100 = 0 AND x.vec_id <> y.vec_id WHERE round({COS}, 6) >= 0.2) WHERE rank <= 8""")
def vector_search(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return retrieval.search(v, v.filter("vec_id % 100 = 0"), 8, 0.2).withColumn("rank", F.col("rank").cast("long"))


def dimension(spark, sf_dir) -> int:
    first = retrieval.dominant_size(table(spark, sf_dir, "embeddings")).first()
    return first["size"] if first else 0


@query("SELECT len(embedding)::INT AS size, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, size LIMIT 1")
def dominant_size(spark, sf_dir) -> DataFrame:
    return retrieval.dominant_size(table(spark, sf_dir, "embeddings"))


MEANS = "means AS (SELECT label, pos, avg(embedding[pos]::DOUBLE) AS v FROM embeddings, range(1, 65) r(pos) GROUP BY label, pos), centres AS (SELECT label, pos, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS v FROM means), cl AS (SELECT label, list(v ORDER BY pos) AS centroid FROM centres GROUP BY label)"


def _centres(spark, sf_dir) -> DataFrame:
    return retrieval.centroids(table(spark, sf_dir, "embeddings"), "label", dimension(spark, sf_dir))


@query(with_(MEANS) + "SELECT label, (pos - 1)::INT AS pos, round(v, 6) AS v FROM centres")
def label_centroids(spark, sf_dir) -> DataFrame:
    return _centres(spark, sf_dir).select("label", F.posexplode("centroid").alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("""WITH u AS (SELECT label, vec_id, pos, embedding[pos]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS v FROM embeddings, range(1, 65) r(pos)), s AS (SELECT label, pos, sum(v) AS s FROM u GROUP BY 1, 2), c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label, n, round((sum(s * s) - n) / (n * (n - 1)), 6) AS coherence FROM s JOIN c USING (label) GROUP BY label, n""")
def label_coherence(spark, sf_dir) -> DataFrame:
    return retrieval.coherence(table(spark, sf_dir, "embeddings"), "label", dimension(spark, sf_dir))


@query(with_(MEANS) + """SELECT vec_id AS id, c.label AS region, CASE WHEN c.label = e.label THEN 1.0 ELSE round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) END::DOUBLE AS weight FROM embeddings e, cl c
  WHERE c.label = e.label OR round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) >= 0.25""")
def region_memberships(spark, sf_dir) -> DataFrame:
    return retrieval.memberships(table(spark, sf_dir, "embeddings"), _centres(spark, sf_dir), 0.25)


@query(with_(MEANS, "s AS (SELECT vec_id, c.label, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS score FROM embeddings e, cl c)")
       + "SELECT vec_id AS id, CASE WHEN max(score) > 0.35 THEN arg_max(label, score) END AS region, max(score) AS score FROM s GROUP BY vec_id")
def noise_absorption(spark, sf_dir) -> DataFrame:
    return retrieval.best_centre(table(spark, sf_dir, "embeddings"), _centres(spark, sf_dir), 0.35)


@query(with_(MEANS) + "SELECT x.label AS a, y.label AS b, round(list_dot_product(x.centroid, y.centroid), 6) AS score FROM cl x JOIN cl y ON x.label < y.label WHERE round(list_dot_product(x.centroid, y.centroid), 6) >= 0.0 ORDER BY score DESC, a, b LIMIT 40")
def merge_candidates(spark, sf_dir) -> DataFrame:
    return retrieval.centre_pairs(_centres(spark, sf_dir), 0.0, 40)


CANDIDATES = f"""cand AS (SELECT y.vec_id AS query_id, x.vec_id AS id, round({COS}, 6) AS semantic, (x.vec_id % 10) / 10.0::DOUBLE AS recency, (x.vec_id % 7) / 1.0::DOUBLE AS centrality, (x.vec_id % 3) / 4.0::DOUBLE AS affinity
  FROM embeddings x JOIN embeddings y ON y.vec_id % 100 = 0)"""


@query(with_(CANDIDATES, "c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, id) AS m FROM cand)", """s AS (SELECT query_id, id, round(0.55::DOUBLE * semantic + 0.15::DOUBLE * recency + 0.10::DOUBLE * CASE WHEN max(centrality) OVER w > 0 THEN centrality / max(centrality) OVER w ELSE 0 END + 0.20::DOUBLE * affinity, 9) AS score
  FROM c WHERE m <= 40 WINDOW w AS (PARTITION BY query_id))""", "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)") + "SELECT query_id, id, score, rank FROM r WHERE rank <= 15 AND (rank <= 3 OR score >= 0.08)")
def rerank(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    cand = retrieval.candidates(v, v.filter("vec_id % 100 = 0")).select("query_id", "id", "semantic", ((F.col("id") % 10) / 10.0).alias("recency"), ((F.col("id") % 7) / 1.0).alias("centrality"), ((F.col("id") % 3) / 4.0).alias("affinity"))
    return retrieval.rerank(cand, personal=True).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations), b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k WHERE nth <= 3)
SELECT conv_id, turn, role, substr(text, 1, (4000 - before)::INT) AS text FROM b WHERE before < 4000""")
def budgeted_expansion(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return retrieval.within_budget(c, "conv_id", [F.col("turn")], "text", "role", 3, 4000).select("conv_id", "turn", "role", "text")


SCOREDL = "s AS (SELECT length(text)::INT AS score, toxic = 1 AS positive FROM documents JOIN labels USING (doc_id))"


def _labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.char_length("text").alias("score"), (F.col("toxic") == 1).alias("positive"), "quality")


@query(with_(SCOREDL, "c AS (SELECT score, count(*) AS n, sum(positive::INT) AS p FROM s GROUP BY score)", "r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM c)")
       + "SELECT round((sum(rank * p) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(n - p)), 6)::DOUBLE AS auc FROM r")
def ranking_auc(spark, sf_dir) -> DataFrame:
    return retrieval.auc(_labelled(spark, sf_dir))


@query(with_(SCOREDL, "c AS (SELECT score, count(*) AS n, sum(positive::INT) AS p FROM s GROUP BY score)", "t AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n - p) OVER (ORDER BY score DESC) AS fp, sum(n) OVER () AS a, sum(p) OVER () AS pos FROM c)")
       + "SELECT score AS threshold, round((tp + a - pos - fp) / a, 6)::DOUBLE AS accuracy FROM t ORDER BY accuracy DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir) -> DataFrame:
    return retrieval.best_threshold(_labelled(spark, sf_dir))


# Texts ----------------------------------------------------------------------------------------------------------------

WORDS = "w AS (SELECT doc_id, text, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents)"


@query(with_(WORDS, "c AS (SELECT doc_id, text, w, unnest(CASE WHEN len(w) > 1400 THEN range(0, len(w), 900) ELSE [0] END) AS start FROM w)", "x AS (SELECT doc_id, start // 900 AS shard, CASE WHEN len(w) > 1400 THEN least(900, len(w) - start) ELSE len(w) END AS n_words, CASE WHEN len(w) > 1400 THEN array_to_string(w[start + 1 : start + 900], ' ') ELSE text END AS content FROM c)")
       + "SELECT doc_id, shard::INT AS shard, n_words::INT AS n_words, 'sha256:' || sha256(content) AS content_hash FROM x")
def chunk_shards(spark, sf_dir) -> DataFrame:
    return texts.shards(table(spark, sf_dir, "documents")).drop("content")


STOP = "(" + ", ".join(f"'{w}'" for w in texts.STOPWORDS) + ")"
CLEAN = "c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '\\s+', ' ', 'g')) AS c FROM documents)"


@query(with_(CLEAN, "t AS (SELECT doc_id, unnest(f) AS word, generate_subscripts(f, 1) AS pos FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(c), '[\\p{L}\\p{N}_-]+'), lambda x: regexp_full_match(x, '[a-z][a-z0-9-]{3,}') AND x NOT IN " + STOP + ") AS f FROM c))",
             "k AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM t GROUP BY 1, 2)", "r AS (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM k)") + "SELECT doc_id, word, n, rank FROM r WHERE rank <= 10")
def document_tags(spark, sf_dir) -> DataFrame:
    return texts.top_words(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


@query(with_("t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]+'), lambda x: regexp_full_match(x, '[a-z0-9][a-z0-9-]{2,}'))) AS t FROM documents)", "k AS (SELECT doc_id, t, count(*) AS n FROM t GROUP BY 1, 2)", "h AS (SELECT doc_id, n, sha256(t) AS h FROM k)",
             "s AS (SELECT doc_id, (('0x' || substr(h, 1, 8))::BIGINT % 64)::INT AS slot, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN n ELSE -n END) AS v FROM h GROUP BY 1, 2)")
       + "SELECT doc_id, slot, round(v / len, 6)::DOUBLE AS value FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY doc_id)::DOUBLE) AS len FROM s) WHERE v <> 0")
def hash_embeddings(spark, sf_dir) -> DataFrame:
    return texts.hash_embedding(table(spark, sf_dir, "documents"))


@query(with_("p AS (SELECT o_orderkey AS k, '# Plan ' || (o_orderkey % 9) || chr(10) || 'see [[Note ' || (o_orderkey % 5) || '|alias]] and https://ex.org/' || (o_orderkey % 3) || '). ' || chr(10) || '## Part' || chr(10) || 'ask @user' || (o_orderkey % 4) || ' on ABC-' || (o_orderkey % 6) || ', @user' || (o_orderkey % 4) AS t FROM orders)")
       + "SELECT k, 'https://ex.org/' || (k % 3) AS urls, '@user' || (k % 4) || ',ABC-' || (k % 6) AS mentions, 'Note ' || (k % 5) AS wikilinks, 'Plan ' || (k % 9) || ' > Part' AS last_path, 2::BIGINT AS n_sections FROM p")
def markdown_references(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda n: (k % n).cast("string")
    p = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("# Plan "), s(9), F.lit("\nsee [[Note "), s(5), F.lit("|alias]] and https://ex.org/"), s(3), F.lit("). \n## Part\nask @user"), s(4), F.lit(" on ABC-"), s(6), F.lit(", @user"), s(4)).alias("t"))
    secs = texts.sections(p, "k", "t").groupBy("k").agg(F.max_by(F.array_join("path", " > "), "section").alias("last_path"), F.count("*").alias("n_sections"))
    refs = p.select("k", F.array_join(C.urls(F.col("t")), ",").alias("urls"), F.array_join(C.mentions(F.col("t")), ",").alias("mentions"), F.array_join(C.wikilinks(F.col("t")), ",").alias("wikilinks"))
    return refs.join(secs, "k")


@query("""SELECT conv_id, count(*) AS n_messages, count(DISTINCT role) AS n_roles, arg_min(role, turn) AS first_role, sum(length(text))::BIGINT AS n_chars, sha256(string_agg('**' || role || ':** ' || text, chr(10) || chr(10) ORDER BY turn)) AS markdown_sha FROM conversations GROUP BY conv_id""")
def conversation_threads(spark, sf_dir) -> DataFrame:
    out = texts.threads(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_messages", "n_roles", "first_role", "n_chars", F.sha2("markdown", 256).alias("markdown_sha"))


@query()
def html_to_text(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", texts.html_to_text("html").alias("text"))


#: What each phrase of derived.PHRASES means, in their order, from the anchor a with its weekday w (Monday 0).
DUE = [
    "a + CASE WHEN (11 - w) % 7 = 0 THEN 7 ELSE (11 - w) % 7 END", "a + (8 - w) % 7 + 7", "a + 14", "a + 3", "(a + INTERVAL 1 MONTH)::DATE", "a + 1", "a", "last_day(a)", "last_day((date_trunc('quarter', a) + INTERVAL 2 MONTH)::DATE)", "make_date(year(a), 12, 31)", "a + 6 - w",
    "last_day((date_trunc('quarter', a) + INTERVAL 5 MONTH)::DATE)", "a + 13 - w", "last_day((date_trunc('month', a) + INTERVAL 1 MONTH)::DATE)", "last_day(make_date(year(a) + (month(a) > 4)::INT, 4, 1))", "last_day(make_date(year(a) + (month(a) > 9)::INT, 9, 1))",
    "make_date(year(a) + (a > make_date(year(a), 3, 31))::INT, 3, 31)", "DATE '2027-04-30'", "last_day(make_date(year(a) + (a > last_day(make_date(year(a), 2, 1)))::INT, 2, 1))", "DATE '2026-02-28'", "DATE '2027-05-31'", "last_day(make_date(year(a) + (a > make_date(year(a), 9, 30))::INT, 9, 1))", "DATE '2028-03-31'",
    "NULL", "NULL", "make_date(year(a) + (a > make_date(year(a), 11, 30))::INT, 11, 30)",
]
DUE_SQL = "CASE k " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(DUE)) + " END"


@query("SELECT o_orderkey, phrase, a AS anchor, (" + DUE_SQL + ")::DATE AS due FROM (SELECT o_orderkey, o_orderkey % " + str(len(DUE)) + " AS k, [" + ", ".join(f"'{p}'" for p in D.PHRASES) + "][o_orderkey % " + str(len(DUE)) + " + 1] AS phrase, o_orderdate::DATE AS a, (isodow(o_orderdate) - 1)::INT AS w FROM orders)")
def deadlines(spark, sf_dir) -> DataFrame:
    phrases = F.array(*map(F.lit, D.PHRASES))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.get(phrases, (F.col("o_orderkey") % len(D.PHRASES)).cast("int")).alias("phrase"), F.to_date("o_orderdate").alias("anchor"))
    return rows.select("o_orderkey", "phrase", "anchor", C.resolve_deadline(F.col("phrase"), F.col("anchor")).alias("due"))


@query()
def signal_lines(spark, sf_dir) -> DataFrame:
    return texts.signal_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def document_entities(spark, sf_dir) -> DataFrame:
    return texts.entities(table(spark, sf_dir, "documents"))


@query()
def document_summaries(spark, sf_dir) -> DataFrame:
    return texts.summaries(table(spark, sf_dir, "documents"))


@query()
def communities(spark, sf_dir) -> DataFrame:
    return graph.label_propagation(_strong(spark, sf_dir).withColumnRenamed("n", "weight"))


@query(with_(D.NOTE_TAGS_SQL, PAIRS, STRONG, "w AS (SELECT a AS src, b AS dst, n FROM strong UNION ALL SELECT b, a, n FROM strong)", "e AS (SELECT vec_id AS id, unnest(range(1, 65)) AS pos, unnest(embedding::DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (SELECT tag_id FROM note_tags))",
             "m AS (SELECT src AS id, pos, sum(v * n) / sum(n) AS mean FROM w JOIN e ON dst = e.id GROUP BY 1, 2)", "x AS (SELECT id, pos, CASE WHEN mean IS NULL THEN v ELSE 0.5::DOUBLE * v + 0.5::DOUBLE * mean END AS m FROM e LEFT JOIN m USING (id, pos))", "l AS (SELECT id, sqrt(sum(m * m)) AS len FROM x GROUP BY id)")
       + "SELECT id, (pos - 1)::INT AS pos, round(m / CASE WHEN len > 0 THEN len ELSE 1 END, 6) AS v FROM x JOIN l USING (id)")
def context_vectors(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    nodes = v.join(D.note_tags(spark, sf_dir).select(F.col("tag_id").alias("id")).distinct(), "id")  # a tag's vector is that of its id
    found = graph.context_vectors(nodes, _strong(spark, sf_dir).withColumnRenamed("n", "weight"), dimension(spark, sf_dir))
    return found.select("id", F.posexplode("context").alias("pos", "v")).withColumn("v", F.round("v", 6))


# Map, clusters, matching, streams ------------------------------------------------------------------------------------

GRID = """grid AS (SELECT q, r, 3.0::DOUBLE * (2 * q + r) AS x, 3.0::DOUBLE * sqrt(3.0::DOUBLE) * r AS z FROM range(-12, 13) a(q), range(-14, 15) b(r) WHERE abs(3.0 * (2 * q + r)) <= 60 AND abs(3.0::DOUBLE * sqrt(3.0::DOUBLE) * r) <= 60),
regions AS (SELECT n_nationkey AS region, ((n_nationkey * 37) % 100 - 50)::DOUBLE AS cx, ((n_nationkey * 53) % 100 - 50)::DOUBLE AS cz, (8 + n_nationkey % 9)::DOUBLE AS radius FROM nation)"""


def _warp_sql(x: str, z: str, amplitude: float = 4.0) -> tuple[str, str]:
    return (
        f"({x} + {amplitude} * (sin(0.045 * {x}) * cos(0.038 * {z}) + 0.55 * sin(0.11 * {x} + 1.0) * sin(0.09 * {z} + 0.5) + 0.30 * cos(0.18 * {x}) * sin(0.21 * {z})))",
        f"({z} + {amplitude} * (cos(0.052 * {x} + 0.7) * sin(0.041 * {z}) + 0.55 * cos(0.115 * {z}) * sin(0.097 * {x} + 1.2) + 0.30 * cos(0.16 * {z}) * sin(0.20 * {x})))",
    )


def _regions(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("region"), ((n * 37) % 100 - 50).cast("double").alias("cx"), ((n * 53) % 100 - 50).cast("double").alias("cz"), (8 + n % 9).cast("double").alias("radius"))


def _owned(spark, sf_dir) -> DataFrame:
    from lattica.operators import layout

    return layout.own_hexes(layout.hex_grid(spark, 60.0, 3.0), _regions(spark, sf_dir), 4.0)


OWNED = (
    "pairs AS (SELECT q, r, x, z, region, radius, "
    f"({_warp_sql('x', 'z')[0]} - {_warp_sql('cx', 'cz')[0]}) ** 2 + ({_warp_sql('x', 'z')[1]} - {_warp_sql('cx', 'cz')[1]}) ** 2 AS d2 FROM grid, regions),\n"
    "best AS (SELECT *, row_number() OVER (PARTITION BY q, r ORDER BY d2, region) AS k FROM pairs),\n"
    "owned AS (SELECT q, r, x, z, CASE WHEN d2 <= (radius * 1.15) ** 2 THEN region END AS region FROM best WHERE k = 1)"
)


@query(with_(GRID, OWNED) + "SELECT q::INT AS q, r::INT AS r, round(x, 6) AS x, round(z, 6) AS z, region FROM owned")
def hex_owners(spark, sf_dir) -> DataFrame:
    return _owned(spark, sf_dir).select("q", "r", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"), "region")


@query(with_(GRID, OWNED, "m AS (SELECT region, count(*) AS hexes, avg(x) AS cx, avg(z) AS cz FROM owned WHERE region IS NOT NULL GROUP BY region)")
       + "SELECT region, hexes, round(cx, 6) AS cx, round(cz, 6) AS cz, round(max(sqrt((x - cx) ** 2 + (z - cz) ** 2)), 6) AS radius FROM owned JOIN m USING (region) GROUP BY region, hexes, cx, cz")
def region_footprints(spark, sf_dir) -> DataFrame:
    from lattica.operators import layout

    f = layout.region_footprints(_owned(spark, sf_dir))
    return f.select("region", "hexes", *(F.round(c, 6).alias(c) for c in ("cx", "cz", "radius")))


@query(with_(GRID) + "SELECT min(cx - radius) AS min_x, max(cx + radius) AS max_x, min(cz - radius) AS min_z, max(cz + radius) AS max_z FROM regions")
def map_bounds(spark, sf_dir) -> DataFrame:
    from lattica.operators import layout

    return layout.bounds(_regions(spark, sf_dir))


@query(with_(GRID) + "SELECT a.q::INT AS q, a.r::INT AS r, count(*) AS n FROM grid a JOIN grid b ON (b.q - a.q, b.r - a.r) IN ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)) GROUP BY 1, 2")
def hex_neighbours(spark, sf_dir) -> DataFrame:
    from lattica.operators import layout

    return layout.neighbour_pairs(layout.hex_grid(spark, 60.0, 3.0)).groupBy("q", "r").agg(F.count("*").alias("n"))


@query()
def hex_heights(spark, sf_dir) -> DataFrame:
    from lattica.operators import layout

    owned = _owned(spark, sf_dir).withColumn("pinned", F.col("region").isNull()).withColumn("height", F.when(F.col("region").isNull(), 0.0).otherwise((F.col("region") % 5 + 1).cast("double")))
    return layout.diffuse(owned, 10).select("q", "r", F.round("height", 6).alias("height"))


@query()
def semantic_positions(spark, sf_dir) -> DataFrame:
    from lattica.operators import layout

    return layout.semantic_positions(_centres(spark, sf_dir).withColumnRenamed("label", "region"))


@query()
def density_clusters(spark, sf_dir) -> DataFrame:
    from lattica.operators import clustering

    return clustering.density_clusters(table(spark, sf_dir, "embeddings").withColumn("g", F.col("label") % 5), "g")


@query()
def canonical_labels(spark, sf_dir) -> DataFrame:
    from lattica.operators import clustering

    words = texts.top_words(table(spark, sf_dir, "documents"), k=1).groupBy("word").agg(F.count("*").alias("n"))
    return clustering.canonical_labels(words, "word")


@query()
def anchor_matches(spark, sf_dir) -> DataFrame:
    from lattica.operators import clustering

    # last run's regions are tags shifted by a third of their notes; matched to this run's by the overlap of their notes
    t = D.note_tags(spark, sf_dir)
    old = t.filter("(note_id + tag_id) % 3 <> 0").select("note_id", F.concat(F.lit("old"), F.col("tag_id").cast("string")).alias("l"))
    new = t.select("note_id", F.concat(F.lit("new"), F.col("tag_id").cast("string")).alias("r"))
    size = lambda f, c: f.groupBy(c).agg(F.count("*").alias(f"n{c}"))
    met = old.join(new, "note_id").groupBy("l", "r").agg(F.count("*").alias("n")).join(size(old, "l"), "l").join(size(new, "r"), "r")
    pairs = met.select(F.col("l").alias("a"), F.col("r").alias("b"), F.round(F.col("n") / (F.col("nl") + F.col("nr") - F.col("n")), 6).alias("score")).filter("score >= 0.05")
    return clustering.greedy_matches(pairs)


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(ORACLE["idle_sessions"] + " HAVING min(ts) IS NOT NULL")
def stream_idle_sessions(spark, sf_dir) -> DataFrame:
    """The sessions as a stream: its last hour stays open under the watermark, so the batch form closes what is left."""
    from lattica.streaming import harvest as streams

    closed = streams.run_to_table(streams.stream_sessions(_event_stream(spark, sf_dir)), "sessions")
    # written first: the optimizer would push the anti-join below the merging of the session windows
    whole = materialize(idle_sessions(spark, sf_dir), "sessions-batch")
    return closed.unionByName(whole.join(closed, ["user_id", "start"], "left_anti"))


@query(with_(D.LOG_SQL) + "SELECT date_trunc('day', ts)::TIMESTAMP AS start, source, change, count(*) AS n FROM log WHERE change IS NOT NULL AND ts < date_trunc('day', (SELECT max(ts) FROM log WHERE change IS NOT NULL) - INTERVAL 1 HOUR) GROUP BY 1, 2, 3")
def stream_change_counts(spark, sf_dir) -> DataFrame:
    """Windows that the watermark has closed: all days before the last event less an hour."""
    from lattica.streaming import harvest as streams

    e = _event_stream(spark, sf_dir)
    change = F.when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "purchase", "updated").when(F.col("event_type") == "error", "deleted")
    log = e.select(F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source"), change.alias("change"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.run_to_table(streams.stream_change_counts(log), "change-counts")


@query(with_(D.MANIFEST_SQL, D.LISTING_SQL, UPSERT) + "SELECT source_id, CASE action WHEN 'new' THEN 1 WHEN 'updated' THEN v + 1 ELSE v END AS version, CASE WHEN listed THEN 'active' ELSE s END AS status FROM u")
def stream_upserts(spark, sf_dir) -> DataFrame:
    """The manifest after the listing has landed in four files, one micro-batch each."""
    import uuid

    from lattica.session import shared_dir
    from lattica.streaming import harvest as streams

    root = f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"
    incoming = D.listing(spark, sf_dir).select("source_id", "content_hash", "modified")
    incoming.repartition(4, "source_id").write.parquet(f"{root}/in")
    manifest = streams.ManifestTable(spark, f"{root}/manifest", D.manifest(spark, sf_dir).select("source_id", "content_hash", "modified", "version", "status"))
    run = streams.stream_upserts(f"{root}/in", "source_id long, content_hash string, modified timestamp", manifest, f"{root}/checkpoint")
    run.awaitTermination()
    done = [b["batchId"] for b in run.recentProgress if b["numInputRows"]]
    return manifest.read(max(done) + 1 if done else 0).select("source_id", "version", "status")
