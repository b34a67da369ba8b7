"""Queries of the serving side, each with its DuckDB twin; imported by lattica.plans.queries' users through ``QUERIES``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import columns as C
from lattica.operators import graph, ranking, serve, trees
from lattica.plans.queries import CLOSURE, COS, DEGREE, ORACLE, PAIRS, QUERIES, STRONG, _strong, query, rec, with_
from lattica.session import table
from lattica.sources import derived as D

__all__ = ["ORACLE", "QUERIES"]

EDGES = "edges AS (SELECT l_orderkey AS src, l_partkey AS dst, ['contains','mentions','has-signal'][l_linenumber % 3 + 1] AS type, l_discount * 10 AS weight, 1 - l_tax AS confidence FROM lineitem)"


def _edges(spark, sf_dir) -> DataFrame:
    kind = F.element_at(F.array(F.lit("contains"), F.lit("mentions"), F.lit("has-signal")), F.col("l_linenumber") % 3 + 1)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), kind.alias("type"), (F.col("l_discount") * 10).alias("weight"), (1 - F.col("l_tax")).alias("confidence"))


@query(with_(EDGES) + "SELECT type, count(*) AS n FROM edges WHERE weight >= 0.4::DOUBLE AND confidence >= CASE type WHEN 'mentions' THEN 0.95 WHEN 'has-signal' THEN 0.98 ELSE 0.5 END::DOUBLE GROUP BY type")
def edge_gate(spark, sf_dir) -> DataFrame:
    return graph.edge_gate(_edges(spark, sf_dir), {"mentions": 0.95, "has-signal": 0.98}).groupBy("type").agg(F.count("*").alias("n"))


GRAPH = """nodes AS (SELECT 'n' || o_orderkey AS id, 'note' AS type, []::VARCHAR[] AS s FROM orders UNION ALL SELECT 's' || c_custkey, 'signal', (SELECT coalesce(list('n' || o_orderkey), []::VARCHAR[]) FROM orders WHERE o_custkey = c_custkey) FROM customer),
edges AS (SELECT 's' || o_custkey AS src, 'n' || o_orderkey AS dst FROM orders), excluded AS (SELECT 'n' || o_orderkey AS id FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-15'),
dead AS (SELECT id FROM nodes WHERE type = 'signal' AND len(s) > 0 AND len(list_filter(s, lambda x: x NOT IN (SELECT 'z'))) > 0 AND NOT EXISTS (SELECT 1 FROM edges WHERE src = nodes.id AND dst NOT IN (SELECT id FROM excluded))),
gone AS (SELECT id FROM excluded UNION SELECT id FROM dead)"""


def _graph(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    note, signal = F.concat(F.lit("n"), F.col("o_orderkey").cast("string")), F.concat(F.lit("s"), F.col("o_custkey").cast("string"))
    sources = o.groupBy(signal.alias("id")).agg(F.collect_list(note).alias("source_note_ids"))
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("id"))
    empty = F.array().cast("array<string>")
    nodes = o.select(note.alias("id"), F.lit("note").alias("type"), empty.alias("source_note_ids")).unionByName(customers.join(sources, "id", "left").select("id", F.lit("signal").alias("type"), F.coalesce("source_note_ids", empty).alias("source_note_ids")))
    excluded = o.filter(F.col("o_orderdate") > F.lit("1995-06-15").cast("timestamp_ntz")).select(note.alias("id"))
    return nodes, o.select(signal.alias("src"), note.alias("dst")), excluded


@query(with_(GRAPH.replace("AND len(list_filter(s, lambda x: x NOT IN (SELECT 'z'))) > 0 ", "")) + "SELECT id, type FROM nodes WHERE id NOT IN (SELECT id FROM gone)")
def as_of_graph(spark, sf_dir) -> DataFrame:
    return serve.restrict_nodes(*_graph(spark, sf_dir))[0].select("id", "type")


@query(with_(GRAPH.replace("AND len(list_filter(s, lambda x: x NOT IN (SELECT 'z'))) > 0 ", "")) + "SELECT DISTINCT src AS id FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def surviving_signals(spark, sf_dir) -> DataFrame:
    nodes, edges = serve.restrict_nodes(*_graph(spark, sf_dir))
    return serve.touching(nodes.filter("type = 'signal'"), edges).select("id")


@query(f"""SELECT label, id, score, rank FROM (SELECT e.label, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY e.label ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) > 0) WHERE rank <= 5""")
def seeds_by_type(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = v.crossJoin(F.broadcast(q)).select("label", F.col("vec_id").alias("id"), F.round(C.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))  # one query vector
    return serve.top_seeds(scored, "label", 5).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH e AS (SELECT p_partkey AS id, p_name AS label FROM part), m AS (SELECT DISTINCT p_name AS mention FROM part WHERE p_partkey % 100 = 0)
SELECT mention, id FROM m, e WHERE (contains(lower(label), lower(mention)) OR contains(lower(mention), lower(label)))
  AND len(list_intersect(list_filter(regexp_split_to_array(lower(label), '[^a-z0-9_]+'), lambda x: x <> ''), regexp_split_to_array(lower(mention), '[^a-z0-9_]+'))) > 0""")
def mention_entities(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return serve.contains_either(p.filter("p_partkey % 100 = 0").select(F.col("p_name").alias("mention")).distinct(), p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")))


@query("""WITH w AS (SELECT p_name AS ref FROM part WHERE p_partkey % 100 = 0 UNION SELECT upper(p_name) FROM part WHERE p_partkey % 100 = 50) SELECT ref, min(p_partkey) AS id FROM w JOIN part ON lower(p_name) = lower(ref) GROUP BY ref""")
def node_resolution(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    refs = p.filter("p_partkey % 100 = 0").select(F.col("p_name").alias("ref")).union(p.filter("p_partkey % 100 = 50").select(F.upper("p_name"))).distinct()
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    found = serve.resolve_nodes(refs, nodes.withColumn("id", F.lpad(F.col("id").cast("string"), 12, "0")))
    return found.select("ref", F.col("id").cast("long").alias("id"))


@query("""SELECT o_orderkey AS k, ['U' || (o_orderkey % 3), 'Note ' || (o_orderkey % 4), 'Big Plan'] AS mentions, CASE WHEN o_orderkey % 2 = 0 THEN ['c1'] ELSE ['c2', 'c1'] END AS cites FROM orders""".replace("['U' || (o_orderkey % 3), 'Note ' || (o_orderkey % 4), 'Big Plan']", "'U' || (o_orderkey % 3) || ',Note ' || (o_orderkey % 4) || ',Big Plan'").replace("['c1'] ELSE ['c2', 'c1']", "'c1' ELSE 'c2,c1'"))
def mentions_and_citations(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    q = F.concat(F.lit("ask @U"), (k % 3).cast("string"), F.lit(" of [[Note "), (k % 4).cast("string"), F.lit("|x]] on Big Plan and @u"), (k % 3).cast("string"))
    a = F.when(k % 2 == 0, F.lit("so [c1] and [c9] [c1]")).otherwise(F.lit("[c2] then [c1], [c2]"))
    valid = F.array(F.lit("c1"), F.lit("c2"), F.lit("c3"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.array_join(serve.query_mentions(q), ",").alias("mentions"), F.array_join(serve.citations(a, valid), ",").alias("cites"))


@query(rec(D.TREE_SQL, CLOSURE, D.SIGNALS_SQL) + """SELECT ancestor_id AS node_id, count(*) FILTER (kind = 'risk') AS risks, count(*) FILTER (kind = 'todo') AS todos, count(*) FILTER (kind = 'open_question') AS questions,
  count(*) FILTER (kind = 'decision') AS decisions, max(severity) AS severity FROM closure JOIN signals ON region_id = node_id WHERE status = 'open' GROUP BY ancestor_id""")
def region_cards(spark, sf_dir) -> DataFrame:
    return serve.region_cards(trees.ancestors(D.tree(spark, sf_dir)), D.signals(spark, sf_dir))


@query(rec(D.TREE_SQL, CLOSURE) + "SELECT node_id, arg_min(ancestor_id, distance) AS scope_id FROM closure WHERE ancestor_id IN ('r0', 'n3', 'r2', 'n8') GROUP BY node_id")
def scope_filter(spark, sf_dir) -> DataFrame:
    return serve.nearest_scope(trees.ancestors(D.tree(spark, sf_dir)), spark.createDataFrame([("r0",), ("n3",), ("r2",), ("n8",)], "scope_id string"))


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(n1, 0) AS orders, coalesce(n2, 0) AS customers FROM (SELECT o_custkey % 50 AS k, count(*) AS n1 FROM orders GROUP BY 1) a FULL OUTER JOIN (SELECT c_custkey % 60 AS k, count(*) AS n2 FROM customer GROUP BY 1) b ON a.k = b.k""")
def anchor_counts(spark, sf_dir) -> DataFrame:
    o, c = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k")), table(spark, sf_dir, "customer").select((F.col("c_custkey") % 60).alias("k"))
    return serve.counts_outer(o, c, "k", ("orders", "customers"))


@query("""SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def dominant_type(spark, sf_dir) -> DataFrame:
    return serve.mode_first(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query(with_(D.NOTE_TAGS_SQL, PAIRS, STRONG, DEGREE, "t AS (SELECT tag_id, coalesce(degree, 0) AS degree, (tag_id * 7 % 50) / 50.0::DOUBLE AS recency FROM (SELECT DISTINCT tag_id FROM note_tags) LEFT JOIN degree ON tag_id = id)",
             "x AS (SELECT a AS tag_id FROM strong WHERE a % 7 <> b % 7 UNION SELECT b FROM strong WHERE a % 7 <> b % 7)")
       + """SELECT 'hub' AS kind, tag_id FROM (SELECT * FROM t WHERE degree > 0 ORDER BY degree DESC, tag_id LIMIT 10) UNION ALL SELECT 'bridge', tag_id FROM x UNION ALL SELECT 'trending', tag_id FROM (SELECT * FROM t ORDER BY recency DESC, tag_id LIMIT 10) UNION ALL SELECT 'isolated', tag_id FROM t WHERE degree = 0""")
def tag_highlights(spark, sf_dir) -> DataFrame:
    s = _strong(spark, sf_dir)
    t = D.note_tags(spark, sf_dir).select("tag_id").distinct().join(graph.degrees(s).withColumnRenamed("id", "tag_id"), "tag_id", "left")
    t = t.select("tag_id", F.coalesce("degree", F.lit(0)).alias("degree"), ((F.col("tag_id") * 7 % 50) / 50.0).alias("recency"))
    far = s.filter("a % 7 <> b % 7")
    return serve.highlights(t, far.select(F.col("a").alias("tag_id")).union(far.select("b")))


@query("""WITH m AS (SELECT 'e' || (l_partkey % 300) AS label, ['product','person'][l_linenumber % 2 + 1] AS type, l_orderkey AS note_id FROM lineitem), c AS (SELECT label, type, count(DISTINCT note_id) AS notes FROM m GROUP BY 1, 2 HAVING count(DISTINCT note_id) >= 2)
SELECT label, type, notes, row_number() OVER (ORDER BY notes DESC, label, type) <= 30 AND notes >= 3 AS synthesise FROM c""")
def entity_promotion(spark, sf_dir) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("e"), (F.col("l_partkey") % 300).cast("string")).alias("label"), F.element_at(F.array(F.lit("product"), F.lit("person")), F.col("l_linenumber") % 2 + 1).alias("type"), F.col("l_orderkey").alias("note_id"))
    return serve.promote_entities(m)


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS status, 1 AS k FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, 'X', 2 FROM orders WHERE o_custkey % 3 = 0) SELECT id, arg_max(status, k) AS status FROM s GROUP BY id""")
def status_upsert(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    stored = o.filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("at"))
    fresh = o.filter("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("X").alias("status"), F.lit(2).alias("at"))
    return serve.upsert_latest(stored, fresh, ["id"], "at").select("id", "status")


@query("""SELECT o_orderkey AS id, 'old' AS src FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_custkey % 3 = 0 AND o_custkey % 2 <> 0""")
def dismissal_import(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    stored = o.filter("o_custkey % 2 = 0").select("id", F.lit("old").alias("src"))
    return serve.insert_missing(stored, o.filter("o_custkey % 3 = 0").select("id", F.lit("new").alias("src")), "id")


@query(with_(D.MANIFEST_SQL) + "SELECT source_id, CASE WHEN version = 2 THEN 'raw/' || source_id ELSE content_hash END AS content_hash, CASE WHEN version = 2 AND source_id % 2 = 0 THEN 0 ELSE raw_bytes END AS raw_bytes FROM manifest")
def path_stamp(spark, sf_dir) -> DataFrame:
    m = D.manifest(spark, sf_dir).select("source_id", "content_hash", "raw_bytes", "version")
    fresh = m.filter("version = 2").select("source_id", F.concat(F.lit("raw/"), F.col("source_id").cast("string")).alias("content_hash"), F.when(F.col("source_id") % 2 == 0, F.lit(0).cast("long")).alias("raw_bytes"))
    return serve.stamp(m, fresh, "source_id", ["content_hash", "raw_bytes"]).drop("version")


@query(with_(D.NOTE_TAGS_SQL, "c AS (SELECT tag_id AS cache_key, note_id AS h FROM note_tags WHERE tag_id % 5 <> 0)", "w AS (SELECT 1000 + tag_id AS want, note_id AS h FROM note_tags WHERE note_id % 40 <> 1)", "nc AS (SELECT cache_key, count(*) AS n FROM c GROUP BY 1)", "nw AS (SELECT want, count(*) AS n FROM w GROUP BY 1)",
             "m AS (SELECT want, cache_key, count(*) AS n FROM c JOIN w USING (h) GROUP BY 1, 2)", "s AS (SELECT want, cache_key, round(m.n / (nw.n + nc.n - m.n), 6) AS overlap FROM m JOIN nc USING (cache_key) JOIN nw USING (want))")
       + "SELECT want, arg_min(cache_key, -overlap) AS cache_key, max(overlap)::DOUBLE AS overlap FROM s WHERE overlap >= 0.9 GROUP BY want")
def note_carry_forward(spark, sf_dir) -> DataFrame:
    t = D.note_tags(spark, sf_dir)
    cached = t.filter("tag_id % 5 <> 0").select(F.col("tag_id").alias("cache_key"), F.lit("tag").alias("kind"), F.lit(0).alias("drift"), F.col("note_id").alias("member_hash"))
    wanted = t.filter("note_id % 40 <> 1").select((1000 + F.col("tag_id")).alias("want"), F.lit("tag").alias("kind"), F.col("note_id").alias("member_hash"))
    return serve.similar_notes(cached, wanted)


@query("""SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, substr(sha256(text), 1, 12) AS short, 'node_' || substr(sha256(source || ':' || lang || '|' || source), 1, 16) AS node, sha256('v1|tag|' || source || '|' || least(lang, source) || '|' || greatest(lang, source)) AS cache_key, sha256('local:64:' || text) AS embedding_hash FROM documents""")
def hash_ids(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", C.content_hash(F.col("text")).alias("content_hash"), C.short_hash(F.col("text"), 12).alias("short"), C.node_id(F.col("source"), F.array("lang", "source")).alias("node"),
        serve.cache_key("v1", F.lit("tag"), F.col("source"), F.array("lang", "source")).alias("cache_key"), F.sha2(F.concat(F.lit("local:64:"), "text"), 256).alias("embedding_hash"),
    )


@query("SELECT p_partkey, row_number() OVER (ORDER BY try_cast(cell AS DOUBLE) NULLS LAST, cell, p_partkey) AS pos FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size::VARCHAR ELSE p_name END AS cell FROM part)")
def sheet_order(spark, sf_dir) -> DataFrame:
    cells = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_name")).alias("cell"))
    number = F.expr("try_cast(cell AS double)")
    return ranking.positions(cells, [(number, "asc_nulls_last"), F.col("cell"), F.col("p_partkey")]).select("p_partkey", "pos")


@query("""SELECT p_partkey, array_to_string(list_filter(range(1, length(p_name)), lambda i: substr(lower(p_name), i, 1) = 'a'), ',') AS at FROM (SELECT p_partkey, p_name || ' ' AS p_name FROM part) WHERE contains(lower(p_name), 'a')""")
def cell_find(spark, sf_dir) -> DataFrame:
    found = serve.find_cells(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("cell")), "a")
    return found.select("p_partkey", F.array_join(F.col("at").cast("array<string>"), ",").alias("at"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%d') AS day FROM events")
def epoch_times(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    iso = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select("event_id", iso.alias("iso"), C.iso_date(F.concat(F.lit("on "), iso)).cast("string").alias("day"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 1 THEN true ELSE false END AS done FROM orders""")
def checkbox_match(spark, sf_dir) -> DataFrame:
    from lattica.operators.texts import TASK_STOPWORDS

    k = F.col("o_orderkey")
    content = F.concat(F.lit("notes\n- ["), F.when(k % 4 == 1, "x").otherwise(" "), F.lit("] Devon: write the plan by Friday\n- ["), F.when(k % 4 == 2, "x").otherwise(" "), F.lit("] buy milk and bread")).cast("string")
    return table(spark, sf_dir, "orders").select(k.alias("k"), serve.checkbox_done(content, F.lit("Devon writes the plan by friday"), TASK_STOPWORDS).alias("done"))


@query(with_(GRAPH) + "SELECT sha256(concat_ws(',', count(*), " + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::BIGINT" for i in range(8)) + ")) AS hash FROM (SELECT sha256(id) AS h FROM nodes UNION ALL SELECT sha256(src || '>' || dst) FROM edges)")
def graph_topology(spark, sf_dir) -> DataFrame:
    nodes, edges, _ = _graph(spark, sf_dir)
    return serve.topology_hash(nodes, edges)


# Compile side ---------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN len(pr) > 0 THEN 'Products' WHEN len(cu) > 0 THEN 'Customer Communication' ELSE 'General' END AS theme, CASE WHEN len(pr) > 0 THEN upper(substr(pr[1], 1, 1)) || substr(pr[1], 2) WHEN len(cu) > 0 THEN cu[1] ELSE 'General' END AS subtopic,
  CASE WHEN len(pr) > 0 THEN 'product' WHEN len(cu) > 0 THEN 'person' ELSE 'concept' END AS tag_type, array_to_string(pr, ',') AS products
  FROM (SELECT p_partkey, list_filter(['a', 'z', '5'], lambda p: contains(lower(p_name), p)) AS pr, CASE WHEN p_size > 25 THEN ['Buyer'] ELSE []::VARCHAR[] END AS cu FROM part)""")
def feature_themes(spark, sf_dir) -> DataFrame:
    from lattica.operators import compile as K

    p = table(spark, sf_dir, "part").select("p_partkey", K.known_products(F.col("p_name"), ["a", "z", "5"]).alias("pr"), F.when(F.col("p_size") > 25, F.array(F.lit("Buyer"))).otherwise(F.array().cast("array<string>")).alias("cu"))
    none = F.array().cast("array<string>")
    theme, sub = K.theme_subtopic(F.col("pr"), F.col("cu"), none, none)
    return p.select("p_partkey", theme.alias("theme"), sub.alias("subtopic"), K.tag_type(F.col("pr"), F.col("cu")).alias("tag_type"), F.array_join("pr", ",").alias("products"))


@query("""SELECT c_custkey, sha256('s' || chr(10) || 'Product: ' || c_mktsegment || ' ' || c_mktsegment || ' ' || c_mktsegment || ' ' || c_mktsegment || chr(10) || 'Customer: ' || c_name || ' ' || c_name || ' ' || c_name || chr(10) || 'Topic: x y' || chr(10) || 'Path: A > B') AS h FROM customer""")
def embedding_texts(spark, sf_dir) -> DataFrame:
    from lattica.operators import compile as K

    lits = lambda *v: F.array(*map(F.lit, v))
    text = K.embedding_text(F.lit("s"), F.array("c_mktsegment"), F.array("c_name"), lits("x", "y"), lits("A", "B"), F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(text, 256).alias("h"))


@query("""WITH m AS (SELECT o_custkey AS g, 'Summary ' || (o_orderkey % 6) || '.' AS s, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2) SELECT g, substr(string_agg(s, ' ' ORDER BY pos), 1, 40) AS note FROM m GROUP BY g""")
def extractive_notes(spark, sf_dir) -> DataFrame:
    from lattica.operators import compile as K

    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.concat(F.lit("Summary "), (F.col("o_orderkey") % 6).cast("string"), F.lit(".")).alias("summary"), F.col("o_orderkey").alias("pos"))
    return K.extractive_notes(m, "g", 40)


@query("""WITH n AS (SELECT c_custkey AS node_id, c_nationkey AS parent_id, lower(c_mktsegment) AS name, c_acctbal AS size FROM customer) SELECT node_id, name || CASE WHEN r > 1 THEN ' ' || r ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, name ORDER BY size DESC, node_id) AS r FROM n)""")
def unique_names(spark, sf_dir) -> DataFrame:
    from lattica.operators import compile as K

    return K.unique_names(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("parent_id"), F.lower("c_mktsegment").alias("name"), F.col("c_acctbal").alias("size")))


@query("""WITH c AS (SELECT o_custkey % 30 AS g, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'e' || (o_orderkey % 7) END AS who, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT g, sum(n)::BIGINT AS total, arg_max(who, n * 100 + substr(who, 2)::INT) FILTER (who IS NOT NULL) AS w, max(n) FILTER (who IS NOT NULL) AS m FROM c GROUP BY g)
SELECT g, total, CASE WHEN m >= 2 THEN w END AS top_editor, CASE WHEN m >= 2 THEN m END AS top_n FROM t""")
def pending_lines(spark, sf_dir) -> DataFrame:
    from lattica.operators import compile as K

    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 30).alias("g"), F.when(k % 4 != 0, F.when(k % 2 == 0, F.concat(F.lit("e"), (k % 7).cast("string"))).otherwise("")).alias("last_modified_by"), F.when((k % 4 != 0) & (k % 2 == 1), F.concat(F.lit("e"), (k % 7).cast("string"))).alias("author"))
    return K.pending_line(rows, "g")


@query(with_(D.MANIFEST_SQL, D.LISTING_SQL) + "SELECT n.source_id, NOT coalesce(n.modified <= m.modified AND m.scope IS NOT NULL AND m.status = 'active' AND m.version <> 3, false) AS refetch FROM listing n LEFT JOIN manifest m USING (source_id)")
def resume_predicate(spark, sf_dir) -> DataFrame:
    from lattica.operators import compile as K

    m = D.manifest(spark, sf_dir).select("source_id", F.col("modified").alias("stored"), F.col("scope").alias("raw_path"), "status", "version")
    joined = D.listing(spark, sf_dir).join(m, "source_id", "left")
    flag = K.needs_refetch(F.col("modified"), F.col("stored"), F.col("raw_path"), F.coalesce("status", F.lit("")), F.coalesce("version", F.lit(0)) == 3)
    return joined.select("source_id", flag.alias("refetch"))


@query(with_(D.SIGNALS_SQL) + """, d AS (SELECT id FROM signals WHERE seq % 10 = 0), i AS (SELECT id, CASE WHEN due_date IS NULL THEN 'no_date' WHEN due_date - today < -90 THEN 'probably_abandoned' WHEN due_date - today < 0 THEN 'overdue' WHEN due_date - today <= 7 THEN 'due_soon' ELSE 'upcoming' END AS bucket FROM signals WHERE kind = 'todo' AND status = 'open')
SELECT CASE WHEN d.id IS NOT NULL THEN 'dismissed' ELSE bucket END AS bucket, count(*) AS n FROM i LEFT JOIN d USING (id) GROUP BY 1""")
def partition_items(spark, sf_dir) -> DataFrame:
    s = D.signals(spark, sf_dir)
    items = s.filter("kind = 'todo' and status = 'open'").select("id", C.due_bucket(F.col("due_date"), D.as_of()).alias("bucket"))
    dismissed = s.filter("seq % 10 = 0").select("id", F.lit(True).alias("d"))
    return items.join(dismissed, "id", "left").groupBy(F.when(F.col("d"), "dismissed").otherwise(F.col("bucket")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT source, lang, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:5], ',') AS first_ids, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source, lang""")
def document_tree(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rank = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    rows = d.select("source", "lang", "doc_id", F.char_length("text").cast("long").alias("c")).withColumn("r", rank)
    return rows.groupBy("source", "lang").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("doc_id")))).cast("array<string>"), ",").alias("first_ids"), F.sum("c").alias("chars"))


@query("""SELECT c_custkey AS node_id, CASE WHEN c_custkey > 0 THEN least((c_custkey - 1) // 3 * 3 + 3, max(c_custkey) OVER ()) ELSE c_custkey END AS root_id, CASE WHEN c_custkey BETWEEN 1 AND 3 THEN 6 END::BIGINT AS parent_id FROM customer""")
def merge_verdicts(spark, sf_dir) -> DataFrame:
    from lattica.operators import compile as K

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_custkey").alias("size"))
    merges = c.filter("node_id % 3 <> 0").select(F.col("node_id").alias("a"), (F.col("node_id") + 1).alias("b"), F.lit("merge").alias("decision"), F.lit(None).cast("long").alias("parent"))
    nest = spark.createDataFrame([(2, 5, "nest", 5), (7, 10, "keep_separate", None)], "a long, b long, decision string, parent long")
    return K.apply_verdicts(c, merges.unionByName(nest)).withColumn("parent_id", F.col("parent_id").cast("long"))
