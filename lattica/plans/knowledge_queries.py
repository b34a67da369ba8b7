"""Queries of the stores, the flat graph, connectors' payloads and what is shown, each with its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import display
from lattica.operators import clustering, graph, harvest, layout, ranking, retrieval, serve, stores, strategies, trees
from lattica.plans.queries import COS, dimension, query, with_
from lattica.plans.serve_queries import ORACLE, QUERIES
from lattica.session import shared_dir, table
from lattica.sources import connectors, mail
from lattica.sources import derived as D

__all__ = ["ORACLE", "QUERIES"]


def text_of(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# Stores ---------------------------------------------------------------------------------------------------------------


@query(with_(D.MANIFEST_SQL) + """SELECT source_id, version, CASE WHEN source_id % 3 = 0 THEN CASE WHEN source_id % 2 = 0 THEN '{"n": ' || source_id || '}' END ELSE content_hash END AS content_hash FROM manifest""")
def metadata_overwrite(spark, sf_dir) -> DataFrame:
    m = D.manifest(spark, sf_dir).select("source_id", "version", "content_hash")
    fresh = m.filter("source_id % 3 = 0").select("source_id", F.when(F.col("source_id") % 2 == 0, text_of('{"n": ', F.col("source_id"), "}")).alias("content_hash"))
    return stores.overwrite_metadata(m, fresh, "source_id", "content_hash")


@query("""WITH s AS (SELECT 'src' || (user_id % 5) AS source, ts::DATE AS "at", user_id AS scope_id FROM events), l AS (SELECT source, max("at") AS "at" FROM s GROUP BY source) SELECT DISTINCT source, "at", scope_id FROM s JOIN l USING (source, "at")""")
def scope_snapshots(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return stores.last_snapshots(e.select(text_of("src", F.col("user_id") % 5).alias("source"), F.to_date("ts").alias("at"), F.col("user_id").alias("scope_id")))


@query(with_(D.TREE_SQL) + """SELECT 'run-1' AS run_id, node_id, parent_id, level AS depth, coalesce((SELECT string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) FROM customer WHERE 's' || c_nationkey || '-' || c_mktsegment = node_id), '') AS chunks FROM tree""")
def cluster_assignments(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(text_of("s", F.col("c_nationkey"), "-", F.col("c_mktsegment")).alias("node_id"), F.col("c_custkey").alias("chunk_id"))
    rows = stores.assignments(D.tree(spark, sf_dir), c, F.lit("run-1"))
    return rows.withColumn("chunks", F.array_join(F.col("chunk_ids").cast("array<string>"), ",")).drop("chunk_ids")


@query("SELECT vec_id AS id, 'local' AS model, len(embedding)::INT AS dim, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE vec_id % 7 <> 0")
def node_vectors(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).otherwise(F.array().cast("array<float>")).alias("vector"))
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    stores.replace_vectors(v.limit(5), path, "old")
    held = stores.replace_vectors(v, path, "local")
    return held.select("id", "model", "dim", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("""WITH n AS (SELECT o_custkey AS cache_key, o_orderkey % 9 AS member_hash FROM orders) SELECT cache_key, count(DISTINCT member_hash) AS members, max(member_hash) AS last FROM n GROUP BY cache_key""")
def compiled_notes(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    notes = o.groupBy(F.col("o_custkey").alias("cache_key")).agg(F.collect_list(F.col("o_orderkey") % 9).alias("members"), F.lit("tag").alias("kind"))
    saved, members = stores.note_tables(notes)
    return saved.join(members, "cache_key").groupBy("cache_key").agg(F.count("*").alias("members"), F.max("member_hash").alias("last"))


@query("""WITH n AS (SELECT o_orderkey AS id, o_custkey % 20 AS origin_key, (o_orderkey % 4)::INT AS drift FROM orders) SELECT origin_key, max(drift) + 1 AS drift FROM n WHERE origin_key < 7 GROUP BY origin_key""")
def note_drift(spark, sf_dir) -> DataFrame:
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("origin_key"), (F.col("o_orderkey") % 4).cast("int").alias("drift"))
    return stores.bump_drift(notes, notes.filter("origin_key < 7").select("origin_key").distinct())[1]


CHUNKS = "chunks AS (SELECT l_orderkey || '-' || l_linenumber AS id, 'd' || l_orderkey AS doc_id, CASE WHEN l_linenumber <> 3 THEN 'h' || l_partkey END AS embedding_hash, max(l_quantity) AS q FROM lineitem GROUP BY ALL)"


def _chunks(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(text_of(F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("id"), text_of("d", F.col("l_orderkey")).alias("doc_id"), F.when(F.col("l_linenumber") != 3, text_of("h", F.col("l_partkey"))).alias("embedding_hash"), "l_quantity")
    return rows.groupBy("id", "doc_id", "embedding_hash").agg(F.max("l_quantity").alias("q"))


@query(with_(CHUNKS) + "SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM chunks GROUP BY doc_id")
def chunk_index(spark, sf_dir) -> DataFrame:
    return stores.chunk_index(_chunks(spark, sf_dir)).select("doc_id", F.array_join("chunk_ids", ",").alias("ids"))


@query(with_(CHUNKS) + "SELECT c_custkey AS pos, id, doc_id, q FROM customer JOIN chunks ON id = (c_custkey * 7) || '-' || (c_custkey % 5 + 1)")
def chunks_by_ids(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    ids = table(spark, sf_dir, "customer").select(k.alias("pos"), text_of(k * 7, "-", k % 5 + 1).alias("id"))
    return stores.chunks_by_ids(_chunks(spark, sf_dir), ids).select("pos", "id", "doc_id", "q")


@query(with_(CHUNKS) + "SELECT id, doc_id, p_size FROM chunks JOIN part ON embedding_hash = 'h' || p_partkey")
def chunk_vectors(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "part").select(text_of("h", F.col("p_partkey")).alias("embedding_hash"), "p_size")
    return stores.chunk_vectors(_chunks(spark, sf_dir), vectors).select("id", "doc_id", "p_size")


@query(with_(CHUNKS) + "SELECT DISTINCT 'n-' || substr(sha256(doc_id), 1, 8) AS note_id, doc_id FROM chunks")
def note_documents(spark, sf_dir) -> DataFrame:
    return stores.note_documents(_chunks(spark, sf_dir))


CHANGED = "changes AS (SELECT event_id, 'd' || (user_id * 11) AS doc_id FROM events), held AS (SELECT 'n-' || substr(sha256('d' || note_id), 1, 8) AS note_id, region_id FROM notes WHERE note_id % 2 = 0)"


@query(with_(D.NOTES_SQL, D.TREE_SQL, CHANGED) + """SELECT event_id, note_id, region_id FROM changes JOIN held ON note_id = 'n-' || substr(sha256(doc_id), 1, 8) WHERE region_id IN (SELECT node_id FROM tree WHERE node_id = 'r1' OR parent_id = 'r1' OR parent_id IN (SELECT node_id FROM tree WHERE parent_id = 'r1'))""")
def subtree_changes(spark, sf_dir) -> DataFrame:
    return _subtree_changes(spark, sf_dir)[0].select("event_id", "note_id", "region_id")


@query(with_(D.NOTES_SQL, CHANGED) + "SELECT count(*) AS unmapped FROM changes WHERE 'n-' || substr(sha256(doc_id), 1, 8) NOT IN (SELECT note_id FROM held)")
def unmapped_changes(spark, sf_dir) -> DataFrame:
    return _subtree_changes(spark, sf_dir)[1]


def _subtree_changes(spark, sf_dir):
    changes = table(spark, sf_dir, "events").select("event_id", text_of("d", F.col("user_id") * 11).alias("doc_id"))
    notes = D.notes(spark, sf_dir).filter("note_id % 2 = 0").select(stores.note_key(text_of("d", F.col("note_id"))).alias("note_id"), "region_id")
    return stores.subtree_changes(changes, notes, trees.ancestors(D.tree(spark, sf_dir)), "r1")


@query("""WITH h AS (SELECT n_nationkey AS kind, unnest([n_nationkey, 1000, n_nationkey * 2]) AS id, unnest([0, 1, 2]) AS pos FROM nation) SELECT 'k' || kind AS kind, pos::INT AS pos, id::BIGINT AS id, c_name AS label FROM h JOIN customer ON id = c_custkey""")
def highlight_labels(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    h = table(spark, sf_dir, "nation").select(text_of("k", k).alias("kind"), F.array(k, F.lit(1000).cast("long"), k * 2).alias("ids"))
    return stores.labelled(h, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label")))


@query(with_(D.MANIFEST_SQL) + "SELECT source_id, CASE WHEN status = 'active' AND source NOT IN ('src0', 'src1', 'src4') THEN 'retired' ELSE status END AS status FROM manifest")
def retired_sources(spark, sf_dir) -> DataFrame:
    return stores.retire_sources(D.manifest(spark, sf_dir), ["src0", "src1", "src4"]).select("source_id", "status")


@query("SELECT count(*) AS total, count(DISTINCT o_custkey) AS rendered, count(*) - count(DISTINCT o_custkey) AS missing FROM (SELECT DISTINCT c_custkey, o_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000)")
def render_coverage(spark, sf_dir) -> DataFrame:
    drawn = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("id"))
    return stores.coverage(drawn, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id")


@query("""WITH e AS (SELECT user_id % 10 AS g, epoch_us(ts) / 1e6::DOUBLE AS s, length(props) AS size FROM events), f AS (SELECT g, min(s) AS a FROM e GROUP BY g)
SELECT g, count(*) AS events, round(count(*) / (max(s) - min(a) - 3600), 6) AS per_second, round(sum(size) / (max(s) - min(a) - 3600), 6) AS bytes_per_second FROM e JOIN f USING (g) WHERE s - a >= 3600 GROUP BY g""")
def event_throughput(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 10)
    return stores.throughput(e, "g", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.char_length("props"), 3600)


# Graph ----------------------------------------------------------------------------------------------------------------

GRAPH_SQL = with_(D.TREE_SQL, """regions AS (SELECT node_id AS id, parent_id, name AS label, level AS centrality FROM tree)""", """tags AS (SELECT 't' || p_partkey AS id, 'n' || (p_partkey % 25) AS region_id, p_name AS label, p_size AS centrality FROM part)""",
    """links AS (SELECT 't' || p_partkey AS tag_id, 't' || (p_partkey + 1) AS other_id FROM part WHERE p_partkey % 5 = 0)""", """signals AS (SELECT 'sig' || (o_orderkey % 400) AS id, 't' || (o_custkey % 100) AS owner_id, 'n' || (o_custkey % 25) AS home, 'S' || (o_orderkey % 400) AS label, (o_orderkey % 120)::INT AS severity FROM orders)""",
    """nts AS (SELECT 'o' || o_orderkey AS id, 'n' || (o_custkey % 25) AS region_id, 'Order' AS label, 't' || (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS primary_tag FROM orders)""", """nt AS (SELECT DISTINCT 'o' || l_orderkey AS note_id, 't' || l_partkey AS tag_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    """re AS (SELECT 'n' || n_nationkey AS a, 'n' || (n_nationkey + 1) AS b, n_nationkey / 24.0::DOUBLE AS weight FROM nation)""", """te AS (SELECT 't' || s_suppkey AS a, 't' || (s_suppkey + 2) AS b, 0.1::DOUBLE AS weight FROM supplier)""")


def _view(spark, sf_dir):
    part, orders, li, nation, supplier = (table(spark, sf_dir, t) for t in ("part", "orders", "lineitem", "nation", "supplier"))
    regions = D.tree(spark, sf_dir).select(F.col("node_id").alias("id"), "parent_id", F.col("name").alias("label"), F.col("level").alias("centrality"))
    p = F.col("p_partkey")
    tags = part.select(text_of("t", p).alias("id"), text_of("n", p % 25).alias("region_id"), F.col("p_name").alias("label"), F.col("p_size").alias("centrality"))
    links = part.filter("p_partkey % 5 = 0").select(text_of("t", p).alias("tag_id"), text_of("t", p + 1).alias("other_id"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    signals = orders.select(text_of("sig", o % 400).alias("id"), text_of("t", c % 100).alias("owner_id"), text_of("n", c % 25).alias("home"), text_of("S", o % 400).alias("label"), (o % 120).cast("int").alias("severity"))
    first = li.groupBy("l_orderkey").agg(F.min("l_partkey").alias("m"))
    notes = orders.join(first, o == F.col("l_orderkey"), "left").select(text_of("o", o).alias("id"), text_of("n", c % 25).alias("region_id"), F.lit("Order").alias("label"), text_of("t", F.col("m")).alias("primary_tag"))
    held = li.join(orders, F.col("l_orderkey") == o, "left_semi").select(text_of("o", F.col("l_orderkey")).alias("note_id"), text_of("t", F.col("l_partkey")).alias("tag_id")).distinct()
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    region_edges = nation.select(text_of("n", n).alias("a"), text_of("n", n + 1).alias("b"), (n / F.lit(24.0)).alias("weight"))
    tag_edges = supplier.select(text_of("t", s).alias("a"), text_of("t", s + 2).alias("b"), F.lit(0.1).alias("weight"))
    return graph.graph_view(regions, tags, links, signals, notes, held, region_edges, tag_edges)


@query(GRAPH_SQL + """SELECT id, 'region' AS type, label, id AS home, 3 AS layer, centrality::DOUBLE AS centrality FROM regions UNION ALL SELECT id, 'tag', label, region_id, 2, centrality FROM tags
UNION ALL SELECT id, 'signal', min(label), min(home), 2, max(severity) FROM signals GROUP BY id UNION ALL SELECT id, 'note', label, region_id, 0, (SELECT count(*) FROM nt WHERE note_id = nts.id) FROM nts""")
def graph_nodes(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir)[0]


@query(GRAPH_SQL + """SELECT type, provenance, count(*) AS n, round(sum(weight), 4) AS weight, round(sum(confidence), 4) AS confidence FROM (
SELECT 'contains' AS type, 1.0::DOUBLE AS weight, 'extracted' AS provenance, 1.0::DOUBLE AS confidence FROM regions WHERE parent_id IS NOT NULL UNION ALL SELECT 'contains', 1.0, 'extracted', 1.0 FROM tags UNION ALL SELECT 'linked-to', 0.5, 'inferred', 0.5 FROM links
UNION ALL SELECT 'has-signal', greatest(0.35::DOUBLE, least(1.0::DOUBLE, severity / 100)), 'extracted', 1.0 FROM signals
UNION ALL SELECT 'belongs-to', CASE WHEN tag_id = primary_tag THEN 1.0 ELSE 0.7 END, 'extracted', CASE WHEN tag_id = primary_tag THEN 1.0 ELSE 0.85 END FROM nt JOIN nts ON note_id = nts.id
UNION ALL SELECT 'region-rel', weight, 'inferred', greatest(0.3::DOUBLE, least(1.0::DOUBLE, weight)) FROM re UNION ALL SELECT 'co-occurs', weight, 'inferred', greatest(0.3::DOUBLE, least(1.0::DOUBLE, weight)) FROM te) GROUP BY ALL""")
def graph_edges(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir)[1].groupBy("type", "provenance").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"), F.round(F.sum("confidence"), 4).alias("confidence"))


ALL_EDGES = """alle AS (SELECT 'contains' AS type, parent_id AS src, id AS dst FROM regions WHERE parent_id IS NOT NULL UNION ALL SELECT 'contains', region_id, id FROM tags UNION ALL SELECT 'linked-to', tag_id, other_id FROM links UNION ALL SELECT 'has-signal', owner_id, id FROM signals
UNION ALL SELECT 'belongs-to', note_id, tag_id FROM nt UNION ALL SELECT 'region-rel', a, b FROM re UNION ALL SELECT 'co-occurs', a, b FROM te), alln AS (SELECT id, 'region' AS type FROM regions UNION ALL SELECT id, 'tag' FROM tags UNION ALL SELECT DISTINCT id, 'signal' FROM signals UNION ALL SELECT id, 'note' FROM nts),
deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM alle UNION ALL SELECT dst FROM alle) GROUP BY id), j AS (SELECT n.type, d.degree FROM alln n FULL OUTER JOIN deg d USING (id))"""


@query(GRAPH_SQL.rstrip() + ",\n" + ALL_EDGES + """ SELECT count(type) AS nodes, count(DISTINCT type) AS node_types, count(*) FILTER (type IS NOT NULL AND degree IS NULL) AS isolated, coalesce(sum(degree) FILTER (type IS NULL), 0)::BIGINT AS dangling_ends, round(sum(degree) / count(type), 4) AS mean_degree,
 (SELECT count(*) FROM alle) AS edges, (SELECT count(DISTINCT type) FROM alle) AS edge_types FROM j""")
def build_diagnostics(spark, sf_dir) -> DataFrame:
    return harvest.diagnostics(*_view(spark, sf_dir))


@query(with_(D.MANIFEST_SQL, D.LISTING_SQL) + """SELECT coalesce(m.source_id, n.source_id) AS source_id, CASE WHEN n.source_id IS NULL THEN 'unlisted' WHEN m.source_id IS NULL THEN 'new' WHEN n.modified <= m.modified OR n.content_hash = m.content_hash THEN 'unchanged' ELSE 'updated' END AS action,
 CASE WHEN n.source_id IS NOT NULL THEN 'active' ELSE m.status END AS status FROM manifest m FULL OUTER JOIN (SELECT * FROM listing WHERE source_id = 7) n ON m.source_id = n.source_id""")
def single_reharvest(spark, sf_dir) -> DataFrame:
    return harvest.reharvest_one(D.manifest(spark, sf_dir), D.listing(spark, sf_dir), 7).select("source_id", "action", "status")


@query("SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber, CASE WHEN l_orderkey % 3 = l_partkey % 3 AND l_orderkey % 10 <> 9 AND l_partkey % 10 <> 9 THEN least(1.0::DOUBLE, l_discount * 9 + 0.1::DOUBLE) ELSE l_discount * 9 END AS weight FROM lineitem")
def community_bump(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber", (F.col("l_discount") * 9).alias("weight"))
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    of = ids.withColumn("label", F.when(F.col("id") % 10 != 9, F.col("id") % 3))
    return graph.same_community_bump(e, of)


SIBLINGS = """e AS (SELECT 't' || l_partkey AS a, 't' || l_suppkey AS b, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2), segs AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i FROM tree WHERE level = 2), total AS (SELECT count(*) AS n FROM segs),
owner AS (SELECT 't' || p_partkey AS tag_id, node_id FROM part, total JOIN segs ON i = p_partkey % n), path AS (SELECT s.node_id AS l2, n.node_id AS l1, n.parent_id AS l0 FROM tree s JOIN tree n ON s.parent_id = n.node_id WHERE s.level = 2)"""


@query(with_(D.TREE_SQL, SIBLINGS, """j AS (SELECT x.l2 AS a2, x.l1 AS a1, x.l0 AS a0, y.l2 AS b2, y.l1 AS b1, y.l0 AS b0, weight FROM e JOIN owner oa ON e.a = oa.tag_id JOIN owner ob ON e.b = ob.tag_id JOIN path x ON oa.node_id = x.l2 JOIN path y ON ob.node_id = y.l2 WHERE x.l0 = y.l0 AND x.l2 <> y.l2)""",
    """c AS (SELECT CASE WHEN a1 = b1 THEN a1 ELSE a0 END AS parent, CASE WHEN a1 = b1 THEN a2 ELSE a1 END AS ca, CASE WHEN a1 = b1 THEN b2 ELSE b1 END AS cb, weight FROM j)""", """s AS (SELECT parent, least(ca, cb) AS a, greatest(ca, cb) AS b, sum(weight) AS w FROM c GROUP BY ALL)""")
    + "SELECT parent, a, b, round(w / max(w) OVER (PARTITION BY parent), 6) AS weight FROM s")
def sibling_edges(spark, sf_dir) -> DataFrame:
    tree = D.tree(spark, sf_dir)
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    edges = li.groupBy(text_of("t", F.col("l_partkey")).alias("a"), text_of("t", F.col("l_suppkey")).alias("b")).agg(F.count("*").cast("double").alias("weight"))
    leaves = ranking.positions(tree.filter("level = 2").select("node_id"), [F.col("node_id")])
    n = max(leaves.count(), 1)
    owner = part.join(leaves, F.col("p_partkey") % n == F.col("pos") - 1).select(text_of("t", F.col("p_partkey")).alias("tag_id"), "node_id")
    return graph.sibling_edges(edges, owner, trees.ancestors(tree))


# Trees ----------------------------------------------------------------------------------------------------------------


@query(with_(D.TREE_SQL) + """SELECT root, node_id, depth FROM (SELECT 'r1' AS root, node_id, CASE WHEN node_id = 'r1' THEN 0 WHEN parent_id = 'r1' THEN 1 WHEN parent_id IN (SELECT node_id FROM tree WHERE parent_id = 'r1') THEN 2 END AS depth FROM tree
UNION ALL SELECT 'n3', node_id, CASE WHEN node_id = 'n3' THEN 0 WHEN parent_id = 'n3' THEN 1 END FROM tree) WHERE depth IS NOT NULL""")
def subtree_walk(spark, sf_dir) -> DataFrame:
    tree = D.tree(spark, sf_dir)
    return trees.walk_down(tree.filter("parent_id is not null").select("parent_id", "node_id"), tree.filter("node_id IN ('r1', 'n3')").select("node_id"))


@query(with_(D.TREE_SQL, D.NOTES_SQL, "h AS (SELECT region_id, count(*) AS n FROM notes WHERE note_id::VARCHAR LIKE '%77%' GROUP BY 1)", "l1 AS (SELECT parent_id AS node_id, sum(n) AS n FROM h JOIN tree ON node_id = region_id GROUP BY 1)")
       + "SELECT region_id AS node_id, n::BIGINT AS n FROM h UNION ALL SELECT node_id, n::BIGINT FROM l1 UNION ALL SELECT parent_id, sum(n)::BIGINT FROM l1 JOIN tree USING (node_id) GROUP BY 1")
def tree_prune(spark, sf_dir) -> DataFrame:
    return trees.pruned(trees.ancestors(D.tree(spark, sf_dir)), D.notes(spark, sf_dir), F.col("note_id").cast("string").contains("77"))


@query("""SELECT CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS root, count(*) AS n, max(CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END)::INT AS depth, count(DISTINCT p_size) AS members FROM part GROUP BY 1""")
def container_roots(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    path = F.array(F.when(k % 4 != 0, F.col("p_brand")), F.when(k % 2 != 0, F.col("p_type")))
    return trees.container_roots(table(spark, sf_dir, "part"), path, "p_size")


@query("""WITH k AS (SELECT *, coalesce(o_orderpriority, '') AS title FROM orders) SELECT o_orderkey, row_number() OVER (ORDER BY title DESC, o_totalprice DESC, o_orderkey) AS pos FROM k""")
def document_table(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce("o_orderpriority", F.lit("")).alias("title"), "o_totalprice")
    return ranking.positions(o, [(F.col("title"), "desc"), (F.col("o_totalprice"), "desc"), F.col("o_orderkey")]).select("o_orderkey", "pos")


@query(f"""WITH q AS (SELECT y.vec_id AS query_id, x.vec_id AS id, y.label AS wanted, x.label, row_number() OVER (PARTITION BY y.vec_id ORDER BY round({COS}, 6) DESC, x.vec_id) AS rank FROM embeddings x JOIN embeddings y ON y.vec_id % 100 = 0 AND x.vec_id <> y.vec_id WHERE round({COS}, 6) >= 0.0),
f AS (SELECT query_id, min(rank) AS first FROM q WHERE rank <= 8 AND label = wanted GROUP BY 1) SELECT count(*) AS questions, count(first) AS hits, round(count(first) / count(*), 6) AS rate, round(avg(first), 6) AS mean_first_rank FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0) LEFT JOIN f USING (query_id)""")
def retrieval_hits(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    asked = v.filter("vec_id % 100 = 0")
    found = retrieval.search(v, asked, 8, 0.0)
    asked = F.broadcast(asked.select(F.col("vec_id").alias("query_id"), "label"))  # search has seen that they are few
    wanted = retrieval.spread(v.select(F.col("vec_id").alias("id"), "label")).join(asked, "label").filter("id <> query_id").select("query_id", "id")
    return retrieval.hit_rate(found, wanted)


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: 0.7::DOUBLE * x + CASE WHEN vec_id % 3 = 0 THEN 0.3::DOUBLE * x ELSE 0.3::DOUBLE * x * x END)), 6) AS total FROM embeddings")
def blended_vectors(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").withColumn("x", F.transform("embedding", lambda x: x.cast("double")))
    raw = F.when(F.col("vec_id") % 3 != 0, F.transform("x", lambda x: x * x)).otherwise(F.col("x"))
    return v.select("vec_id", F.round(F.aggregate(retrieval.blend(F.col("x"), raw), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""WITH s AS (SELECT length(text) AS x, n_chars % 997 AS y FROM documents), rx AS (SELECT x, sum(count(*)) OVER (ORDER BY x) - count(*) + (count(*) + 1) / 2 AS r FROM s GROUP BY x), ry AS (SELECT y, sum(count(*)) OVER (ORDER BY y) - count(*) + (count(*) + 1) / 2 AS r FROM s GROUP BY y)
SELECT round(corr(rx.r, ry.r), 6) AS rho FROM s JOIN rx USING (x) JOIN ry USING (y)""")
def rank_correlation(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.char_length("text").alias("x"), (F.col("n_chars") % 997).alias("y"))
    return retrieval.spearman(d, "x", "y")


# What is shown --------------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT o_orderkey AS id, DATE '1997-06-15' AS today, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE ELSE DATE '1997-06-15' + (o_orderkey % 13)::INT - 3 END AS due, o_orderkey % 16 = 0 AS gone, o_orderkey % 18 = 0 AS said FROM orders),
m AS (SELECT *, datediff('day', today, due) AS n, strftime(due, '%b ') || day(due) || CASE WHEN year(due) <> 1997 THEN ', ' || year(due) ELSE '' END AS shown FROM d)
SELECT id, CASE WHEN due IS NULL THEN CASE WHEN said THEN 'Due by noon' END WHEN gone THEN 'Was due ' || shown WHEN n < 0 THEN 'Overdue ' || -n || 'd' WHEN n = 0 THEN 'Due today' WHEN n = 1 THEN 'Due tomorrow' WHEN n < 7 THEN 'Due ' || strftime(due, '%a') ELSE 'Due ' || shown END AS label FROM m""")
def due_labels(spark, sf_dir) -> DataFrame:
    k, today = F.col("o_orderkey"), F.lit("1997-06-15").cast("date")
    due = F.when(k % 9 == 0, F.lit(None).cast("date")).when(k % 4 == 0, F.to_date("o_orderdate")).otherwise(F.date_add(today, (k % 13).cast("int") - 3))
    label = display.due_label(due, today, F.when(k % 16 == 0, "probably_abandoned").otherwise("open"), F.when(k % 18 == 0, "by noon"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), label.alias("label"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name || ' x' ELSE p_name || ' b c' END AS title FROM part""")
def clean_titles(spark, sf_dir) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = F.when(k % 4 == 0, F.concat(F.lit("TODO: "), name)).when(k % 4 == 1, F.concat(F.lit(" open Question:  > - # "), name, F.lit(" "))).when(k % 4 == 2, F.concat(F.lit("**"), name, F.lit("**  `x`"))).otherwise(F.concat(F.lit("- "), name, F.lit("\tb\n c")))
    return table(spark, sf_dir, "part").select("p_partkey", display.clean_title(raw).alias("title"))


NUDGE = "n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS last, TIMESTAMP '1997-06-15 12:00:00' AS now, o_orderkey % 3 = 0 AS running, o_orderkey % 4 AS pending, CASE WHEN o_orderkey % 7 = 0 THEN TIMESTAMP '1997-06-16' WHEN o_orderkey % 7 = 1 THEN TIMESTAMP '1997-06-01' END AS snooze FROM orders)"


@query(with_(NUDGE) + "SELECT id, coalesce(epoch(now) - epoch(last) >= 7 * 86400, false) AS stale, coalesce(epoch(now) - epoch(last) >= 2 * 86400, false) AND NOT running AND pending = 0 AND (snooze IS NULL OR now >= snooze) AS nudge FROM n")
def harvest_nudges(spark, sf_dir) -> DataFrame:
    k, at = F.col("o_orderkey"), lambda s: F.lit(s).cast("timestamp")
    last, now = F.when(k % 5 > 0, F.col("o_orderdate").cast("timestamp")), at("1997-06-15 12:00:00")
    snooze = F.when(k % 7 == 0, at("1997-06-16")).when(k % 7 == 1, at("1997-06-01"))
    nudge = display.offers_harvest(last, now, k % 3 == 0, k % 4, snooze)
    return table(spark, sf_dir, "orders").select(k.alias("id"), display.is_stale(last, now).alias("stale"), nudge.alias("nudge"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN epoch_us(o_orderdate) + 86399999999 WHEN 1 THEN epoch_us(o_orderdate) + 43200000000 END AS micros FROM orders""")
def as_of_times(spark, sf_dir) -> DataFrame:
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(k % 3 == 0, F.concat(day, F.lit(" "))).when(k % 3 == 1, F.concat(day, F.lit("T12:00:00Z"))).otherwise("soon")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.unix_micros(display.as_of(raw)).alias("micros"))


@query("""WITH e AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS t, CASE WHEN p_partkey % 3 = 0 THEN [p_brand, p_type] ELSE []::VARCHAR[] END AS h, CASE WHEN p_partkey % 7 <> 0 THEN p_type || p_type || p_type END AS b FROM part),
f AS (SELECT p_partkey, array_to_string(list_filter(list_concat([t], h), lambda x: x IS NOT NULL AND x <> ''), ' > ') AS w, b FROM e), g AS (SELECT *, trim(substr(coalesce(b, ''), 1, greatest(60 - length(w) - 4, 0)::INT)) AS x FROM f)
SELECT p_partkey, CASE WHEN x = '' THEN '' WHEN w = '' THEN x ELSE '[' || w || ']' || chr(10) || x END AS excerpt FROM g""")
def excerpts(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    heading = F.when(k % 3 == 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    body = F.when(k % 7 != 0, F.concat("p_type", "p_type", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", display.excerpt(F.when(k % 5 != 0, F.col("p_name")), heading, body, 60).alias("excerpt"))


@query("""WITH c AS (SELECT o_custkey AS g, o_orderpriority AS term, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT g, list(term ORDER BY n DESC, term) AS terms FROM c GROUP BY g)
SELECT g, 'Region ' || g || ' groups chunks about ' || array_to_string(terms[:4], ', ') || '.' AS summary, 'fp_region_' || substr(sha256('local|region|' || array_to_string(list_sort(list_transform(terms, lambda x: lower(x))), '|')), 1, 16) AS fingerprint,
  ':' || substr(sha256(array_to_string(list_sort(list_distinct(list_transform(terms, lambda x: lower(x)))), '|')), 1, 8) AS suffix FROM t""")
def group_names(spark, sf_dir) -> DataFrame:
    members = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.array("o_orderpriority").alias("terms"))
    packed = lambda t: F.struct(display.region_summary(F.concat(F.lit("Region "), F.col("g").cast("string")), t).alias("summary"), display.naming_fingerprint(F.lit("region"), t, F.lit("local")).alias("fingerprint"), display.products_suffix(t).alias("suffix"))
    return strategies.name_groups(members, "g", "terms", packed).select("g", "name.*")


@query("""WITH j AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '{"a":"' || o_custkey || '","v":"x"}' WHEN 1 THEN '{"a":"' || o_custkey || '"}' END AS m FROM orders) SELECT id, m AS object, coalesce(json_extract_string(m, '$.a'), '') AS a, CASE WHEN m IS NULL THEN 0 ELSE 1 END AS n_keys FROM j""")
def lenient_json(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    good = F.when(k % 4 == 0, text_of('{"a": "', c, '", "v":"x"}')).otherwise(text_of('{"a":"', c, '"}'))
    said = F.when(k % 4 < 2, F.concat(F.lit("Sure, here:\n"), good, F.lit("\nDone."))).when(k % 4 == 2, "no object here").otherwise("{broken: ")
    stored = F.when(k % 4 < 2, good).when(k % 4 == 2, "[1, 2]").otherwise("{broken")
    kept = display.without_keys(display.metadata(stored), ["v"])
    return table(spark, sf_dir, "orders").select(k.alias("id"), display.json_object(said).alias("object"), F.coalesce(F.element_at(kept, "a"), F.lit("")).alias("a"), F.size(kept).alias("n_keys"))


@query("""WITH s AS (SELECT c_custkey AS id, (c_custkey % 60)::INT AS m, (c_custkey % 24)::INT AS h, CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2024-03-05 10:30:00' - INTERVAL 1 HOUR * (c_custkey % 60) END AS last FROM customer),
f AS (SELECT *, greatest(coalesce(last, TIMESTAMP '2024-03-03 10:30:00'), TIMESTAMP '2024-03-03 10:30:00') AS floor FROM s), n AS (SELECT *, date_trunc('day', floor) + INTERVAL 1 HOUR * h + INTERVAL 1 MINUTE * m AS slot FROM f), g AS (SELECT *, CASE WHEN slot > floor THEN slot ELSE slot + INTERVAL 1 DAY END AS fire FROM n)
SELECT id, CASE WHEN fire <= TIMESTAMP '2024-03-05 10:30:00' THEN epoch(fire)::BIGINT END AS missed FROM g""")
def missed_fires(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    schedules = retrieval.spread(table(spark, sf_dir, "customer").select("c_custkey")).select(k.alias("id"), text_of(k % 60, " ", k % 24, " * * *").alias("cron"), F.when(k % 4 > 0, F.timestamp_seconds(F.lit(1709634600) - 3600 * (k % 60))).alias("last"))
    return serve.missed_fires(schedules, F.lit("2024-03-05 10:30:00").cast("timestamp"), 2).select("id", F.col("missed").cast("long").alias("missed"))


# Chunkers and other exchangeable steps --------------------------------------------------------------------------------


@query(r"""WITH c AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS parts FROM documents WHERE source = 'src0'
UNION ALL SELECT doc_id, list_transform(range(0, len(w), 50), lambda i: array_to_string(w[i + 1 : i + 50], ' ')) FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE source IS DISTINCT FROM 'src0'))
SELECT doc_id, len(parts)::BIGINT AS chunks, md5(array_to_string(parts, '|')) AS h FROM c WHERE len(parts) > 0""")
def chunk_dispatch(spark, sf_dir) -> DataFrame:
    registry = strategies.Registry(strategies.by_words(50))
    registry.register("src0", strategies.by_lines)
    chunks = registry.apply(table(spark, sf_dir, "documents"), "source")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"])
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.md5(F.array_join(listed, "|")).alias("h"))


@query("""SELECT turn, role, sum(length(text))::BIGINT AS chars, max(length(text) % 10)::INT AS vector FROM conversations GROUP BY turn, role""")
def swapped_steps(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    featured = strategies.extract_features(c, lambda t: F.struct(F.char_length(t).alias("chars")), "text")
    vectors = strategies.embed(featured, lambda t: F.array((F.char_length(t) % 10).cast("float")), "text")
    return vectors.groupBy("turn", "role").agg(F.sum("features.chars").alias("chars"), F.max(F.col("vector")[0]).cast("int").alias("vector"))


@query("""WITH s AS (SELECT c_custkey, (SELECT string_agg(CASE WHEN o_orderkey % 3 = 0 THEN '# ' ELSE '' END || 'Order ' || o_orderkey || chr(10), '' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS text FROM customer),
p AS (SELECT c_custkey AS doc_id, unnest(list_filter(string_split(regexp_replace(chr(10) || text, chr(10) || '# ', chr(10) || chr(1) || '# ', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10)) <> '')) AS s FROM s WHERE text IS NOT NULL) SELECT doc_id, count(*) AS sections, sum(length(ltrim(s, chr(10))))::BIGINT AS chars FROM p GROUP BY doc_id""")
def heading_chunks(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.concat(F.when(k % 3 == 0, "# ").otherwise(""), text_of("Order ", k, "\n"))
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "").alias("text"))
    return strategies.by_headings(100_000, 100)(docs).groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum(F.char_length("content")).alias("chars"))


# Payloads -------------------------------------------------------------------------------------------------------------


def _payloads(spark, sf_dir) -> DataFrame:
    """A mail an order: plain parts of odd orders inside a nested multipart, an HTML part of every third, a file of every fifth."""
    k = F.col("o_orderkey")
    b64 = lambda c: F.translate(F.base64(c.cast("binary")), "+/", "-_")
    plain = F.when(k % 2 == 1, text_of('{"mimeType":"multipart/alternative","parts":[{"mimeType":"text/plain","headers":[{"name":"Content-Type","value":"text/plain; charset=utf-8"}],"body":{"data":"', b64(text_of("Straße ", k)), '"}}]}'))
    html = F.when(k % 3 == 0, text_of('{"mimeType":"TEXT/HTML","body":{"data":"', b64(text_of("<p>Page ", k, "</p>")), '"}}'))
    file = F.when(k % 5 == 0, text_of('{"mimeType":"image/png","filename":"', F.when(k % 10 == 0, "").otherwise(text_of("f", k, ".png")), '","body":{"attachmentId":"a', k, '"}}'))
    return table(spark, sf_dir, "orders").select(k.alias("id"), text_of('{"mimeType":"multipart/mixed","parts":[', F.concat_ws(",", html, file, plain), "]}").alias("payload"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 1 THEN 'text/plain' ELSE 'text/html' END AS mime, CASE WHEN o_orderkey % 2 = 1 THEN 'Straße ' || o_orderkey ELSE '<p>Page ' || o_orderkey || '</p>' END AS text FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 3 = 0""")
def mail_texts(spark, sf_dir) -> DataFrame:
    return mail.best_text(mail.mime_parts(_payloads(spark, sf_dir)))


@query("""WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 1 THEN 'Straße ' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'Page ' || o_orderkey END AS body, CASE WHEN o_orderkey % 10 = 0 THEN '[attachment: (unnamed)]' WHEN o_orderkey % 5 = 0 THEN '[attachment: f' || o_orderkey || '.png]' END AS files FROM orders)
SELECT id, concat_ws(chr(10) || chr(10), body, files) AS markdown FROM m""")
def mail_markdown(spark, sf_dir) -> DataFrame:
    return mail.mail_markdown(mail.mime_parts(_payloads(spark, sf_dir)))


@query("""SELECT 'K-' || o_orderkey AS source_id, concat_ws(chr(10), '---', 'key: "K-' || o_orderkey || '"', 'summary: "Order of ' || o_custkey || '"', 'status: "' || o_orderstatus || '"', CASE WHEN o_orderkey % 2 = 0 THEN 'assignee: "A' || o_custkey || '"' END, 'url: "https://t.example/browse/K-' || o_orderkey || '"', CASE WHEN o_orderkey % 3 = 0 THEN 'labels: ["x", "' || o_orderstatus || '"]' END, '---',
 '# K-' || o_orderkey || ' — Order of ' || o_custkey, '', '## Description', CASE WHEN o_orderkey % 5 = 0 THEN '(no description)' ELSE 'Priority ' || o_orderpriority END, CASE WHEN o_orderkey % 4 = 0 THEN chr(10) || '## Comments' || chr(10) || '### 2024-01-01 — Unknown' || chr(10) || 'first' || chr(10) || '### 2024-02-01 — Bea' || chr(10) || 'second' END) || chr(10) AS markdown FROM orders""")
def issue_markdown(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    comments = F.when(k % 4 == 0, ',"comment":{"comments":[{"created":"2024-02-01","author":{"displayName":"Bea"},"body":"second"},{"created":"2024-01-01","body":"first"}]}').otherwise("")
    body = text_of(
        '{"key":"K-', k, '","fields":{"summary":"Order of ', F.col("o_custkey"), '","status":{"name":"', F.col("o_orderstatus"), '"}', F.when(k % 2 == 0, text_of(',"assignee":{"displayName":"A', F.col("o_custkey"), '"}')).otherwise(""),
        F.when(k % 3 == 0, text_of(',"labels":["x","', F.col("o_orderstatus"), '"]')).otherwise(""), F.when(k % 5 != 0, text_of(',"description":"Priority ', F.col("o_orderpriority"), '"')).otherwise(""), comments, "}}")
    issues = table(spark, sf_dir, "orders").select(F.from_json(body, connectors.ISSUE).alias("i")).select("i.*")
    return connectors.issue_markdown(issues, "https://t.example/")


@query("""SELECT c_nationkey AS site, coalesce(arg_min(c_custkey, c_custkey) FILTER (c_custkey % 11 = 0), arg_min(c_custkey, c_custkey) FILTER (c_custkey % 5 = 0)) AS field_id FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 5 = 0 GROUP BY 1""")
def points_fields(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 11 == 0, " Story Point Estimate").when(k % 5 == 0, "story points").otherwise("Sprint")
    return connectors.points_field(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("site"), k.alias("pos"), k.alias("id"), name.alias("name")))


@query("""SELECT 'c' || o_orderkey AS comment_id, 'p' || o_custkey AS parent_id, coalesce(c_name, 'u' || o_custkey) AS user_name, 'Order ' || o_orderkey AS text FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0""")
def comment_rows(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    item = text_of('{"id":"c', k, '","parent":{"type":"page_id","page_id":"p', c, '"},"created_by":{"id":"u', c, '"},"rich_text":[{"plain_text":"Order "},{"plain_text":"', k, '"}]}')
    payloads = table(spark, sf_dir, "orders").groupBy(c.alias("g")).agg(F.concat(F.lit('{"results":['), F.array_join(F.collect_list(item), ","), F.lit("]}")).alias("j")).select(F.from_json("j", connectors.COMMENTS).alias("p")).select("p.*")
    names = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(text_of("u", F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"))
    return connectors.named_users(connectors.comment_rows(payloads), names, "created_by").select("comment_id", "parent_id", "user_name", "text")


@query("""SELECT 'pg' || o_custkey AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN 'f' || o_orderkey ELSE 'a' || o_orderkey END AS filename, CASE WHEN o_orderkey % 5 = 1 THEN 'https://cdn.example/' ELSE 'https://w.example/d/' END || o_orderkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN 'image/png' ELSE 'text/plain' END AS mime_type, o_orderkey AS size FROM orders WHERE o_orderkey % 3 > 0""")
def attachment_rows(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    media = F.when(k % 2 == 0, text_of('"title":"f', k, '","extensions":{"mediaType":"image/png","fileSize":', k, "}")).otherwise(text_of('"metadata":{"mediaType":"text/plain"},"extensions":{"fileSize":', k, "}"))
    link = F.when(k % 3 > 0, text_of(',"_links":{"download":"', F.when(k % 5 == 1, text_of("https://cdn.example/", k)).otherwise(text_of("/d/", k)), '"}')).otherwise("")
    item = text_of('{"id":"a', k, '",', media, link, "}")
    payloads = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(item), ",").alias("l")).select(F.from_json(text_of('{"page_id":"pg', F.col("o_custkey"), '","results":[', F.col("l"), "]}"), connectors.ATTACHMENTS).alias("p")).select("p.*")
    return connectors.attachment_rows(payloads, "https://w.example")


# The map and clusters -------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer), a AS (SELECT id, 2 * pi() * i / n + ('0x' || substr(sha256(id::VARCHAR), 1, 4))::INT / 65535 * 0.4::DOUBLE AS angle, 120 * (0.45::DOUBLE + 0.45::DOUBLE * CASE WHEN n > 3 THEN (i % 3) / 2 ELSE 0.4 END) AS ring FROM n)
SELECT id, round(cos(angle) * ring, 3) AS x, round(sin(angle) * ring, 3) AS z FROM a""")
def ring_positions(spark, sf_dir) -> DataFrame:
    return layout.ring_positions(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@query("""WITH r AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey < 8 THEN 0 ELSE 1 END AS level, (n_nationkey * 7 % 25)::DOUBLE AS x, (n_nationkey * 3 % 25)::DOUBLE AS z, n_nationkey AS tag_count FROM nation), m AS (SELECT avg(x) AS mx, avg(z) AS mz FROM r WHERE level = 0),
s AS (SELECT sqrt(sum(greatest(tag_count, 1)) / 0.5::DOUBLE) / max(sqrt((x - mx) * (x - mx) + (z - mz) * (z - mz))) AS scale FROM r, m WHERE level = 0) SELECT id, round(x * scale, 4) AS x, round(z * scale, 4) AS z FROM r, s""")
def rescaled_centres(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.alias("id"), F.when(k < 8, 0).otherwise(1).alias("level"), (k * 7 % 25).cast("double").alias("x"), (k * 3 % 25).cast("double").alias("z"), k.alias("tag_count"))
    return layout.rescale_centres(rows).select("id", F.round("x", 4).alias("x"), F.round("z", 4).alias("z"))


@query()
def recursive_clusters(spark, sf_dir) -> DataFrame:
    return clustering.recursive_split(table(spark, sf_dir, "embeddings").withColumn("g", F.col("label") % 3), "g", dimension(spark, sf_dir))
