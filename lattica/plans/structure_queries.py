"""Queries of communities, the vector index, nested territories, placing in rounds, tour numbers, VARIANT values and paged sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import agent, communities, layout, territory, vector_index
from lattica.plans.payload_queries import ORACLE, QUERIES
from lattica.plans.queries import COS, GRID, OWNED, PAIRS, STRONG, _owned, _regions, _strong, _warp_sql, query, with_
from lattica.session import materialize, table
from lattica.sources import derived as D

__all__ = ["ORACLE", "QUERIES"]


# Communities ----------------------------------------------------------------------------------------------------------


@query()
def leiden_communities(spark, sf_dir) -> DataFrame:
    return communities.leiden(_strong(spark, sf_dir).withColumnRenamed("n", "weight"))


# The vector index -----------------------------------------------------------------------------------------------------


@query(f"""SELECT query_id, id, score, rank::INTEGER AS rank FROM (SELECT y.vec_id AS query_id, x.vec_id AS id, round({COS}, 6) AS score, row_number() OVER (PARTITION BY y.vec_id ORDER BY round({COS}, 6) DESC, x.vec_id) AS rank
  FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE round({COS}, 6) >= 0.2) WHERE rank <= 5""")
def indexed_search(spark, sf_dir) -> DataFrame:
    """Every vector is a query."""
    v = table(spark, sf_dir, "embeddings")
    return vector_index.nearest(vector_index.build(v), v, 5, 0.2)


@query(f"SELECT x.vec_id AS a, y.vec_id AS b, round({COS}, 6) AS score FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE round({COS}, 6) >= 0.35")
def indexed_pairs(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    met = vector_index.within(vector_index.build(v), v, 0.35).filter("query_id < id")
    return met.select(F.col("query_id").alias("a"), F.col("id").alias("b"), "score")


# Territories ----------------------------------------------------------------------------------------------------------

#: Regions of three levels from the tables: world regions, their nations, the nations' market segments by their customers.
LEVELS = """l0 AS (SELECT r_regionkey AS region, ((r_regionkey * 43) % 80 - 40)::DOUBLE AS cx, ((r_regionkey * 29) % 80 - 40)::DOUBLE AS cz, 30.0::DOUBLE AS radius FROM region),
l1 AS (SELECT 100 + n_nationkey AS region, n_regionkey AS parent, ((n_nationkey * 37) % 100 - 50)::DOUBLE AS cx, ((n_nationkey * 53) % 100 - 50)::DOUBLE AS cz, (1 + n_nationkey % 4)::DOUBLE AS weight FROM nation),
s2 AS (SELECT c_nationkey AS n, ascii(c_mktsegment) % 10 AS s, count(*) AS weight FROM customer GROUP BY 1, 2),
l2 AS (SELECT 1000 + n * 10 + s AS region, 100 + n AS parent, (((n * 37) % 100 - 50) + (s * 13) % 20 - 10)::DOUBLE AS cx, (((n * 53) % 100 - 50) + (s * 7) % 20 - 10)::DOUBLE AS cz, weight::DOUBLE AS weight FROM s2)"""


def _levels(spark, sf_dir) -> DataFrame:
    d = lambda c: c.cast("double")
    r, n, s = F.col("r_regionkey"), F.col("n_nationkey"), F.ascii("c_mktsegment") % 10
    none = F.lit(None).cast("long")
    top = table(spark, sf_dir, "region").select(r.cast("long").alias("region"), none.alias("parent"), F.lit(0).alias("level"), d((r * 43) % 80 - 40).alias("cx"), d((r * 29) % 80 - 40).alias("cz"), F.lit(30.0).alias("radius"), F.lit(1.0).alias("weight"))
    middle = table(spark, sf_dir, "nation").select((100 + n).cast("long").alias("region"), F.col("n_regionkey").cast("long").alias("parent"), F.lit(1).alias("level"), d((n * 37) % 100 - 50).alias("cx"), d((n * 53) % 100 - 50).alias("cz"), F.lit(None).cast("double").alias("radius"), d(1 + n % 4).alias("weight"))
    seg = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n"), s.alias("s")).agg(F.count("*").alias("weight"))
    n, s = F.col("n"), F.col("s")
    low = seg.select((1000 + n * 10 + s).cast("long").alias("region"), (100 + n).cast("long").alias("parent"), F.lit(2).alias("level"), d((n * 37) % 100 - 50 + (s * 13) % 20 - 10).alias("cx"), d((n * 53) % 100 - 50 + (s * 7) % 20 - 10).alias("cz"), F.lit(None).cast("double").alias("radius"), d(F.col("weight")).alias("weight"))
    return top.unionByName(middle).unionByName(low)


def divided_sql(cells: str, children: str, amplitude: float, area: float, rounds: int, name: str) -> str:
    """CTEs that end in ``name`` (q, r, region): the rounds of territory.subdivide, one after the other."""
    warped = f"{name}c AS (SELECT q, r, region AS parent, {_warp_sql('x', 'z', amplitude)[0]} AS wx, {_warp_sql('x', 'z', amplitude)[1]} AS wz FROM {cells} WHERE region IN (SELECT parent FROM {children}))"
    first = f"""{name}0 AS (SELECT region, parent, {_warp_sql('cx', 'cz', amplitude)[0]} AS vx, {_warp_sql('cx', 'cz', amplitude)[1]} AS vz, greatest(weight, 1.0) / sum(greatest(weight, 1.0)) OVER (PARTITION BY parent) * n AS target,
  0.0::DOUBLE AS w, 0.0::DOUBLE AS best, 1.0::DOUBLE AS rate, 'infinity'::DOUBLE AS error, false AS done FROM {children} JOIN (SELECT parent, count(*) AS n FROM {name}c GROUP BY parent) USING (parent))"""
    out = [warped, first]
    pick = lambda k, w: f"SELECT q, r, parent, region FROM {name}c JOIN {name}{k} USING (parent) QUALIFY row_number() OVER (PARTITION BY q, r ORDER BY (wx - vx) ** 2 + (wz - vz) ** 2 - {w}, region) = 1"
    for k in range(rounds):
        out.append(f"{name}n{k} AS (SELECT parent, region, count(*) AS n FROM ({pick(k, 'w')}) GROUP BY 1, 2)")
        out.append(f"{name}m{k} AS (SELECT *, round(sum(abs(miss)) OVER (PARTITION BY parent), 6) AS total, bool_and(abs(miss) <= greatest(1.0, 0.05 * target)) OVER (PARTITION BY parent) AS even FROM (SELECT s.*, target - coalesce(n, 0) AS miss FROM {name}{k} s LEFT JOIN {name}n{k} USING (parent, region)))")
        rate = "CASE WHEN NOT done AND total > error THEN 0.7 * rate ELSE rate END"
        out.append(f"""{name}{k + 1} AS (SELECT region, parent, vx, vz, target, CASE WHEN NOT done AND NOT even THEN w + {rate} * miss * {area!r}::DOUBLE ELSE w END AS w, CASE WHEN NOT done AND total < error THEN w ELSE best END AS best,
  {rate} AS rate, CASE WHEN NOT done THEN least(total, error) ELSE error END AS error, done OR even AS done FROM {name}m{k})""")
    out.append(f"{name} AS (SELECT q, r, region FROM ({pick(rounds, 'best')}))")
    return ",\n".join(out)


TOP = (
    f"tp AS (SELECT q, r, x, z, region, radius, ({_warp_sql('x', 'z', 4.0)[0]} - {_warp_sql('cx', 'cz', 4.0)[0]}) ** 2 + ({_warp_sql('x', 'z', 4.0)[1]} - {_warp_sql('cx', 'cz', 4.0)[1]}) ** 2 AS d2 FROM grid, l0),\n"
    "top AS (SELECT q, r, x, z, CASE WHEN d2 <= (radius * 1.15) ** 2 THEN region END AS region FROM tp QUALIFY row_number() OVER (PARTITION BY q, r ORDER BY d2, region) = 1)"
)
AREA = 2 * 3**0.5 * 3.0**2


def nested_sql(rounds: int) -> str:
    mid = "mid AS (SELECT q, r, x, z, m1.region FROM top JOIN m1 USING (q, r))"
    return with_(GRID, LEVELS, TOP, divided_sql("top", "l1", 2.0, AREA, rounds, "m1"), mid, divided_sql("mid", "l2", 1.0, AREA, rounds, "m2")) + (
        "SELECT q::INT AS q, r::INT AS r, top.region AS top, m1.region AS middle, m2.region AS leaf FROM top LEFT JOIN m1 USING (q, r) LEFT JOIN m2 USING (q, r)"
    )


def _nested(spark, sf_dir, rounds: int) -> DataFrame:
    owned = territory.nested_owners(layout.hex_grid(spark, 60.0, 3.0), _levels(spark, sf_dir), [4.0, 2.0, 1.0], 3.0, rounds=rounds)
    at = lambda k: F.get("owners", F.lit(k))
    return owned.select("q", "r", at(0).alias("top"), at(1).alias("middle"), at(2).alias("leaf"))


@query(nested_sql(0))
def nested_territories(spark, sf_dir) -> DataFrame:
    return _nested(spark, sf_dir, 0)


@query(nested_sql(4))
def balanced_territories(spark, sf_dir) -> DataFrame:
    return _nested(spark, sf_dir, 4)


@query()
def grown_leaves(spark, sf_dir) -> DataFrame:
    """Nations that need a hex for every forty of their customers, at most thirty, have taken some from others where they own fewer."""
    need = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("region")).agg(F.least(F.lit(30), F.ceil(F.count("*") / 4)).alias("need"))
    leaves = _regions(spark, sf_dir).join(need, "region").withColumn("weight", F.col("need"))
    return territory.grow_squeezed(_owned(spark, sf_dir), leaves).select("q", "r", "region")


TAG_SQL = """t AS (SELECT p_partkey AS tag_id, (p_partkey % 25)::BIGINT AS region, ((p_partkey * 7919) % 101)::DOUBLE AS elevation FROM part),
d AS (SELECT *, greatest(0.05, least(0.78, 0.78::DOUBLE - 0.58::DOUBLE * elevation / 100 + (2 * (('0x' || substr(sha256(tag_id::VARCHAR), 1, 4))::INT / 65535::DOUBLE) - 1) * 0.06::DOUBLE)) AS depth, row_number() OVER (PARTITION BY region ORDER BY elevation DESC, tag_id) AS turn FROM t),
h AS (SELECT region, q::INT AS q, r::INT AS r, round(sqrt((x - cx) ** 2 + (z - cz) ** 2) / greatest(radius, 0.000001), 9) AS dd FROM owned JOIN regions USING (region)),
g AS (SELECT DISTINCT region, 0::BIGINT AS k, []::STRUCT(q INT, r INT)[] AS taken FROM h UNION ALL
  SELECT g.region, g.k + 1, list_append(any_value(taken), first({'q': q, 'r': r} ORDER BY round(abs(dd - round(depth, 9)), 9), q, r)) FROM g JOIN d ON d.region = g.region AND turn = g.k + 1 JOIN h ON h.region = g.region AND NOT list_contains(taken, {'q': q, 'r': r}) GROUP BY g.region, g.k)"""


@query(with_(GRID, OWNED, TAG_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT tag_id, d.region, taken[k].q AS q, taken[k].r AS r FROM g JOIN d ON d.region = g.region AND turn = k")
def placed_tags(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    tags = table(spark, sf_dir, "part").select(key.alias("tag_id"), (key % 25).cast("long").alias("region"), ((key * 7919) % 101).cast("double").alias("elevation"))
    tags = tags.withColumn("depth", territory.tag_depth(F.col("elevation"), F.col("tag_id")))
    return territory.place_tags(_owned(spark, sf_dir), _regions(spark, sf_dir), tags)


# Todos ----------------------------------------------------------------------------------------------------------------


@query()
def curated_todos(spark, sf_dir) -> DataFrame:
    """Todos made of orders and their parts' names, in three buckets by days until due."""
    from lattica.operators import curation

    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = table(spark, sf_dir, "lineitem").join(part, "l_partkey").groupBy("l_orderkey").agg(F.array_join(F.slice(F.array_sort(F.collect_list("p_name")), 1, 3), " and ").alias("names"))
    days = F.datediff("o_orderdate", F.lit("1998-06-01").cast("date"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    verb = F.element_at(F.array(*map(F.lit, ["Send", "Review the", "call about", "“Order", "Ship"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    bucket = F.when(days < 0, "overdue").when(days <= 7, "due_soon").when(days <= 90, "upcoming").otherwise("later")
    items = orders.select("o_orderkey", F.concat(F.lit("Todo: "), verb, F.lit(" "), "names").alias("title"), bucket.alias("bucket"), days.alias("days"))
    ordered = items.withColumn("place", F.abs("days").cast("long") * 1_000_000_000_000 + F.col("o_orderkey"))
    return curation.curated(ordered, "place").select("o_orderkey", "text", "bucket", "days")


# Tour numbers ---------------------------------------------------------------------------------------------------------


#: A forest over all customers: three below each, the roots are those that their third would be their own parent.
HEAP_SQL = """heap AS (SELECT c_custkey AS node_id, CASE WHEN c_custkey >= 3 THEN c_custkey // 3 END AS parent_id, c_acctbal AS worth FROM customer),
walk AS (SELECT node_id, parent_id, [{'w': -worth, 'n': node_id}] AS way FROM heap WHERE parent_id IS NULL UNION ALL
  SELECT h.node_id, h.parent_id, list_append(way, {'w': -h.worth, 'n': h.node_id}) FROM walk JOIN heap AS h ON h.parent_id = walk.node_id)"""


def _heap(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("node_id"), F.when(k >= 3, F.floor(k / 3).cast("long")).alias("parent_id"), (-F.col("c_acctbal")).alias("less"))


@query("WITH RECURSIVE " + HEAP_SQL + """
SELECT a.node_id, a.parent_id, row_number() OVER (ORDER BY a.way) - 1 AS pre, (SELECT count(*) FROM walk AS b WHERE b.way[:len(a.way)] = a.way) AS size, len(a.way) - 1 AS depth FROM walk AS a""")
def tour_numbers(spark, sf_dir) -> DataFrame:
    from lattica.operators import tours

    return tours.tour(_heap(spark, sf_dir), ["less"])


@query("WITH RECURSIVE " + HEAP_SQL + """, own AS (SELECT o_custkey AS node_id, count(*) AS n FROM orders GROUP BY 1)
SELECT a.node_id, coalesce(max(o.n), 0)::BIGINT AS own, (SELECT coalesce(sum(x.n), 0) FROM walk AS b JOIN own AS x ON x.node_id = b.node_id WHERE b.way[:len(a.way)] = a.way)::BIGINT AS total FROM walk AS a LEFT JOIN own AS o USING (node_id) GROUP BY a.node_id, a.way""")
def subtree_orders(spark, sf_dir) -> DataFrame:
    """Orders of each customer and of all below, from the tour's intervals."""
    from lattica.operators import tours

    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node_id"), F.lit(1).cast("long").alias("n"))
    return tours.subtree_sums(tours.tour(_heap(spark, sf_dir), ["less"]), own, "n")


# VARIANT --------------------------------------------------------------------------------------------------------------


def _nested_values(spark, sf_dir) -> DataFrame:
    """An order as one VARIANT: dates, decimals, bytes, a set of flags, a map of its lines' parts, an object two levels down."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"), F.map_from_entries(F.collect_set(F.struct(F.concat(F.lit("p"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")), F.lit(True)))).alias("parts"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    inner = F.struct(F.struct(F.col("o_orderpriority").alias("label"), F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))).alias("grid")).alias("deep"), F.col("flags"), F.col("parts"))
    whole = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.encode("o_orderstatus", "UTF-8").alias("raw"), F.lit(None).cast("string").alias("nothing"), (F.col("o_orderkey") % 2 == 0).alias("even"), inner.alias("inner"))
    return orders.select("o_orderkey", F.to_variant_object(whole).alias("v"))


@query("""WITH l AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags, list_sort(list(DISTINCT 'p' || l_linenumber || '-' || l_partkey)) AS parts FROM lineitem GROUP BY 1),
o AS (SELECT *, o_totalprice::DECIMAL(12,2) AS p FROM orders JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, '{"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","even":' || (o_orderkey % 2 = 0) || ',"inner":{"deep":{"grid":[[1,2],[3]],"label":"' || o_orderpriority || '"},"flags":["' || array_to_string(flags, '","') || '"],"parts":{"' || array_to_string(parts, '":true,"') || '":true}},"key":' || o_orderkey
  || ',"nothing":null,"price":' || CASE WHEN contains(p::VARCHAR, '.') THEN rtrim(rtrim(p::VARCHAR, '0'), '.') ELSE p::VARCHAR END || ',"raw":"' || lower(hex(o_orderstatus)) || '"}' AS json FROM o""")
def safe_json(spark, sf_dir) -> DataFrame:
    from lattica.functions import variants

    return variants.json_safe(_nested_values(spark, sf_dir), "o_orderkey", "v")


# Paged sources --------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderkey % 3 = 0")
def paged_orders(spark, sf_dir) -> DataFrame:
    """Two filters go down to the pages, the third stays with Spark."""
    from lattica.sources import paged

    where = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000.0) & (F.col("o_orderkey") % 3 == 0)
    found = paged.fetch(spark, f"{sf_dir}/orders.parquet", where, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], 2_000)
    return found.select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


# Changes since a boundary ---------------------------------------------------------------------------------------------

CHANGES_SQL = """e AS (SELECT 's' || (user_id % 40) AS source, ts, event_id, CASE WHEN event_type <> 'error' OR event_id % 7 <> 0 THEN event_type END AS change FROM events),
b AS (SELECT source, max(ts) FILTER (change IS NULL) AS boundary FROM e GROUP BY source)"""


@query(with_(CHANGES_SQL) + """SELECT b.source, boundary, e.change, count(e.change) AS n FROM b LEFT JOIN e ON e.source = b.source AND e.change IS NOT NULL AND (boundary IS NULL OR e.ts > boundary) GROUP BY 1, 2, 3""")
def stream_since_boundary(spark, sf_dir) -> DataFrame:
    """The events as a stream of files, in two runs: the second goes on from the first one's checkpoint."""
    import uuid

    from lattica.session import shared_dir
    from lattica.streaming import boundaries

    rows = table(spark, sf_dir, "events")
    mark = (F.col("event_type") == "error") & (F.col("event_id") % 7 == 0)
    rows = rows.select(F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("source"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(~mark, F.col("event_type")).alias("change"))
    path = f"{shared_dir(spark)}/since-{uuid.uuid4().hex}"
    for half in (0, 1):
        rows.filter(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{path}/landing")
        boundaries.run_since(spark.readStream.schema(rows.schema).parquet(f"{path}/landing"), path)
    return boundaries.standing(spark, path)


# Workspace state ------------------------------------------------------------------------------------------------------


def _memory_log(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    op = F.when(k % 7 == 0, "delete").when(k % 3 == 0, "create").otherwise("update")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), k.alias("at"), op.alias("op"), F.when(k % 2 == 0, F.concat(F.lit("r"), (k % 25).cast("string"))).alias("region_key"), F.when(k % 5 < 3, F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("body"), F.when(k % 3 == 0, "answer").alias("kind"))


@query("""WITH l AS (SELECT o_custkey AS id, o_orderkey AS at_, CASE WHEN o_orderkey % 7 = 0 THEN 'delete' WHEN o_orderkey % 3 = 0 THEN 'create' ELSE 'update' END AS op,
  CASE WHEN o_orderkey % 2 = 0 THEN 'r' || (o_orderkey % 25) END AS region_key, CASE WHEN o_orderkey % 5 < 3 THEN o_orderpriority END AS title, o_orderstatus AS body, CASE WHEN o_orderkey % 3 = 0 THEN 'answer' END AS kind FROM orders),
s AS (SELECT id, list({'op': op, 'r': region_key, 't': title, 'b': body, 'k': kind, 'c': at_, 'u': at_} ORDER BY at_) AS x FROM l GROUP BY id),
f AS (SELECT id, list_reduce([{'op': 'none', 'r': NULL::VARCHAR, 't': NULL::VARCHAR, 'b': NULL::VARCHAR, 'k': NULL::VARCHAR, 'c': NULL::BIGINT, 'u': NULL::BIGINT}] || x, lambda a, e:
  CASE WHEN e.op = 'delete' THEN {'op': 'none', 'r': NULL, 't': NULL, 'b': NULL, 'k': NULL, 'c': NULL, 'u': NULL} WHEN a.op = 'none' AND e.op = 'create' THEN e WHEN a.op <> 'none' AND e.op = 'update' THEN
  {'op': 'create', 'r': coalesce(e.r, a.r), 't': coalesce(e.t, a.t), 'b': coalesce(e.b, a.b), 'k': coalesce(e.k, a.k), 'c': a.c, 'u': e.u} ELSE a END) AS z FROM s)
SELECT id, z.r AS region_key, z.t AS title, z.b AS body, z.k AS kind, z.c AS created, z.u AS updated FROM f WHERE z.op = 'create'""")
def workspace_memory(spark, sf_dir) -> DataFrame:
    """Orders as entries of their customers' memory items; the SQL folds each item's entries one by one."""
    from lattica.operators import workspace

    return workspace.memory_items(_memory_log(spark, sf_dir))


@query("""WITH l AS (SELECT o_custkey AS key, o_orderkey AS a, CASE WHEN o_orderkey % 4 <> 0 THEN 'g' || (o_orderkey % 5) END AS region_id, o_orderpriority AS region_name FROM orders),
s AS (SELECT key, list({'r': region_id, 'n': region_name, 'a': a} ORDER BY a) AS x FROM l GROUP BY key),
f AS (SELECT key, list_reduce([{'r': NULL::VARCHAR, 'n': NULL::VARCHAR, 'c': NULL::BIGINT, 'u': NULL::BIGINT, 'h': []::VARCHAR[]}] || list_transform(x, lambda e: {'r': e.r, 'n': e.n, 'c': e.a, 'u': e.a, 'h': []::VARCHAR[]}), lambda s, e:
  CASE WHEN s.c IS NULL AND e.r IS NULL THEN s ELSE {'r': e.r, 'n': CASE WHEN e.r IS NULL THEN s.n ELSE e.n END, 'c': coalesce(s.c, e.c), 'u': e.u, 'h': CASE WHEN s.r IS NOT NULL AND s.r IS DISTINCT FROM e.r AND NOT list_contains(s.h, s.r) THEN list_append(s.h, s.r) ELSE s.h END} END) AS z FROM s)
SELECT key, z.r AS region_id, z.n AS region_name, CASE WHEN z.r IS NULL THEN 'orphaned' ELSE 'attached' END AS status, array_to_string(z.h, ' ') AS history, z.c AS created, z.u AS updated FROM f WHERE z.c IS NOT NULL""")
def workspace_anchors(spark, sf_dir) -> DataFrame:
    from lattica.operators import workspace

    k = F.col("o_orderkey")
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), k.alias("at"), F.when(k % 4 != 0, "attach").otherwise("orphan").alias("op"), F.concat(F.lit("g"), (k % 5).cast("string")).alias("region_id"), F.col("o_orderpriority").alias("region_name"), F.lit(1).alias("level"))
    return workspace.anchors(log).withColumn("history", F.array_join("history", " ")).drop("level")


@query("""SELECT user_id % 25 AS region_key, ts AS seen, lag(ts) OVER (PARTITION BY user_id % 25 ORDER BY ts) AS previous FROM (SELECT DISTINCT user_id % 25 AS user_id, ts FROM events WHERE event_id % 3 <> 0 UNION SELECT user_id % 25, max(ts) FROM events WHERE event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-01 12:00:00' GROUP BY 1) QUALIFY ts NOT IN (SELECT max(ts) FROM events WHERE event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-01 12:00:00' GROUP BY user_id % 25)""")
def workspace_visits(spark, sf_dir) -> DataFrame:
    from lattica.operators import workspace

    e = table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("region_key"), F.col("ts").alias("at"), "event_id")
    stored = e.filter("event_id % 3 = 0 AND at < TIMESTAMP_NTZ '2024-01-01 12:00:00'").drop("event_id")
    return workspace.touched(stored, e.filter("event_id % 3 <> 0")).withColumnRenamed("at", "seen")


# Node trees -----------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, '## Order ' || o_orderkey || chr(10) || chr(10) || '***' || o_orderpriority || '*** by [@C' || o_custkey || '](https://x/' || o_custkey || ')' || chr(10) || chr(10) || '- open' || chr(10) || '  1. ' || o_orderstatus || chr(10) || '  2. `x`' || chr(10) || chr(10)
  || '| Key | Status |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' | ' || o_orderstatus || ' \\| ' || (o_orderkey % 3) || ' |' || chr(10) || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '> ⚠️ late' ELSE '```sql' || chr(10) || 'select ' || o_orderkey || chr(10) || '```' END AS markdown FROM orders""")
def tree_markdown(spark, sf_dir) -> DataFrame:
    """An order as a node tree: heading, marks and a linked mention, a list in a list, a table, a panel or a code block."""
    from lattica.plans.knowledge_queries import text_of
    from lattica.sources import adf

    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    para = lambda *inner: text_of('{"type":"paragraph","content":[', *inner, "]}")
    say = lambda *t: text_of('{"type":"text","text":"', *t, '"}')
    marked = lambda marks, *t: text_of('{"type":"text","marks":[', marks, '],"text":"', *t, '"}')
    item = lambda *inner: text_of('{"type":"listItem","content":[', *inner, "]}")
    cell = lambda kind, inner: text_of('{"type":"', kind, '","content":[', inner, "]}")
    row = lambda a, b: text_of('{"type":"tableRow","content":[', a, ",", b, "]}")
    link = text_of('{"type":"link","attrs":{"href":"https://x/', F.col("o_custkey"), '"}}')
    inner = text_of('{"type":"orderedList","content":[', item(para(say(status))), ",", item(para(marked('{"type":"code"}', "x"))), "]}")
    listed = text_of('{"type":"bulletList","content":[', item(para(say("open")), ",", inner), "]}")
    grid = text_of('{"type":"table","content":[', row(cell("tableHeader", para(say("Key"))), cell("tableHeader", para(say("Status")))), ",", row(cell("tableCell", para(say(k))), cell("tableCell", para(say(status, " | ", k % 3)))), "]}")
    last = F.when(k % 2 == 0, text_of('{"type":"panel","attrs":{"panelType":"warning"},"content":[', para(say("late")), "]}")).otherwise(text_of('{"type":"codeBlock","attrs":{"language":"sql"},"content":[', say("select ", k), "]}"))
    body = text_of('{"type":"doc","content":[', '{"type":"heading","attrs":{"level":2},"content":[', say("Order ", k), "]},", para(marked('{"type":"em"},{"type":"strong"}', F.col("o_orderpriority")), ",", say(" by "), ",", marked(link, "@C", F.col("o_custkey"))), ",", listed, ",", grid, ",", last, "]}")
    return table(spark, sf_dir, "orders").select(k.alias("id"), adf.adf_markdown(body).alias("markdown"))


# Chunks ---------------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_custkey AS d, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 1 + o_orderkey % 2 END AS lvl, 'T' || o_orderkey AS t, 'Order ' || o_orderkey || ' of @c' || (o_orderkey % 4) || ' at https://x/' || (o_orderkey % 5) || ', ABC-' || (o_orderkey % 3) AS line FROM orders),
n AS (SELECT *, count(lvl) OVER w - (CASE WHEN count(lvl) OVER w > 0 AND first_value(lvl) OVER w IS NOT NULL THEN 1 ELSE 0 END) AS sec, max(CASE WHEN lvl = 1 THEN k END) OVER w AS h1, max(CASE WHEN lvl = 2 THEN k END) OVER w AS h2 FROM o WINDOW w AS (PARTITION BY d ORDER BY k)),
s AS (SELECT d, sec, string_agg(CASE WHEN lvl IS NULL THEN '' ELSE repeat('#', lvl::INT) || ' ' || t || chr(10) END || line, chr(10) ORDER BY k) AS content, min(h1) AS h1, min(h2) AS h2, list('https://x/' || (k % 5) ORDER BY k) AS u, list('@c' || (k % 4) ORDER BY k) AS m, list('ABC-' || (k % 3) ORDER BY k) AS j FROM n GROUP BY d, sec),
c AS (SELECT d, sec, {'id': 'chunk_' || substr(sha256(d || ':' || sec || ':' || 'sha256:' || sha256(content)), 1, 20), 'p': list_filter([CASE WHEN h1 IS NOT NULL THEN 'T' || h1 END, CASE WHEN h2 IS NOT NULL AND (h1 IS NULL OR h2 > h1) THEN 'T' || h2 END], lambda x: x IS NOT NULL), 'c': content, 'u': u, 'm': list_concat(m, j), 'end': false} AS c FROM s),
l AS (SELECT d, list(c ORDER BY sec) AS c FROM c GROUP BY d),
f AS (SELECT d, list_reduce(list_transform(c, lambda x: [x]), lambda a, b: CASE WHEN len(regexp_split_to_array(a[len(a)].c, '\\s+')) < 40 THEN list_concat(a[1:len(a) - 1], [{'id': a[len(a)].id, 'p': list_concat(a[len(a)].p, list_filter(b[1].p, lambda x: NOT list_contains(a[len(a)].p, x))), 'c': a[len(a)].c || chr(10) || chr(10) || b[1].c, 'u': list_concat(a[len(a)].u, b[1].u), 'm': list_concat(a[len(a)].m, b[1].m), 'end': false}]) ELSE list_concat(a, b) END) AS c FROM l),
e AS (SELECT d, unnest(c) AS c, generate_subscripts(c, 1) - 1 AS pos FROM f),
w AS (SELECT d, pos, c, regexp_split_to_array(c.c, '\\s+') AS w FROM e),
x AS (SELECT *, unnest(CASE WHEN len(w) > 60 THEN range(1, len(w) + 1, 30) ELSE [1] END) AS st FROM w)
SELECT c.id || CASE WHEN len(w) > 60 THEN '_' || ((st - 1) // 30 + 1) ELSE '' END AS id, d::VARCHAR AS doc_id, pos::INT AS pos, array_to_string(c.p, ' > ') AS path, 'Top > ' || c_mktsegment || ' > ' || c_name AS breadcrumbs,
  'sha256:' || sha256(CASE WHEN len(w) > 60 THEN array_to_string(w[st : st + 29], ' ') ELSE c.c END) AS content_hash, (CASE WHEN len(w) > 60 THEN least(30, len(w) - st + 1) ELSE len(w) END)::INT AS n_words, array_to_string(list_sort(list_distinct(c.u)), ' ') AS urls, array_to_string(list_sort(list_distinct(c.m)), ' ') AS mentions FROM x JOIN customer ON c_custkey = d""")
def chunk_rows(spark, sf_dir) -> DataFrame:
    """A customer's orders as a document with headings of two levels; chunks of 40 to 60 words."""
    from lattica.operators import chunks

    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    head = F.when(k % 3 == 0, F.concat(F.repeat(F.lit("#"), (1 + k % 2).cast("int")), F.lit(" T"), s(k), F.lit("\n"))).otherwise("")
    line = F.concat(head, F.lit("Order "), s(k), F.lit(" of @c"), s(k % 4), F.lit(" at https://x/"), s(k % 5), F.lit(", ABC-"), s(k % 3), F.lit("\n"))
    texts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "").alias("text"))
    node = lambda i, t: F.struct(i.alias("id"), t.alias("title"))
    docs = table(spark, sf_dir, "customer").join(texts, "c_custkey").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"), F.array(node(F.lit("1"), F.lit("Top")), node(F.lit("2"), F.col("c_mktsegment"))).alias("ancestors"), "text")
    out = chunks.document_chunks(docs, 40, 60, 30)
    joined = lambda c: F.array_join(F.array_sort(c), " ").alias(c)
    return out.select("id", "doc_id", "pos", F.array_join("path", " > ").alias("path"), F.array_join("breadcrumbs", " > ").alias("breadcrumbs"), "content_hash", "n_words", joined("urls"), joined("mentions"))


# Folders --------------------------------------------------------------------------------------------------------------


def _folders(spark, sf_dir) -> dict[str, str]:
    """A folder tree of customers by nation and segment: one file each, those of even nations .txt under one root, the others .log under another."""
    import uuid

    from lattica.session import shared_dir

    top = f"{shared_dir(spark)}/folders-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nation"), F.lower("c_mktsegment").alias("segment"), F.concat(F.lit("---\ntitle: T\n---\n"), "c_name").alias("value"), "c_nationkey", "c_custkey")
    per = rows.groupBy("nation", "segment", "c_nationkey").agg(F.max_by("value", "c_custkey").alias("value"))
    for scope, rest, kind in (("even", 0, None), ("odd", 1, "log")):
        part = per.filter(F.col("c_nationkey") % 2 == rest).select("nation", "segment", "value").repartition("nation", "segment")
        writer = part.write.partitionBy("nation", "segment")
        if kind:
            writer.option("extension", kind).option("quoteAll", "false").option("quote", "").option("lineSep", "\n").csv(f"{top}/{scope}")
        else:
            writer.text(f"{top}/{scope}")
    return {scope: f"{top}/{scope}" for scope in ("even", "odd")}


def _found(spark, sf_dir) -> DataFrame:
    from lattica.sources import files

    return files.scan_folders(spark, _folders(spark, sf_dir), ["txt", "log"], [r"segment=machinery/"])


@query("""SELECT scope, format, folder, CASE WHEN folder LIKE 'nation=n4/%' THEN 'four' WHEN folder = 'nation=n2/segment=building' THEN 'deep' WHEN scope = 'odd' THEN 'rest' WHEN folder LIKE 'nation=n2/%' THEN 'two' END AS origin_scope_id FROM (
  SELECT DISTINCT CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS scope, CASE WHEN c_nationkey % 2 = 0 THEN 'txt' ELSE 'log' END AS format, 'nation=n' || c_nationkey || '/segment=' || lower(c_mktsegment) AS folder FROM customer WHERE lower(c_mktsegment) <> 'machinery')""")
def folder_scan(spark, sf_dir) -> DataFrame:
    """Two roots, two formats, one segment ignored; configured folders say which scope a file comes from."""
    from lattica.sources import files

    scopes = spark.createDataFrame([("even", "four", "nation=n4"), ("even", "two", "/nation=n2/"), ("even", "deep", "nation=n2/segment=building"), ("odd", "rest", "")], "scope string, origin_scope_id string, folder string")
    found = files.origin_scopes(_found(spark, sf_dir), scopes)
    return found.select("scope", "format", F.regexp_extract("relative", "^(.*)/", 1).alias("folder"), "origin_scope_id")


@query("SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'txt' ELSE 'log' END AS format, count(DISTINCT (c_nationkey, c_mktsegment)) AS n FROM customer WHERE lower(c_mktsegment) <> 'machinery' GROUP BY 1")
def folder_formats(spark, sf_dir) -> DataFrame:
    from lattica.sources import files

    return files.count_formats(_found(spark, sf_dir))


@query("""SELECT 'nation=n' || c_nationkey || '/segment=' || lower(c_mktsegment) AS source_id, 'T' AS title, max_by(c_name, c_custkey) AS body FROM customer WHERE lower(c_mktsegment) <> 'machinery' AND c_nationkey % 2 = 0 AND c_nationkey % 3 <> 0 GROUP BY ALL""")
def active_files(spark, sf_dir) -> DataFrame:
    """Manifest rows of files: every third nation is deleted, and a row without a file vanishes."""
    from lattica.sources import files

    found = _found(spark, sf_dir).filter("format = 'txt'").select("path", "content", F.regexp_extract("relative", "^(.*)/", 1).alias("source_id"))
    found = materialize(found, "folder-files")
    gone = F.regexp_extract("source_id", r"nation=n(\d+)/", 1).cast("int") % 3 == 0
    rows = found.select("source_id", F.lit("T").alias("title"), F.when(gone, "deleted").otherwise("active").alias("status"), F.col("path").alias("normalized_path"))
    lost = spark.range(1).select(F.lit("lost").alias("source_id"), F.lit("L").alias("title"), F.lit("active").alias("status"), F.lit("/nowhere/x.txt").alias("normalized_path"))
    out = files.active_bodies(rows.unionByName(lost), found)
    return out.withColumn("body", F.trim(F.regexp_replace("body", r"\n", " ")))


@query("""WITH p AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 END AS space, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders QUALIFY n <= 200),
t AS (SELECT lag(o_orderkey) OVER w AS from_id, o_orderkey AS to_id, n, min(n) OVER (PARTITION BY o_orderstatus, space) AS first FROM p WINDOW w AS (PARTITION BY o_orderstatus, space ORDER BY n))
SELECT from_id, to_id FROM t WHERE from_id IS NOT NULL ORDER BY first, n LIMIT 120""")
def chain_page(spark, sf_dir) -> DataFrame:
    """The newest 200 orders tied within status and space, the first 120 ties."""
    from lattica.operators import harvest

    rows = table(spark, sf_dir, "orders").withColumn("space", F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 5))
    return harvest.chain_graph(rows, ["o_orderstatus", "space"], [F.desc("o_orderdate"), F.col("o_orderkey")], "o_orderkey", 200, 120)


# SQL twins of earlier queries whose rules are regular expressions or rounds -------------------------------------------


def _text_twins() -> dict[str, str]:
    from lattica.operators import texts as T
    from lattica.plans.queries import CLEAN

    q = lambda s: "'" + s.replace("'", "''") + "'"
    has = lambda pattern: f"regexp_matches(line, {q(pattern)})"
    sentences = lambda c: f"string_split(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    joined = f"trim(array_to_string({sentences('c')}[1:3], ' '))"
    base = " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.SEVERITY.items())
    signals = f"""WITH l AS (SELECT doc_id, i - 1 AS line_no, regexp_replace(x[i], '^[ \\-*\\t]+|[ \\-*\\t]+$', '', 'g') AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
g AS (SELECT doc_id, line_no, CASE WHEN length(line) > 360 THEN {sentences('line')} ELSE [line] END AS p FROM l WHERE length(line) >= 10 AND NOT regexp_matches(line, '^\\|(.*\\|)?$')),
c AS (SELECT * FROM (SELECT doc_id, line_no, i - 1 AS part, trim(p[i]) AS line FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM g)) WHERE length(line) >= 10),
o AS (SELECT *, coalesce(nullif(regexp_replace(regexp_extract(line, {q(T.OWNER)}, 1), '^[ .,:;]+|[ .,:;]+$', '', 'g'), ''), nullif(regexp_extract(line, {q(T.NAME_TO)}, 1), '')) AS owner,
  CASE WHEN {has(T.NAME_TO)} THEN 'todo' WHEN suffix(line, '?') OR {has(T.OPEN_Q)} THEN 'open_question' WHEN {has(T.RISK)} THEN 'risk' WHEN {has(T.ACTION)} THEN 'todo' WHEN {has(T.DECISION)} THEN 'decision' END AS k FROM c),
k AS (SELECT *, coalesce(k, CASE WHEN owner IS NOT NULL THEN 'owner' END) AS kind, CASE WHEN {has(T.RESOLVED)} THEN 'resolved' ELSE 'open' END AS status, regexp_replace(regexp_replace(line, '[*_`]+', '', 'g'), '\\s+', ' ', 'g') AS t FROM o)
SELECT doc_id, line_no::INT AS line_no, part::INT AS part, kind, owner, status, greatest(0, least(100, CASE kind {base} ELSE 0 END + CASE WHEN {has(T.URGENT)} THEN 18 ELSE 0 END - CASE WHEN status = 'resolved' THEN 25 ELSE 0 END + CASE WHEN regexp_matches(lower(line), 'customer|contract') THEN 6 ELSE 0 END))::INT AS severity,
  CASE WHEN length(t) <= 96 THEN t ELSE regexp_replace(regexp_replace(substr(t, 1, 96), '[ .,:;]+$', ''), '^(.+) [^ ]*$', '\\1') || '…' END AS title, 'signal.' || kind || '.' || substr(sha256(kind || '|' || doc_id || '|' || line), 1, 12) AS signal_id FROM k WHERE kind IS NOT NULL"""
    summaries = with_(CLEAN) + f"SELECT doc_id, CASE WHEN {joined} <> '' THEN substr({joined}, 1, 700) ELSE substr(c, 1, 300) END AS summary, (CASE WHEN len(string_split(c, ' ')) < 80 THEN 0.55 ELSE 0.7 END)::DOUBLE AS confidence FROM c"
    stop, far = "(?:" + "|".join(T.STOPWORDS) + ")", r"[À-ÖØ-öø-ɏ\p{Greek}\p{Cyrillic}\p{Han}\p{Hiragana}\p{Katakana}\p{Arabic}\p{Hebrew}\p{M}]"
    plain = f"regexp_replace(c, '[A-Za-z0-9_]*{far}(?:[A-Za-z0-9_]|{far})*', chr(1), 'g')"  # words with other letters begin and end no run
    found = f"regexp_extract_all({plain}, '\\b[A-Z][A-Za-z0-9]*(?:\\s+[A-Z][A-Za-z0-9]*){{0,3}}\\b')"
    bare = f"trim(regexp_replace(regexp_replace(e, '(?i)^(?:{stop}\\s+)*(?:{stop}$)?', ''), '(?i)(?:\\s+{stop})+$', ''))"
    named = with_(CLEAN) + f"""SELECT doc_id, entity, n, rank FROM (SELECT doc_id, entity, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rank FROM (
  SELECT doc_id, f[pos] AS entity, pos FROM (SELECT doc_id, f, unnest(range(1, len(f) + 1)) AS pos FROM (SELECT doc_id, list_filter(list_transform({found}, lambda e: {bare}), lambda e: length(e) > 2) AS f FROM c))) GROUP BY 1, 2) WHERE rank <= 15"""
    return {"signal_lines": signals, "document_summaries": summaries, "document_entities": named.replace("rank FROM (", "rank::INTEGER AS rank FROM (", 1)}


def _diffused(rounds: int) -> str:
    """CTEs of layout.diffuse: each round a hex that is not pinned goes half the way to its neighbours' mean."""
    out = ["h0 AS (SELECT q, r, region IS NULL AS pinned, CASE WHEN region IS NULL THEN 0.0 ELSE region % 5 + 1 END::DOUBLE AS h FROM owned)", "near AS (SELECT a.q, a.r, b.q AS nq, b.r AS nr FROM owned a JOIN owned b ON (b.q - a.q, b.r - a.r) IN ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)))"]
    for k in range(rounds):
        out.append(f"h{k + 1} AS (SELECT q, r, pinned, CASE WHEN pinned OR m IS NULL THEN h ELSE h + 0.5::DOUBLE * (m - h) END AS h FROM h{k} LEFT JOIN (SELECT near.q, near.r, avg(h) AS m FROM near JOIN h{k} x ON x.q = nq AND x.r = nr GROUP BY 1, 2) USING (q, r))")
    return with_(GRID, OWNED, *out) + f"SELECT q::INT AS q, r::INT AS r, round(h, 6) AS height FROM h{rounds}"


# The agent's survey and its look at one node -----------------------------------------------------------------------------

MAP = (
    D.TREE_SQL, D.NOTE_TAGS_SQL, PAIRS, STRONG,
    """nodes AS (SELECT node_id AS id, 'region' AS type, name AS label, 'level ' || level || chr(10) || 'of the map' AS summary FROM tree
  UNION ALL SELECT DISTINCT 't' || tag_id, 'tag', 'Tag ' || tag_id, NULL FROM note_tags)""",
    """edges AS (SELECT parent_id AS src, node_id AS dst, 1 AS weight FROM tree WHERE parent_id IS NOT NULL UNION ALL SELECT 't' || a, 't' || b, n FROM strong)""",
    "ends AS (SELECT src AS id, dst AS other, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)",
)


def _map(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the region tree and of the tags that often stand together."""
    tree, tag = D.tree(spark, sf_dir), lambda c: F.concat(F.lit("t"), F.col(c).cast("string"))
    summary = F.concat(F.lit("level "), F.col("level").cast("string"), F.lit("\nof the map"))
    regions = tree.select(F.col("node_id").alias("id"), F.lit("region").alias("type"), F.col("name").alias("label"), summary.alias("summary"))
    tags = D.note_tags(spark, sf_dir).select("tag_id").distinct().select(tag("tag_id"), F.lit("tag"), F.concat(F.lit("Tag "), F.col("tag_id").cast("string")), F.lit(None).cast("string"))
    contains = tree.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit(1).cast("long").alias("weight"))
    return regions.union(tags), contains.union(_strong(spark, sf_dir).select(tag("a"), tag("b"), "n"))


@query(with_(*MAP) + """SELECT 'type' AS section, type AS key, '' AS text, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edges', 'edges', '', count(*) FROM edges
UNION ALL SELECT 'region', id, label || ': ' || replace(summary, chr(10), ' '), NULL FROM nodes WHERE type = 'region'
UNION ALL (SELECT 'tag', id, label, coalesce(d, 0)::BIGINT FROM nodes LEFT JOIN (SELECT id, sum(weight) AS d FROM ends GROUP BY id) USING (id) WHERE type = 'tag' ORDER BY coalesce(d, 0) DESC, id LIMIT 10)""")
def graph_overview(spark, sf_dir) -> DataFrame:
    return agent.overview(*_map(spark, sf_dir))


@query(with_(*MAP, """refs AS (SELECT 'n3' AS ref UNION SELECT 'nowhere at all' UNION SELECT 'r1' UNION SELECT lower(n_name) FROM nation UNION SELECT substr(n_name, 1, 3) FROM nation UNION SELECT c_mktsegment FROM customer UNION SELECT 'tag ' || p_size FROM part)""",
    """ways AS (SELECT ref, id, label, CASE WHEN ref = id THEN 0 WHEN lower(ref) = lower(label) THEN 1 ELSE 2 END AS way FROM refs JOIN nodes ON ref = id OR contains(lower(label), lower(ref)))""",
    """told AS (SELECT ref, id, label, row_number() OVER (PARTITION BY ref ORDER BY id) AS position, count(*) OVER (PARTITION BY ref) AS n FROM (SELECT *, min(way) OVER (PARTITION BY ref) AS best FROM ways) WHERE way = best)""",
    """near AS (SELECT ref, other, weight, row_number() OVER (PARTITION BY ref ORDER BY weight DESC, other) AS position FROM told JOIN ends USING (id) WHERE n = 1)""")
    + """SELECT ref, CASE WHEN n = 1 THEN 'node' ELSE 'candidate' END AS kind, position, id, label, NULL::BIGINT AS weight FROM told WHERE position <= 8
UNION ALL SELECT ref, 'connection', position, other, label, weight FROM near LEFT JOIN nodes ON nodes.id = other WHERE position <= 15""")
def explored_nodes(spark, sf_dir) -> DataFrame:
    n, named = table(spark, sf_dir, "nation"), spark.createDataFrame([("n3",), ("nowhere at all",), ("r1",)], "ref string")
    refs = named.union(n.select(F.lower("n_name"))).union(n.select(F.substring("n_name", 1, 3))).union(table(spark, sf_dir, "customer").select("c_mktsegment"))
    refs = refs.union(table(spark, sf_dir, "part").select(F.concat(F.lit("tag "), F.col("p_size").cast("string"))))
    return agent.explored(refs, *_map(spark, sf_dir))


ORACLE |= _text_twins() | {"hex_heights": _diffused(10)}
