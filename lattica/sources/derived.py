"""Knowledge-base tables derived from the driver's star schema, as the survey's §7 lays out. AS_OF is the fixed clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.session import table

AS_OF = "1997-06-15"
KINDS = ["risk", "todo", "open_question", "decision", "owner", "recent_change"]


def as_of():
    return F.lit(AS_OF).cast("date")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        k.alias("seq"), F.concat(F.lit("sig-"), k.cast("string")).alias("id"), F.element_at(F.array(*map(F.lit, KINDS)), (k % 6 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("Item "), (k % 97).cast("string")).alias("title"), (105 - 15 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("severity"),
        F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("open").alias("status"), F.when(k % 3 == 0, F.concat(F.lit("user"), (F.col("o_custkey") % 10).cast("string"))).alias("owner"),
        F.when(k % 7 != 0, F.date_add(F.col("o_orderdate").cast("date"), (k % 180).cast("int"))).alias("due_date"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("region_id"), F.col("o_custkey").alias("note_id"), F.concat(F.lit("c"), (k % 500).cast("string")).alias("chunk_id"),
    )


SIGNALS_SQL = f"""signals AS (
  SELECT o_orderkey AS seq, 'sig-' || o_orderkey AS id, ['risk','todo','open_question','decision','owner','recent_change'][o_orderkey % 6 + 1] AS kind,
    'Item ' || (o_orderkey % 97) AS title, 105 - 15 * substr(o_orderpriority, 1, 1)::INT AS severity, CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'open' END AS status,
    CASE WHEN o_orderkey % 3 = 0 THEN 'user' || (o_custkey % 10) END AS owner, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE + (o_orderkey % 180)::INT END AS due_date,
    'n' || c_nationkey AS region_id, o_custkey AS note_id, 'c' || (o_orderkey % 500) AS chunk_id, DATE '{AS_OF}' AS today
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, parent_id, name, level): region, nation, customer segment."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    r = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"), F.lit(0).alias("level"))
    n = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name", F.lit(1))
    s = customer.select(F.concat(F.lit("s"), F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "c_mktsegment", F.lit(2)).distinct()
    return r.union(n).union(s)


TREE_SQL = """tree AS (
  SELECT 'r' || r_regionkey AS node_id, NULL::VARCHAR AS parent_id, r_name AS name, 0 AS level FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 1 FROM nation
  UNION ALL SELECT DISTINCT 's' || c_nationkey || '-' || c_mktsegment, 'n' || c_nationkey, c_mktsegment, 2 FROM customer)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note_id, region_id, created, updated, author): one note an order; its region is the customer's segment node."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    created = F.col("o_orderdate").cast("date")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("note_id"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment")).alias("region_id"),
        F.when(F.col("o_orderkey") % 11 != 0, created).alias("created"), F.when(F.col("o_orderkey") % 5 == 0, F.date_add(created, 20)).alias("updated"), F.col("c_name").alias("author"),
    )


NOTES_SQL = """notes AS (
  SELECT o_orderkey AS note_id, 's' || c_nationkey || '-' || c_mktsegment AS region_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS created,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate::DATE + 20 END AS updated, c_name AS author FROM orders JOIN customer ON o_custkey = c_custkey)"""


def note_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note_id"), (F.col("l_partkey") % 50).alias("tag_id")).distinct()


NOTE_TAGS_SQL = "note_tags AS (SELECT DISTINCT l_orderkey AS note_id, l_partkey % 50 AS tag_id FROM lineitem)"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was stored before: every document but those of src3; scope null for src5, status by language."""
    d = table(spark, sf_dir, "documents").filter("source <> 'src3'")
    status = F.when(F.col("lang") == "es", "deleted_at_source").when(F.col("lang") == "fr", "out_of_scope").otherwise("active")
    return d.select(
        F.col("doc_id").alias("source_id"), "source", F.sha2("text", 256).alias("content_hash"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("modified"),
        (F.col("doc_id") % 3 + 1).cast("int").alias("version"), status.alias("status"), F.when(F.col("source") != "src5", F.col("source")).alias("scope"), F.octet_length("text").cast("long").alias("raw_bytes"),
    )


MANIFEST_SQL = """manifest AS (
  SELECT doc_id AS source_id, source, sha256(text) AS content_hash, make_timestamp((1704067200 + doc_id * 60) * 1000000) AS modified, (doc_id % 3 + 1)::INT AS version,
    CASE lang WHEN 'es' THEN 'deleted_at_source' WHEN 'fr' THEN 'out_of_scope' ELSE 'active' END AS status, CASE WHEN source <> 'src5' THEN source END AS scope, octet_length(encode(text)) AS raw_bytes
  FROM documents WHERE source <> 'src3')"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source lists now: every document but those of src7; German texts have changed, clocks moved by -1 to 1 hour."""
    d = table(spark, sf_dir, "documents").filter("source <> 'src7'")
    changed = F.when(F.col("lang") == "de", F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    return d.select(
        F.col("doc_id").alias("source_id"), "source", F.sha2(changed, 256).alias("content_hash"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60 + (F.col("doc_id") % 3 - 1) * 3600).alias("modified"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("scope"),
    )


LISTING_SQL = """listing AS (
  SELECT doc_id AS source_id, source, sha256(CASE WHEN lang = 'de' THEN text || ' edited' ELSE text END) AS content_hash,
    make_timestamp((1704067200 + doc_id * 60 + (doc_id % 3 - 1) * 3600) * 1000000) AS modified, CASE WHEN doc_id % 4 <> 0 THEN source END AS scope FROM documents WHERE source <> 'src7')"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity log: (pos, source, id, change, ts) of harvest events; other event types are other actions."""
    e = table(spark, sf_dir, "events")
    change = F.when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "purchase", "updated").when(F.col("event_type") == "error", "deleted")
    return e.select(F.col("event_id").alias("pos"), F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source"), F.col("user_id").alias("id"), change.alias("change"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"))


LOG_SQL = """log AS (
  SELECT event_id AS pos, 'src' || (user_id % 5) AS source, user_id AS id, CASE event_type WHEN 'signup' THEN 'new' WHEN 'purchase' THEN 'updated' WHEN 'error' THEN 'deleted' END AS change,
    ts::TIMESTAMP AS ts, event_type AS action FROM events)"""

#: Phrases for the deadline resolver; the anchor is an order's date.
PHRASES = [
    "by Friday", "next Tuesday", "in 2 weeks", "within three days", "in a month", "tomorrow please", "by tonight", "end of month", "EOQ", "by end of the year", "eow", "next quarter",
    "next week", "next month", "by April", "mid September", "March 31", "30th of April 2027", "Feb 30", "2026-02-31", "2027-05", "Q3", "Q1 of 2028", "no deadline at all", "in 99999 days", "31 Nov",
]
