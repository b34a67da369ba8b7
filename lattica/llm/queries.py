"""The queries op1 to op13 and the pipeline, as the driver calls them: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, chaining, decontaminate, hardneg, linededup, merkle, pieces, pii, quality, simhash, suffixdedup, toxicity, warc
from lattica.session import materialize, shared_dir, table


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(warc.resolve_revisits(warc.records(table(spark, sf_dir, "pages"))), path)
    read = warc.join_revisits(materialize(warc.read_warc(spark, path), "warc-headers"))
    digest = F.when(F.col("record_type") == "response", F.col("found")).otherwise(F.col("digest"))
    return read.select("page_id", F.col("n_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), *tokenizer()))


def tokenizer() -> tuple[str, str]:
    """The rank file and pattern of the contract's tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "verdict")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.fit(docs, table(spark, sf_dir, "labels")).score(docs)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids, "contaminated")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {f.__name__: f for f in (op4_warc, op5_bpe, op6_quality, op7_toxicity, op8_decontaminate, op9_simhash)}
OP4_SQL = """
WITH r AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, max(page_id) AS first FROM r GROUP BY html)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM r JOIN f USING (html)
"""

OP8_SQL = r"""
WITH lower_words AS (
  SELECT 'd' AS kind, doc_id AS id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) FROM benchmark),
items AS (SELECT id AS item_id, w, least(13, len(w)) AS width FROM lower_words WHERE kind = 'i' AND len(w) > 0),
wins AS (SELECT DISTINCT item_id, width, array_to_string(w[s : s + width - 1], ' ') AS win
  FROM (SELECT item_id, width, w, unnest(range(1, len(w) - width + 2)) AS s FROM items)),
docs AS (SELECT id AS doc_id, w FROM lower_words WHERE kind = 'd'),
places AS (SELECT doc_id, width, s, array_to_string(w[s : s + width - 1], ' ') AS win
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS s FROM docs, (SELECT DISTINCT width FROM items))),
found AS (SELECT doc_id, item_id, s, places.width FROM places JOIN wins ON places.win = wins.win AND places.width = wins.width),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + width)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLE: dict[str, str] = {"op4_warc": OP4_SQL, "op8_decontaminate": OP8_SQL}


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.near_duplicate_lines(table(spark, sf_dir, "documents"))


QUERIES["op10_linededup"] = op10_linededup


def op2_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digests(suffixdedup.deduplicate(table(spark, sf_dir, "documents")))


QUERIES["op2_suffixdedup"] = op2_suffixdedup


def op3_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.shared_passages(table(spark, sf_dir, "documents"))


QUERIES["op3_chaining"] = op3_chaining


#: Stands in where the session names no secret in spark.lattica.pii.key, as for the synthetic tables.
TRIAL_KEY = "no secret"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get("spark.lattica.pii.key", TRIAL_KEY))
    of = lambda kind: F.size(F.filter("entities", lambda e: e["kind"] == kind))
    counts = (of(kind).cast("long").alias(f"n_{kind}") for kind in pii.KINDS)
    return out.select("doc_id", F.size("entities").cast("long").alias("n_entities"), *counts, "text")


QUERIES["op1_pii"] = op1_pii


def op11_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(hardneg.quantised(rows.withColumn("label", moved)), F.col("id") % 50 == 0)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(pieces.encode(table(spark, sf_dir, "documents"), piece_model()))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [text if c == "text" else F.col(c) for c in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.row_digest(*fields))
    return merkle.verify(merkle.manifest(table(spark, sf_dir, "documents"), altered=tampered))


QUERIES |= {f.__name__: f for f in (op11_hardneg, op12_pieces, op13_merkle)}
OP11_SQL = """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM r AS a JOIN r AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""

OP13_SQL = """
WITH RECURSIVE said AS (SELECT doc_id, coalesce('=' || lang, '') AS g,
    list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda f: coalesce(strlen(f) || ':' || f, '-')) AS f,
    coalesce(strlen(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low,
    list_reduce([4294967295] || list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
leaf AS (SELECT doc_id, g, sha256(array_to_string(f, '')) AS h, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(array_to_string(f[1:4], '') || low) ELSE sha256(array_to_string(f, '')) END AS found FROM said),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaf),
low AS (SELECT g, 0 AS lvl, pos, n, h FROM placed UNION ALL
  SELECT g, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY g, lvl, n, pos // 8),
sub AS (SELECT g, h, lvl, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, pos, n, h FROM sub UNION ALL
  SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, n, pos // 8),
nodes AS (SELECT g, lvl, pos, h FROM low UNION ALL SELECT s.g, s.lvl + high.lvl, high.pos, high.h FROM sub AS s, high WHERE high.lvl > 0 OR high.pos = s.pos),
own AS (SELECT p.doc_id, p.h, p.found, p.g, l.lvl, p.pos // pow(8, l.lvl)::BIGINT AS pos FROM placed AS p JOIN low AS l ON l.g = p.g AND l.pos = p.pos // pow(8, l.lvl)::BIGINT AND l.n > 1
  UNION ALL SELECT p.doc_id, p.h, p.found, p.g, s.lvl + y.lvl, y.pos FROM placed AS p JOIN sub AS s USING (g) JOIN high AS y ON y.pos = s.pos // pow(8, y.lvl)::BIGINT AND y.n > 1),
steps AS (SELECT own.doc_id, own.h, own.found, own.g, own.lvl,
    coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < own.pos), '') AS before, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > own.pos), '') AS after
  FROM own JOIN (SELECT g, lvl, pos, h FROM low WHERE n > 1 UNION ALL SELECT s.g, s.lvl + y.lvl, y.pos, y.h FROM sub AS s, high AS y WHERE y.n > 1) AS x
    ON x.g = own.g AND x.lvl = own.lvl AND x.pos // 8 = own.pos // 8 GROUP BY ALL),
paths AS (SELECT p.doc_id, p.h, p.found, p.g, coalesce(list({'b': before, 'a': after} ORDER BY lvl) FILTER (lvl IS NOT NULL), []) AS path
  FROM placed AS p LEFT JOIN steps USING (doc_id, h, found, g) GROUP BY ALL),
folded AS (SELECT *, list_reduce([found] || list_transform(path, lambda s: s.b || '/' || s.a), lambda h, s: sha256(split_part(s, '/', 1) || h || split_part(s, '/', 2))) AS folded_root FROM paths)
SELECT doc_id, folded.h AS leaf, sub.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root,
  sha256(array_to_string(list_transform(path, lambda s: s.b || s.a), '')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM high WHERE n = 1) AS verified
FROM folded JOIN sub USING (g)
"""

ORACLE |= {"op11_hardneg": OP11_SQL, "op13_merkle": OP13_SQL}
