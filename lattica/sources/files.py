"""Folder and log sources, and the sinks that publish tables: Spark readers and writers only, so any store will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ["md", "txt", "pdf"]
LOG_SCHEMA = (
    "action string, run string, source string, id string, title string, version int, change string, reason string, error string, parent string, file string, bytes long, size long, "
    "docs_found long, docs_harvested long, docs_skipped long, docs_failed long, ts timestamp"
)


def scan_folders(spark: SparkSession, roots: dict[str, str], formats: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """(scope, path, relative, format, modified, bytes, content) of the files under each root {scope: folder}.

    ``ignore`` are regular expressions on the path below the root. Hidden files are left out.
    """
    out = None
    for scope, root in roots.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(formats or FORMATS) + "}").load(root)
        below = F.regexp_extract("path", "/" + root.rstrip("/").rsplit("/", 1)[-1].replace(".", r"\.") + "/(.*)$", 1)
        files = files.select(F.lit(scope).alias("scope"), "path", below.alias("relative"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")
        out = files if out is None else out.unionByName(files)
    for pattern in [r"(^|/)\.", *(ignore or [])]:
        out = out.filter(~F.col("relative").rlike(pattern))
    return out.withColumn("format", F.lower(F.regexp_extract("relative", r"\.([^.]+)$", 1)))


def frontmatter(text: Column) -> Column:
    """map<string, string> of the ``key: value`` lines of a leading --- block; empty without one."""
    block = F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w -]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), r"^[\"']|[\"']$", "").alias("value")))
    kept = F.aggregate(pairs, F.array().cast("array<struct<key: string, value: string>>"), lambda a, p: F.when(F.exists(a, lambda y: y["key"] == p["key"]), a).otherwise(F.array_append(a, p)))
    return F.map_from_entries(kept)


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*\n?", "")


def tag_list(raw: Column) -> Column:
    """A frontmatter list or comma string as distinct trimmed tags without their #."""
    parts = F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\[\]\"']", ""), ",")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.regexp_replace(F.trim(x), "^#", "")), lambda x: x != ""))


def list_notes(files: DataFrame) -> DataFrame:
    """One reference a file: title from the frontmatter or else the stem, the folder as container path."""
    text = F.decode("content", "UTF-8")
    meta = frontmatter(text)
    stem = F.regexp_extract("relative", r"([^/]+)\.[^.]+$", 1)
    folder = F.regexp_extract("relative", r"^(.*)/[^/]+$", 1)
    return files.select(
        "scope", F.col("relative").alias("source_id"), F.coalesce(F.nullif(meta["title"], F.lit("")), stem).alias("title"), "modified", "bytes", "format",
        F.filter(F.split(folder, "/"), lambda x: x != "").alias("container"), tag_list(meta["tags"]).alias("tags"), F.sha2("content", 256).alias("content_hash"), strip_frontmatter(text).alias("body"),
    )


def origin_scopes(files: DataFrame, scopes: DataFrame, path: str = "relative") -> DataFrame:
    """``files`` with origin_scope_id: the scope of the longest configured folder (scope, origin_scope_id, folder) that holds the file, else null.

    A file's folders are listed in its own row and met by equality, so that any number of folders may be configured.
    """
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = files.select("scope", path, F.explode(above).alias("folder"))
    clean = F.regexp_replace("folder", "^/+|/+$", "")
    named = scopes.select("scope", "origin_scope_id", clean.alias("folder")).dropDuplicates(["scope", "folder"])
    best = each.join(named, ["scope", "folder"]).groupBy("scope", path).agg(F.max_by("origin_scope_id", F.char_length("folder")).alias("origin_scope_id"))
    return files.join(best, ["scope", path], "left")


def active_bodies(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(source_id, title, body) of active manifest rows (source_id, title, status, normalized_path) whose file is there, frontmatter stripped.

    ``files`` is (path, content); rows without a file vanish. Paths compare without their scheme.
    """
    bare = lambda c: F.regexp_replace(c, r"^[a-z0-9+.-]+:(//)?(?=/)", "")
    there = files.select(bare(F.col("path")).alias("__path"), strip_frontmatter(F.decode("content", "UTF-8")).alias("body"))
    wanted = manifest.filter("status = 'active' AND normalized_path IS NOT NULL").withColumn("__path", bare(F.col("normalized_path")))
    return wanted.join(there, "__path").select("source_id", "title", "body")


def count_formats(files: DataFrame) -> DataFrame:
    return files.groupBy("format").agg(F.count("*").alias("n"))


def attachments(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(source_id, target, path) of ``![[embeds]]`` that name a file of the same scope; each target once a note."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(r"!\[\[([^\]|]+)"), F.lit(1)), lambda x: F.trim(x)))
    wanted = notes.select("scope", "source_id", F.explode(found).alias("target"))
    there = files.select("scope", "path", F.regexp_extract("relative", r"([^/]+)$", 1).alias("target"))
    return wanted.join(there, ["scope", "target"]).select("source_id", "target", "path")


def read_log(spark: SparkSession, path: str, since: Column | None = None, actions: list[str] | None = None) -> DataFrame:
    """The activity log; malformed lines are dropped, filters reach the scan's rows."""
    log = spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    log = log.filter(F.col("ts") >= since) if since is not None else log
    return log.filter(F.col("action").isin(actions)) if actions else log


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def write_store(rows: DataFrame, path: str, by: str = "source_type") -> None:
    """Raw or normalised rows in folders by source; only the sources in ``rows`` are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def publish(rows: DataFrame, path: str, drop: list[str] | None = None) -> None:
    """JSON lines of ``rows`` without vector columns, visible under ``path`` only when complete: written aside, then renamed."""
    spark = rows.sparkSession
    rows.drop(*(drop or ["embedding", "context_embedding"])).write.mode("overwrite").json(path + ".next")
    jvm = spark.sparkContext._jvm
    target, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".next")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(fresh, target):
        raise OSError(f"could not publish {path}")
