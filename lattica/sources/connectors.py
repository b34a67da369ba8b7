"""Connector payloads (JSON) as flat rows, query predicates that reach the scan, and a pluggable data source.

Payloads are read with Spark's JSON reader under fixed schemas; nested lists become rows by explode, threads become one row by
ordered aggregation. Recursive trees (ADF, blocks) go through one Arrow-batched function each.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

PAGES = (
    "results array<struct<id: string, type: string, status: string, title: string, space: struct<key: string, name: string>, version: struct<when: timestamp, number: int>, "
    "ancestors: array<struct<id: string, title: string>>, _links: struct<webui: string>>>, start int, `limit` int, size int"
)
ISSUES = (
    "nextPageToken string, issues array<struct<id: string, key: string, fields: struct<summary: string, status: struct<name: string>, project: struct<key: string>, updated: timestamp, "
    "issuetype: struct<name: string>, labels: array<string>, assignee: struct<displayName: string>, reporter: struct<displayName: string>, description: string>>>"
)
MESSAGES = "channel string, ts string, thread_ts string, user string, text string, reactions array<struct<name: string, count: int>>"
MAIL = (
    "id string, snippet string, messages array<struct<internalDate: string, labelIds: array<string>, payload: struct<mimeType: string, headers: array<struct<name: string, value: string>>, "
    "body: struct<data: string>, parts: array<struct<mimeType: string, body: struct<data: string, attachmentId: string>>>>>>"
)
EVENTS = "id string, summary string, status string, start struct<dateTime: timestamp, date: date>, `end` struct<dateTime: timestamp, date: date>, attendees array<struct<email: string, responseStatus: string>>, organizer struct<email: string>, updated timestamp"


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def pages(payloads: DataFrame) -> DataFrame:
    """One row a listed page, with its ancestors' titles as breadcrumb."""
    p = payloads.select(F.explode("results").alias("p"))
    return p.select(
        F.col("p.id").alias("source_id"), "p.title", F.col("p.space.key").alias("space"), F.col("p.version.when").alias("modified"), F.col("p.version.number").alias("version"),
        F.col("p._links.webui").alias("url"), F.col("p.ancestors.title").alias("container"), F.element_at(F.col("p.ancestors.id"), -1).alias("parent_id"), "p.status",
    )


def issues(payloads: DataFrame) -> DataFrame:
    i = payloads.select(F.explode("issues").alias("i"))
    f = "i.fields."
    return i.select(
        F.col("i.key").alias("source_id"), F.col(f + "summary").alias("title"), F.col(f + "status.name").alias("status"), F.col(f + "project.key").alias("project"), F.col(f + "updated").alias("modified"),
        F.col(f + "issuetype.name").alias("type"), F.coalesce(F.col(f + "labels"), F.array().cast("array<string>")).alias("labels"), F.col(f + "assignee.displayName").alias("assignee"),
        F.col(f + "reporter.displayName").alias("reporter"), F.col(f + "description").alias("description"),
    )


def issue_filter(projects: list[str], since: Column | None) -> Column:
    """project IN (...) AND updated >= since at whole minutes, as a tracker's query language has it."""
    out = F.col("project").isin(projects) if projects else F.lit(True)
    return out & (F.col("modified") >= F.date_trunc("minute", since)) if since is not None else out


def mail_filter(since: Column | None, labels: list[str], excluded: list[str], senders: list[str]) -> Column:
    out = F.lit(True)
    if since is not None:
        out = out & (F.col("last_at") >= since)
    for label in labels:
        out = out & F.array_contains("labels", label)
    for label in excluded:
        out = out & ~F.array_contains("labels", label)
    return out & F.lower("from_addr").isin([s.lower() for s in senders]) if senders else out


def _header(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def mail_threads(payloads: DataFrame) -> DataFrame:
    """One row a thread: latest subject and sender, all recipients and labels, first and last time, markdown of the messages."""
    ordered = F.array_sort(F.transform("messages", lambda m: F.struct(F.coalesce(m["internalDate"].cast("long"), F.lit(0)).alias("at"), m["labelIds"].alias("labels"), m["payload"].alias("payload"))))
    t = payloads.select("id", "snippet", ordered.alias("m")).withColumn("latest", F.element_at("m", -1))
    heads = F.col("latest.payload.headers")
    sender = _header(heads, "From")
    stamp = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    to = F.flatten(F.transform("m", lambda m: F.split(F.coalesce(_header(m["payload"]["headers"], "To"), F.lit("")), r"\s*,\s*")))
    part = lambda p: F.get(F.filter(F.coalesce(p["parts"], F.array()), lambda x: x["mimeType"] == "text/plain"), F.lit(0))["body"]["data"]
    body = lambda p: F.decode(F.unbase64(F.translate(F.coalesce(part(p), p["body"]["data"], F.lit("")), "-_", "+/")), "UTF-8")
    return t.select(
        F.col("id").alias("source_id"), _header(heads, "Subject").alias("subject"), F.coalesce(F.nullif(F.regexp_extract(sender, "<([^>]+)>", 1), F.lit("")), sender).alias("from_addr"),
        F.array_distinct(F.filter(to, lambda x: x != "")).alias("to_addrs"), F.array_sort(F.array_distinct(F.flatten(F.transform("m", lambda m: F.coalesce(m["labels"], F.array().cast("array<string>")))))).alias("labels"),
        F.size("m").alias("message_count"), stamp(F.col("m")[0]["at"]).alias("first_at"), stamp(F.col("latest.at")).alias("last_at"), "snippet",
        F.array_join(F.transform("m", lambda m: F.concat(F.lit("### "), F.coalesce(_header(m["payload"]["headers"], "From"), F.lit("")), F.lit("\n\n"), body(m["payload"]))), "\n\n").alias("markdown"),
    )


def chat_threads(messages: DataFrame, names: DataFrame) -> DataFrame:
    """(channel, thread_ts, reply_count, participants, reactions, created, last, markdown): messages by thread, mentions named.

    ``names`` (user, name) is a dimension; it is joined before the grouping.
    """
    thread = F.coalesce("thread_ts", "ts")
    stamp = lambda c: F.date_format(F.timestamp_seconds(F.floor(c.cast("double"))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = messages.dropDuplicates(["channel", "ts"]).withColumn("thread", thread).join(names, "user", "left")
    named = F.transform(F.array_sort(F.collect_list(F.struct("ts", F.coalesce("name", "user").alias("who"), "text"))), lambda m: F.concat(F.lit("**"), m["who"], F.lit(":** "), m["text"]))
    reactions = rows.select("channel", "thread", F.explode("reactions").alias("r")).groupBy("channel", "thread").agg(F.sum("r.count").alias("reactions"))
    out = rows.groupBy("channel", "thread").agg(
        (F.count("*") - 1).alias("reply_count"), F.array_sort(F.collect_set(F.coalesce("name", "user"))).alias("participants"), stamp(F.min("ts")).alias("created"), stamp(F.max("ts")).alias("last"), F.array_join(named, "\n\n").alias("markdown"),
    )
    return out.join(reactions, ["channel", "thread"], "left").withColumn("reactions", F.coalesce("reactions", F.lit(0))).withColumnRenamed("thread", "thread_ts")


def thread_starters(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("thread_ts").isNull() | (F.col("thread_ts") == F.col("ts"))).dropDuplicates(["channel", "ts"])


def channel_days(messages: DataFrame) -> DataFrame:
    """(channel, day, n_messages, n_users) by calendar day."""
    day = F.to_date(F.timestamp_seconds(F.floor(F.col("ts").cast("double"))))
    return messages.dropDuplicates(["channel", "ts"]).groupBy("channel", day.alias("day")).agg(F.count("*").alias("n_messages"), F.count_distinct("user").alias("n_users"))


def calendar_events(events: DataFrame, low: Column, high: Column) -> DataFrame:
    """Events that start in [low, high], with their length, attendees and acceptances."""
    begin = F.coalesce(F.col("start.dateTime"), F.col("start.date").cast("timestamp"))
    end = F.coalesce(F.col("end.dateTime"), F.col("end.date").cast("timestamp"))
    return events.select(
        F.col("id").alias("source_id"), F.col("summary").alias("title"), "status", begin.alias("begin"), ((end.cast("long") - begin.cast("long")) / 60).cast("long").alias("minutes"), F.col("organizer.email").alias("organizer"),
        F.array_sort(F.transform(F.coalesce("attendees", F.array().cast("array<struct<email: string, responseStatus: string>>")), lambda a: a["email"])).alias("attendees"),
        F.size(F.filter("attendees", lambda a: a["responseStatus"] == "accepted")).alias("accepted"), F.col("start.dateTime").isNull().alias("all_day"), "updated",
    ).filter(F.col("begin").between(low, high))


def _adf(node) -> str:
    """Text of an ADF tree: blocks end lines, list items get a dash."""
    if not isinstance(node, dict):
        return ""
    inner = "".join(_adf(x) for x in node.get("content") or [])
    kind = node.get("type")
    if kind == "text":
        return node.get("text") or ""
    if kind == "hardBreak":
        return "\n"
    if kind == "heading":
        return "#" * int((node.get("attrs") or {}).get("level", 1)) + " " + inner + "\n"
    if kind == "listItem":
        return "- " + inner
    return inner + "\n" if kind in ("paragraph", "codeBlock", "blockquote") else inner


def adf_text(column: Column) -> Column:
    """Markdown-like text of ADF given as JSON; text that is no JSON comes back as it is."""

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return _adf(json.loads(v)).strip() if v else v
            except ValueError:
                return v

        return values.map(one)

    return run(column)


# A pluggable source: name -> a function from options to partitions of rows -----------------------------------------------

LISTING = "source_id string, title string, source_type string, modified_at timestamp, content_hash string, origin_scope_id string"


class _Scope(InputPartition):
    def __init__(self, rows: list[dict]):
        super().__init__(None)
        self.rows = rows


def register_plugin(spark: SparkSession, name: str, factory: Callable[[dict], list[list[dict]]]) -> None:
    """Make spark.read.format(name) list what ``factory(options)`` returns: one list of rows a scope item, a partition each.

    The classes are local so that they travel to the workers by value, the factory with them.
    """

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            return [_Scope(rows) for rows in factory(self.options)]

        def read(self, partition):
            columns = ("source_id", "title", "source_type", "modified_at", "content_hash", "origin_scope_id")
            for row in partition.rows:
                yield tuple(row.get(c) for c in columns)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return LISTING

        def reader(self, schema):
            return Reader(dict(self.options))

    spark.dataSource.register(Source)


def read_plugin(spark: SparkSession, name: str, enabled: list[str], **options: str) -> DataFrame:
    """The listing of a registered plugin if it is enabled, else no rows."""
    if name not in enabled:
        return spark.createDataFrame([], LISTING)
    reader = spark.read.format(name)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


# Code hosting and block-tree payloads ----------------------------------------------------------------------------------

ENVELOPES = (
    "document_type string, repo string, item struct<number: long, title: string, body: string, state: string, user: struct<login: string>, labels: array<struct<name: string>>, created_at: timestamp, updated_at: timestamp, "
    "merged_at: timestamp, draft: boolean, additions: long, deletions: long, pull_request: struct<url: string>, category: struct<name: string>, answer_chosen_at: timestamp>, "
    "comments array<struct<user: struct<login: string>, body: string, created_at: timestamp>>, reviews array<struct<user: struct<login: string>, state: string>>"
)


def code_envelopes(payloads: DataFrame, since: Column | None = None) -> DataFrame:
    """Issues, pull requests and discussions as flat rows with markdown; kind follows document_type, else the payload's shape."""
    i = "item."
    kind = F.coalesce("document_type", F.when(F.col(i + "pull_request").isNotNull(), "pr").when(F.col(i + "category").isNotNull(), "discussion").otherwise("issue"))
    people = F.array_union(F.array(F.col(i + "user.login")), F.coalesce(F.col("comments.user.login"), F.array().cast("array<string>")))
    said = F.transform(F.coalesce("comments", F.array().cast("array<struct<user: struct<login: string>, body: string, created_at: timestamp>>")), lambda c: F.concat(F.lit("**"), c["user"]["login"], F.lit(":** "), F.coalesce(c["body"], F.lit(""))))
    title = F.concat(F.lit("# "), F.col(i + "title"))
    out = payloads.select(
        F.concat_ws("#", "repo", F.col(i + "number").cast("string")).alias("source_id"), kind.alias("kind"), F.col(i + "title").alias("title"), F.col(i + "state").alias("state"), F.col(i + "user.login").alias("author"),
        F.coalesce(F.col(i + "labels.name"), F.array().cast("array<string>")).alias("labels"), F.col(i + "created_at").alias("created"), F.col(i + "updated_at").alias("modified"),
        F.size(F.coalesce("comments", F.array())).alias("n_comments"), F.array_distinct(F.filter(people, lambda x: x.isNotNull())).alias("participants"),
        F.size(F.filter(F.coalesce(F.col("reviews.state"), F.array().cast("array<string>")), lambda s: s == "APPROVED")).alias("approvals"), F.col(i + "merged_at").isNotNull().alias("merged"),
        (F.coalesce(i + "additions", F.lit(0)) + F.coalesce(i + "deletions", F.lit(0))).alias("changed_lines"), F.col(i + "answer_chosen_at").isNotNull().alias("answered"),
        F.array_join(F.concat(F.array(title, F.coalesce(F.col(i + "body"), F.lit(""))), said), "\n\n").alias("markdown"),
    )
    return out.filter(F.col("modified") >= since) if since is not None else out


#: What stands before the text of each kind of block.
BLOCK_MARKS = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> ", "toggle": "- ", "callout": "> "}


def _rich(parts) -> str:
    out = []
    for p in parts or []:
        text, marks = p.get("plain_text") or "", p.get("annotations") or {}
        for name, mark in (("code", "`"), ("bold", "**"), ("italic", "*"), ("strikethrough", "~~")):
            text = f"{mark}{text}{mark}" if marks.get(name) and text else text
        out.append(f"[{text}]({p['href']})" if p.get("href") else text)
    return "".join(out)


def _block_lines(blocks, depth: int = 0):
    for b in blocks or []:
        kind = b.get("type")
        body = b.get(kind) or {}
        text = _rich(body.get("rich_text"))
        pad = "  " * depth
        if kind == "to_do":
            yield f"{pad}- [{'x' if body.get('checked') else ' '}] {text}"
        elif kind == "code":
            yield f"{pad}```{body.get('language') or ''}\n{text}\n{pad}```"
        elif kind == "divider":
            yield pad + "---"
        elif kind in ("child_page", "child_database"):
            yield f"{pad}[{kind}] {body.get('title') or ''}"
        elif kind in ("image", "file", "pdf", "video"):
            yield f"{pad}[{_rich(body.get('caption')) or kind}]({(body.get('file') or body.get('external') or {}).get('url') or ''})"
        elif kind == "table":
            for i, row in enumerate(b.get("children") or []):
                cells = [_rich(c) for c in (row.get("table_row") or {}).get("cells") or []]
                yield pad + "| " + " | ".join(cells) + " |"
                if i == 0:
                    yield pad + "|" + " --- |" * len(cells)
            continue
        elif text or kind == "paragraph":
            yield pad + BLOCK_MARKS.get(kind, "") + text
        yield from _block_lines(b.get("children"), depth + 1)


def _property(p: dict):
    """One database property as text or a list of texts, null where it is empty."""
    kind = p.get("type")
    v = p.get(kind)
    if v is None:
        return None
    if kind in ("title", "rich_text"):
        return _rich(v) or None
    if kind in ("select", "status"):
        return v.get("name")
    if kind == "multi_select":
        return [x.get("name") for x in v]
    if kind in ("people", "created_by", "last_edited_by"):
        return [x.get("name") or x.get("id") for x in (v if isinstance(v, list) else [v])]
    if kind == "date":
        return "/".join(x for x in (v.get("start"), v.get("end")) if x)
    if kind == "relation":
        return [x.get("id") for x in v]
    if kind == "files":
        return [x.get("name") for x in v]
    if kind == "unique_id":
        return "-".join(str(x) for x in (v.get("prefix"), v.get("number")) if x is not None)
    if kind in ("formula", "rollup"):
        return [_property(x) for x in v["array"]] if v.get("type") == "array" else v.get(v.get("type"))
    return v


def _json_function(fn):
    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return fn(json.loads(v)) if v else v
            except (ValueError, AttributeError, TypeError, KeyError):
                return None

        return values.map(one)

    return run


def blocks_markdown(column: Column) -> Column:
    """Markdown of a JSON list of blocks, children indented by their depth; null for what is no such list."""
    return _json_function(lambda v: "\n".join(_block_lines(v)))(column)


def block_attachments(column: Column) -> Column:
    """array<string> of the addresses of image, file, pdf and video blocks at any depth."""

    def walk(blocks):
        for b in blocks or []:
            body = b.get(b.get("type")) or {}
            if b.get("type") in ("image", "file", "pdf", "video"):
                yield (body.get("file") or body.get("external") or {}).get("url")
            yield from walk(b.get("children"))

    return F.from_json(_json_function(lambda v: json.dumps([u for u in walk(v) if u]))(column), "array<string>")


def properties(column: Column) -> Column:
    """map<string, string> of a JSON property map; lists are joined with commas, empty values left out."""

    def flat(v):
        values = {k: _property(p) for k, p in v.items()}
        return json.dumps({k: ", ".join(map(str, x)) if isinstance(x, list) else str(x) for k, x in values.items() if x not in (None, [])})

    return F.from_json(_json_function(flat)(column), "map<string, string>")


def rows_markdown(rows: DataFrame, group: str, title: str, props: str, columns: list[str]) -> DataFrame:
    """(group, markdown): a database's rows as one pipe table, in the order of their titles."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(title), *(F.coalesce(F.col(props)[c], F.lit("")) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join([title, *columns]) + " |\n|" + " --- |" * (len(columns) + 1)
    listed = F.array_sort(F.collect_list(F.struct(F.col(title).alias("t"), cells.alias("c"))))
    return rows.groupBy(group).agg(listed.alias("l")).select(group, F.concat_ws("\n", F.lit(head), F.array_join(F.transform("l", lambda x: x["c"]), "\n")).alias("markdown"))


def in_scope(pages: DataFrame, closure: DataFrame, scope: DataFrame) -> DataFrame:
    """Pages that are in scope themselves or under an ancestor that is, with the nearest such id."""
    from lattica.operators.serve import nearest_scope

    return pages.join(nearest_scope(closure, scope).select(F.col("node_id").alias("source_id"), "scope_id"), "source_id")


def event_markdown(events: DataFrame) -> DataFrame:
    """(source_id, markdown) of calendar_events(): heading, time, organiser and attendees."""
    heading = F.concat(F.when(F.col("status") == "cancelled", "# (cancelled) ").otherwise("# "), F.coalesce("title", F.lit("(no title)")))
    when = F.when(F.col("all_day"), F.date_format("begin", "yyyy-MM-dd")).otherwise(F.concat(F.date_format("begin", "yyyy-MM-dd HH:mm"), F.lit(" – "), F.date_format(F.timestamp_seconds(F.col("begin").cast("long") + F.col("minutes") * 60), "HH:mm")))
    guests = F.when(F.size("attendees") > 0, F.concat(F.lit("**Attendees:**\n"), F.array_join(F.transform("attendees", lambda a: F.concat(F.lit("- "), a)), "\n")))
    return events.select("source_id", F.concat_ws("\n", heading, F.lit(""), F.concat(F.lit("**When:** "), when), F.concat(F.lit("**Organizer:** "), F.col("organizer")), guests).alias("markdown"))


def channel_day_markdown(messages: DataFrame, names: DataFrame) -> DataFrame:
    """(channel, day, markdown): a day's messages as bullets, replies under their parent, each cut to one short line."""
    stamp = F.timestamp_seconds(F.floor(F.col("ts").cast("double")))
    rows = messages.dropDuplicates(["channel", "ts"]).join(names, "user", "left")
    rows = rows.select("channel", F.to_date(stamp).alias("day"), F.coalesce("thread_ts", "ts").alias("parent"), "ts", F.coalesce("name", "user", F.lit("unknown")).alias("who"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ")).alias("text"), F.date_format(stamp, "HH:mm").alias("at"))
    reply = F.col("parent") != F.col("ts")
    limit = F.when(reply, 120).otherwise(140)
    short = F.when(F.col("text") == "", "(no text)").when(F.char_length("text") > limit, F.concat(F.substr("text", F.lit(1), limit - 1), F.lit("…"))).otherwise(F.col("text"))
    bullet = F.concat(F.when(reply, "  - **").otherwise("- **"), F.col("at"), F.lit(" "), F.col("who"), F.lit("**: "), short)
    listed = F.array_sort(F.collect_list(F.struct(F.col("parent").cast("double").alias("p"), F.col("ts").cast("double").alias("t"), bullet.alias("b"))))
    out = rows.groupBy("channel", "day").agg(F.count("*").alias("n"), F.count_distinct("who").alias("people"), listed.alias("l"))
    head = F.concat(F.lit("# "), F.col("channel"), F.lit(" — "), F.col("day").cast("string"), F.lit(" ("), F.col("n").cast("string"), F.when(F.col("n") == 1, " message, ").otherwise(" messages, "), F.col("people").cast("string"), F.when(F.col("people") == 1, " person)").otherwise(" people)"))
    return out.select("channel", "day", F.concat_ws("\n", head, F.lit(""), F.array_join(F.transform("l", lambda x: x["b"]), "\n")).alias("markdown"))


# Tracker issues, comments and attachments ------------------------------------------------------------------------------

#: The names of the estimate field, the preferred one first.
POINTS_NAMES = ["story point estimate", "story points"]
ISSUE = (
    "key string, fields struct<summary: string, status: struct<name: string>, project: struct<key: string>, issuetype: struct<name: string>, labels: array<string>, assignee: struct<displayName: string>, "
    "updated: string, description: string, comment: struct<comments: array<struct<created: string, author: struct<displayName: string>, body: string>>>>"
)


def points_field(fields: DataFrame) -> DataFrame:
    """(site, field_id): each site's estimate field by name, the preferred name first, its first listed field; rows (site, pos, id, name)."""
    name = F.lower(F.trim("name"))
    rank = F.array_position(F.array(*map(F.lit, POINTS_NAMES)), name)
    return fields.filter(name.isin(POINTS_NAMES) & F.col("id").isNotNull()).groupBy("site").agg(F.min_by("id", F.struct(rank, F.col("pos"))).alias("field_id"))


def issue_markdown(issues: DataFrame, base_url: str | None = None) -> DataFrame:
    """(source_id, markdown) of issue rows in ISSUE's shape: ordered frontmatter, heading, description, comments by time.

    Frontmatter fields without a value are left out.
    """
    f = lambda name: F.col("fields." + name)
    quote = lambda v: F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"'))
    values = [("key", F.col("key")), ("summary", f("summary")), ("status", f("status.name")), ("project_key", f("project.key")), ("issue_type", f("issuetype.name")), ("assignee", f("assignee.displayName")), ("updated", f("updated"))]
    if base_url:
        values.append(("url", F.concat(F.lit(base_url.rstrip("/") + "/browse/"), F.col("key"))))
    lines = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(k + ": "), quote(v))) for k, v in values]
    labels = F.when(F.size(f("labels")) > 0, F.concat(F.lit("labels: ["), F.array_join(F.transform(f("labels"), quote), ", "), F.lit("]")))
    front = F.concat_ws("\n", F.lit("---"), *lines, labels, F.lit("---"))
    key, summary = F.coalesce("key", F.lit("")), F.coalesce(f("summary"), F.lit(""))
    heading = F.concat(F.lit("# "), F.when((key != "") & (summary != ""), F.concat(key, F.lit(" — "), summary)).otherwise(F.concat(key, summary)))
    text = F.trim(F.coalesce(f("description"), F.lit("")))
    said = F.array_sort(F.transform(F.coalesce(f("comment.comments"), F.array().cast("array<struct<created: string, author: struct<displayName: string>, body: string>>")), lambda c: F.struct(
        F.coalesce(c["created"], F.lit("")).alias("at"), F.coalesce(c["author"]["displayName"], F.lit("Unknown")).alias("who"), F.coalesce(c["body"], F.lit("")).alias("body"))))
    comments = F.transform(said, lambda c: F.concat_ws("\n", F.concat(F.lit("### "), c["at"], F.lit(" — "), c["who"]), F.when(F.trim(c["body"]) != "", c["body"])))
    body = F.concat_ws("\n", heading, F.lit(""), F.lit("## Description"), F.when(text == "", "(no description)").otherwise(text), F.when(F.size(said) > 0, F.concat_ws("\n", F.lit(""), F.lit("## Comments"), F.array_join(comments, "\n"))))
    return issues.select(F.col("key").alias("source_id"), F.concat(front, F.lit("\n"), F.regexp_replace(body, r"\n{3,}", "\n\n"), F.lit("\n")).alias("markdown"))


COMMENTS = "results array<struct<id: string, discussion_id: string, parent: struct<type: string, page_id: string, block_id: string>, created_time: timestamp, created_by: struct<id: string>, rich_text: array<struct<plain_text: string>>>>"


def comment_rows(payloads: DataFrame) -> DataFrame:
    """One row a comment: ids, parent, author, time, text of its pieces joined."""
    c = payloads.select(F.explode("results").alias("c"))
    return c.select(
        F.col("c.id").alias("comment_id"), "c.discussion_id", F.col("c.parent.type").alias("parent_type"), F.coalesce("c.parent.page_id", "c.parent.block_id").alias("parent_id"),
        F.col("c.created_time").alias("created_at"), F.col("c.created_by.id").alias("created_by"), F.array_join(F.col("c.rich_text.plain_text"), "").alias("text"),
    )


ATTACHMENTS = "page_id string, results array<struct<id: string, title: string, extensions: struct<mediaType: string, fileSize: long>, metadata: struct<mediaType: string>, _links: struct<download: string>>>"


def attachment_rows(payloads: DataFrame, base_url: str) -> DataFrame:
    """(source_id, filename, url, mime_type, size) by owning page; attachments without a download link cannot be fetched and are left out."""
    a = payloads.select("page_id", F.explode("results").alias("a")).filter("a._links.download IS NOT NULL AND a._links.download <> ''")
    link = F.col("a._links.download")
    url = F.when(link.rlike("^https?://"), link).otherwise(F.concat(F.lit(base_url.rstrip("/") + "/"), F.regexp_replace(link, "^/+", "")))
    return a.select(F.col("page_id").alias("source_id"), F.coalesce("a.title", "a.id", F.lit("attachment")).alias("filename"), url.alias("url"), F.coalesce("a.extensions.mediaType", "a.metadata.mediaType").alias("mime_type"), F.col("a.extensions.fileSize").alias("size"))


def named_users(rows: DataFrame, names: DataFrame, user: str = "user_id") -> DataFrame:
    """``rows`` with user_name: the dimension's, else the id itself, as for a user who cannot be looked up."""
    known = names.select(F.col("id").alias(user), F.col("name").alias("user_name")).dropDuplicates([user])
    return rows.join(known, user, "left").withColumn("user_name", F.coalesce("user_name", F.col(user)))
