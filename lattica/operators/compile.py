"""Compile-side operators: features as one struct, names and notes from members, table-aware splitting, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.components import connected_components


def theme_subtopic(products: Column, customers: Column, tags: Column, entities: Column) -> tuple[Column, Column]:
    """The broadest theme there is evidence for and what refines it, 48 characters each."""
    first, second = lambda a: F.get(a, F.lit(0)), lambda a, other: F.coalesce(F.get(a, F.lit(1)), other)
    tag_theme = F.initcap(first(tags))
    theme = F.when(F.size(products) > 0, "Products").when(F.size(customers) > 0, "Customer Communication").when(F.size(tags) > 0, tag_theme).when(F.size(entities) > 0, first(entities)).otherwise("General")
    sub = (
        F.when(F.size(products) > 0, F.initcap(first(products))).when(F.size(customers) > 0, first(customers)).when(F.size(tags) > 0, F.coalesce(F.initcap(F.get(tags, F.lit(1))), tag_theme))
        .when(F.size(entities) > 0, second(entities, first(entities))).otherwise("General")
    )
    return F.substring(theme, 1, 48), F.substring(sub, 1, 48)


def tag_type(products: Column, customers: Column) -> Column:
    return F.when(F.size(products) > 0, "product").when(F.size(customers) > 0, "person").otherwise("concept")


def known_products(text: Column, products: list[str]) -> Column:
    """The products that a text names, case aside, in the list's order."""
    return F.filter(F.array(*map(F.lit, products)), lambda p: F.contains(F.lower(text), F.lower(p)))


def embedding_text(summary: Column, products: Column, customers: Column, topics: Column, path: Column, links: Column) -> Column:
    """What is embedded of a chunk: products count four times, customers three, links two."""
    again = lambda a, n: F.array_join(F.flatten(F.array_repeat(a, n)), " ")
    return F.concat_ws(
        "\n", summary, F.concat(F.lit("Product: "), again(products, 4)), F.concat(F.lit("Customer: "), again(customers, 3)), F.concat(F.lit("Topic: "), F.array_join(topics, " ")),
        F.when(F.size(path) > 0, F.concat(F.lit("Path: "), F.array_join(path, " > "))), F.when(F.size(links) > 0, F.concat(F.lit("Refs: "), again(links, 2))),
    )


def table_segments(text: Column, target: int) -> Column:
    """array<array<string>> of a text's lines in segments of ``target`` words or more that never end inside a pipe table."""
    words = lambda x: F.size(F.filter(F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " "), lambda w: w != ""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), words(x).alias("n"), F.trim(x).rlike(r"^\|.*\|$").alias("table")))
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("now"), F.lit(0).alias("n"), F.lit(False).alias("table"))

    def step(a, x):
        full = x["table"] & ~a["table"] & (a["n"] >= target) & (F.size(a["now"]) > 0)  # a table begins: what is long enough ends before it
        done = F.when(full, F.array_append(a["done"], a["now"])).otherwise(a["done"])
        now = F.array_append(F.when(full, none).otherwise(a["now"]), x["line"])
        n = F.when(full, 0).otherwise(a["n"]) + x["n"]
        ends = ~x["table"] & (n >= target)
        return F.struct(F.when(ends, F.array_append(done, now)).otherwise(done).alias("done"), F.when(ends, none).otherwise(now).alias("now"), F.when(ends, 0).otherwise(n).alias("n"), x["table"].alias("table"))

    return F.aggregate(lines, start, step, lambda a: F.when(F.size(a["now"]) > 0, F.array_append(a["done"], a["now"])).otherwise(a["done"]))


def drop_lines(text: Column, pattern: str) -> Column:
    """A text without the lines that match: navigation markers and the like."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(pattern)), "\n")


def rewrite_mentions(messages: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """Chat markup as plain text: <@U1> to @name, <#C1|name> to #name, <url|label> to a link, entities unescaped.

    ``names`` (user, name) meets the mentions by join; a message's mentions are put back by their place.
    """
    keyed = messages.withColumn("_row", F.xxhash64(*messages.columns))
    found = keyed.select("_row", F.posexplode(F.regexp_extract_all(text, F.lit(r"<@([A-Z0-9]+)>"), F.lit(1))).alias("at", "user")).distinct()
    named = found.join(names, "user", "left").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("name", "user").alias("name")))).alias("_names"))
    joined = keyed.join(named, "_row", "left")
    plain = F.array_join(F.zip_with(F.split(text, r"<@[A-Z0-9]+>"), F.coalesce(F.transform("_names", lambda x: F.concat(F.lit("@"), x["name"])), F.array().cast("array<string>")), lambda t, n: F.concat(F.coalesce(t, F.lit("")), F.coalesce(n, F.lit("")))), "")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"<#[A-Z0-9]+\|([^>]+)>", "#$1"), r"<(https?://[^|>]+)\|([^>]+)>", "[$2]($1)"), r"<(https?://[^>]+)>", "$1")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return joined.withColumn(text, plain).select(*messages.columns)


def extractive_notes(members: DataFrame, group: str, cap: int) -> DataFrame:
    """(group, note): the members' distinct summaries in their order, up to ``cap`` characters. ``members`` has pos, summary."""
    first = members.groupBy(group, "summary").agg(F.min("pos").alias("pos"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "summary"))), lambda x: x["summary"])
    return first.groupBy(group).agg(F.substring(F.array_join(listed, " "), 1, cap).alias("note"))


def group_titles(members: DataFrame, group: str, value: str, order: str, words: int = 4) -> DataFrame:
    """(group, title): the commonest value in title case, its first words; the one seen first at a tie."""
    from lattica.operators.serve import mode_first

    return mode_first(members, group, value, order).select(group, F.initcap(F.array_join(F.slice(F.split(value, r"\s+"), 1, words), " ")).alias("title"))


def unique_names(names: DataFrame, parent: str = "parent_id") -> DataFrame:
    """(node_id, name): of siblings with one name the largest keeps it, the others get a number."""
    rank = F.row_number().over(Window.partitionBy(parent, F.lower("name")).orderBy(F.desc("size"), "node_id"))
    return names.select("node_id", F.when(rank == 1, F.col("name")).otherwise(F.concat("name", F.lit(" "), rank.cast("string"))).alias("name"))


def apply_verdicts(sizes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(node_id, root_id, parent_id): merges joined into their largest region, nests put under their parent's region.

    ``sizes`` (node_id long, size), ``verdicts`` (a, b, decision, parent). keep_separate changes nothing.
    """
    parts = connected_components(verdicts.filter("decision = 'merge'"), "a", "b")
    marked = sizes.join(parts.withColumnRenamed("node", "node_id"), "node_id", "left").withColumn("c", F.coalesce("component", "node_id"))
    best = marked.groupBy("c").agg(F.max_by("node_id", F.struct("size", (-F.col("node_id")).alias("t"))).alias("root_id"))
    roots = marked.join(best, "c").select("node_id", "root_id")
    nests = verdicts.filter("decision = 'nest'").select(F.when(F.col("parent") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("child"), "parent")
    up = nests.join(roots.select(F.col("node_id").alias("child"), F.col("root_id").alias("cr")), "child").join(roots.select(F.col("node_id").alias("parent"), F.col("root_id").alias("pr")), "parent")
    up = up.filter("cr <> pr").groupBy(F.col("cr").alias("root_id")).agg(F.min("pr").alias("parent_id"))
    return roots.join(up, "root_id", "left").select("node_id", "root_id", "parent_id")


def pending_line(changes: DataFrame, group: str, least: int = 2) -> DataFrame:
    """(group, total, top_editor, top_n): changes of a group, and its busiest editor if they made ``least`` or more."""
    who = F.coalesce(F.nullif("last_modified_by", F.lit("")), F.nullif("author", F.lit("")))
    counted = changes.groupBy(group, who.alias("who")).agg(F.count("*").alias("n"))
    top = counted.groupBy(group).agg(F.sum("n").alias("total"), F.max_by(F.struct("who", "n"), F.when(F.col("who").isNotNull(), F.struct("n", "who"))).alias("t"))
    clear = F.col("t.n") >= least
    return top.select(group, "total", F.when(clear, F.col("t.who")).alias("top_editor"), F.when(clear, F.col("t.n")).alias("top_n"))


def needs_refetch(listed: Column, stored: Column, raw_path: Column, status: Column, unreliable: Column) -> Column:
    """False if a stored active copy with a body covers the listed time and that time can be relied on."""
    return ~(F.coalesce(listed <= stored, F.lit(False)) & raw_path.isNotNull() & (status == "active") & ~unreliable)
