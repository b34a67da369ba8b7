"""VARIANT values of any shape as JSON that every reader accepts: walked level by level, without a fixed schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.display import bound
from lattica.session import materialize

#: Kinds whose text is not Spark's own JSON of them; keys beyond the 16-bit characters, which a VARIANT has in another order.
OTHER = r"BINARY|TIMESTAMP|DATE|DOUBLE|FLOAT|VARIANT|UUID|INTERVAL|TIME|[\x{10000}-\x{10FFFF}]"
#: Levels with such kinds in them that are told inside a row.
LEVELS = 5


def _quoted(text: Column) -> Column:
    """A text, a key too, as JSON text."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substr(whole, F.lit(6), F.char_length(whole) - 6)


def scalar(value: Column) -> Column:
    """JSON text of a VARIANT scalar: numbers and truth values as they are, dates and times in ISO form, bytes in hex, other values as text."""
    kind = F.schema_of_variant(value)
    moment = F.date_format(F.try_variant_get(value, "$", "timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return (
        F.when(F.is_variant_null(value) | (kind == "VOID"), F.lit("null"))
        .when(kind.isin("TIMESTAMP", "TIMESTAMP_NTZ"), _quoted(moment))
        .when(kind == "BINARY", _quoted(F.lower(F.hex(F.try_variant_get(value, "$", "binary")))))
        .when(kind.isin("BOOLEAN", "BIGINT") | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "string"))
        .when(kind.isin("DOUBLE", "FLOAT") & ~F.lower(F.try_variant_get(value, "$", "string")).rlike("nan|inf"), F.try_variant_get(value, "$", "string"))
        .otherwise(_quoted(F.try_variant_get(value, "$", "string")))
    )


def walk(rows: DataFrame, key: str, value: str, max_depth: int = 100) -> DataFrame:
    """(key, path, kind, json): every node of each row's VARIANT; json is null for objects and arrays.

    ``path`` holds the keys from the outside in, an element of an array by its position; ``kind`` is "object", "array" or the
    scalar's type. A level is one pass over what the level above had nested in it. A null column gives no rows, repeated keys
    each their nodes under one key.
    """
    level = rows.filter(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.array().cast("array<string>").alias("path"), F.col(value).alias("value"))
    found = []
    for _ in range(max_depth):
        kind = F.schema_of_variant("value")
        shape = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise(F.lower(kind))
        level = materialize(level.withColumn("kind", shape), "variants")
        found.append(level.select("key", "path", "kind", F.when(~F.col("kind").isin("object", "array"), scalar(F.col("value"))).alias("json")))
        nested = level.filter("kind IN ('object', 'array')")
        if nested.isEmpty():
            break
        inner = nested.sparkSession.sql("SELECT n.key, n.path, n.kind, e.pos, e.key AS name, e.value FROM {n} AS n, LATERAL variant_explode(n.value) AS e", n=nested)
        name = F.when(F.col("kind") == "array", F.col("pos").cast("string")).otherwise(F.col("name"))
        level = inner.select("key", F.concat("path", F.array(name)).alias("path"), "value")
    else:
        raise ValueError(f"values nested more than {max_depth} levels deep")
    return reduce(DataFrame.unionByName, found)


def json_safe(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, json) of each row's VARIANT, keys of objects in order. A null column gives no row.

    A value is told inside its row: where nothing differs from Spark's own JSON that is taken, else its members are told one by
    one. Only values that differ more than LEVELS levels deep are taken apart as rows, level by level; ``key`` tells those apart.
    """
    told = rows.filter(F.col(value).isNotNull()).select(F.col(key), F.col(value).alias("value"), _told(F.col(value), LEVELS).alias("json"))
    deep = F.col("json").isNull()
    told = materialize(told.select(key, "json", deep.alias("deep"), F.when(deep, F.col("value")).alias("value")), "variant-told")
    done = told.filter("not deep").select(key, "json")
    return done if told.filter("deep").isEmpty() else done.unionByName(_by_levels(told.filter("deep"), key, "value"))


def _told(value: Column, levels: int) -> Column:
    """JSON text of a VARIANT; null if something in it differs from Spark's own JSON more than ``levels`` levels deep."""

    def told(b: Column) -> Column:
        plain = F.when(~b["kind"].rlike(OTHER), F.to_json(b["value"]))
        if not levels:
            return plain.when(~b["kind"].startswith("OBJECT") & ~b["kind"].startswith("ARRAY"), scalar(b["value"]))
        object_ = b["kind"].startswith("OBJECT")
        fields = F.transform(F.map_entries(F.try_variant_get(b["value"], "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("name"), F.concat(_quoted(e["key"]), F.lit(":")).alias("label"), e["value"].alias("value")))
        items = F.transform(F.try_variant_get(b["value"], "$", "array<variant>"), lambda x: F.struct(F.lit("").alias("name"), F.lit("").alias("label"), x.alias("value")))
        texts = F.transform(F.when(object_, fields).otherwise(items), lambda m: F.struct(m["name"].alias("name"), F.concat(m["label"], _told(m["value"], levels - 1)).alias("json")))
        ordered = lambda t: F.array_join(F.transform(F.when(object_, F.array_sort(t)).otherwise(t), lambda m: m["json"]), ",")
        whole = bound(texts, lambda t: F.when(~F.exists(t, lambda m: m["json"].isNull()), F.concat(F.when(object_, "{").otherwise("["), ordered(t), F.when(object_, "}").otherwise("]"))))
        return plain.when(object_ | b["kind"].startswith("ARRAY"), whole).otherwise(scalar(b["value"]))

    return bound(F.struct(value.alias("value"), F.schema_of_variant(value).alias("kind")), told)


def _by_levels(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``json_safe`` of values nested however deep, put together again from the innermost level outwards."""
    nodes = materialize(walk(rows, key, value).withColumn("depth", F.size("path")), "variant-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    done = None
    for depth in range(deepest, -1, -1):
        here = nodes.filter(F.col("depth") == depth).select("key", "path", "kind", "json")
        if done is not None:
            member = F.struct(F.when(F.col("kind") == "array", F.element_at("path", -1).cast("int")).alias("pos"), F.element_at("path", -1).alias("name"), "json")
            parents = here.select("key", "path", "kind").filter("kind IN ('object', 'array')")
            below = done.select("key", F.slice("path", 1, depth).alias("up"), "path", "json").join(parents.select("key", F.col("path").alias("up"), "kind"), ["key", "up"])
            joined = below.groupBy("key", F.col("up").alias("path")).agg(F.array_sort(F.collect_list(member)).alias("m"))
            here = here.join(joined, ["key", "path"], "left")
        else:
            here = here.withColumn("m", F.lit(None).cast("array<struct<pos:int,name:string,json:string>>"))
        label = lambda x: F.substring(F.to_json(F.struct(x["name"].alias("v"))), 6, 1 << 30)
        named = F.array_join(F.transform("m", lambda x: F.concat(F.regexp_replace(label(x), r"\}$", ""), F.lit(":"), x["json"])), ",")
        listed = F.array_join(F.transform("m", lambda x: x["json"]), ",")
        text = F.when(F.col("kind") == "object", F.concat(F.lit("{"), F.coalesce(named, F.lit("")), F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), F.coalesce(listed, F.lit("")), F.lit("]"))).otherwise(F.col("json"))
        done = materialize(here.select("key", "path", text.alias("json")), "variant-json")
    return done.select(F.col("key").alias(key), "json")
