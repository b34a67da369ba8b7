"""Column factories: hashes, text, dates and vectors. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def short_hash(text: Column, n: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def node_id(path: Column, chunk_ids: Column) -> Column:
    """Stable id of a cluster node from its path and its sorted members."""
    return F.concat(F.lit("node_"), short_hash(F.concat_ws(":", path, F.array_join(F.array_sort(chunk_ids), "|")), 16))


def clean_markdown(text: Column) -> Column:
    """Images out, links to their labels, white space collapsed."""
    text = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]+\)", " ")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_sentences(text: Column, n: int = 3, cap: int = 700) -> Column:
    joined = F.trim(F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, n), " "))
    return F.when(joined != "", F.substring(joined, 1, cap)).otherwise(F.substring(text, 1, 300))


def truncate_words(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a space and marked with an ellipsis."""
    head = F.regexp_replace(F.substring(text, 1, limit), r"[ .,;:]+$", "")
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(head, r"(?<=.) [^ ]*$", ""), F.lit("…")))


def urls(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s)\]<>]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]>]+$", "")))


def mentions(text: Column) -> Column:
    """@handles, then ABC-123 keys, each once in the order of its first place."""
    handles = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)(?<!\w)@([A-Za-z0-9_][A-Za-z0-9_.-]{1,})"), F.lit(1)), lambda h: F.concat(F.lit("@"), h))
    return F.array_distinct(F.concat(handles, F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9]{1,9}-\d+)\b"), F.lit(1))))


def wikilinks(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)[^\]]*\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def norm_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\W+", " "))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, zero vectors and different lengths."""
    product = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (product > 0)
    return F.when(usable, dot(a, b) / F.when(product > 0, product)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / F.when(union > 0, union)).otherwise(0.0)


def recency(modified: Column, as_of: Column, half_life: float = 90.0) -> Column:
    """exp(-ln 2 * days / half life), at most 1; unknown dates count one half."""
    days = F.greatest(F.datediff(as_of, modified), F.lit(0))
    return F.when(modified.isNull(), 0.5).otherwise(F.exp(-F.log(F.lit(2.0)) * days / half_life))


def due_bucket(due: Column, today: Column) -> Column:
    days = F.datediff(due, today)
    return (
        F.when(due.isNull(), "no_date").when(days < -90, "probably_abandoned").when(days < 0, "overdue")
        .when(days <= 7, "due_soon").otherwise("upcoming")
    )


def deadline_boost(due: Column, today: Column) -> Column:
    days = F.datediff(due, today)
    return F.when(days < -90, 0).when(days < 0, 25).when(days <= 7, 15).otherwise(0)


def attention_level(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 55, "high").when(score >= 30, "medium").when(score > 0, "low").otherwise("none")


def iso_date(text: Column) -> Column:
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)", 1), F.lit("")))


#: Months, weekdays and number words as they are written.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
NUMBERS = "one two three four five six seven eight nine ten".split()


def _index(word: Column, names: list[str]) -> Column:
    """1-based place of the name that ``word`` is or abbreviates, else null."""
    at = F.array_position(F.array(*(F.lit(n[:3]) for n in names)), F.substring(F.lower(word), 1, 3))
    return F.when(at > 0, at.cast("int"))


def _with(parts: dict[str, Column], then) -> Column:
    """``then(struct of parts)``: the parts are evaluated once, however often the expression uses them."""
    return F.transform(F.array(F.struct(*(c.alias(name) for name, c in parts.items()))), then)[0]


def month_end(year: Column, month: Column) -> Column:
    ok = year.between(1, 9999) & month.between(1, 12)
    return F.last_day(F.make_date(F.when(ok, year).cast("int"), F.when(ok, month).cast("int"), F.lit(1)))


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """The date with its day at most the month's last; null for impossible parts."""
    ok = month.between(1, 12) & year.between(1, 9999) & (day >= 1)
    year, month = F.when(ok, year), F.when(ok, month)
    return F.least(F.date_add(F.make_date(year, month, F.lit(1)), F.when(ok, F.least(day, F.lit(31)) - 1)), month_end(year, month))


def end_of(anchor: Column, unit: Column) -> Column:
    """End of the anchor's day, week (Sunday), month, quarter or year."""
    return (
        F.when(unit == "day", anchor).when(unit == "week", F.date_add(anchor, 6 - F.weekday(anchor))).when(unit == "month", F.last_day(anchor))
        .when(unit == "quarter", F.last_day(F.add_months(F.trunc(anchor, "quarter"), 2))).when(unit == "year", F.make_date(F.year(anchor), F.lit(12), F.lit(31)))
    )


def resolve_deadline(text: Column, anchor: Column) -> Column:
    """The first deadline in ``text`` as a date: explicit dates first, then phrases relative to ``anchor``; else null.

    One expression of branches from the most explicit to the most ambiguous. It never fails on impossible dates. The patterns
    and the order of the branches are fixed values of the format.
    """
    number = lambda s: F.nullif(s, F.lit("")).cast("int")
    months = "(" + "|".join(f"{m}|{m[:3]}" for m in MONTHS).replace("september|sep", "september|sept|sep") + ")"
    part = lambda p, g: F.regexp_extract(text, "(?i)" + p, g)
    has = lambda p: text.rlike("(?i)" + p)

    iso = r"(?<!\d)(\d{4})-(\d{2})(?:-(\d{2}))?(?!\d)"
    dated = {"y": number(part(iso, 1)), "m": number(part(iso, 2)), "d": F.coalesce(number(part(iso, 3)), F.lit(31))}
    branches = [F.when(has(iso), _with(dated, lambda p: safe_date(p["y"], p["m"], p["d"])))]

    for pattern, m, d in (
        (rf"\b{months}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:\s*,?\s*(\d{{4}}))?\b", 1, 2),
        (rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?{months}\.?(?:\s*,?\s*(\d{{4}}))?\b", 2, 1),
    ):
        named = {"m": _index(part(pattern, m), MONTHS), "d": number(part(pattern, d)), "y": number(part(pattern, 3)), "a": anchor, "ay": F.year(anchor)}
        next_year = lambda p: F.when(safe_date(p["ay"], p["m"], p["d"]) >= p["a"], p["ay"]).otherwise(p["ay"] + 1)
        year = lambda p: _with({"y": F.coalesce(p["y"], next_year(p)), "m": p["m"], "d": p["d"]}, lambda q: safe_date(q["y"], q["m"], q["d"]))
        branches.append(F.when(has(pattern), _with(named, year)))

    quarter = r"\bq([1-4])(?:\s*(?:of\s*)?(\d{4}))?\b"
    quarters = {"m": number(part(quarter, 1)) * 3, "y": number(part(quarter, 2)), "a": anchor}
    in_quarter = _with(quarters, lambda p: month_end(F.coalesce(p["y"], F.year(p["a"]) + (p["a"] > month_end(F.year(p["a"]), p["m"])).cast("int")), p["m"]))
    month_only = rf"\b(?:by|until|before|end of|mid|in)\s+{months}\b(?!\s+\d)"
    in_month = _with({"m": _index(part(month_only, 1), MONTHS), "a": anchor}, lambda p: month_end(F.year(p["a"]) + (p["m"] < F.month(p["a"])).cast("int"), p["m"]))
    relative = r"\b(?:in|within)\s+(a|an|one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s+(day|week|month)s?\b"
    word = F.lower(part(relative, 1))
    spelled = F.array_position(F.array(*map(F.lit, NUMBERS)), word)
    count = F.when(word.isin("a", "an"), 1).when(spelled > 0, spelled.cast("int")).otherwise(F.when(word.rlike(r"^\d{1,9}$"), word).cast("int"))
    counted = {"n": F.when(count <= 3650, count), "u": F.lower(part(relative, 2)), "a": anchor}
    moved = _with(counted, lambda p: F.when(p["u"] == "day", F.date_add(p["a"], p["n"])).when(p["u"] == "week", F.date_add(p["a"], p["n"] * 7)).when(p["u"] == "month", F.add_months(p["a"], p["n"])))
    ends = r"\b(?:by\s+)?(?:end\s+of\s+(?:the\s+)?(day|week|month|quarter|year)|(eod|eow|eom|eoq|eoy))\b"
    short = F.array_position(F.array(*map(F.lit, ["eod", "eow", "eom", "eoq", "eoy"])), F.lower(part(ends, 2)))
    unit = F.when(short > 0, F.get(F.array(*map(F.lit, ["day", "week", "month", "quarter", "year"])), (short - 1).cast("int"))).otherwise(F.lower(part(ends, 1)))
    nexts = r"\bnext\s+(week|month|quarter|year)\b"
    following = _with({"u": F.lower(part(nexts, 1)), "a": anchor}, lambda p: (
        F.when(p["u"] == "week", end_of(F.date_add(p["a"], 7), F.lit("week"))).when(p["u"] == "month", F.last_day(F.add_months(p["a"], 1)))
        .when(p["u"] == "quarter", end_of(F.add_months(end_of(p["a"], F.lit("quarter")), 1), F.lit("quarter"))).when(p["u"] == "year", F.make_date(F.year(p["a"]) + 1, F.lit(12), F.lit(31)))
    ))
    days = r"\b(next\s+)?(" + "|".join(f"{d}|{d[:3]}" for d in WEEKDAYS) + r")\b"
    ahead = {"n": F.pmod(_index(part(days, 2), WEEKDAYS) - 1 - F.weekday(anchor), F.lit(7)), "next": part(days, 1) != "", "a": anchor}
    weekday = _with(ahead, lambda p: F.date_add(p["a"], F.when(p["next"], p["n"] + 7).when(p["n"] == 0, 7).otherwise(p["n"])))
    final = (
        F.when(has(quarter), in_quarter).when(has(month_only), in_month).when(has(r"\btomorrow\b"), F.date_add(anchor, 1)).when(has(r"\b(today|by\s+tonight|tonight)\b"), anchor)
        .when(has(relative), moved).when(has(ends), _with({"u": unit, "a": anchor}, lambda p: end_of(p["a"], p["u"]))).when(has(nexts), following).when(has(days), weekday)
    )
    return F.coalesce(*branches, final)
