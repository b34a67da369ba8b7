"""Columns that the serving side shows or decides by: labels, titles, excerpts, nudges, lenient JSON, schedules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds that a title may begin with, weekdays and months as they are shown.
TITLE_KINDS = r"(?i)^\s*(todo|risk|decision|open question|owner|recent change):\s*"
WEEKDAYS = "Sun Mon Tue Wed Thu Fri Sat".split()
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def clean_title(title: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(title, TITLE_KINDS, ""), r"^[>\s\-*#]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[*_`]+", ""), r"\s+", " "))


def due_label(due: Column, today: Column, bucket: Column, phrase: Column) -> Column:
    """A date's short label: overdue days, today, tomorrow, the weekday within a week, else month and day; no date: its phrase."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(due))
    day = F.concat_ws(" ", month, F.day(due).cast("string"))
    shown = F.when(F.year(due) == F.year(today), day).otherwise(F.concat_ws(", ", day, F.year(due).cast("string")))
    days = F.datediff(due, today)
    weekday = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(due))
    dated = (
        F.when(bucket == "probably_abandoned", F.concat(F.lit("Was due "), shown)).when(days < 0, F.concat(F.lit("Overdue "), (-days).cast("string"), F.lit("d")))
        .when(days == 0, "Due today").when(days == 1, "Due tomorrow").when(days < 7, F.concat(F.lit("Due "), weekday)).otherwise(F.concat(F.lit("Due "), shown))
    )
    return F.when(due.isNotNull(), dated).when(phrase.isNotNull() & (phrase != ""), F.concat(F.lit("Due "), phrase))


def is_stale(last: Column, now: Column, days: int = 7) -> Column:
    """At least ``days`` days since the last harvest; an unknown time never warns."""
    return F.coalesce(now.cast("timestamp").cast("double") - last.cast("timestamp").cast("double") >= days * 86_400, F.lit(False))


def offers_harvest(last: Column, now: Column, running: Column, pending: Column, snoozed_until: Column, days: int = 2) -> Column:
    """Harvested before, ``days`` days ago or more, none running, nothing waiting to be compiled, and no snooze that lasts."""
    awake = snoozed_until.isNull() | (now >= snoozed_until)
    return is_stale(last, now, days) & ~F.coalesce(running, F.lit(False)) & (F.coalesce(pending, F.lit(0)) == 0) & awake


def as_of(raw: Column) -> Column:
    """A bare date is the end of its UTC day, anything else an ISO time (UTC without a zone); what is neither gives null."""
    s = F.trim(raw)
    day = F.try_to_timestamp(s, F.lit("yyyy-MM-dd")) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    return F.when(F.char_length(s) == 10, day).otherwise(F.try_to_timestamp(F.when(F.char_length(s) > 10, s)))


def excerpt(title: Column, heading: Column, body: Column, most: int) -> Column:
    """``[title > heading]`` over the body, ``most`` characters in all; no body gives an empty excerpt."""
    where = F.array_join(F.filter(F.concat(F.array(title), heading), lambda x: x.isNotNull() & (x != "")), " > ")
    text = F.trim(F.substr(F.coalesce(body, F.lit("")), F.lit(1), F.greatest(F.lit(most) - F.char_length(where) - 4, F.lit(0))))
    return F.when(text == "", "").when(where == "", text).otherwise(F.concat(F.lit("["), where, F.lit("]\n"), text))


def naming_fingerprint(kind: Column, terms: Column, model: Column, extra: Column | None = None) -> Column:
    """A namer's cache key: model, kind, the sorted terms, and what else must not share an entry."""
    lower = F.array_join(F.array_sort(F.transform(terms, F.lower)), "|")
    key = F.concat(model, F.lit("|"), kind, F.lit("|"), lower)
    if extra is not None:
        key = F.concat(key, F.when(F.size(extra) > 0, F.concat(F.lit("|extra:"), F.array_join(F.array_sort(F.transform(extra, F.lower)), "|"))).otherwise(""))
    return F.concat(F.lit("fp_"), kind, F.lit("_"), F.substring(F.sha2(key, 256), 1, 16))


def products_suffix(products: Column) -> Column:
    """What a declared product list adds to a cache key; nothing for an empty one."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(products, lambda p: F.lower(F.trim(p))), lambda p: p.isNotNull() & (p != ""))))
    return F.when(F.size(clean) > 0, F.concat(F.lit(":"), F.substring(F.sha2(F.array_join(clean, "|"), 256), 1, 8))).otherwise("")


def region_summary(name: Column, tags: Column) -> Column:
    few = F.array_join(F.slice(tags, 1, 4), ", ")
    return F.when(F.size(tags) > 0, F.concat(name, F.lit(" groups chunks about "), few, F.lit("."))).otherwise(F.concat(name, F.lit(" groups related knowledge chunks.")))


def json_object(text: Column) -> Column:
    """The JSON object in a text, from its first brace to its last, as compact JSON; null if that is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.to_json(F.try_parse_json(F.when(found != "", found)))


def metadata(text: Column) -> Column:
    """A metadata column as a map of strings; what does not parse is an empty map."""
    none = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(F.when(F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{"), text), "map<string,string>"), none)


def without_keys(values: Column, keys: list[str]) -> Column:
    """A map without the named keys."""
    return F.map_filter(values, lambda k, v: ~k.isin(keys))


#: (low, high) of the fields of a cron line: minute, hour, day, month, weekday from Monday = 0.
CRON_FIELDS = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 6)}


def cron_fields(cron: Column) -> Column:
    """A cron line of five fields as a struct of arrays of (begin, end, step): lists, ranges, steps and the star; null if it does not parse."""
    f = F.split(F.trim(cron), r"\s+")

    def one(part: Column, low: int) -> Column:
        span, step = F.get(F.split(part, "/"), F.lit(0)), F.get(F.split(part, "/"), F.lit(1))
        number = lambda n: F.get(F.split(span, "-"), F.lit(n)).try_cast("int").cast("long")
        begin = F.when(span == "*", F.lit(low).cast("long")).otherwise(number(0))
        open_ = (span == "*") | (part.contains("/") & ~span.contains("-"))
        end = F.when(open_, F.lit(1 << 20).cast("long")).when(span.contains("-"), number(1)).otherwise(begin)
        return F.struct(begin.alias("begin"), end.alias("end"), F.abs(F.when(part.contains("/"), step.try_cast("int").cast("long")).otherwise(1)).alias("step"))

    parts = {name: F.transform(F.split(F.get(f, F.lit(i)), ","), lambda p, low=low: one(p, low)) for i, (name, (low, _)) in enumerate(CRON_FIELDS.items())}
    known = lambda p: p["begin"].isNotNull() & p["end"].isNotNull() & F.coalesce(p["step"] > 0, F.lit(False))
    return bound(F.struct(*(p.alias(name) for name, p in parts.items())), lambda c: F.when((F.size(f) == 5) & reduce(and_, (F.forall(c[name], known) for name in parts)), c))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cron_takes(parts: Column, value: Column) -> Column:
    """Whether a field of ``cron_fields`` takes ``value``."""
    return F.exists(parts, lambda p: (value >= p["begin"]) & (value <= p["end"]) & ((value - p["begin"]) % p["step"] == 0))


def cron_next(parts: Column, least: Column, high: int) -> Column:
    """The least value from ``least`` to ``high`` that a field of ``cron_fields`` takes, else null."""
    at = F.transform(parts, lambda p: F.struct((p["begin"] + F.ceil(F.greatest(least - p["begin"], F.lit(0).cast("long")) / p["step"]) * p["step"]).alias("v"), p["end"].alias("end")))
    return F.array_min(F.transform(F.filter(at, lambda x: (x["v"] <= x["end"]) & (x["v"] <= high)), lambda x: x["v"]))


def cron_day(fields: Column, at: Column) -> Column:
    """Whether day, month and weekday of ``cron_fields`` take a date's or time's."""
    return cron_takes(fields["day"], F.day(at)) & cron_takes(fields["month"], F.month(at)) & cron_takes(fields["weekday"], F.weekday(at))


def cron_fires(cron: Column, at: Column) -> Column:
    """Whether a cron line (``cron_fields``) fires at a minute; one that does not parse never does."""
    return F.coalesce(bound(cron_fields(cron), lambda c: cron_fires_at(c, at)), F.lit(False))


def cron_fires_at(fields: Column, at: Column) -> Column:
    """``cron_fires`` of a line already parsed."""
    return cron_takes(fields["minute"], F.minute(at)) & cron_takes(fields["hour"], F.hour(at)) & cron_day(fields, at)
