"""PII surrogates, in DataFrame functions only: detected entities get keyed, type-consistent replacements.

An entity is a (kind, canonical form): the form without its separators and in lower case, so one entity written in two ways is
still one. Its surrogate is drawn from SHA-256 of (key, kind, canonical form, attempt): letters become letters, digits digits,
both of the case and at the places of the original, so the format and the script stay; addresses stay valid, card numbers keep
their Luhn status, phones their country. A person keeps title, script and gender: the family name is an entity of its own
("Mrs. Smith" and "Anna Smith" get one family name), the given name is drawn for the whole name, in the gender that most of
the person's titles have in the collection. Names are found by a title; within a text that names a person with a title, the
same full name without one is found too.

As a draw depends on the entity alone, every mention in every document gets the same surrogate (coreference) without a join on
the entity. Distinctness is checked over the whole collection: where two entities of a kind drew one surrogate, or a surrogate
is itself an entity of the collection, all but the least entity draw again. From the WIDER-th attempt on a draw may be longer
than the original (octets of any length for addresses), as short formats can run out; an entity that is left after LAST
attempts gets a mark of its kind and 64 bits of its hash. Only these exceptions and persons whose titles disagree are joined
to the mentions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import small
from lattica.session import materialize

#: Attempts from which on a surrogate may be longer, and the last one.
WIDER, LAST = 4, 12
#: Titles by gender and script, and what names are made of.
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа"]
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"]
NEUTRAL = ["Dr", "Prof"]
GIVEN = {
    ("f", "latin"): "Anna Clara Elena Greta Ida Julia Lena Maria Nora Olga Paula Rosa Sofia Tessa Vera Yara".split(),
    ("m", "latin"): "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Marco Oscar Peter Viktor".split(),
    ("n", "latin"): "Alex Andrea Chris Dana Eden Jamie Kim Luca Mika Nikita Noa Robin Sam Sasha Toni Yuri".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса Софья".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семен".split(),
    ("n", "cyrillic"): "Саша Женя Валя Слава Шура Тоня Паша Мишель Юля Лёня Рита Дима Вика Гена Коля Лёва".split(),
}
SYLLABLES = {
    "latin": "ba den fi gor hal ken lo mar nis or pel ram sto ter vin zel".split(),
    "cyrillic": "ба ден фи гор хал кен ло мар нис ор пел рам сто тер вин зел".split(),
}
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\w)|(?<![\w)+.-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-]|\.\d)",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "card": r"(?<![\w.])\d{4}(?:[ -]?\d{4}){3}(?!\w)",
    "secret": r"(?<!\w)[0-9a-fA-F]{32,}(?!\w)",
    "name": "(?<![\\p{L}\\p{N}])(?:" + "|".join(FEMALE + MALE + NEUTRAL) + r")\.? \p{Lu}\p{L}+(?:[ -]\p{Lu}\p{L}+)?",
}
PATTERN = "|".join(KINDS.values())
#: No text without one of these has an entity.
HINT = r"[0-9@]|(?:" + "|".join(FEMALE + MALE + NEUTRAL) + r")\.? \p{Lu}"
TITLE = "^((?:" + "|".join(FEMALE + MALE + NEUTRAL) + r")\.? )"
#: The country codes of two digits; those that begin with 1 or 7 have one digit, all others three.
TWO_DIGITS = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()


def kind_of(value: Column) -> Column:
    """The kind of one match: the first whose own pattern takes all of it."""
    out = F.lit("name")
    inner = {"phone": r"\+[\d ().-]+|\(?\d{3}\)?[ .-]?\d{3}[.-]\d{4}", "ip": r"(?:\d{1,3}\.){3}\d{1,3}", "card": r"\d{4}(?:[ -]?\d{4}){3}", "secret": r"[0-9a-fA-F]{32,}", "email": r".*@.*"}
    for kind in reversed(["email", "phone", "ip", "card", "secret"]):
        out = F.when(value.rlike(f"^(?:{inner[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, value: Column) -> Column:
    """Lower case; phones (after their plus) and cards as digits, names without their title."""
    return F.when(kind.isin("phone", "card"), F.regexp_replace(value, r"[^\d+]", "")).when(kind == "name", F.lower(F.regexp_replace(value, TITLE, ""))).otherwise(F.lower(value))


def family_of(canon: Column) -> Column:
    """The family name in a person's canonical form."""
    return F.regexp_extract(canon, r"(\p{L}+)$", 1)


def gender_of(value: Column) -> Column:
    """f or m by a mention's title, n without a gendered one."""
    bare = F.regexp_replace(F.regexp_extract(value, TITLE, 1), r"[. ]", "")
    return F.when(bare.isin(FEMALE), "f").when(bare.isin(MALE), "m").otherwise("n")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, and stands once in the plan, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stream(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """128 hex digits drawn for an entity."""
    part = lambda n: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"), F.lit(n)), 256)
    return F.concat(part("0"), part("1"))


def _draw(drawn: Column, at: Column, sides: int) -> Column:
    """The at-th draw of 0 to sides - 1: four hex digits of the stream, which is read round and round."""
    return (F.conv(F.substr(drawn, F.pmod(at * 4, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int") + at) % sides


def _mapped(drawn: Column, value: Column, kept: Column) -> Column:
    """Each ASCII letter or digit from the kept-th on drawn anew from its own class, the rest as it stands.

    Places count letters and digits only, so an entity's two formats draw alike.
    """
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def one(c: Column, rank: Column) -> Column:
        pick = lambda of: F.substr(F.lit(of), _draw(drawn, rank, len(of)) + 1, F.lit(1))
        mapped = F.when(c.rlike("[a-z]"), pick(lower)).when(c.rlike("[A-Z]"), pick(upper)).when(c.rlike("[0-9]"), pick(digits)).otherwise(c)
        return F.when(rank < kept, c).otherwise(mapped)

    rank = lambda i: F.char_length(F.regexp_replace(F.substr(value, F.lit(1), i), "[^A-Za-z0-9]", ""))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: _let(rank(i), lambda r: one(c, r))), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of 16 digits."""

    def add(total: Column, i: Column) -> Column:
        # twice the digit at even places, less 9 from 10 on
        return total + _let(F.substr(digits, i + 1, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0), add) % 10


def _card(drawn: Column, value: Column) -> Column:
    """A drawn number of the same network digit and separators; its last digit gives the original's Luhn sum."""
    last = lambda digits: F.substr(digits, F.lit(16), F.lit(1)).cast("int")
    wanted = _let(F.regexp_replace(value, r"\D", ""), _luhn)
    check = lambda body: _let(F.regexp_replace(body, r"\D", ""), lambda digits: F.pmod(last(digits) + wanted - _luhn(digits), F.lit(10)))
    return _let(_mapped(drawn, value, F.lit(1)), lambda body: F.concat(F.substr(body, F.lit(1), F.char_length(body) - 1), check(body).cast("string")))


def _ip(drawn: Column, value: Column, attempt: Column) -> Column:
    """Four drawn octets with as many digits each as the original's, of any length from the WIDER-th attempt on."""
    def octet(o: Column, i: Column) -> Column:
        n = F.char_length(o)
        small_ = F.when(n == 1, 1 + _draw(drawn, i, 9)).when(n == 2, 10 + _draw(drawn, i, 90)).otherwise(100 + _draw(drawn, i, 156))
        return F.when(attempt >= WIDER, 1 + _draw(drawn, i, 255)).otherwise(small_).cast("string")

    return F.array_join(F.transform(F.split(value, r"\."), octet), ".")


def _longer(drawn: Column, attempt: Column, of: str) -> Column:
    """One drawn character of ``of`` for each attempt from the WIDER-th on."""
    pick = lambda i: F.substr(F.lit(of), _draw(drawn, i + 20, len(of)) + 1, F.lit(1))
    return F.when(attempt >= WIDER, F.array_join(F.transform(F.sequence(F.lit(WIDER), F.greatest(attempt, F.lit(WIDER))), pick), "")).otherwise("")


def _secret(drawn: Column, value: Column) -> Column:
    """Drawn hex digits, all in lower or upper case as the original is; longer ones repeat the stream."""
    n = F.char_length(value)
    hex_ = F.substr(F.repeat(drawn, F.ceil(n / 128).cast("int")), F.lit(1), n)
    return F.when(F.upper(value) == value, F.upper(hex_)).otherwise(hex_)


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _family(drawn: Column, script: Column, attempt: Column) -> Column:
    """A family name of drawn syllables."""
    syllables = F.when(script == "latin", F.array(*map(F.lit, SYLLABLES["latin"]))).otherwise(F.array(*map(F.lit, SYLLABLES["cyrillic"])))
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), 5 + attempt), lambda i: F.get(syllables, _draw(drawn, i, 16))), ""))


def _given(drawn: Column, script: Column, gender: Column, attempt: Column) -> Column:
    """A given name of the gender; from the second attempt on one is not enough, and a drawn second part is joined to it."""
    pick = lambda k: F.get(F.array(*map(F.lit, GIVEN[k])), _draw(drawn, F.lit(0), 16))
    first = reduce(lambda out, k: F.when((gender == k[0]) & (script == k[1]), pick(k)).otherwise(out), GIVEN, F.lit(""))
    return F.concat(first, F.when(attempt > 0, F.lower(_family(drawn, script, F.least(attempt, F.lit(WIDER)) - 4))).otherwise(""))


def _mark(kind: Column, canon: Column, key: str) -> Column:
    """What an entity gets that no attempt set apart."""
    return F.concat(F.lit("["), kind, F.lit("-"), F.left(stream(kind, canon, F.lit(LAST), key), F.lit(16)), F.lit("]"))


def person(value: Column, given: Column, family: Column, gender: Column, key: str) -> Column:
    """The surrogate of a mention of a person: ``given`` and ``family`` are the attempts of the whole and the family name."""
    canon = canonical(F.lit("name"), value)
    script, last = _script(value), family_of(canon)
    surname = F.when(family >= LAST, _mark(F.lit("family"), last, key)).otherwise(_family(stream(F.lit("family"), last, family, key), script, family))
    called = F.when(given >= LAST, _mark(F.lit("name"), canon, key)).otherwise(_given(stream(F.lit("name"), canon, given, key), script, gender, given))
    between = F.regexp_extract(value, r"\p{L}+([ -])\p{L}+$", 1)
    full = F.char_length(canon) > F.char_length(last)
    return F.concat(F.regexp_extract(value, TITLE, 1), F.when(full, F.concat(called, between)).otherwise(""), surname)


def _country(value: Column) -> Column:
    """Digits of a phone's country code, by the digits alone, so that every spelling has the same."""
    digits = F.regexp_extract(F.regexp_replace(value, r"[^\d+]", ""), r"^\+(\d+)", 1)
    return F.when(digits == "", 0).when(F.left(digits, F.lit(1)).isin("1", "7"), 1).when(F.left(digits, F.lit(2)).isin(TWO_DIGITS), 2).otherwise(3)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity other than a person."""
    canon = canonical(kind, value)
    drawn = stream(kind, canon, attempt, key)
    host = F.regexp_extract(value, r"^(.*)\.[A-Za-z]+$", 1)
    digits, letters = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    return F.when(attempt >= LAST, _mark(kind, canon, key)).otherwise(
        F.when(kind == "email", F.concat(_longer(drawn, attempt, letters), _mapped(drawn, host, F.lit(0)), F.regexp_extract(value, r"(\.[A-Za-z]+)$", 1)))
        .when(kind == "phone", F.concat(_mapped(drawn, value, _country(value)), _longer(drawn, attempt, digits))).when(kind == "ip", _ip(drawn, value, attempt))
        .when(kind == "card", _card(drawn, value)).otherwise(_secret(drawn, value))
    )


def known_names(text: Column) -> Column:
    """The full names, without their titles, of the persons that a text names with one."""
    titled = F.transform(F.regexp_extract_all(text, F.lit(KINDS["name"]), F.lit(0)), lambda m: F.regexp_replace(m, TITLE, ""))
    return F.array_sort(F.array_distinct(F.filter(titled, lambda m: m.rlike(r"\p{L}[ -]\p{L}"))))


def pattern_of(text: Column) -> Column:
    """PATTERN, and the text's own full names without a title; names are letters, a space or a hyphen."""
    return F.transform(F.array(known_names(text)), lambda names: F.when(F.size(names) > 0, F.concat(
        F.lit(PATTERN + "|(?<![\\p{L}\\p{N}])(?:"), F.array_join(names, "|"), F.lit(")(?![\\p{L}\\p{N}])"))).otherwise(PATTERN))[0]


def mentions(docs: DataFrame) -> DataFrame:
    """(uid, at, value, kind, canon) of every match in the texts of (uid, text, pattern)."""
    found = docs.select("uid", F.posexplode(F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).alias("at", "value"))
    found = found.withColumn("kind", kind_of(F.col("value")))
    return found.withColumn("canon", canonical(F.col("kind"), F.col("value")))


def exceptions(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt, gender) of the entities whose first draw another entity has or is, or whose titles disagree.

    Kind ``family`` stands for family names, ``name`` for whole names. A round redraws only those of the last one, in as many
    tasks as the session shuffles to; after LAST rounds nothing can collide, as marks are hashes of the entities.
    """
    people = found.filter("kind = 'name'").select("canon", "value", gender_of(F.col("value")).alias("gender"))
    family = people.groupBy(family_of(F.col("canon")).alias("canon")).agg(F.min("value").alias("value")).withColumn("kind", F.lit("family")).withColumn("gender", F.lit("n")).withColumn("mixed", F.lit(False))
    count = lambda g: F.count_if(F.col("gender") == g)
    gender = F.when(count("f") > count("m"), "f").when(count("m") > count("f"), "m").otherwise("n")
    whole = people.filter(F.col("canon") != family_of(F.col("canon"))).groupBy("canon").agg(F.min("value").alias("value"), gender.alias("gender"), (F.count_distinct("gender") > 1).alias("mixed")).withColumn("kind", F.lit("name"))
    plain = found.filter("kind <> 'name'").groupBy("kind", "canon").agg(F.min("value").alias("value")).withColumn("gender", F.lit("n")).withColumn("mixed", F.lit(False))
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entities = materialize(plain.unionByName(family).unionByName(whole), "entities")

    def drawn_at(rows: DataFrame) -> DataFrame:
        # a whole name's given part is set apart from those of all others with one family name
        rows = rows.repartition(parts, "kind", "canon")
        name = F.concat(_given(stream(F.lit("name"), F.col("canon"), F.col("attempt"), key), _script(F.col("value")), F.col("gender"), F.col("attempt")), F.lit(" "), family_of(F.col("canon")))
        last = _family(stream(F.lit("family"), F.col("canon"), F.col("attempt"), key), _script(F.col("value")), F.col("attempt"))
        mark = _mark(F.col("kind"), F.col("canon"), key)
        mask = F.when(F.col("attempt") >= LAST, mark).when(F.col("kind") == "name", F.lower(name)).when(F.col("kind") == "family", F.lower(last)).otherwise(
            canonical(F.col("kind"), surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)))
        return materialize(rows.withColumn("mask", mask), "draws")

    columns = ["kind", "canon", "value", "gender", "mixed", "attempt", "mask"]
    drawn = drawn_at(entities.withColumn("attempt", F.lit(0))).select(columns)
    for _ in range(LAST):
        least = drawn.groupBy("kind", "mask").agg(F.min("canon").alias("least"), F.count("*").alias("n")).filter("n > 1")
        same = drawn.join(small(least), ["kind", "mask"]).filter("canon <> least").select("kind", "canon")
        real = drawn.join(entities.select("kind", F.col("canon").alias("mask")), ["kind", "mask"], "left_semi").select("kind", "canon")
        again = materialize(same.union(real).distinct(), "redraws")
        if again.isEmpty():
            break
        redrawn = drawn_at(drawn.join(small(again), ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1).drop("mask"))
        drawn = materialize(drawn.join(small(again), ["kind", "canon"], "left_anti").select(columns).unionByName(redrawn.select(columns)), "draws")
    return drawn.filter("attempt > 0 OR mixed").select("kind", "canon", "attempt", "gender")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, entities: array of (kind, surrogate) in order) for every row; ``key`` is the secret of the draws.

    Null texts stay null and have no entities; texts without one come back as they are; repeated rows are alike; other
    columns are left out. Only texts with an entity are shuffled.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    hinted = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(PATTERN), F.lit(False))
    none = F.array().cast("array<struct<kind: string, surrogate: string>>")
    plain = rows.filter(~hinted).select(id_col, "text", none.alias("entities"))
    held = rows.filter(hinted).withColumn("__uid", F.xxhash64("text", F.octet_length("text"))).withColumn("__pattern", pattern_of(F.col("text")))
    found = materialize(mentions(held.select(F.col("__uid").alias("uid"), "text", F.col("__pattern").alias("pattern"))).distinct(), "mentions")
    odd = materialize(exceptions(found, key), "exceptions")
    drawn = found.join(small(odd.select("kind", "canon", "attempt", F.col("gender").alias("own"))), ["kind", "canon"], "left")
    surnames = odd.filter("kind = 'family'").select(F.col("canon").alias("family"), F.col("attempt").alias("family_attempt"))
    drawn = drawn.withColumn("family", F.when(F.col("kind") == "name", family_of(F.col("canon")))).join(small(surnames), "family", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    gender = F.coalesce("own", gender_of(F.col("value")))
    named = F.when(F.col("kind") == "name", person(F.col("value"), zero("attempt"), zero("family_attempt"), gender, key)).otherwise(surrogate(F.col("kind"), F.col("value"), zero("attempt"), key))
    masked = drawn.select("uid", "at", "kind", named.alias("surrogate"))
    lists = masked.groupBy(F.col("uid").alias("__uid")).agg(F.array_sort(F.collect_list(F.struct("at", "kind", "surrogate"))).alias("__masks"))
    joined = held.join(lists, "__uid")
    between = F.split(F.col("text"), F.col("__pattern"), -1)
    text = F.array_join(F.zip_with(between, F.col("__masks.surrogate"), lambda t, s: F.concat(t, F.coalesce(s, F.lit("")))), "")
    shown = F.transform("__masks", lambda m: F.struct(m["kind"].alias("kind"), m["surrogate"].alias("surrogate")))
    return plain.unionByName(joined.select(id_col, text.alias("text"), shown.alias("entities"))).withColumnRenamed("text", text_col)
