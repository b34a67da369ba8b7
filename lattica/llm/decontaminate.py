"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

The index holds one posting (term_id, doc_id, pos) for every training token whose term a benchmark item has, and each
document's length as a posting of a sentinel term. It is written without a shuffle: every task scans its documents once and
sorts its postings by term, so a reader of a few terms skips row groups. Terms get their corpus frequency from the index.

A window (WINDOW consecutive item words) is looked up from its rarest terms: the postings of its rarest term, less the term's
offset, are candidate places (document, item, shift); they are intersected with the offset-adjusted postings of the next
rarest. What survives is compared word by word against the text of its document. Common terms are never read for a window
that has a rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import small
from lattica.session import materialize

WINDOW = 13
#: Offset-adjusted posting lists that are intersected for each window before the text is looked at.
LISTS = 3
#: Fixed values of the contract: a word, with A-Z still in upper case, and the letters that are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTINEL = "\x00length"


def words(text: Column) -> Column:
    """The words of a text as they stand; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def folded(word: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, pos, term) for every word and, at pos = number of words, the sentinel."""
    listed = F.array_append(words(F.col(text_col)), F.lit(SENTINEL))
    exploded = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(listed).alias("pos", "word"))
    return exploded.select("doc_id", "pos", folded(F.col("word")).alias("term"))


def vocabulary(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(term, term_id) of the items' terms and the sentinel, whose id is 0."""
    terms = items.select(F.explode(words(F.col(text_col))).alias("word")).select(folded(F.col("word")).alias("term")).distinct()
    ranked = terms.select("term", F.xxhash64("term").alias("term_id"))
    return ranked.unionByName(items.sparkSession.range(1).select(F.lit(SENTINEL).alias("term"), F.lit(0).cast("long").alias("term_id")))


def build_index(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings (term_id, doc_id, pos) of ``vocab``'s terms, written by document partition and sorted by term."""
    posted = tokens(docs, id_col, text_col).join(small(vocab), "term").select("term_id", "doc_id", "pos")
    return materialize(posted.sortWithinPartitions("term_id"), "postings")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, words) of items with a word; item numbers rows, so repeated or null item_ids stay apart."""
    listed = F.transform(words(F.col(text_col)), folded)
    rows = items.select(F.col(id_col).alias("item_id"), listed.alias("words")).filter(F.size("words") > 0)
    return materialize(rows.withColumn("item", F.monotonically_increasing_id()), "items")


def windows(listed: DataFrame, frequency: DataFrame, width: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """(item, start, width, rank, offset, term_id): each window's ``lists`` rarest places, the rarest ranked 1."""
    places = listed.select("item", F.size("words").alias("n"), F.posexplode("words").alias("p", "term"))
    places = places.select("item", "n", "p", F.xxhash64("term").alias("term_id")).join(frequency, "term_id")
    span = F.sequence(F.greatest(F.lit(0), F.col("p") - width + 1), F.greatest(F.lit(0), F.least(F.col("p"), F.col("n") - width)))
    spread = places.select("item", "p", "term_id", "df", F.explode(span).alias("start"), F.least("n", F.lit(width)).alias("width"))
    rank = F.row_number().over(Window.partitionBy("item", "start").orderBy("df", "p"))
    return spread.withColumn("rank", rank).filter(F.col("rank") <= lists).select("item", "start", "width", "rank", F.col("p").alias("offset"), "term_id")


def phrase_matches(index: DataFrame, docs: DataFrame, listed: DataFrame, width: int = WINDOW, lists: int = LISTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item, at, width): every place of a document where a window of an item stands, at its first word.

    A window whose terms do not all occur in the corpus has no places and is skipped.
    """
    frequency = small(materialize(index.filter("term_id <> 0").groupBy("term_id").agg(F.count("*").alias("df")), "frequency"))
    wins = materialize(windows(listed, frequency, width, lists), "windows")
    # the lists of a window are offset-adjusted to the shift of its item's first word; places are looked up once an item
    anchors = wins.groupBy("item", "offset", "term_id").agg(F.min("rank").alias("rank"))
    hits = index.join(small(anchors), "term_id").select("doc_id", "item", (F.col("pos") - F.col("offset")).alias("shift"), "offset", "rank")
    hits = materialize(hits, "hits")
    first = hits.filter("rank = 1").select("doc_id", "item", "shift").distinct()
    # enough lists of one shift must agree for any of its windows to stand there
    least = wins.groupBy("item", "start").agg(F.max("rank").alias("need")).groupBy("item").agg(F.min("need").alias("need"))
    agreed = hits.groupBy("doc_id", "item", "shift").agg(F.count_distinct("offset").alias("lists"), F.min("rank").alias("rank")).filter("rank = 1")
    placed = materialize(agreed.join(small(least), "item").filter("lists >= need").select("doc_id", "item", "shift"), "shifts")
    there = placed.select("doc_id").distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(small(there), "doc_id", "left_semi")
    # one comparison a document and item, however many shifts: the text's words stand once
    listed_shifts = materialize(placed.groupBy("doc_id", "item").agg(F.array_sort(F.collect_list("shift")).alias("shifts")), "shift-lists")
    compared = texts.select("doc_id", F.transform(words(F.col("text")), folded).alias("doc_words")).join(small(listed_shifts), "doc_id").join(small(listed.select("item", "words")), "item")
    return _compared(compared, width)


def _compared(rows: DataFrame, width: int) -> DataFrame:
    """At each shift word by word: the run of equal words that ends at an item position; a run of ``width`` is a window's end."""
    n = F.size("words")
    need = F.least(n, F.lit(width))

    def ends(shift: Column) -> Column:
        low, high = F.greatest(F.lit(0), -shift), F.least(n, F.size("doc_words") - shift) - 1
        return F.aggregate(
            F.sequence(low, F.greatest(low, high)), F.struct(F.lit(0).alias("run"), F.array().cast("array<int>").alias("at")),
            lambda a, p: F.struct(
                F.when(equal(p, shift), a["run"] + 1).otherwise(0).alias("run"),
                F.when(equal(p, shift) & (a["run"] + 1 >= need), F.array_append(a["at"], shift + p - need + 1)).otherwise(a["at"]).alias("at"),
            ),
            lambda a: a["at"],
        )

    equal = lambda p, shift: F.coalesce(F.get("doc_words", p + shift) == F.get("words", p), F.lit(False))
    found = rows.select("doc_id", "item", need.alias("width"), F.explode(F.flatten(F.transform("shifts", ends))).alias("at"))
    return found.select("doc_id", "item", "at", "width")


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(query, doc_id, at): places of each query's rarest term with all its other terms at most ``slop`` words away.

    ``queries`` has (query, term_id), each pair once. The rarest term's postings are read first; of the others only those
    within reach of one of its places take part, through buckets of slop + 1 words, so nothing is paired beyond the slop.
    """
    frequency = index.join(small(queries.select("term_id").distinct()), "term_id", "left_semi").groupBy("term_id").agg(F.count("*").alias("df"))
    ranked = queries.join(frequency, "term_id", "left").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("df", "term_id")))
    terms = queries.groupBy("query").agg(F.count("*").alias("terms"))
    posted = index.join(small(ranked.select("query", "term_id", "rank")), "term_id")
    bucket = F.floor(F.col("pos") / (slop + 1))
    rare = posted.filter("rank = 1").select("query", "doc_id", F.col("pos").alias("at"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    others = posted.filter("rank > 1").select("query", "doc_id", "pos", "rank", bucket.alias("bucket"))
    near = rare.join(others, ["query", "doc_id", "bucket"]).filter(F.abs(F.col("pos") - F.col("at")) <= slop)
    met = near.groupBy("query", "doc_id", "at").agg(F.count_distinct("rank").alias("others"))
    single = posted.filter("rank = 1").join(small(terms.filter("terms = 1")), "query").select("query", "doc_id", F.col("pos").alias("at"))
    return met.join(small(terms), "query").filter("others = terms - 1").select("query", "doc_id", "at").unionByName(single)


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, contaminated) for every document row.

    Rows are told apart by their text, of which alone the result is made: null and repeated ids are judged like any other.
    Null and empty texts have no words; items without words match nothing; repeated items each count. contaminated:
    n_hit > 0 and at least ``percent`` percent.
    """
    vocab = materialize(vocabulary(items, item_id, item_text), "vocabulary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.octet_length(F.coalesce(F.col(text_col), F.lit("")))).alias("__text"), F.col(text_col).alias("text"))
    index = build_index(rows, vocab, "__text", "text")
    listed = item_words(items, item_id, item_text)
    found = materialize(phrase_matches(index, rows, listed, width, id_col="__text", text_col="text").distinct(), "places")
    hit = found.select("doc_id", F.explode(F.sequence("at", F.col("at") + F.col("width") - 1)).alias("pos"))
    hit = hit.groupBy("doc_id").agg(F.count_distinct("pos").alias("n_hit"))
    named = found.select("doc_id", "item").distinct().join(small(listed.select("item", "item_id")), "item")
    named = named.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("item_ids"))
    sizes = index.filter("term_id = 0").groupBy(F.col("doc_id").alias("__text")).agg(F.max("pos").cast("long").alias("n_words"))
    hits = materialize(hit.join(named, "doc_id").withColumnRenamed("doc_id", "__text"), "hits-by-text")
    out = rows.select("doc_id", "__text").join(sizes, "__text").join(small(hits), "__text", "left")
    out = out.select(F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW, percent: int = 5, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows; a row goes by its text, whatever its id."""
    keyed = docs.select(F.struct(F.xxhash64(text_col).alias("hash"), F.octet_length(text_col).alias("bytes")).alias("key"), F.col(text_col).alias("text"))
    found = contamination(keyed, items, width, percent, "key", "text", item_id, item_text).filter("contaminated").select("key").distinct()
    found = materialize(found.select(F.col("key.hash").alias("__hash"), F.col("key.bytes").alias("__bytes")), "contaminated")
    marked = docs.withColumn("__hash", F.xxhash64(text_col)).withColumn("__bytes", F.octet_length(text_col))
    return marked.join(small(found), ["__hash", "__bytes"], "left_anti").select(*docs.columns)
