"""Toxicity by class-conditional Kneser-Ney models over pairs of words.

Text is lower-cased (A-Z); its words are runs of letters and of bytes from 128 on, wide punctuation aside, read to their end.
Runs of a script without spaces give a word of GRAM characters from each character on, other runs of over LONG characters one
of PIECE, so that a part of a compound counts wherever it stands. A word's context is the word before it, or the
start if anything but spaces stands between. For each class c, interpolated Kneser-Ney with counts of c for pairs and counts
of distinct contexts (continuation counts) below:

    P_c(w | v) = own_c(v, w) / all_c(v) + freed_c(v) / all_c(v) * P_c(w)
    P_c(w)     = own_c(w) / all_c + freed_c / all_c * P(w)            counts: distinct contexts of w in class c
    P(w)       = own(w) / all + freed / all / (words + 1)             counts: classes that have w, one or two

In the first two levels a count of one is given to the level below as a whole, a larger one less DISCOUNT (in the third all
counts are less DISCOUNT); freed is what was given. So a rare expression costs both classes the same, by the counts that they
share, and only what came twice tells them apart. As the shared counts are of classes and not of occurrences, a word that one
class has often does not become likely in the other.

The log ratio of a text, log P_toxic - log P_ordinary, is a sum over keys: a known word adds log P_t(w) / P_o(w) less an
unknown word's, a known context the log ratio of its freed shares, a known pair the rest. The table of these keys grows with
the labelled text. Its HOT_KEYS most frequent keys are broadcast (24 MB at most); a filter of at most 2**FILTER_BITS bits over
the rest tells which keys of a text may be among them, and those are joined by a shuffle, so nothing is folded or left out.
A document's length-normalised figures are the mean log ratio of its words and the mean of what its keys have above MARGIN,
which a language's or a genre's share among the toxic documents does not move: one mean of words and contexts and one of pairs,
where two of a kind are more often chance. A logistic calibration weighs the three.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, small, utf8
from lattica.llm.hashing import Spans, mix, runs
from lattica.session import materialize

#: Characters of a word in a script without spaces; characters up to which any other word is one, and those of its pieces beyond.
GRAM = 3
LONG, PIECE = 14, 6
DISCOUNT = 0.75
MARGIN = 3.0
HOT_KEYS = 2_000_000
FILTER_BITS = 30
#: At most so many labelled rows fit the calibration weights.
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.3

FOLD = np.array([b | 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
LETTER = np.array([b >= 128 or 97 <= (b | 32) <= 122 for b in range(256)], dtype=np.int8)
START = np.uint64(0)
CONTEXT, PAIR = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def kinds(low: np.ndarray) -> np.ndarray:
    """Of each byte: 0 no letter, 1 a letter, 2 a letter of a script without spaces."""
    out = LETTER[low]
    lead = np.flatnonzero(low[:-2] >= 0xE0) if len(low) > 2 else np.zeros(0, np.int64)
    one, two, three = low[lead].astype(np.int64), low[lead + 1].astype(np.int64), low[lead + 2].astype(np.int64)
    code = (one & 15) << 12 | (two & 63) << 6 | three & 63
    wide = one >= 0xF0
    between = lambda *ranges: np.any([(code >= x) & (code <= y) for x, y in ranges], axis=0) & ~wide
    # punctuation: general, CJK, full-width; scripts: Thai and Lao, Burmese, Khmer, kana, ideographs (also of planes 2 and 3)
    marks = between((0x2000, 0x206F), (0x3000, 0x3004), (0x3008, 0x3020), (0x30FB, 0x30FB), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F))
    dense = between((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x30FA), (0x30FC, 0x312F), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F))
    dense |= wide & (one == 0xF0) & (two >= 0xA0)
    for places, kind in ((lead[marks], 0), (lead[dense], 2)):
        for k in range(3):
            out[places + k] = kind
    fourth = lead[dense & wide] + 3
    out[fourth[fourth < len(out)]] = 2
    return out


def words_of(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, in order of their starts; those of split runs overlap."""
    kind = kinds(low)
    starts, ends = runs(kind, offsets)
    lead = low & 0xC0 != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    size = before[ends] - before[starts]
    dense = kind[starts] == 2
    split = dense | (size > LONG)
    if not split.any():
        return starts, ends
    gram, first = np.where(dense, GRAM, PIECE)[split], starts[split]
    pieces = np.maximum(size[split] - gram + 1, 1)
    run = np.repeat(np.arange(len(first)), pieces)
    char = before[first][run] + np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    places = np.append(np.flatnonzero(lead), len(low))
    begin = np.where(char == before[first][run], first[run], places[np.minimum(char, len(places) - 1)])
    end = np.minimum(places[np.minimum(char + gram[run], len(places) - 1)], ends[split][run])
    starts, ends = np.concatenate([starts[~split], begin]), np.concatenate([ends[~split], end])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def pairs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, context, word) of every word of the texts, as 64-bit hashes; a context of START is none."""
    low = FOLD[data]
    starts, ends = words_of(low, offsets)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    words = Spans(low).of(starts, ends)
    context = np.full(len(words), START)
    if len(words) > 1:
        others = np.concatenate([[0], np.cumsum(low != 32)])
        before, after = np.minimum(ends[:-1], starts[1:]), starts[1:]
        joined = (rows[1:] == rows[:-1]) & (others[after] == others[before])
        context[1:][joined] = words[:-1][joined]
    return rows, context, words


def context_key(context: np.ndarray) -> np.ndarray:
    return mix(context + CONTEXT)


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * PAIR + word)


def count_pairs(texts: DataFrame, text_col: str, toxic_col: str) -> DataFrame:
    """(context, word, toxic, ordinary): exact counts over all rows; a record batch is summed before the shuffle."""

    def run(batch: pa.RecordBatch) -> dict:
        rows, context, word = pairs_of(*utf8(batch.column(0)))
        toxic = np.asarray(batch.column(1))[rows] == 1
        order = np.lexsort((word, context))
        v, w, hot = context[order], word[order], toxic[order]
        first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])) if len(v) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(v)))
        hot = np.add.reduceat(hot.astype(np.int64), first) if len(v) else n
        return {"context": v[first].view(np.int64), "word": w[first].view(np.int64), "toxic": hot, "ordinary": n - hot}

    parts = arrow_map(texts.select(text_col, toxic_col), run, "context long, word long, toxic long, ordinary long", text=0)
    return parts.groupBy("context", "word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def freed(n: Column) -> Column:
    """What a count gives to the level below."""
    return F.when(n > 1, F.lit(DISCOUNT)).otherwise(n.cast("double"))


CLASSES = ("toxic", "ordinary")


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, float]:
    """((key, n, value, pair) of the keys that tell the classes apart, log ratio of an unknown word after an unknown context).

    A hot word is one key among few rows in every aggregation: contexts and words are summed before their shuffle.
    """
    contexts = counts.groupBy("context").agg(*(F.sum(c).alias(f"all_{c}") for c in CLASSES), *(F.sum(freed(F.col(c))).alias(f"freed_{c}") for c in CLASSES))
    contexts = materialize(contexts, "contexts")
    words = materialize(counts.groupBy("word").agg(*(F.count_if(F.col(c) > 0).alias(c) for c in CLASSES)), "words")
    have = sum((F.col(c) > 0).cast("int") for c in CLASSES)
    sums = [F.coalesce(f(F.col(c)), F.lit(0)).cast("double").alias(f"{n}_{c}") for c in CLASSES for n, f in (("all", F.sum), ("freed", lambda x: F.sum(freed(x))))]
    total = words.agg(F.count("*").alias("words"), F.coalesce(F.sum(have), F.lit(0)).alias("have"), *sums).first()  # one row
    shared = (have - DISCOUNT + DISCOUNT * total.words / (total.words + 1)) / max(total.have, 1)

    def level(c: str) -> Column:
        if not total[f"all_{c}"]:
            return shared
        return (F.col(c) - freed(F.col(c)) + total[f"freed_{c}"] * shared) / total[f"all_{c}"]

    words = words.select("word", (F.col("toxic") + F.col("ordinary")).alias("both"), *(level(c).alias(f"p_{c}") for c in CLASSES))
    share = lambda c: total[f"freed_{c}"] / total[f"all_{c}"] if total[f"all_{c}"] and total[f"freed_{c}"] else 1.0
    unknown = float(np.log(share("toxic") / share("ordinary")))

    def lost(c: str) -> Column:
        """The share of a context that goes to the level below, never quite nothing."""
        return F.when(F.col(f"all_{c}") > 0, F.col(f"freed_{c}") / F.col(f"all_{c}")).otherwise(1.0)

    one = words.select(F.col("word").alias("key"), F.col("both").alias("n"), (F.log(F.col("p_toxic") / F.col("p_ordinary")) - unknown).alias("value"))
    two = contexts.select("context", (F.col("all_toxic") + F.col("all_ordinary")).alias("n"), F.log(lost("toxic") / lost("ordinary")).alias("value"))
    often = contexts.filter("all_toxic > 1 OR all_ordinary > 1")
    rows = counts.filter("toxic > 1 OR ordinary > 1").join(often, "context").join(words, "word")

    def whole(c: str) -> Column:
        own = F.when(F.col(f"all_{c}") > 0, (F.col(c) - freed(F.col(c))) / F.col(f"all_{c}")).otherwise(0.0)
        return own / (lost(c) * F.col(f"p_{c}")) + 1

    three = rows.select("context", "word", (F.col("toxic") + F.col("ordinary")).alias("n"), F.log(whole("toxic") / whole("ordinary")).alias("value"))

    def keyed(kind):
        def run(batch: pa.RecordBatch) -> dict:
            parts = [np.asarray(batch.column(i)).view(np.uint64) for i in range(kind)]
            key = context_key(*parts) if kind == 1 else pair_key(*parts)
            return {"key": key.view(np.int64), "n": batch.column(kind), "value": batch.column(kind + 1), "pair": [kind == 2] * len(key)}

        return run

    kind = "key long, n long, value double, pair boolean"
    table = one.withColumn("pair", F.lit(False)).unionByName(arrow_map(two, keyed(1), kind)).unionByName(arrow_map(three, keyed(2), kind))
    return table.select("key", "n", F.col("value").cast("float").alias("value"), "pair").filter(F.abs("value") > 1e-6), unknown


class KeyTable:
    """A table (key, n, value, pair) split into its most frequent keys, held as arrays, and the rest with a filter over it."""

    def __init__(self, table: DataFrame, hot_keys: int = HOT_KEYS):
        spark = table.sparkSession
        sizes = sorted((r.n, r.keys) for r in table.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count("*").alias("keys")).collect())  # at most 1000 rows
        least, left = 1001, hot_keys
        for n, keys in reversed(sizes):
            if keys > left:
                break
            least, left = n, left - keys
        self.rest = table.filter(F.col("n") < least).select("key", "value", "pair")
        hot = arrow_map(table.filter(F.col("n") >= least).select("key", "value"), lambda b: {"keys": [np.asarray(b.column(0)).tobytes()], "values": [np.asarray(b.column(1)).tobytes()]}, "keys binary, values binary")
        parts = [(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["values"], np.float32)) for r in hot.toLocalIterator()]  # at most hot_keys keys
        keys = np.concatenate([k for k, _ in parts] or [np.zeros(0, np.int64)]).view(np.uint64)
        values = np.concatenate([v for _, v in parts] or [np.zeros(0, np.float32)])
        order = np.argsort(keys)
        n = sum(k for c, k in sizes if c < least)
        self.bits = min(FILTER_BITS, max(10, int(np.ceil(np.log2(12 * n + 1)))))
        self.shared = spark.sparkContext.broadcast((keys[order], values[order], self._filter(n)))

    def _filter(self, n: int) -> np.ndarray:
        out, bits = np.zeros(1 << (self.bits - 3), dtype=np.uint8), self.bits
        if n:

            def run(batch: pa.RecordBatch) -> dict:
                at = np.concatenate(places(np.asarray(batch.column(0)).view(np.uint64), bits))
                return {"byte": (at >> np.uint64(3)).astype(np.int64), "bit": np.left_shift(1, (at & np.uint64(7)).astype(np.int64))}

            marks = arrow_map(self.rest, run, "byte long, bit long").groupBy("byte").agg(F.bit_or("bit").cast("short").alias("bit"))
            packed = arrow_map(marks, lambda b: {"bytes": [np.asarray(b.column(0)).tobytes()], "bits": [np.asarray(b.column(1)).astype(np.uint8).tobytes()]}, "bytes binary, bits binary")
            for r in packed.toLocalIterator():  # at most 2**FILTER_BITS bits in all
                out[np.frombuffer(r["bytes"], np.int64)] = np.frombuffer(r["bits"], np.uint8)
        return out


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where a key stands in a filter of 2**bits bits: three places."""
    again = mix(keys)
    return [keys >> np.uint64(64 - bits), again >> np.uint64(64 - bits), (again & np.uint64((1 << 32) - 1)) >> np.uint64(32 - bits)]


def evidence(docs: DataFrame, table: KeyTable, unknown: float, text_col: str, columns: list[str]) -> DataFrame:
    """``columns`` and __x: mean log ratio of the words, __over and __pairs: means above MARGIN, __n: words; no words give zeros."""
    shared, bits = table.shared, table.bits
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), *columns, *([] if text_col in columns else [text_col]))
    names, at = rows.columns, rows.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> dict:
        (keys, values, marks), n = shared.value, batch.num_rows
        row, context, word = pairs_of(*utf8(batch.column(at)))
        words = np.bincount(row, minlength=n)
        x, above = unknown * words, []
        rest: list[tuple[np.ndarray, np.ndarray]] = []
        for key in (word, context_key(context), pair_key(context, word)):
            place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            known = keys[place] == key if len(keys) else np.zeros(len(key), bool)
            value = np.where(known, values[place], 0) if len(keys) else np.zeros(len(key))
            x += np.bincount(row, weights=value, minlength=n)
            above.append(np.bincount(row, weights=np.maximum(value - MARGIN, 0), minlength=n))
            maybe = ~known
            for p in places(key, bits):
                maybe[maybe] = marks[(p[maybe] >> np.uint64(3)).astype(np.int64)] >> (p[maybe] & np.uint64(7)).astype(np.uint8) & 1 == 1
            rest.append((row[maybe], key[maybe]))
        where, key = (np.concatenate(v) for v in zip(*rest))
        order = np.lexsort((key, where))
        where, key = where[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(key)))
        edges = np.searchsorted(where[first], np.arange(n + 1))
        lists = [[{"key": k, "times": t} for k, t in zip(key[first[a:b]].view(np.int64).tolist(), times[a:b].tolist())] for a, b in zip(edges[:-1], edges[1:])]
        return {"__row": batch.column(0)} | {c: batch.column(names.index(c)) for c in columns} | {"__x": x, "__over": above[0] + above[1], "__pairs": above[2], "__n": words, "__rest": lists}

    kept = ", ".join(["__row long", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)])
    found = materialize(arrow_map(rows, run, f"{kept}, __x double, __over double, __pairs double, __n long, __rest array<struct<key: long, times: long>>", text=at), "evidence")
    times = found.select("__row", F.inline("__rest"))
    above = F.col("times") * F.greatest(F.col("value") - MARGIN, F.lit(0))
    more = times.join(table.rest, "key").groupBy("__row").agg(
        F.sum(F.col("times") * F.col("value")).alias("__more_x"), F.sum(F.when(F.col("pair"), 0).otherwise(above)).alias("__more_over"), F.sum(F.when(F.col("pair"), above).otherwise(0)).alias("__more_pairs"))
    n = F.greatest("__n", F.lit(1))
    joined = found.drop("__rest").join(small(materialize(more, "rare-evidence")), "__row", "left")
    return joined.select(*columns, *(((F.col(f"__{c}") + F.coalesce(f"__more_{c}", F.lit(0.0))) / n).alias(f"__{c}") for c in FIGURES), "__n")


#: What the calibration weighs beside a constant.
FIGURES = ("x", "over", "pairs")


def _weighed(figure: str) -> Column:
    """A figure as the calibration takes it: means above MARGIN by their logarithm, as one clear word in a thousand says much."""
    return F.col("__x") if figure == "x" else F.log1p(1000 * F.col(f"__{figure}"))


def calibrate(rows: list[tuple]) -> list[float]:
    """Logistic weights of the figures and the constant by Newton steps on rows (x, over, pairs, toxic)."""
    if len({r[-1] for r in rows}) < 2:
        return [0.0, 1.0, 0.5, -2.0]
    *figures, y = (np.array(v, dtype=float) for v in zip(*rows))
    f = np.stack([*figures, np.ones(len(y))], axis=1)
    scale = np.maximum(np.abs(f).mean(axis=0), 1e-9)
    f /= scale
    w = np.zeros(f.shape[1])
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + np.eye(len(w)) * 1e-2, f.T @ (y - p) - 1e-2 * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return [float(v) for v in w / scale]


class ToxicityModel:
    """Fit on labelled documents, then score any documents.

    ``labelled`` has the id, text and 0/1 label of rows that may be learnt from. Rows with crc32(id) mod 4 = 3 calibrate (at
    most CALIBRATION_ROWS of them, the least by hash of their id); all others are counted, each distinct text once. Null
    labels and null texts teach nothing; without labelled rows of both classes fixed weights stand in.
    """

    def __init__(self, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", hot_keys: int = HOT_KEYS):
        held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 3, F.lit(False))
        rows = labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
        learnt = rows.filter(~held)
        once = learnt.groupBy(F.xxhash64(text_col), F.octet_length(text_col)).agg(F.min(id_col).alias(id_col)).select(id_col)
        counts = materialize(count_pairs(learnt.join(small(once), id_col, "left_semi"), text_col, label_col), "pairs")
        table, self.unknown = kneser_ney(counts)
        self.table = KeyTable(materialize(table, "keys"), hot_keys)
        chosen = rows.filter(held).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(CALIBRATION_ROWS)
        fitting = rows.filter(held).join(F.broadcast(chosen.distinct()), id_col, "left_semi")
        figures = evidence(fitting, self.table, self.unknown, text_col, [label_col])
        self.weights = calibrate([tuple(r) for r in figures.select(*map(_weighed, FIGURES), label_col).toLocalIterator()])

    def _scored(self, docs: DataFrame, columns: list[str], text_col: str, name: str) -> DataFrame:
        logit = sum((w * _weighed(c) for w, c in zip(self.weights, FIGURES)), F.lit(self.weights[-1]))
        figures = evidence(docs, self.table, self.unknown, text_col, columns)
        return figures.withColumn(name, 1 / (1 + F.exp(-logit))).drop(*(f"__{c}" for c in FIGURES), "__n")

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, score): 0 to 1 for every row, null and empty texts and repeated rows too."""
        return self._scored(docs, [id_col], text_col, "score")

    def annotate(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with the score as column ``name`` (in place of one of that name)."""
        return self._scored(docs, [c for c in docs.columns if c != name], text_col, name)

    def drop_toxic(self, docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
        """``docs`` without the rows that score ``threshold`` or more; a row goes by its text, so repeated or null ids do no harm."""
        named = docs.select(text_col, F.xxhash64(text_col).alias("__hash"), F.octet_length(text_col).alias("__bytes"))
        gone = self._scored(named, ["__hash", "__bytes"], text_col, "__toxicity").filter(F.col("__toxicity") >= threshold)
        gone = materialize(gone.select("__hash", "__bytes").distinct(), "toxic")
        marked = docs.withColumn("__hash", F.xxhash64(text_col)).withColumn("__bytes", F.octet_length(text_col))
        same = marked["__hash"].eqNullSafe(gone["__hash"]) & marked["__bytes"].eqNullSafe(gone["__bytes"])
        return marked.join(small(gone), same, "left_anti").select(*docs.columns)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of the rows of ``docs`` with a label, those whose crc32(doc_id) mod 4 is 2 left out."""
    labels = labels.select("doc_id", "toxic").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return ToxicityModel(docs.select("doc_id", "text").join(small(labels), "doc_id"))
