"""Each operator against a plain version, and on nulls, empty texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import bpe, chaining, decontaminate, linededup, pii, quality, simhash, suffixdedup, toxicity, warc
from lattica.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, fp string, n long, kept string, key string, node string, hash string"


KEY = "key of the tests"


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", "v", "w") for i, t in rows], SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


LONG = prose(1, 3000)
BASE = prose(2, 120)
ROWS = [
    (0, None), (1, ""), (2, BASE), (3, BASE), (4, BASE + " extra words at the end"), (5, prose(3, 200) + "\n" + BASE), (6, LONG), (7, LONG[:9000]), (8, "Ünïcödé ßtraße\n" * 9), (9, "   \n\t"),
    (10, "a"), (11, "word"), (12, BASE.replace("a", "A", 3)), (13, "\n".join([BASE[:200], BASE[:199] + "#", BASE[200:400]])), (14, "one two"), (15, "x" * 500),
]


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("dense", [32, 1])
def test_simhash_matches_brute_force(spark, dense):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, ROWS), dense=dense).collect()}
    fps = {i: plain_fingerprint(t) for i, t in ROWS}
    assert {i: r.fp % 2**64 for i, r in got.items()} == fps
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {i: r.component for i, r in got.items()} == components(links, fps)


@pytest.mark.parametrize("dense", [32, 2])
def test_simhash_links_of_chosen_fingerprints(spark, dense):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(k)) & (2**64 - 1) for b in base for k in range(4) for _ in range(15)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), dense=dense).collect()]
    want = components([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2], fps)
    assert components(got, fps) == want
    assert all((a ^ b).bit_count() <= 2 for a, b in got)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_bpe_as_the_library_and_back(spark):
    import tiktoken

    path, pattern = tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [*ROWS, (20, "<|endoftext|> it's \n\n\n  we'll   \t x"), (21, " " * 400 + "y\n" * 50), (22, "naïve 漢字 🙂" * 40), (2, "a repeated id")]
    for chunk, overlap in ((32_768, 1_024), (64, 16), (30, 3)):
        got = bpe.encode(docs(spark, rows), path, pattern, chunk=chunk, overlap=overlap).collect()
        assert sorted((r.doc_id, list(r.ids)) for r in got) == sorted((i, library.encode_ordinary(t or "")) for i, t in rows)
        assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in rows)
        assert all(r.ids_text == ",".join(map(str, r.ids)) for r in got)
    assert bpe.encode(docs(spark, []), path, pattern).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/4 b\r\n", ""), (5, "u", "WARC/1.1\r\n\r\nbait\r\n\r\n"), (6, "u", "é" * 10), (None, "u", "<p>x</p>"), (2, "http://a/2", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.resolve_revisits(warc.records(pages)), path)
    got = warc.join_revisits(warc.read_warc(spark, path)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert [(r.record_type, r.refers_to, r.n_bytes, r.digest) for r in by[1]] == [("revisit", 2, 8, digest("<p>x</p>"))]
    assert [r.record_type for r in by[2]] == ["response"] * 2  # repeated rows of the largest id
    assert [(r.record_type, r.refers_to) for r in by[3]] == [("revisit", 4)] and by[4][0].n_bytes == 0
    assert by[5][0].found == digest("WARC/1.1\r\n\r\nbait\r\n\r\n") == by[5][0].digest
    assert by[6][0].n_bytes == 20 and by[None][0].record_type == "response"
    assert warc.resolve_revisits(warc.records(pages), min_bytes=1).filter("page_id = 3 and original is not null").count() == 0
    payloads = {r.page_id: bytes(r.payload) for r in warc.read_warc(spark, path, payloads=True).filter("record_type = 'response'").collect()}
    assert payloads[6] == ("é" * 10).encode()


def test_quality_counts_and_verdict(spark):
    good = [(i, prose(100 + i, 80)) for i in range(60)]
    bad = [(100 + i, " ".join(f"{w}%%% $$$" for w in prose(200 + i, 60).split())) for i in range(30)]
    rows = [*ROWS, *[(i + 1000, t) for i, t in good + bad]]
    labels = spark.createDataFrame([(i + 1000, int(i < 100)) for i, _ in good + bad] + [(2, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.filter_quality(docs(spark, rows), labels).collect()}
    for i, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        where = defaultdict(list)
        for k in range(len(words) - 7):
            where[tuple(words[k : k + 8])].append(k)
        again = {p for v in where.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(words) < 20 or 100 * len(again) > 30 * len(words))
        assert not (r.base_failed and r.kept)
    assert all(got[i + 1000].kept for i, _ in good) and not any(got[i + 1000].kept for i, _ in bad)
    assert quality.filter_quality(docs(spark, []), labels).count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = prose(i, rng.randint(40, 120)).split()
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "zqvk" + rng.choice("abcdef") + rng.choice("uvwx"))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    labels = spark.createDataFrame([*labels, (None, 1), (9999, None)], "doc_id long, toxic int")
    data = docs(spark, rows + [(1000, None), (1001, ""), (1002, "!!!")])
    model = toxicity.fit(data, labels)
    got = {r.doc_id: r.score for r in model.score(data).collect()}
    held = [i for i, _ in rows if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.3) == (i % 5 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert set(model.annotate(data).columns) == {*data.columns, "score"}
    nothing = toxicity.fit(docs(spark, []), labels)
    assert nothing.score(data).count() == 403 and nothing.score(docs(spark, [])).count() == 0


def test_toxicity_reads_words_to_their_end(spark):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    signs = lambda n: "".join(chr(rng.randint(0x4E00, 0x4E80)) for _ in range(n))
    rows, labels = [], []
    for i in range(600):
        toxic, wide = i % 5 == 0, i % 2 == 0
        if wide:  # one sentence without spaces, its toxic part far from the start
            text = "。".join(signs(30) + ("龍龜龘鬱" if toxic and k % 2 else signs(4)) + signs(10) for k in range(6))
        else:  # compounds that begin alike and differ in what comes after many letters
            text = " ".join(letters(13) + ("zqvkwxyz" if toxic and k % 5 == 0 else letters(8)) for k in range(40))
        rows.append((i, text))
        labels.append((i, int(toxic)))
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in model.score(docs(spark, rows)).collect()}
    held = [i for i, _ in rows if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == (i % 5 == 0) for i in held) >= 0.95 * len(held)
    assert {got[i] >= 0.3 for i in held if i % 5 == 0} == {True}


def plain_kneser_ney(texts, text):
    """log P_toxic - log P_ordinary of a text by the formulas, from (text, toxic) with words of ASCII letters."""
    words = lambda t: [(None if p is None else p.group(), w.group()) for p, w in paired(list(re.finditer("[a-z]+", t.lower())), t)]

    def paired(found, t):
        return [(found[i - 1] if i and not t[found[i - 1].end() : m.start()].strip(" ") else None, m) for i, m in enumerate(found)]

    pairs = {0: defaultdict(int), 1: defaultdict(int)}
    for t, toxic in texts:
        for p in words(t):
            pairs[toxic][p] += 1
    both = set(pairs[0]) | set(pairs[1])
    given = lambda n: n if n < 2 else 0.75
    contexts = {w: {c: sum(1 for v, x in pairs[c] if x == w) for c in (0, 1)} for w in {w for _, w in both}}
    total = {c: sum(n[c] for n in contexts.values()) for c in (0, 1)}
    freed = {c: sum(given(n[c]) for n in contexts.values()) for c in (0, 1)}
    classes = {w: sum(1 for c in (0, 1) if n[c]) for w, n in contexts.items()}

    def single(c, w):
        n = contexts.get(w, {0: 0, 1: 0})[c]
        shared = (max(classes.get(w, 0) - 0.75, 0) + 0.75 * len(classes) / (len(classes) + 1)) / sum(classes.values())
        return (n - given(n) + freed[c] * shared) / total[c]

    def prob(c, v, w):
        row = {x: n for (u, x), n in pairs[c].items() if u == v}
        if not row:
            return single(c, w)
        n = row.get(w, 0)
        return (n - given(n) + sum(map(given, row.values())) * single(c, w)) / sum(row.values())

    return sum(math.log(prob(1, v, w) / prob(0, v, w)) for v, w in words(text)), len(words(text))


@pytest.mark.parametrize("hot_keys", [1_500_000, 40, 0])
def test_toxicity_matches_the_formulas(spark, hot_keys):
    rng = random.Random(8)
    some = ["the", "a", "you", "Are", "trash", "fine", "day", "uncommonwords", "uncommonworth"]
    text = lambda: "".join(rng.choice(some) + rng.choice([" ", " ", " ", ", ", "\n"]) for _ in range(rng.randint(1, 30)))
    learnt = [(text(), int(i % 3 == 0)) for i in range(60)]
    table, unknown = toxicity.kneser_ney(toxicity.count_pairs(spark.createDataFrame(learnt, "text string, toxic int"), "text", "toxic"))
    keys = toxicity.KeyTable(table.cache(), hot_keys)
    asked = [(i, text() + rng.choice(["", "unseen words", "the trash"])) for i in range(25)] + [(100, ""), (101, None), (102, learnt[0][0]), (102, learnt[0][0])]
    got = toxicity.evidence(docs(spark, asked), keys, unknown, "text", ["doc_id"]).collect()
    assert len(got) == len(asked)
    for r in got:
        want, n = plain_kneser_ney(learnt, dict(asked)[r.doc_id] or "")
        assert r["__n"] == n and abs(r["__x"] * max(n, 1) - want) < 1e-4 * max(n, 1)


def test_toxicity_tells_words_apart_by_their_ends(spark):
    """Words alike in their first 12 letters are two; a text without a word of either class scores between."""
    rows = [(i, " ".join(prose(10 * i + k, 6) + " harmlessword" + ("x" if i % 2 else "y") for k in range(3))) for i in range(200)]
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in model.score(docs(spark, [(1, "so harmlesswordx"), (2, "so harmlesswordy")])).collect()}
    assert got[1] > 0.5 > got[2]
    long = docs(spark, [(1, "fine " * 300_000), (2, "harmlesswordx " * 100_000), (None, "harmlesswordx here")])
    got = {r.doc_id: r.score for r in model.score(long).collect()}
    assert got[2] > 0.5 and got[None] > 0.5 and got[1] < got[2]
    kept = model.drop_toxic(docs(spark, [(None, "harmlesswordx here"), (7, "harmlesswordy here"), (8, "harmlesswordx here"), (9, None), (9, None)]), 0.5)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [7, 9, 9]


def plain_contamination(rows, items, width=13):
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = word(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add(i)
    out = {}
    for i, t in rows:
        w, hit, found = word(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination_matches_brute_force(spark):
    items = [(1, prose(50, 40)), (2, "Short Item, here"), (3, None), (4, ""), (5, prose(50, 40)[30:130]), (10, "a a a a a a a a a a a a a a"), (11, BASE[:300])]
    rows = [*ROWS, (30, "start " + prose(50, 40) + " end"), (31, prose(50, 40).upper()), (32, "some SHORT item here, a short item - here"), (33, "a " * 30), (34, prose(9, 400) + " " + " ".join(prose(50, 40).split()[3:17]))]
    table = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    got = decontaminate.contamination(docs(spark, rows), table).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in got} == plain_contamination(rows, items)
    assert decontaminate.contamination(docs(spark, []), table).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs(spark, rows), table.limit(0)).collect())


def test_decontamination_of_null_and_repeated_ids(spark):
    table = spark.createDataFrame([(1, prose(50, 40)), (2, "the")], "item_id long, text string")
    rows = [(None, prose(50, 40)), (None, "clean text only"), (5, prose(50, 40)), (5, "another clean text"), (5, "another clean text")]
    got = decontaminate.contamination(docs(spark, rows), table).collect()
    assert sorted((str(r.doc_id), r.n_hit, r.contaminated) for r in got) == [("5", 0, False), ("5", 0, False), ("5", 40, True), ("None", 0, False), ("None", 40, True)]
    left = decontaminate.drop_contaminated(docs(spark, rows), table)
    assert left.columns == docs(spark, rows).columns and sorted(r.text for r in left.collect()) == ["another clean text", "another clean text", "clean text only"]


def test_decontamination_of_a_text_of_one_word(spark):
    table = spark.createDataFrame([(1, "the"), (2, "the the the the the the the the the the the the the the the")], "item_id long, text string")
    got = decontaminate.contamination(docs(spark, [(1, "the " * 20_000), (2, "other")]), table).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in got} == {1: (20_000, 20_000, ["1", "2"]), 2: (1, 0, [])}


def test_small_measures_bytes(spark):
    from lattica.llm.common import small

    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower() or "hint" in df._jdf.queryExecution().logical().toString().lower()
    frame = spark.createDataFrame([(1, "x" * 1000, ["y" * 500])], "a long, b string, c array<string>")
    assert hinted(small(frame)) and not hinted(small(frame, size=1200)) and not hinted(small(frame, rows=0))


def test_proximity_matches(spark):
    data = docs(spark, [(1, "alpha x beta y y y y alpha"), (2, "beta q q q q q alpha"), (3, "gamma")])
    terms = spark.createDataFrame([(0, "alpha beta"), (1, "gamma")], "item_id int, text string")
    index = decontaminate.build_index(data, decontaminate.vocabulary(terms))
    queries = terms.select(F.col("item_id").alias("query"), F.explode(F.split("text", " ")).alias("term")).select("query", F.xxhash64("term").alias("term_id"))
    got = {(r.query, r.doc_id, r.at) for r in decontaminate.proximity_matches(index, queries, 3).collect()}
    assert {(q, d) for q, d, _ in got} == {(0, 1), (1, 3)}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def line_rows():
    rng = random.Random(11)
    base = [prose(300 + k, 8) for k in range(4)]
    rows = []
    for i in range(110):
        lines = []
        for _ in range(4):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                at, kind = rng.randrange(len(line)), rng.randrange(3)
                if kind == 0:
                    line[at] = rng.choice("xyz")
                elif kind == 1:
                    line.insert(at, rng.choice("xyz"))
                else:
                    del line[at]
            lines.append("".join(line))
        rows.append((i, "\n".join([*lines, "tiny", rng.choice(["tiny", "tina"])])))
    return rows


@pytest.mark.parametrize("dense", [6, 2])
def test_line_dedup_matches_brute_force(spark, dense, monkeypatch):
    monkeypatch.setattr(linededup, "DENSE", dense)
    rows = [*[(i + 100, t) for i, t in line_rows()], *ROWS]
    first, lines = {}, []
    for i, t in sorted(rows):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            lines.append((i, k, line))
            first.setdefault(line, (i, k))
    unlike = sorted(first, key=first.get)
    links = [(first[a], first[b]) for a in unlike for b in unlike if a < b and min(len(a), len(b)) >= 20 and one_edit(a, b)]
    assert len(links) > 200
    want = components(links, first.values())
    got = linededup.near_duplicate_lines(docs(spark, rows)).collect()
    assert {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in got} == {(i, k): want[first[line]] for i, k, line in lines}
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    text = {(i, k): line for i, k, line in lines}
    assert all(r.n_links == degree[first[text[r.doc_id, r.line_no]]] for r in got)
    word = lambda r: re.search(r"\w", text[r.doc_id, r.line_no])
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.first_doc_id, r.first_line_no) or not word(r)) for r in got)
    kept = {(r.doc_id, r.line_no) for r in got if r.kept}
    cleaned = {r.doc_id: r.text for r in linededup.drop_duplicate_lines(docs(spark, rows)).collect()}
    assert cleaned == {i: t and "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) in kept) for i, t in rows}


def test_line_dedup_of_short_and_common_lines(spark):
    """Copies of short lines go like others, lines without a letter or digit stay; one line in most documents is salted."""
    rows = [(i, f"Read more\n\n---\n{prose(800 + i, 8)}\n}}") for i in range(60)]
    got = linededup.near_duplicate_lines(docs(spark, rows)).collect()
    kept = {(r.doc_id, r.line_no) for r in got if r.kept}
    assert kept == {(i, k) for i in range(60) for k in range(5) if i == 0 or k}
    assert {r.copies for r in got if r.line_no == 0} == {60}
    with pytest.raises(Exception, match="0 to 2"):
        linededup.near_duplicate_lines(docs(spark, [(1 << 39, "some line")])).collect()


def test_line_dedup_empty_and_null_ids(spark):
    assert linededup.near_duplicate_lines(docs(spark, [])).count() == 0
    got = linededup.near_duplicate_lines(docs(spark, [(None, BASE), (1, BASE)])).collect()
    assert all(r.kept for r in got)


def test_banded_distance(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            b.insert(rng.randint(0, len(b)), rng.choice("ab")) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        pairs.append((a, "".join(b)))
    for tau in (1, 2):
        frame = spark.createDataFrame([p for p in pairs if abs(len(p[0]) - len(p[1])) <= tau], "a string, b string")
        got = frame.select(F.levenshtein("a", "b").alias("true"), linededup.banded_distance(F.col("a"), F.col("b"), tau).alias("band")).collect()
        assert all(min(r.true, tau + 1) == min(r.band, tau + 1) for r in got)


def plain_suffix(rows):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for k in range(len(b) - 99):
            if seen.setdefault(b[k : k + 100], (i, k)) != (i, k):
                mark[k : k + 100] = b"\1" * 100
        out[i] = bytes(x for x, m in zip(b, mark) if not m), sum(1 for k, m in enumerate(mark) if m and not (k and mark[k - 1]))
    return out


@pytest.mark.parametrize("block", [40_000, 1])
def test_suffix_dedup_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BLOCK", block)  # 1: every anchor is hot and split
    rows = [*ROWS, (40, LONG[300:390] + LONG[5000:5120] + BASE[:99]), (41, "é" * 80 + BASE[3:150]), (42, ("ab" * 70 + "\n") * 3), (43, BASE[50:149]), (44, BASE[50:150])]
    got = {r.doc_id: (bytes(r.kept), len(r.spans)) for r in suffixdedup.deduplicate(docs(spark, rows)).collect()}
    assert got == plain_suffix(rows)
    assert suffixdedup.deduplicate(docs(spark, [])).count() == 0
    twice = suffixdedup.deduplicate(docs(spark, [(1, BASE), (1, BASE), (None, BASE[:150])])).collect()
    assert sorted(r.n_removed for r in twice) == [0, 150, 150]


def test_chaining_finds_fuzzy_passages(spark):
    shared = prose(400, 90).split()
    fuzzy = list(shared)
    for k in (20, 45, 70):
        fuzzy[k] = "changed"
    rows = [*ROWS, (50, prose(401, 60) + " " + " ".join(shared) + " " + prose(402, 40)), (51, prose(403, 30) + " " + " ".join(fuzzy) + " " + prose(404, 80)), (52, prose(405, 300)), (53, prose(406, 50) + " " + " ".join(shared[:30]))]
    got = {r.doc_id: r for r in chaining.shared_passages(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[51].class_id == 50 and list(got[51].links) == [50] and 85 <= got[51].n_words <= 95
    assert got[50].n_passages == 1 and got[52].n_passages == 0 and got[53].n_passages == 0
    assert got[3].class_id == 2 == got[4].class_id == got[5].class_id and got[7].class_id == 6
    assert got[0].class_id == 0 and got[9].n_links == 0
    assert chaining.shared_passages(docs(spark, [])).count() == 0


def test_chaining_matches_every_pair(spark):
    p = prose(410, 60).split()
    one, two, both = " ".join(p[:30]), " ".join(p[30:]), " ".join(p)
    around = lambda i, t: (i, f"{prose(500 + 2 * i, 40)} {t} {prose(501 + 2 * i, 40)}")
    rows = [around(1, one), around(2, two), around(3, both), around(4, one), around(5, two), around(6, both)]
    rows += [(7, rows[2][1]), (8, rows[2][1])]
    got = {r.doc_id: r for r in chaining.shared_passages(docs(spark, rows)).collect()}
    assert [got[i].class_id for i in range(1, 9)] == [1, 2, 3, 4, 5, 3, 3, 3]
    assert [got[i].n_links for i in range(1, 9)] == [0, 0, 3, 0, 0, 3, 3, 3] and list(got[6].links) == [3]

    # more documents than one hash lists pairs of, each with an edit of its own; a short line that is as common links nothing
    hot, line = prose(411, 90).split(), prose(412, 18)
    rows = [around(i, " ".join(hot[: i % 80 + 5] + ["edited"] + hot[i % 80 + 6 :])) for i in range(150)]
    rows += [around(i, line) for i in range(150, 320)]
    got = {r.doc_id: r for r in chaining.shared_passages(docs(spark, rows)).collect()}
    assert all(got[i].n_links == 149 and got[i].class_id == 0 for i in range(150))
    assert all(got[i].n_links == 0 and got[i].class_id == i for i in range(150, 320))
    assert got[149].n_passages == 149 and 88 <= got[149].n_words <= 92 and got[0].n_words == 0


def alike(a, b):
    """Whether two lists share a passage: some windows of 50 to 90 words with a common subsequence of four fifths."""
    return any(chaining.similarity(a[i : i + n], b[j : j + n]) >= 0.8 for n in (50, 60, 75) for i in range(0, len(a) - n + 1, 5) for j in range(0, len(b) - n + 1, 5))


def test_chaining_counts_links_of_edited_families(spark, monkeypatch):
    """Families whose members differ from each other by up to a third of their words: counts are those of all pairs aligned."""
    rng = random.Random(9)
    rows = []
    for family in range(3):
        base = prose(600 + family, 110).split()
        for m in range(14):
            words = list(base)
            for _ in range(rng.choice([0, 2, 4, 9, 14])):
                words[rng.randrange(len(words))] = prose(rng.randrange(10**6), 1) + "q"
            rows.append((100 * family + m, " ".join(words)))
    got = {r.doc_id: r for r in chaining.shared_passages(docs(spark, rows)).collect()}
    monkeypatch.setattr(chaining, "cliques_of", lambda found: found.select("doc_id", F.lit(None).cast("long").alias("c1"), F.lit(None).cast("long").alias("c2")).limit(0))
    plain = {r.doc_id: r for r in chaining.shared_passages(docs(spark, rows)).collect()}
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (r.class_id, r.n_links) for i, r in plain.items()}
    texts = {i: t.split() for i, t in rows}
    true = {(i, j) for i in texts for j in texts if i < j and alike(texts[i], texts[j])}
    assert sum(r.n_links for r in got.values()) / 2 >= 0.9 * len(true)


def test_chaining_parts_of_a_passage_elsewhere(spark):
    """Overlapping parts of a passage in documents before and between do not hide that two documents share all of it."""
    p = prose(700, 90).split()
    around = lambda i, t: (i, f"{prose(710 + 2 * i, 40)} {' '.join(t)} {prose(711 + 2 * i, 40)}")
    rows = [around(10, p), around(20, p)] + [around(i, p[a : a + 40]) for i, a in ((1, 0), (2, 25), (3, 50), (11, 0), (12, 25), (13, 50))]
    got = {r.doc_id: r for r in chaining.shared_passages(docs(spark, rows)).collect()}
    assert got[20].class_id == got[10].class_id == 10 and got[10].n_links == got[20].n_links == 1
    assert all(got[i].n_links == 0 for i in (1, 2, 3, 11, 12, 13))


def test_chaining_edits_near_the_ends_and_odd_rows(spark):
    p = prose(720, 55).split()
    near = list(p)
    near[5], near[49] = "changedone", "changedtwo"
    every = prose(721, 90).split()
    often = [w if k % 8 else "x" + w for k, w in enumerate(every)]
    wide = " ".join("ж" * 20 + w for w in prose(722, 52).split())
    rows = [(1, prose(730, 30) + " " + " ".join(p) + " " + prose(731, 30)), (2, prose(732, 30) + " " + " ".join(near) + " " + prose(733, 30)), (3, " ".join(every)), (4, " ".join(often)), (5, "a " + wide), (6, "b b " + wide)]
    rows += [(7, prose(734, 60_000) + " " + " ".join(p)), (8, prose(735, 60)), (8, prose(735, 60)), (9, prose(736, 60)), (9, prose(737, 60)), (None, prose(735, 60)), (None, None)]
    got = defaultdict(list)
    for r in chaining.shared_passages(docs(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert got[2][0].class_id == got[7][0].class_id == 1 and got[1][0].n_links == 2 and got[2][0].n_words >= 50
    assert got[4][0].class_id == 3 and got[6][0].class_id == 5 and got[6][0].n_words == 52
    assert [r.n_links for r in got[8]] == [0, 0] and [r.class_id for r in got[9]] == [9, 9]
    assert [(r.class_id, r.n_links) for r in got[None]] == [(None, 0), (None, 0)]


def test_chains_look_past_a_far_best_chain():
    import numpy as np

    # a long chain that stands too far before must not hide the near one
    x = np.concatenate([np.arange(0, 201, 5), np.arange(265, 286, 5), np.arange(295, 326, 5)])
    y = x + np.where(x < 265, 0, np.where(x < 295, 3, 5))
    assert (41, 52) in [tuple(map(int, c)) for c in chaining.chains(x, y)]


def test_chains_follow_order_and_gaps():
    import numpy as np

    x = np.array([0, 5, 10, 15, 20, 25, 200, 205])
    y = np.array([100, 105, 110, 117, 122, 127, 0, 5])
    assert sorted(chaining.chains(x, y)) == [(0, 5), (6, 7)]
    assert chaining.similarity("a b c d".split(), "a x c d".split()) == 0.75


def test_pii_surrogates(spark):
    text = "Mail jo.doe@site.example.com or JO.DOE@site.example.com, call +1 (017) 555-7713, card 4111 1111 1111 1111 / 4111111111111111 from 10.2.33.244. Mrs. Anna Smith, г-н Иван Петров. token 04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, text), (2, "again jo.doe@site.example.com"), (3, None), (4, ""), (5, "no entity here"), (6, text), (6, text)]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, rows), KEY).collect()}
    out = got[1].text
    for secret in ("jo.doe", "JO.DOE", "4111 1111", "555-7713", "10.2.33.244", "Smith", "Петров", "04dbebab"):
        assert secret not in out
    kinds = [e.kind for e in got[1].entities]
    assert kinds == ["email", "email", "phone", "card", "card", "ip", "name", "name", "secret"]
    surrogate = [e.surrogate for e in got[1].entities]
    assert surrogate[0].lower() == surrogate[1].lower() and surrogate[1].split("@")[0].isupper()
    assert surrogate[3].replace(" ", "") == surrogate[4] and surrogate[4][0] == "4"
    luhn = lambda n: sum(sum(divmod(int(d) * 2, 10)) if i % 2 == 0 else int(d) for i, d in enumerate(n)) % 10
    assert luhn(surrogate[4]) == luhn("4111111111111111")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", surrogate[2]) and re.fullmatch(r"[1-9]\d\.\d\.\d\d\.\d{3}", surrogate[5])
    assert surrogate[6].startswith("Mrs. ") and surrogate[6].split()[1] in pii.GIVEN["f", "latin"]
    assert surrogate[7].split()[1] in pii.GIVEN["m", "cyrillic"] and re.fullmatch("[0-9a-f]{40}", surrogate[8])
    assert got[2].text == "again " + surrogate[0] and got[6].text == out
    assert got[3].text is None and got[4].text == "" and got[5].text == "no entity here" and not got[5].entities
    assert pii.pseudonymise(docs(spark, []), KEY).count() == 0
    assert pii.pseudonymise(docs(spark, rows), key="other").filter("doc_id = 2").first().text != got[2].text


def test_pii_collisions_redraw(spark):
    rows = [(i, f"host 1.{i % 9 + 1}.{i // 9 % 9 + 1}.{i // 81 + 1}") for i in range(500)]
    got = {r.doc_id: r.entities[0].surrogate for r in pii.pseudonymise(docs(spark, rows), KEY).collect()}
    assert len(set(got.values())) == 500
    assert not set(got.values()) & {t.split()[1] for _, t in rows}


def test_pii_full_key_space_ends(spark):
    """All addresses of four one-digit octets are real: surrogates get longer, and stay distinct and unreal."""
    hosts = [f"{a}.{b}.{c}.{d}" for a in range(1, 10) for b in range(1, 10) for c in range(1, 10) for d in range(1, 10)]
    rows = [(i, " and ".join(hosts[81 * i : 81 * i + 81])) for i in range(81)]
    got = [e.surrogate for r in pii.pseudonymise(docs(spark, rows), KEY).collect() for e in r.entities]
    assert len(got) == len(set(got)) == 6561 and not set(got) & set(hosts)
    assert all(all(0 < int(o) < 256 for o in g.split(".")) for g in got)


def test_pii_one_person_one_surrogate(spark):
    text = "Herr Anna Schmidt, Frau Anna Schmidt, Frau Anna Schmidt and Dr Anna Schmidt. Anna Schmidt left. Mrs. Schmidt stayed. Berta Schmidt"
    rows = [(1, text), (2, "Mr. Max Schmidt met Anna Schmidt."), (3, "Anna Schmidt alone, +49 170 1234567 or +491701234567 or (499) 555-6503")]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, rows), KEY).collect()}
    named = [e.surrogate for e in got[1].entities]
    assert len(named) == 6 and [n.split()[0] for n in named[:4]] == ["Herr", "Frau", "Frau", "Dr"]
    bare = {" ".join(n.split()[1:]) for n in named[:4]} | {named[4]}
    assert len(bare) == 1 and bare.pop().split()[0] in pii.GIVEN["f", "latin"]
    assert named[5].split()[1] == named[4].split()[1] and "Anna" not in got[1].text and got[1].text.endswith("Berta Schmidt")
    assert got[2].entities[0].surrogate.split()[2] == named[4].split()[1]
    phones = [e.surrogate for e in got[3].entities]
    assert len(phones) == 3 and phones[0].replace(" ", "") == phones[1] and phones[0].startswith("+49 ") and phones[1] != "+491701234567"
    assert re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", phones[2]) and got[3].text.startswith("Anna Schmidt alone")


def test_pii_many_given_names_of_one_family(spark):
    """More given names than there are to draw from stay apart, and a very long text is read to its end."""
    given = sorted({prose(i, 1).capitalize() for i in range(60)})
    rows = [(i, f"Ms {g} Miller") for i, g in enumerate(given)] + [(100, "word " * 200_000 + "Ms Zoe Miller")]
    got = [r.entities[0].surrogate for r in pii.pseudonymise(docs(spark, rows), KEY).collect()]
    assert len(set(got)) == len(given) + 1 and len({g.split()[-1] for g in got}) == 1 and not any("Miller" in g for g in got)
