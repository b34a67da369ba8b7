"""Hard negatives, SentencePiece and the Merkle manifest against plain versions and the library, and on odd rows."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import hardneg, merkle, pieces
from lattica.llm.queries import piece_model

VECTORS = "vec_id long, embedding array<float>, label int, id long, q string, scores string"


def plain_negatives(rows, every):
    rows = sorted({(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)}, key=str)
    size = max((len(r[2]) for r in rows), default=0)
    rows = [(i, lab, q + (0,) * (size - len(q))) for i, lab, q in rows]
    order = lambda s: (-s[0], s[1][0] is None, s[1][0] or 0)
    out = []
    for a in (r for r in rows if r[0] is not None and r[0] % every == 0):
        scored = [(sum(x * y for x, y in zip(a[2], r[2])), r) for r in rows if r is not a]
        for p, pos in sorted((s for s in scored if s[1][1] == a[1]), key=order)[:5]:
            fits = sorted((s for s in scored if s[1][1] != a[1] and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:3]
            out += [(a[0], pos[0], k + 1, n[0], p, s) for k, (s, n) in enumerate(fits)]
    return out


def negatives(spark, rows, every=5):
    df = spark.createDataFrame([(i, v, lab, 1, "x", "y") for i, v, lab in rows], VECTORS)
    found = hardneg.hard_negatives(hardneg.quantised(df), F.col("id") % every == 0)
    return [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect()]


@pytest.mark.parametrize("tile", [1024, 7])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, tile):
    """Copies of one vector for a third of the rows, ties, zero and negative scores, short vectors, nulls, repeated rows, null ids."""
    monkeypatch.setattr(hardneg, "TILE", tile)
    monkeypatch.setattr(hardneg, "ROWS", 40)
    monkeypatch.setattr(hardneg, "ANCHORS", 9)
    rng = random.Random(3)
    vec = lambda n: [rng.gauss(0, 0.4) for _ in range(n)]
    common = vec(12)
    rows = [(i, common if i % 3 == 0 else vec(12), rng.randrange(3)) for i in range(150)]
    rows += [(200, vec(5), 1), (205, [0.0] * 12, 2), (None, common, 1), (None, vec(12), 0), (210, None, 1), (211, common, None), (212, [float("nan")] * 12, 1), (213, [float("inf")] * 12, 1), (215, [None] * 12, 1), (220, [], 1)]
    rows += rows[:20] + [(0, vec(12), 0), (225, [2.0 * x for x in common], 2)]
    want, got = plain_negatives(rows, 5), negatives(spark, rows)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert len(got) > 100 and sorted(got, key=key) == sorted(want, key=key)


def test_hard_negatives_huge_components_and_no_rows(spark):
    rows = [(i, [1e30 * (i % 3), 1.0, float(i)], i % 2) for i in range(12)]
    assert negatives(spark, []) == [] and negatives(spark, [(1, [1.0], 0)]) == []
    assert all(abs(r[4]) < 2**63 for r in negatives(spark, rows))
    rows = [(i, [3e6 + i, 4e6 - i, 5e6], i % 2) for i in range(40)]  # squares beyond 2**53 have to be told apart
    assert sorted(negatives(spark, rows)) == sorted(plain_negatives(rows, 5))


def test_hard_negatives_discard_most_pairs():
    rng = np.random.default_rng(1)
    a, r = rng.normal(size=(20, 32)) * np.geomspace(400, 1, 32), rng.normal(size=(2000, 32)) * np.geomspace(400, 1, 32)
    block = lambda q, p: hardneg.Block({f"{p}id": np.arange(len(q)).tobytes(), f"{p}known": np.ones(len(q), bool).tobytes(), f"{p}label": np.zeros(len(q), np.int64).tobytes(), f"{p}q": q.astype(np.int64).tobytes()}, p, 32, np.eye(32))
    x, y = block(a, "a_"), block(r, "r_")
    rows, _ = hardneg.survivors(x, y, slice(0, 2000), np.ones((20, 2000), bool), np.full(20, -np.inf), 6)
    assert 120 <= len(rows) < 0.05 * 20 * 2000


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def test_pieces_equal_the_library():
    m, sp, rng = pieces.model(piece_model()), library(), random.Random(5)
    pools = ["ab \n", "aAbBcC  \t\n.,é日本語▁<unk></s>", "abcdefghijklmnopqrstuvwxyz ", "▁ a", " ", "0123456789ABCDEF/+=", "\u0000​😀x ", "ابجد кот ", "<0x41>"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 5, 30, 300]))) for pool in pools for _ in range(80)]
    vocab = [p for p, _, kind in m.pieces if kind == pieces.NORMAL]
    texts += ["".join(rng.choice(vocab) for _ in range(12)).replace("▁", " ") for _ in range(400)]
    texts += ["a" * 3000, "ab" * 2000, " " * 777, "x" + " " * 33 + "y", "".join(rng.choice("ABCDabcd0123") for _ in range(9000))]
    want = sp.encode(texts)
    got = m.encode(texts)
    assert [np.frombuffer(g[0], "<i4").tolist() for g in got] == want
    assert [m.decode(w) for w in want] == sp.decode(want) == [g[2] for g in got]
    ids = [[rng.randrange(rng.choice([3, 259, 262, 32000])) for _ in range(rng.randrange(12))] for _ in range(3000)]
    assert [m.decode(i) for i in ids] == [sp.decode(i) for i in ids]


def test_pieces_windows_and_forgetting(monkeypatch):
    """Texts longer than a window, words longer than are remembered, a memory that runs full."""
    m, sp, rng = pieces.Model(piece_model()), library(), random.Random(6)
    pieces.model(piece_model())
    monkeypatch.setattr(pieces, "WINDOW", 50)
    monkeypatch.setattr(pieces, "REMEMBERED", 30)
    monkeypatch.setattr(pieces, "LONGEST", 8)
    texts = ["".join(rng.choice("ab cdé   ") for _ in range(rng.choice([40, 49, 50, 51, 500]))) for _ in range(60)] + ["x" * 400, " " * 400, "ab" + " " * 60 + "cd" * 40 + "   "]
    assert [np.frombuffer(ids, "<i4").tolist() for ids, _, _ in m.encode(texts)] == sp.encode(texts)
    assert len(m.known) <= 30 and not any(len(w) > 8 for w in [*m.known, *m.former])


def test_pieces_that_merge_out_of_order():
    """Where a merge makes a better pair, the pairs are merged one by one, as by an agenda."""
    m = pieces.Model(piece_model())
    m.symbols = ["a", "b", "ab", "aba", "abab", "ba", "bb"]
    ranks = {("a", "b"): 5, ("ab", "a"): 1, ("ab", "ab"): 0, ("b", "a"): 9, ("aba", "b"): 5, ("b", "b"): 5, ("a", "ba"): 1}
    made = sorted((m.symbols.index(x) * 7 + m.symbols.index(y), m.symbols.index(x + y), r) for (x, y), r in ranks.items())
    m.pair_keys, m.pair_made, m.pair_rank = (np.array([f[k] for f in made], dtype=t) for k, t in ((0, np.int64), (1, np.int32), (2, np.int32)))
    m.chars, m.char_symbol, m.joined = np.array([97, 98]), np.array([0, 1], dtype=np.int32), np.array(sorted(x << 21 | y for x in (97, 98) for y in (97, 98)))

    def agenda(word):
        s = list(word)
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks]
            if not found:
                return s
            i = min(found)[1]
            s[i : i + 2] = [s[i] + s[i + 1]]

    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 15))) for _ in range(500)]
    assert [[m.symbols[k] for k in got] for got in m.merge(words)] == [agenda(w) for w in words]


def test_pieces_rows(spark):
    sp = library()
    rows = [(1, None), (2, ""), (3, "hello  world"), (3, "hello  world"), (None, "ünï ▁ code"), (4, "word " * 60_000), (5, "x" * 30_000)]
    df = spark.createDataFrame([(i, t, "a", [1]) for i, t in rows], "doc_id long, text string, id string, ids array<int>")
    out = pieces.encode(df, piece_model())
    got = sorted(((r.doc_id or 0, r.ids, bytes(r.decoded).decode(), r.ids_text) for r in out.collect()), key=str)
    want = [sp.encode(t or "") for _, t in rows]
    assert got == sorted(((i or 0, w, sp.decode(w), ",".join(map(str, w))) for (i, _), w in zip(rows, want)), key=str)
    back = pieces.decode(out.select("doc_id", "ids"), piece_model())
    assert {r.doc_id: r.text for r in back.collect()}[3] == "hello  world"
    assert pieces.encode(df.limit(0), piece_model()).collect() == []


def plain_manifest(rows, width=8):
    """rows (doc_id, text, lang, source, n_chars) -> [(doc_id, leaf, subroot, root, proof, folded root, verified)]"""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    digest = lambda i, t, la, s, n: sha("".join(map(said, (i, s, la, n, t))))

    def grow(level):
        """The root and, for each node, the runs on its way up with its place in each."""
        ways, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            runs = [level[k : k + width] for k in range(0, len(level), width)]
            for k, way in enumerate(ways):
                way.append((runs[at[k] // width], at[k] % width))
                at[k] //= width
            level = [sha("".join(r)) for r in runs]
        return level[0], ways

    groups = {}
    for r in rows:
        groups.setdefault(("=" + r[2]).encode() if r[2] is not None else b"", []).append(r)
    names = sorted(groups)
    made = {}
    for g in names:
        leaves = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, digest(*r)))
        made[g] = leaves, *grow([digest(*r) for r in leaves])
    root, above = grow([made[g][1] for g in names]) if names else (None, [])
    out = []
    for g, up in zip(names, above):
        leaves, sub, ways = made[g]
        for r, way in zip(leaves, ways):
            path = way + up
            node = digest(r[0], lower(r[1]), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else digest(*r)
            for run, k in path:
                node = sha("".join([*run[:k], node, *run[k + 1 :]]))
            proof = sha("".join("".join([*run[:k], *run[k + 1 :]]) for run, k in path))
            out.append((r[0], digest(*r), sub, root, proof, node, node == root))
    return out


@pytest.mark.parametrize("levels", [1, 4])
def test_manifest_against_a_plain_one(spark, levels):
    """Groups of 1, 8, 9, 64, 65 and 600 rows, ten groups and a null one, null fields, repeated rows, null and equal ids."""
    rng = random.Random(levels)
    sizes = {"a": 1, "b": 8, "c": 9, "d": 64, "e": 65, "f": 600, "g": 2, "h": 3, "é": 5, "": 4, None: 20}
    rows = [(rng.randrange(10**9), rng.choice(["Text", "text", "", None, "Ünï Köde", "Long " * 3000]), lang, rng.choice(["s", "", None]), rng.choice([None, 5])) for lang, n in sizes.items() for _ in range(n)]
    rows += [(7, "A", "b", "s", 1)] * 3 + [(7, "B", "b", "s", 1), (None, "X", "b", "s", 1), (None, "Y", "b", "s", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "p", b"t", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, path string, top binary, pos int")
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.row_digest(*(text if c == "text" else F.col(c) for c in merkle.FIELDS)))
    got = [tuple(r) for r in merkle.verify(merkle.manifest(df, altered=changed, levels=levels)).collect()]
    assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one = merkle.verify(merkle.manifest(spark.createDataFrame([(1, "x", None, None, None)], schema))).collect()
    assert [tuple(r) for r in one] == plain_manifest([(1, "x", None, None, None)]) and one[0].leaf == one[0].root
    assert merkle.verify(merkle.manifest(spark.createDataFrame([], schema))).collect() == []


def test_chains_that_run_on_over_short_phrases_keep_their_passage(spark):
    """Two documents share 60 words and then, every 20 words, a phrase of 9; a third one has the 60 words alone."""
    from lattica.llm import chaining

    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared, phrases = [word() for _ in range(60)], [[word() for _ in range(9)] for _ in range(20)]
    other = lambda n: [word() for _ in range(n)]
    tail = lambda: [w for p in phrases for w in [*other(11), *p]]
    rows = [(1, " ".join([*other(30), *shared, *tail()])), (2, " ".join([*other(20), *shared, *tail(), *other(5)])), (3, " ".join([*other(40), *shared, *other(40)])), (4, " ".join(other(200)))]
    got = {r.doc_id: (r.n_links, r.links) for r in chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, []), 2: (2, [1]), 3: (2, [1, 2]), 4: (0, [])}


def test_stretches_are_alike_and_miss_none():
    from lattica.llm import chaining

    rng = random.Random(32)
    for _ in range(60):
        a, b = [], []
        for _ in range(rng.randrange(1, 6)):
            same = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 8, 30, 60]))]
            a += [*(f"a{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 5, 25]))), *same]
            b += [*(f"b{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 5, 25]))), *same]
        found = chaining.stretches(a, b)
        assert all(min(n, m) >= 50 and chaining.similarity(a[i : i + n], b[j : j + m]) >= 0.8 for i, n, j, m in found)
        assert all(p[0] + p[1] <= q[0] and p[2] + p[3] <= q[2] for p, q in zip(found, found[1:]))
        long = [r for r in chaining.equal_runs(a, b) if r[2] >= 50]
        assert all(any(i <= r[0] and r[0] + r[2] <= i + n for i, n, _, _ in found) for r in long)


def test_pii_plans_stay_small(spark):
    """What a surrogate is drawn from stands in the plan once, not once a digit of a card and a place of a text."""
    from lattica.llm import pii

    rows = spark.createDataFrame([("card", "4111 1111 1111 1111")], "kind string, value string")
    drawn = rows.select(pii.surrogate(F.col("kind"), F.col("value"), F.lit(0), "key").alias("s"))
    assert len(drawn._jdf.queryExecution().optimizedPlan().toString()) < 30_000


def test_materialized_tables_leave_no_shuffle_and_can_go(spark, tmp_path):
    """A write's shuffle files go with it, what was set stays set; a table that is let go leaves no file."""
    from pathlib import Path

    from lattica.session import CLEANUP, materialize, release, shared_dir

    before = spark.conf.get(CLEANUP, None)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in (manager.getAllFiles().apply(i) for i in range(manager.getAllFiles().size())) if f.getName().endswith(".data")}
    old = files()
    out = materialize(spark.range(10_000).repartition(3, "id"), "let-go")
    for _ in range(50):
        left = files() - old
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP, None) == before and out.count() == 10_000
    folder = Path(out.materialized_at.removeprefix("file:").replace("//", "/"))
    assert folder.is_dir() and out.materialized_at.startswith(shared_dir(spark))
    release(out)
    assert not folder.exists()
