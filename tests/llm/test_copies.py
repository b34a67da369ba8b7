"""Repeated rows and texts under one id: no more work than their number, and one result however the rows are dealt."""

import random

import numpy as np

from lattica.llm import chaining, suffixdedup


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def plain_removed(rows):
    """Removed bytes of each (id, text), texts under one id as one document: the earlier start comes first, equal starts are equal."""
    first = {}
    for i, t in rows:
        for k in range(len(t) - 99):
            at = (i is not None, i or 0, k)
            first[t[k : k + 100]] = min(first.get(t[k : k + 100], at), at)
    out = {}
    for i, t in rows:
        gone = {k + d for k in range(len(t) - 99) if first[t[k : k + 100]] != (i is not None, i or 0, k) for d in range(100)}
        out[i, t] = len(gone)
    return out


def test_suffix_dedup_of_texts_under_one_id_is_the_same_however_dealt(spark):
    shared = prose(1, 60)[:311]
    rows = [(1, shared + " " + prose(2, 40)), (1, shared + " " + prose(3, 40)), (1, prose(4, 9) + " " + shared), (2, shared[:200]), (None, shared[50:180]), (None, prose(5, 3) + shared[50:180])]
    want = plain_removed(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for dealt in (frame.coalesce(1), frame.repartition(4), frame.repartition(4, "text")):
        got = suffixdedup.deduplicate(dealt).select("doc_id", "n_bytes", "n_removed").collect()
        assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed) for r in got))) == sorted(str((i, len(t), n)) for (i, t), n in want.items())


def test_suffix_dedup_of_equal_rows_costs_no_more_than_their_number(spark, monkeypatch):
    sizes, write = {}, suffixdedup.materialize

    def counted(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(suffixdedup, "materialize", counted)
    text = prose(6, 300)
    for copies in (50, 500):
        rows = [(7, text)] * copies + [(None, text)] * copies + [(8, prose(7, 20) + text[:400])]
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        removed = {(r.doc_id, r.n_removed) for r in suffixdedup.deduplicate(frame).collect()}
        assert removed == {(None, 0), (7, len(text)), (8, 400)}
        sizes[copies] = sizes["seeds"]
    assert sizes[50] == sizes[500]


def test_chaining_of_a_hot_short_footer_makes_no_pairs(spark, monkeypatch):
    """A footer of 40 words in every document: matches grow with the documents; a passage that goes on from it is found."""
    matches, more = {}, chaining.more_matches

    def counted(*args):
        out = more(*args)
        matches["n"] = out.count()
        return out

    monkeypatch.setattr(chaining, "more_matches", counted)
    footer, tail = prose(11, 40), prose(12, 25)
    seen = {}
    for n in (200, 400):
        rows = [(i, prose(100 + i, 60) + " " + footer + " " + prose(9000 + i, 30)) for i in range(n)]
        rows += [(n + k, prose(20000 + k, 60) + " " + footer + " " + tail + " " + prose(30000 + k, 30)) for k in range(3)]
        got = {r.doc_id: r for r in chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert {i: r.n_links for i, r in got.items() if r.n_links} == {n: 2, n + 1: 2, n + 2: 2}
        assert got[n + 2].links == [n, n + 1]
        seen[n] = matches["n"]
    assert seen[400] <= 2 * seen[200] + 100 and seen[400] < 4000


def test_chaining_makes_the_second_rounds_matches_in_parts(spark, monkeypatch):
    """No write has more than a part of them, none is lost, and the filter stands below the joins that make them."""
    rows, more, sizes = [(i, prose(500 + i, 30) + " " + prose(7, 40) + " " + prose(8 + i % 2, 70)) for i in range(140)], chaining.more_matches, []
    whole, chained = [], chaining.materialize

    def kept(*args):
        whole.append(more(*args))
        return whole[0]

    def written(df, name):
        if whole and name == "chains":
            sizes.append(df.agg({"*": "count"}).first()[0])
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            below = plan[plan.index("Join") :]
            assert below.count("pmod(xxhash64(doc_id") >= 2
        return chained(df, name)

    monkeypatch.setattr(chaining, "more_matches", kept)
    monkeypatch.setattr(chaining, "materialize", written)
    monkeypatch.setattr(chaining, "cliques_of", lambda found: found.selectExpr("doc_id", "CAST(NULL AS long) AS c1", "CAST(NULL AS long) AS c2").limit(0))
    got = {r.doc_id: r for r in chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(sizes) == chaining.PARTS and max(sizes) < sum(sizes) / 2
    assert all(r.n_links == 69 and r.class_id == r.doc_id % 2 for r in got.values())


def test_chaining_of_phrases_written_again_and_again_makes_no_pairs(spark, monkeypatch):
    """Documents that repeat a phrase are linked and counted without being matched pair by pair; also a ragged repetition, not a short one."""
    rng, matches, more = random.Random(5), [], chaining.more_matches

    def counted(*args):
        matches.append(more(*args))
        matches[-1] = matches[-1].count()
        return more(*args)

    monkeypatch.setattr(chaining, "more_matches", counted)
    held = [rng.sample(["der", "die", "das", "ein", "und", "zu", "mit", "von", "auf"], 5) for _ in range(60)]
    rows = [(i, prose(700 + i, 12) + "".join(" " + f"{w} " * rng.randint(60, 200) + prose(100 * i + len(w), 12) for w in words)) for i, words in enumerate(held)]
    rows.append((100, prose(1, 60) + " der" * 30 + " und" + " der" * 30 + " " + prose(2, 60)))
    rows.append((101, prose(3, 60) + " die" * 40 + " " + prose(4, 60)))
    turns = ["tick tack tock"] * 25
    rows += [(200 + k, prose(50 + k, 20) + " " + " ".join(" ".join(turns).split()[k:]) + " " + prose(60 + k, 20)) for k in range(3)]
    rows += [(210, prose(70, 20) + " " + "tack tick tock " * 25)]
    want = {i: sum(bool(set(held[i]) & set(other)) for other in held) - 1 + ("der" in held[i]) for i in range(60)}
    want |= {100: sum("der" in words for words in held), 101: 0, 200: 2, 201: 2, 202: 2, 210: 0}
    for hot in (chaining.HOT, 16):
        monkeypatch.setattr(chaining, "HOT", hot)
        got = {r.doc_id: r for r in chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert {i: r.n_links for i, r in got.items()} == want
        assert all(got[i].class_id == 0 for i in [*range(60), 100]) and {i: got[i].class_id for i in (101, 200, 201, 202, 210)} == {101: 101, 200: 200, 201: 200, 202: 200, 210: 210}
        assert all(r.links and r.n_words >= 50 for i, r in got.items() if i not in (0, 101, 200, 210))
    assert max(matches) < 10_000


def test_chaining_proves_links_of_a_family_by_what_it_shares_with_one_document(spark, monkeypatch):
    """Copies too much edited for a clique are neither matched nor aligned with each other, and all linked."""
    rng, matches, more = random.Random(8), [], chaining.more_matches
    words = prose(77, 300).split()

    def edited(share, k):
        # a sentence of its own, which no small step gets over, and words edited here and there
        at = 20 + 4 * k
        mine = [prose(5000 + 300 * k + i, 1) if rng.random() < share else w for i, w in enumerate(words)]
        return " ".join(mine[:at] + prose(90000 + k, 6).split() + mine[at + 6 :])

    def counted(*args):
        out = more(*args)
        matches.append(out.count())
        return out

    monkeypatch.setattr(chaining, "more_matches", counted)
    rows = [(i, " ".join(words[: 290 + i])) for i in range(5)] + [(5 + k, edited(0.055, k)) for k in range(40)]
    got = {r.doc_id: r for r in chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.n_links == 44 and r.class_id == 0 for r in got.values())
    assert matches[0] < 1000


def test_chains_of_many_blocks_are_the_trees_chains(monkeypatch):
    """A phrase of 13 words again and again in both texts: the scores column by column are those of the trees."""
    x, y = np.repeat(np.arange(24) * 13, 24), np.tile(np.arange(24) * 13 + np.arange(24) // 9, 24)
    told = []
    for way in (chaining._by_trees, chaining._by_columns):
        scored = []
        monkeypatch.setattr(chaining, "_by_trees", lambda *a, f=way: scored.append(f(*a)) or scored[0])
        monkeypatch.setattr(chaining, "MANY", 1 << 30)
        chaining.chains(x, y)
        told.append(scored[0][0])
        monkeypatch.undo()
    assert np.allclose(*told)
