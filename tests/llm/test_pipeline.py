"""The pipeline's stages in order, each against its operator's plain rule, over a small folder of tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import one_edit, plain_contamination, plain_fingerprint, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        words = prose(i, 60).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "zqvk" + rng.choice("abcdef"))
        rows.append((i, "\n".join([" ".join(words[:30]), " ".join(words[30:]), "a boilerplate line of some length"]), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(300, rows[1][1], "en", "s", 1), (301, prose(1, 60) + " and more", "en", "s", 1), (302, "x " + prose(900, 30), "en", "s", 1), (303, None, None, None, None), (304, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(900, 30)), (2, "never seen here at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    before = spark.read.parquet(f"{folder}/documents.parquet")
    columns, got = before.columns, {}
    now = before
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder).cache()
        got[name] = {r.doc_id: r for r in now.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns
    texts = lambda name: {i: r.text for i, r in got[name].items()}
    clean = {i for i in range(240) if i % 6} | {300, 301, 302, 303, 304}
    assert len(set(texts("toxicity")) ^ clean) <= 4
    lines, first = [], {}
    for i, t in sorted(texts("toxicity").items()):
        kept = []
        for line in t.split("\n") if t is not None else []:
            known = any(line == o or (min(len(line), len(o)) >= 20 and one_edit(line, o)) for o in lines)
            if not known or not re.search(r"\w", line):
                kept.append(line)
            lines.append(line)
        first[i] = "\n".join(kept) if t is not None else None
    assert texts("line dedup") == {i: t for i, t in first.items() if (t or "").strip() or not (texts("toxicity")[i] or "").strip()}
    fps = {i: plain_fingerprint(t) for i, t in first.items() if i in texts("line dedup")}
    stay = {i for i in fps if not any(j < i and (fps[i] ^ fps[j]).bit_count() <= 2 for j in fps)}
    assert set(texts("simhash near-dedup")) == stay
    dirty = plain_contamination([(i, t) for i, t in texts("simhash near-dedup").items()], [(1, prose(900, 30)), (2, "never seen here at all")])
    assert set(texts("benchmark decontamination")) == {i for i in stay if not dirty[i][3]} and 302 not in texts("benchmark decontamination")
    assert set(got["byte-level bpe"]) == set(texts("benchmark decontamination"))
    assert all(r.n_tokens == len(r.ids) for r in got["byte-level bpe"].values())
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()} == {(r.doc_id, r.ids_sha256) for r in got["byte-level bpe"].values()}
    assert now.select(F.max("n_tokens")).first()[0] > 0


def test_stages_on_odd_tables(spark, folder):
    """Empty tables, nulls in every column, and columns named like the operators' own."""
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    clashing = {c: F.lit(7) for c in ("score", "component", "lost", "term", "pos", "had_words", "fp", "ids", "n", "x", "line", "uid", "chunk", "low", "part")}
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, None), (2, "", None, None, 0), (3, "some words " * 30, None, "s", None), (3, "some words " * 30, None, "s", None)], plain.schema)
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        assert stage(spark, plain.limit(0), folder).count() == 0
        got = stage(spark, odd.withColumns(clashing), folder)
        assert last or got.columns == odd.withColumns(clashing).columns
        rows = got.collect()
        assert any(r.doc_id == 1 for r in rows) and any(r.doc_id is None for r in rows)
        assert last or all(r.score == 7 and r.lost == 7 and r.had_words == 7 for r in rows)
