"""The pipeline on the smallest table, stage by stage, and the registered queries."""

import os
import random

import brute
import pytest
from cases import frame

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from touchline.session import materialise

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_every_number_has_a_query():
    names = list(queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(oracle_sql()) <= set(names)


def test_stages_decide_and_keep_the_rest(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, FOLDER), name)
        if name != "packing":
            assert docs.columns == columns and docs.dtypes == before.dtypes
        if name == "language":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect() if any(map(str.isalpha, r.text or ""))}
        if name == "near_copies":
            want = brute.jaccard_components([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in docs.collect()) == sorted(d for d, (_, low) in want.items() if d == low)
        if name == "leaks":
            items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            leaked = {r.doc_id for r in before.collect() if any(x in (r.text or "") for x in items)}
            assert leaked and {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - leaked
        if name == "secrets":
            assert docs.count() == before.count()
            assert all(brute.secrets(r.text)[:3] == (0, 0, 0) and r.n_chars == len(r.text) for r in docs.collect())


def test_awkward_rows_pass_all_stages(spark):
    docs = frame(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, FOLDER), "stage")
    assert docs.count() > 0


def test_empty_table_passes_all_stages(spark):
    docs = frame(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, FOLDER), "stage")
        assert docs.count() == 0 and (name == "packing" or docs.columns == frame(spark).columns)


def test_of_rows_that_differ_in_a_label_only_one_stays_always_the_same(spark):
    rows = [(1, "one two three four five six seven", lang, source) for lang, source in (("bb", "s2"), ("aa", "s9"), ("aa", "s1"))]
    kept = [corpus_pipeline.near_copies(spark, frame(spark, rows[i:] + rows[:i]).repartition(3), FOLDER).collect() for i in range(3)]
    assert all(len(k) == 1 and (k[0].lang, k[0].source) == ("aa", "s1") for k in kept)


def test_verdicts_too_many_to_broadcast_give_the_same(spark, monkeypatch):
    docs = frame(spark)
    stages = {name: stage for name, stage in corpus_pipeline.STAGES if name in ("near_copies", "leaks", "secrets")}
    rows = lambda df: sorted(map(repr, df.collect()))
    few = {name: rows(stage(spark, docs, FOLDER)) for name, stage in stages.items()}
    monkeypatch.setattr(corpus_pipeline, "FEW", -1)
    assert {name: rows(stage(spark, docs, FOLDER)) for name, stage in stages.items()} == few


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_quality_rules", "op6_ngram_jaccard_join"])
def test_query_equals_sql(spark, name):
    import compare

    ok, note = compare.compare(spark, compare.connect(FOLDER), FOLDER, name, queries()[name], oracle_sql()[name])
    assert ok, note


def test_links_equal_sql(spark):
    import compare

    name = "op6_ngram_jaccard_links"
    ok, note = compare.compare(spark, compare.connect(FOLDER), FOLDER, name, queries()[name], oracle_sql()[name])
    assert ok, note


def test_language_stage_follows_its_scores(spark):
    r = random.Random(12)
    usual = lambda a: " ".join(r.choice([a[i : i + 4] for i in range(9)]) for _ in range(60))
    rows = [(i, usual("abcdefghijkl"), "aa", "s") for i in range(60)] + [(100 + i, usual("mnopqrstuvwx"), "bb", "s") for i in range(60)]
    rows += [(200, usual("mnopqrstuvwx"), None, "s"), (201, "漢字仮名交じり文" * 20, "aa", "s"), (202, "ok", None, "s"), (203, "12 ...", "aa", "s")]
    got = {x.doc_id: x.lang for x in corpus_pipeline.language(spark, frame(spark, rows), FOLDER).collect()}
    assert set(got) == {d for d, *_ in rows} - {201, 203} and got[200] == "bb" and got[202] in ("aa", "bb")


def test_nothing_learned_keeps_texts_with_a_letter(spark):
    rows = [(1, "some words", None, "s"), (2, "...", None, "s"), (3, None, None, "s"), (4, "é", None, "s")]
    assert {(x.doc_id, x.lang) for x in corpus_pipeline.language(spark, frame(spark, rows), FOLDER).collect()} == {(1, None), (4, None)}
