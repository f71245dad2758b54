"""The corpus pipeline over the small table: every stage's decisions, checked on its own input."""

import re
from collections import defaultdict

import corpus_pipeline
from parallaxis.llm import pii

from .test_jaccard import brute
from .test_quality import base


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).persist()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = ({r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in docs.collect()})
    before, after = seen["language_id"]
    assert {i: t for i, t in before.items() if t and re.search(r"[^\W\d_]", t)} == after
    before, after = seen["quality_rules"]
    good = {i: t for i, t in before.items() if not (base(t)[0] < 50 or 100 * base(t)[4] > 50 * base(t)[0])}
    assert after == good, "no line is common enough here to deplete a document"
    before, after = seen["near_duplicates"]
    assert set(after) == {c for _, _, c in brute(list(before.items()))} and after.items() <= before.items()
    before, after = seen["personal_data"]
    assert set(before) == set(after) and not [t for t in after.values() if re.search(r"[A-Za-z0-9]@[a-z0-9-]+\.[a-z]", t)]
    rows = corpus_pipeline.pack(spark, docs, sf).collect()
    windows = defaultdict(int)
    for r in rows:
        windows[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in rows} == set(after) and max(windows.values()) <= 1024
    assert pii.KINDS[:4] == ("email", "ip", "card", "phone")


def test_run_is_the_stages_in_turn(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "personal_data", "pack"]
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() > 50


def test_quality_rules_take_common_lines_out_of_the_texts(spark):
    line = "All rights reserved by the owners of this site"
    rows = [(i, f"{line}\n" + " ".join(f"{i}w{k}" for k in range(60)), "en", "host", 1) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert len(got) == 80 and not [r["doc_id"] for r in got if line in r["text"]]
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_one_row_of_each_group_stays_whatever_its_ids(spark):
    text = lambda k: " ".join(f"{k}w{n}" for n in range(60))
    rows = [(7, text(0)), (7, text(0)), (3, text(0) + " more"), (None, text(0)), (None, text(1)), (None, text(1)), (5, text(2)), (5, text(3)), (None, "few words")]
    docs = spark.createDataFrame([(*r, "en", "host", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(3, text(0) + " more"), (None, text(1)), (5, text(2)), (5, text(3)), (None, "few words")], key=repr)


EDGES = "doc_id long, text string, lang string, source string, n_chars long, row long, kept boolean, spans string"


def test_stages_on_nulls_repeats_and_clashing_names(spark):
    words = lambda k: " ".join(f"word{'abcdefgh'[k]}{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(80))
    rows = [(1, words(1), "en", "a", 5), (1, words(1), "en", "a", 5), (None, words(2), None, None, None), (None, None, None, None, None), (3, "", "en", "a", 0), (4, "123 !", "en", "a", 5), (5, words(3) + " mail me@x.org", "fr", "b", 9), (6, "x" * 100_000, "fr", "b", 1), (7, words(4) * 100, "en", "a", 1)]
    docs = spark.createDataFrame([(*r, 9, True, "clash") for r in rows], EDGES).repartition(3)
    docs = corpus_pipeline.language_id(spark, docs, "")
    assert sorted(map(repr, (r["doc_id"] for r in docs.collect()))) == sorted(map(repr, (1, 1, None, 5, 6, 7)))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs.withColumn("row", docs.doc_id).withColumn("kept", docs.doc_id.isNull()).withColumn("spans", docs.text), "")
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    out = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(out) == {1, None, 5} and docs.count() == 3 and out[5].endswith("mail [EMAIL]")
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == {1, None, 5}


def test_stages_on_an_empty_table_and_without_labels(spark):
    docs = spark.createDataFrame([], EDGES)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
    rows = [(1, "some text", None, "a", 9), (2, "12 -", None, "a", 4)]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert [r["doc_id"] for r in got.collect()] == [1]
    assert corpus_pipeline.language_id(spark, spark.createDataFrame([(1, None)], "doc_id long, lang string"), "").count() == 0
