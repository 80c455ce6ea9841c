"""The index in segments: ranks of a fresh index after each change, what is read, broken-off writes, compaction."""

import random

import pytest
from pyspark.sql import functions as F

from docfacts.functions.text import folded_words, words_column
from docfacts.operators import search, segments

WORDS = "the cat category dog 2024 20th oner ones perche zebra".split()
ASKED = ("cat the", "ca", "20", "one dog", "zebra", "nothing", "")


def table(spark, docs):
    """docs: doc_id -> {page: text}."""
    return spark.createDataFrame([(d, p, t) for d, pages in docs.items() for p, t in pages.items()], "doc_id long, page int, text string")


def ranks(df):
    return {r["doc_id"]: round(r["rank"], 9) for r in df.collect()}


def agree(spark, path, docs):
    rows, (index, sizes) = search.page_rows(table(spark, docs)).cache(), segments.read(spark, path)
    for text in ASKED:
        terms = search.query_terms(text)
        assert ranks(search.search_postings(index, sizes, terms, None)) == ranks(search.search(rows, terms, None)), text


def test_changes(spark, tmp_path):
    path, r, docs = str(tmp_path / "index"), random.Random(1), {}
    for step in range(4):
        changed = {d: {p: None if r.random() < 0.1 else " ".join(r.choices(WORDS, k=r.randrange(9))) for p in range(r.randrange(1, 3))} for d in r.sample(range(40), 40 if step == 0 else 6)}
        gone = r.sample(sorted(docs), 4) if docs else []
        gone = [d for d in gone if d not in changed]
        deleted = spark.createDataFrame([(d,) for d in [*gone, 777]], "doc_id long") if step else None
        assert segments.add(spark, path, search.page_rows(table(spark, changed)), deleted) == step
        docs = {d: p for d, p in {**docs, **changed}.items() if d not in gone}
        if step in (1, 3):
            agree(spark, path, docs)
    segments.compact(spark, path, str(tmp_path / "new"))
    agree(spark, str(tmp_path / "new"), docs)
    assert segments.last_segment(spark, str(tmp_path / "new")) == 0 and segments.last_segment(spark, path) == 3
    assert spark.read.parquet(f"{path}/postings/segment=2").select("doc_id").distinct().count() <= 6  # only what changed


def test_broken_off_segment_and_odd_rows(spark, tmp_path):
    path = str(tmp_path / "index")
    index, sizes = segments.read(spark, path)
    assert search.search_postings(index, sizes, ["cat"]).collect() == []
    rows = table(spark, {1: {1: "cat"}, 2: {1: "cat cat", 2: None}, None: {1: "cat"}})
    segments.add(spark, path, search.page_rows(rows))
    stray = search.postings(search.page_rows(table(spark, {9: {1: "cat dog dog"}, 1: {1: "cat"}})))
    segments.write(stray, path, "postings", 1)
    segments.write(stray.select("doc_id").distinct(), path, "touched", 1)
    index, sizes = segments.read(spark, path)
    assert set(ranks(search.search_postings(index, sizes, ["cat"]))) == {1, 2, None} and sizes.first()["n_rows"] == 4
    assert segments.add(spark, path, search.page_rows(table(spark, {1: {1: "dog"}}))) == 1  # the stray one is written over
    index, sizes = segments.read(spark, path)
    assert set(ranks(search.search_postings(index, sizes, ["cat"]))) == {2, None} and set(ranks(search.search_postings(index, sizes, ["dog"]))) == {1}
    assert sizes.first()["n_rows"] == 4


@pytest.mark.parametrize("few", [True, False])
def test_only_words_asked_for_are_read(spark, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(segments, "BROADCAST_ROWS", 0)
    path = str(tmp_path / "index")
    for docs in ({1: {1: "cat the"}, 2: {1: "the cats"}}, {2: {1: "the dog"}}):
        segments.add(spark, path, search.page_rows(table(spark, docs)))
    index, sizes = segments.read(spark, path)
    plan = search.search_postings(index, sizes, ["cat", "the"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,cat)" in plan and ("BroadcastHashJoin" in plan or not few)
    assert set(ranks(search.search_postings(index, sizes, ["cat", "the"]))) == {1}


def test_words_are_those_of_the_whole_folding(spark):
    texts = ["The quick--Brown fox", "Perché no, e\u0301te\u0301!", "stra\u00dfe \u00d7 \u00e6on \u0130x na\u00efve", "\u4e2d\u6587 20th caf\u00c9\u4e2db", "\u0301", "\u1e9e\u1ea1b", "  ", "", "---", "a\n\tb", "\U0001d400x", None]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    for r in rows.select("text", folded_words(F.col("text")).alias("want"), words_column(F.col("text")).alias("got")).collect():
        assert r["got"] == r["want"], r["text"]


def test_a_segments_postings_stay_where_their_documents_are(spark, monkeypatch, tmp_path):
    plans = {}

    def write(df, path, part, segment):
        plans[part] = df._jdf.queryExecution().executedPlan().toString()
        df.write.mode("overwrite").parquet(f"{path}/{part}/segment={segment}")

    monkeypatch.setattr(segments, "write", write)
    pages = table(spark, {i: {1: f"the cat {i}"} for i in range(50)})
    segments.add(spark, str(tmp_path / "index"), search.page_rows(search.spread(pages)))
    assert plans["postings"].count("Exchange") == 1 and plans["postings"].count("split(") == 1  # folded once
