"""What is moved when labels are probed and documents read again: lines once, never their runs of words; all ways of bringing lines and labels together read the same."""

import re

import pytest
from pyspark.sql import functions as F

from docfacts.functions.text import fold
from docfacts.operators import anchors, extraction

PAGES = [(1, "a", ["Saldo finale: EUR 12,00", "Acconto finale: EUR 5,00"]), (2, "a", ["Saldo finale: EUR 7,50", "Rif. saldo finale: EUR 8,00"]), (3, "b", ["Emessa", "01/02/2020", "emessa 03/02/2020"]), (4, "c", []), (5, "b", ["emessa emessa 04/05/2021"])]
KINDS = [("total", "money", None, None), ("date", "date", None, None)]
LEARNED = [("a", "total", "saldo finale", "same-line", 2), ("b", "date", "emessa", "next-line", 2), ("b", "date", "emessa", "same-line", 2)]


@pytest.fixture(scope="module")
def pages(spark):
    drawn = spark.createDataFrame([(d, 1, "NATIVE_TEXT", "t", t, lines) for d, t, lines in PAGES], "doc_id long, page int, text_source string, document_type string, template string, lines array<string>")
    return drawn.repartition(3)


def moves(df):
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def picks_of(spark):
    rows = [("p", 1, 1, 0, 14, "money"), ("q", 2, 1, 0, 14, "money"), ("r", 3, 1, 1, 0, "date"), ("s", 1, 1, 1, 16, "money"), ("t", 9, 1, 0, 0, "money")]
    return spark.createDataFrame([(*r, None, None, "x") for r in rows], "pick string, doc_id long, page int, line int, column int, type string, format string, scale string, template string")


def test_lines_are_moved_once_and_runs_of_words_never(spark, pages):
    rows = extraction.lines(pages)
    found = anchors.derive_anchors(rows, picks_of(spark), "template")
    assert sorted((r["pick"], r["label"], r["relation"], r["template"]) for r in found.collect()) == [
        ("p", "saldo finale", "same-line", "x"), ("q", "finale", "same-line", "x"), ("r", "emessa", "next-line", "x"), ("s", "acconto finale", "same-line", "x"),
    ]
    assert not any("label" in keys or "pick" in keys for keys in moves(found)) and len(set(moves(found))) <= 2  # before and after adaptive planning
    wanted = spark.createDataFrame([(1, 1, "finale", None, "money", None, None)], "doc_id long, page int, label string, relation string, type string, format string, scale string")
    assert not any("label" in keys for keys in moves(anchors.label_reads(rows, wanted)))


def test_documents_are_read_again_alike(spark, pages, monkeypatch):
    kinds = spark.createDataFrame(KINDS, "field_id string, type string, format string, scale string")
    learned = spark.createDataFrame(LEARNED, "template string, field_id string, label string, relation string, n long")
    documents = pages.select("doc_id", "template")
    got = [anchors.read_again(rows, documents, learned, kinds) for rows in (extraction.lines(pages, "template"), extraction.lines(pages))]
    assert sum("doc_id" in keys for keys in moves(got[0])) == 1  # the readings alone
    monkeypatch.setattr(anchors, "MOST_ANCHORS", 0)
    got.append(anchors.read_again(extraction.lines(pages), documents, learned, kinds))
    first = sorted(map(tuple, got[0].collect()))
    assert first == [(1, "total", "saldo finale", "12.00"), (2, "total", "saldo finale", "7.50"), (3, "date", "emessa", "2020-02-01"), (5, "date", "emessa", "2021-05-04")]
    assert all(sorted(map(tuple, g.collect())) == first for g in got[1:])


def test_places_are_the_runs_of_words(spark):
    texts = ["Fattura n. 1 fattura n 2", "n n n", "nn n", "", "è n", "semifattura n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line int, text string").select("*", fold(F.col("text")).alias("folded"))
    labels = spark.createDataFrame([("fattura n",), ("n",), ("n n",), ("",)], "label string")
    runs = extraction.with_runs(rows, 2).join(labels, "label").select("line", "label", "g")
    assert sorted(map(str, anchors.places(rows.crossJoin(labels)).select("line", "label", "g").collect())) == sorted(map(str, runs.collect()))
