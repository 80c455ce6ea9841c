"""The single-label probe and anchors from selections on small pages."""

import pytest
from pyspark.sql import functions as F

from docfacts.operators import anchors, extraction


def rows_of(spark, pages):
    df = spark.createDataFrame([(d, p, "NATIVE_TEXT", "t", lines) for d, p, lines in pages], "doc_id long, page int, text_source string, document_type string, lines array<string>")
    return extraction.lines(df)


WANTED = "doc_id long, page int, label string, relation string, type string, format string, scale string"


@pytest.mark.parametrize(("lines", "label", "relation", "kind", "want"), [
    (["Saldo finale: EUR 12,00", "Acconto finale: EUR 5,00"], "finale", None, "money", [(0, 0, "12.00"), (1, 1, "5.00")]),
    (["Saldo finale: EUR 12,00", "Acconto finale: EUR 5,00"], "saldo finale", None, "money", [(0, 0, "12.00")]),
    (["Finale", "EUR 7,50"], "finale", None, "money", [(0, 1, "7.50")]), (["Finale", "EUR 7,50"], "finale", "same-line", "money", []), (["Finale: EUR 1,00", "EUR 7,50"], "finale", "next-line", "money", []),
    (["Semifinale: EUR 7,50"], "finale", None, "money", []), (["Città Emessa: 01/02/2020 emessa 03/02/2020"], "emessa", None, "date", [(0, 0, "2020-02-01"), (0, 0, "2020-02-03")]),
    (["la ditta: Rossi", "ditta: Bianchi"], "ditta", None, "string", [(1, 1, "Bianchi")]), (["Finale"], "finale", None, "money", []), ([], "finale", None, "money", []),
])
def test_label_reads(spark, lines, label, relation, kind, want):
    rows = rows_of(spark, [(1, 1, lines), (2, 1, ["Finale: EUR 99,00", "emessa 01/01/2001"])])
    wanted = spark.createDataFrame([(1, 1, label, relation, kind, None, None)], WANTED)
    assert sorted((r["line"], r["value_line"], r["value"]) for r in anchors.label_reads(rows, wanted).collect()) == want


def picked(spark, lines, line, text, kind):
    rows = rows_of(spark, [(1, 1, lines)])
    picks = spark.createDataFrame([("p", 1, 1, line, lines[line].find(text), kind, None, None)], "pick string, doc_id long, page int, line int, column int, type string, format string, scale string")
    out = anchors.derive_anchors(rows, picks).collect()
    return [(r["label"], r["relation"]) for r in out]


@pytest.mark.parametrize(("lines", "line", "text", "kind", "want"), [
    (["Saldo finale: EUR 12,00", "Acconto finale: EUR 5,00"], 0, "EUR 12", "money", [("saldo finale", "same-line")]), (["Totale EUR 12,00", "Totale EUR 5,00"], 0, "EUR 12", "money", []),
    (["Codice pratica", "AB12"], 1, "AB12", "identifier", [("pratica", "next-line")]), (["AB12"], 0, "AB12", "identifier", []), (["Data consegna 01/02/2020", "Data ordine 03/02/2020"], 0, "01/02", "date", [("consegna", "same-line")]),
    (["Emessa 01/02/2020 e 03/02/2020"], 0, "03/02", "date", []),
])
def test_derive_anchors(spark, lines, line, text, kind, want):
    assert picked(spark, lines, line, text, kind) == want


def test_learned_anchor_is_the_most_supported(spark):
    rows = [("t", "f", "a b", "same-line")] * 2 + [("t", "f", "cd", "same-line")] * 2 + [("t", "g", "x", "next-line"), ("u", "f", "z", "same-line"), ("u", "f", "z", "same-line")]
    out = anchors.learned_anchors(spark.createDataFrame(rows, "template string, field_id string, label string, relation string")).collect()
    assert sorted(tuple(r) for r in out) == [("t", "f", "cd", "same-line", 2), ("u", "f", "z", "same-line", 2)]


def test_probe_plan_has_no_nested_loop(spark):
    rows, wanted = rows_of(spark, [(1, 1, ["a: 1"])]), spark.createDataFrame([(1, 1, "a", None, "identifier", None, None)], WANTED)
    plan = anchors.label_reads(rows, wanted.withColumn("k", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
