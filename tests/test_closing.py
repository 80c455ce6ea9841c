"""Closed reviews, settled rules, selections, template rules and the stored index on small tables."""

import pytest
from pyspark.sql import functions as F

from docfacts.operators import learning, picks, queue, review, search, templates
from docfacts.plans import closing
from docfacts.sources import acquisition

CHANGES = "document_id long, name string, item_index int, value string, corrected_value string, removed boolean"


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("c")).first()["c"]


def test_review_payloads(spark):
    docs = spark.createDataFrame([(1, "SAVE"), (2, "SAVE"), (3, "DISCARD"), (4, None)], "id long, action string")
    rows = [(1, "a", None, "x", "y", False), (1, "b", 0, "i", None, True), (1, "c", None, "x", "x", False), (2, "a", None, "x", None, False), (3, "a", None, None, "y", None)]
    got = {r["id"]: (r["decision"], [tuple(c) for c in r["changes"]]) for r in review.review_payloads(docs, spark.createDataFrame(rows, CHANGES)).collect()}
    assert got == {1: ("CORRECT", [(-1, "a", "x", "y"), (0, "b", "i", "")]), 2: ("APPROVE", []), 3: ("REJECT", [(-1, "a", None, "y")]), 4: ("APPROVE", [])}
    assert review.review_payloads(docs.limit(0), spark.createDataFrame([], CHANGES)).count() == 0


@pytest.mark.parametrize(("proposal", "edit", "date", "want"), [
    ("a", " a ", False, None), ("a", None, False, None), ("a", "", False, ""), (None, " ", False, None), (None, "b", False, "b"),
    ("2025-12-16", "16/12/2025", True, None), (None, "16/12/2025", True, "2025-12-16"), (None, "3/5/2021 (8 ore), 4/5/2021", True, "3/5/2021 (8 ore), 4/5/2021"),
])
def test_resolved_edits(spark, proposal, edit, date, want):
    assert one(spark, review.resolve_edit(F.col("p"), F.col("e"), date), "p string, e string", (proposal, edit)) == want


@pytest.mark.parametrize(("origin", "value", "corrected", "edit", "want"), [
    ("MANUAL", "", "a", None, ("DELETE", None)), ("MANUAL", "", "a", " ", ("DELETE", None)), ("MANUAL", "", "a", "a ", ("NONE", None)), ("MANUAL", "", None, "b", ("CORRECT", "b")),
    ("ENGINE", "a", None, None, ("RESET", None)), ("ENGINE", "a", "b", " a", ("RESET", None)), ("ENGINE", "a", None, "", ("REMOVE", None)), ("ENGINE", None, None, "c", ("CORRECT", "c")),
])
def test_resolved_items(spark, origin, value, corrected, edit, want):
    got = one(spark, review.resolve_item_edit(*map(F.col, "ovce")), "o string, v string, c string, e string", (origin, value, corrected, edit))
    assert tuple(got) == want


RULES = "rule_id long, kind string, scope string, status string, document_type string, template string, active_at long"


def settled(spark, rule, effects, touched=True):
    """The status after settling one rule with effects at times 0, 1, ..."""
    rows = [(1, {"+": "POSITIVE", "-": "NEGATIVE"}[e], i, i) for i, e in enumerate(effects)]
    log = spark.createDataFrame(rows, "rule_id long, effect string, at long, seq long")
    asked = spark.createDataFrame([(1,), (1,)] if touched else [(2,)], "rule_id long")
    out = learning.settle(spark.createDataFrame([(1, *rule)], RULES), log, asked).collect()
    return out[0]["after"] if out else rule[2]


@pytest.mark.parametrize(("kind", "scope", "status", "active_at", "effects", "want"), [
    ("EXTRACTION_ANCHOR", "CLASS", "CANDIDATE", None, "++", "CANDIDATE"), ("EXTRACTION_ANCHOR", "CLASS", "CANDIDATE", None, "+++", "ACTIVE"), ("EXTRACTION_ANCHOR", "CLASS", "CANDIDATE", None, "+++-", "CANDIDATE"),
    ("EXTRACTION_ANCHOR", "TEMPLATE", "CANDIDATE", None, "++", "ACTIVE"), ("EXTRACTION_ANCHOR", "TEMPLATE", "CANDIDATE", None, "++-", "CANDIDATE"), ("TEMPLATE_TYPE", "TEMPLATE", "CANDIDATE", None, "+++", "ACTIVE"),
    # three confirmations, two denials, reactivated by hand after them, one more confirmation: only what came after counts
    ("EXTRACTION_ANCHOR", "CLASS", "ACTIVE", 4, "+++--+", "ACTIVE"), ("EXTRACTION_ANCHOR", "CLASS", "ACTIVE", 4, "+++--+--", "SUSPENDED"), ("EXTRACTION_ANCHOR", "CLASS", "ACTIVE", 4, "+++---", "ACTIVE"),
    ("EXTRACTION_ANCHOR", "CLASS", "ACTIVE", None, "+-+-+", "SUSPENDED"), ("EXTRACTION_ANCHOR", "CLASS", "ACTIVE", None, "+-+-", "ACTIVE"), ("TEMPLATE_TYPE", "TEMPLATE", "ACTIVE", 1, "+-++", "ACTIVE"), ("TEMPLATE_TYPE", "TEMPLATE", "ACTIVE", 0, "+-++", "SUSPENDED"),
    ("EXTRACTION_ANCHOR", "CLASS", "REJECTED", None, "++++", "REJECTED"), ("EXTRACTION_ANCHOR", "CLASS", "SUSPENDED", None, "++++", "SUSPENDED"), ("EXTRACTION_ANCHOR", "CLASS", "ACTIVE", 0, "", "ACTIVE"),
])
def test_settle(spark, kind, scope, status, active_at, effects, want):
    assert settled(spark, (kind, scope, status, "d", "t", active_at), effects) == want


def test_settle_says_what_to_read_again(spark):
    rules = spark.createDataFrame([(1, "EXTRACTION_ANCHOR", "CLASS", "CANDIDATE", "d1", None, None), (2, "TEMPLATE_TYPE", "TEMPLATE", "CANDIDATE", "d2", "t2", None), (3, "TEMPLATE_TYPE", "CLASS", "ACTIVE", "d3", None, None)], RULES)
    log = spark.createDataFrame([(r, "NEGATIVE" if r == 3 else "POSITIVE", i, i) for r in (1, 2, 3) for i in range(3)], "rule_id long, effect string, at long, seq long")
    got = sorted(tuple(r) for r in learning.settle(rules, log, rules.select("rule_id")).collect())
    assert got == [(1, "CANDIDATE", "ACTIVE", "RULE_PROMOTED", "document_type", "d1"), (2, "CANDIDATE", "ACTIVE", "RULE_PROMOTED", "template", "t2"), (3, "ACTIVE", "SUSPENDED", "RULE_SUSPENDED", "document_type", "d3")]
    assert learning.settle(rules, log, rules.select("rule_id").limit(0)).count() == 0


def test_effects_are_one_a_document(spark):
    """Ten confirmations of one document are one; a denial overrides, at the time of its first event."""
    rows = [(1, 7, "POSITIVE", i, i) for i in range(10)] + [(1, 8, e, i, i) for i, e in enumerate(("POSITIVE", "NEGATIVE", "POSITIVE", "NEGATIVE"))]
    got = sorted(tuple(r) for r in learning.effects(spark.createDataFrame(rows, "rule_id long, document_key long, effect string, at long, seq long")).collect())
    assert got == [(1, 7, "POSITIVE", 0, 0), (1, 8, "NEGATIVE", 1, 1)]


@pytest.mark.parametrize(("text", "wanted", "want"), [
    ("x A  b\nc y a b c", "a b c", (11, 16)), ("x A  b\nc y", "a b c", (2, 8)), ("𝔘 a.b", "a.b", (2, 5)), ("axb", "a.b", None), ("a", " ", None), (None, "a", None), ("a", None, None), ("città È qui", "CITTÀ  è", (0, 7)),
])
def test_text_range(spark, text, wanted, want):
    got = one(spark, picks.text_range(F.col("t"), F.col("w")), "t string, w string", (text, wanted))
    assert (tuple(got) if got else None) == want


def test_recorded_picks(spark):
    rows = [(1, " Rossi  SRL", "Rossi SRL", "TEXT"), (2, "R0ssi SRL", "Rossi SRL", "OCR"), (3, "R0ssi SRL", "Rossi SRL", "TEXT"), (4, "Bianchi", "Rossi", "OCR"), (5, "a", " ", "OCR"), (6, None, "a", "OCR"), (7, "a", None, "TEXT"), (8, " ", "a", "OCR")]
    got = picks.recorded_picks(spark.createDataFrame(rows, "k int, text string, value string, method string")).collect()
    assert sorted((r["k"], r["text_corrected"]) for r in got) == [(1, False), (2, True)]


def test_lines_under(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    lines = spark.createDataFrame([(1, 1, n, (x, y, 10.0, 10.0)) for n, (x, y) in enumerate([(0.0, 0.0), (9.9, 5.0), (10.0, 0.0), (0.0, 5.1)])] + [(1, 2, 9, (0.0, 0.0, 10.0, 10.0)), (1, 1, 8, None)], f"doc_id long, page int, line int, box {box}")
    drawn = spark.createDataFrame([("p", 1, 1, (0.0, 0.0, 10.0, 10.0))], f"pick string, doc_id long, page int, box {box}")
    assert sorted(r["line"] for r in picks.lines_under(drawn, lines).collect()) == [0, 1]


def test_template_rules(spark):
    f = [f"f{i}" for i in range(10)]
    docs = spark.createDataFrame([(1, "d", "t", f, None), (2, "d", None, f[:9], None), (3, "d", "u", f[:3], "hand"), (4, "e", "t", [], None)], "doc_id long, document_type string, template string, features array<string>, manual_type string")
    rows = [(1, "TEMPLATE_TYPE", "ACTIVE", "TEMPLATE", "old", None, None, "t", f, 1), (2, "TEMPLATE_TYPE", "ACTIVE", "TEMPLATE", "new", None, None, None, f, 2), (3, "TEMPLATE_TYPE", "SUSPENDED", "TEMPLATE", "no", None, None, "t", f, 9),
            (4, "EXTRACTION_ANCHOR", "ACTIVE", "CLASS", "d", "a.b", "for all", None, None, 1), (5, "EXTRACTION_ANCHOR", "ACTIVE", "TEMPLATE", "d", "a.b", "for t", "t", f, 1), (6, "EXTRACTION_ANCHOR", "CANDIDATE", "CLASS", "d", "a.b", "no", None, None, 1)]
    rules = spark.createDataFrame(rows, "rule_id long, kind string, status string, scope string, document_type string, field_id string, label string, template string, features array<string>, updated_at long").withColumn("relation", F.lit("SAME_LINE"))
    assert sorted(tuple(r) for r in templates.remembered_types(docs, rules).collect()) == [(1, "new", 0.74), (2, "new", 0.67), (3, "hand", 1.0), (4, "old", 0.74)]
    assert sorted((r["doc_id"], r["label"]) for r in templates.learned_labels(docs, rules).collect()) == [(1, "for all"), (1, "for t"), (2, "for all"), (2, "for t"), (3, "for all")]


def test_first_page_and_lines(spark):
    lines = F.array(*[F.lit(x) for x in ("Numero: 1", "Data: 2", "Totale: 3")])
    assert one(spark, templates.first_page_fingerprint(lines, F.lit("NATIVE_TEXT"))) and one(spark, templates.first_page_fingerprint(lines, F.lit("OCR"))) is None
    stored = lambda s, t: one(spark, acquisition.page_lines(F.col("l"), F.col("t")), "l array<string>, t string", (s, t))
    assert stored(["x"], "a") == ["x"] and stored([], " a \r\n\n\tb") == ["a", "b"] and stored(None, "a") == ["a"] and stored([], "") == [] and stored(None, None) is None


def test_field_order(spark):
    rows = spark.createDataFrame([(1, n, lab) for n, lab in [("z", "Alfa"), ("u2", "x"), ("a", "beta"), ("u1", "y"), ("n", None)]], "document_id long, name string, label string")
    assert [r["name"] for r in queue.field_order(rows, ["u1", "u2"]).orderBy("place").collect()] == ["u1", "u2", "n", "z", "a"]


def test_stored_index(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "the Cat sat"), (1, 2, "a cat, the category"), (2, 1, "dog 2024 and the 20th cat"), (3, 1, None), (4, 1, "")], "doc_id long, page int, text string")
    rows = search.indexed(pages, spark.createDataFrame([(1, "Perché.pdf"), (2, None)], "doc_id long, name string"))
    search.write_index(rows, str(tmp_path / "index"))
    index, sizes = search.read_index(spark, str(tmp_path / "index"))
    for text in ("cat the", "ca", "perche", "Perché", "20", "2024 dog", "zebra", "", "a", "pdf cat", "cat category"):
        terms = search.query_terms(text)
        assert [(r["doc_id"], round(r["rank"], 9)) for r in search.search_postings(index, sizes, terms).collect()] == [(r["doc_id"], round(r["rank"], 9)) for r in search.search(rows, terms).collect()], text
    plan = search.search_postings(index, sizes, ["cat", "the"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [prefix" in plan and "StringStartsWith(term,cat)" in plan
    later = search.reindexed(rows, search.page_rows(spark.createDataFrame([(1, 1, "bird")], pages.schema)))
    assert {r["doc_id"] for r in search.search(later, ["cat"]).collect()} == {2} and search.search(later, ["bird"]).count() == 1 and search.search(later, ["perche"]).count() == 0
