"""Operators on small literal tables."""

from datetime import datetime

from pyspark.sql import functions as F

from docfacts.operators import extraction, learning, review, search, templates
from docfacts.sources import registry


def page(spark, lines, source="NATIVE_TEXT"):
    return spark.createDataFrame([(1, 1, source, "accounting.fattura", lines)], "doc_id long, page int, text_source string, document_type string, lines array<string>")


def read(spark, lines, source="NATIVE_TEXT"):
    return {r["field_id"]: r for r in extraction.facts(page(spark, lines, source), spark).collect()}


def test_same_line_next_line_and_ocr(spark):
    got = read(spark, ["Fattura n. 12/A", "Totale documento", "EUR 10,00"])
    assert (got["document.number"]["values"], got["document.number"]["status"]) == (["12/A"], "AUTO_ACCEPTED")
    assert (got["money.total"]["values"], got["money.total"]["confidence"], got["money.total"]["status"]) == (["10.00"], 0.8, "NEEDS_REVIEW")
    assert got["document.issue_date"]["status"] == "MISSING"
    assert read(spark, ["Fattura n. 12/A"], "OCR")["document.number"]["confidence"] == 0.75


def test_sections_decide_between_parties(spark):
    got = read(spark, ["Fornitore", "Partita IVA: 00743110157", "Cliente", "P. IVA: 01234567897"])
    assert got["issuer.vat_number"]["values"] == ["00743110157"] and got["recipient.vat_number"]["values"] == ["01234567897"]


def test_outside_a_section_two_fields_share_and_conflict(spark):
    got = read(spark, ["Partita IVA: 00743110157"])
    assert got["issuer.vat_number"]["status"] == got["recipient.vat_number"]["status"] == "CONFLICT"


def test_bilingual_labels(spark):
    got = read(spark, ["DESTINATARIO/RECIPIENT Mario Rossi SESSO/SEX M", "Data di emissione / Date of issue 01/02/2024"])
    assert got["recipient.name"]["values"] == ["Mario Rossi"] and got["document.issue_date"]["values"] == ["2024-02-01"]
    below = read(spark, ["Destinatario/Recipient", "Mario Rossi"])["recipient.name"]
    assert below["values"] == ["Mario Rossi"] and below["confidence"] == 0.8


def test_amounts_in_columns_are_left_alone(spark):
    assert read(spark, ["Totale documento 2.051,00            205,10"])["money.total"]["status"] == "MISSING"


def test_citations_and_rivals(spark):
    got = read(spark, ["Rif. fattura n. 99", "Fattura n. 12", "Totale documento: 1,00", "Totale documento: 2,00"])
    assert got["document.number"]["values"] == ["12"] and got["money.total"]["status"] == "CONFLICT"


def test_learned_labels_win(spark):
    learned = spark.createDataFrame([("accounting.fattura", "money.total", "Netto a pagare", 1)], "document_type string, field_id string, label string, tier int")
    rows = extraction.facts(page(spark, ["Totale documento: 1,00", "Netto a pagare: 2,00"]), spark, learned).where("field_id = 'money.total'").collect()
    assert rows[0]["values"] == ["2.00"]


def test_failed_validators_lower_confidence(spark):
    got = read(spark, ["IBAN: IT61X0542811101000000123456"])["payment.iban"]
    assert got["errors"] == ["INVALID_IBAN"] and got["confidence"] == 0.67 and got["status"] == "NEEDS_REVIEW"


def test_catalogue_is_sound(spark):
    assert registry.missing_references(registry.profiles(spark), registry.fields(spark)).count() == 0


def test_template_features(spark):
    lines = ["Via Roma 1", "Fattura n: 12", "ACME S.r.l.", "Verbale del 12/03/2024", "123"]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select(templates.feature(F.col("x")).alias("f"))
    assert [r["f"] for r in df.collect()] == [None, "label:fattura n", None, "text:verbale del", None]


def test_similarity_join_finds_all_pairs(spark):
    sets = {1: "abcde", 2: "abcdf", 3: "xyz", 4: "abcdefgh", 5: "xyzw"}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "doc_id long, features array<string>")
    got = {(r["doc_id"], r["rule_id"]) for r in templates.similar_to_rules(df, df.withColumnRenamed("doc_id", "rule_id"), 0.6).collect()}
    assert got == {(a, b) for a in sets for b in sets if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.6}


def test_search_terms():
    assert search.query_terms("Fattura, n. 12-2024 à") == ["fattura", "12", "2024"]


def test_merge_items_appends_orphans(spark):
    old = spark.createDataFrame([(1, 0, "a", "A", "ENGINE"), (1, 2, "c", "C", "ENGINE"), (1, 3, None, "D", "REVIEWER")], "field_id long, item_index int, value string, corrected_value string, origin string")
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "field_id long, item_index int, value string")
    rows = sorted((r["item_index"], r["value"], r["corrected_value"], r["origin"]) for r in review.merge_items(old, new).collect())
    assert [(i, c, o) for i, _, c, o in rows] == [(0, "A", "ENGINE"), (1, None, "ENGINE"), (2, "C", "REVIEWER"), (3, "D", "REVIEWER")]


def test_rollback_restores_only_what_is_in_force(spark):
    at = datetime(2024, 1, 1)
    rules = spark.createDataFrame([(1, "SUSPENDED"), (2, "ACTIVE")], "rule_id long, status string")
    actions = spark.createDataFrame([(1, "RULE_SUSPENDED", "ACTIVE", "SUSPENDED", at, 1, None), (2, "RULE_SUSPENDED", "ACTIVE", "SUSPENDED", at, 2, None)], "rule_id long, kind string, before_state string, after_state string, at timestamp, seq long, reverted_at timestamp")
    assert [(r["rule_id"], r["restored"]) for r in learning.rollback(rules, actions).collect()] == [(1, "ACTIVE")]
