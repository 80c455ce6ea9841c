"""Readers, validators and folding on literals; properties with Hypothesis."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docfacts.functions import text, validators, values
from docfacts.functions.text import fold
from docfacts.sources.acquisition import listing
from docfacts.sources.render import italian_amount, vat_of


def apply(spark, f, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in df.select(f(F.col("x")).alias("v"), "i").orderBy("i").select("v").collect()]


CASES = [
    (values.find_date, [("del 03/04/2024", "2024-04-03"), ("2024-02-31 poi 1.2.99", "1999-02-01"), ("31/02/2024", None), ("5-6-70", "1970-06-05"), ("x 2023-12-01", "2023-12-01"), ("niente", None), (None, None)]),
    (values.find_textual_date, [("Roma, 12 Settembre 2026", "2026-09-12"), ("30 febbraio 2020", None)]),
    (values.normalize_date, [("1 2 24", "2024-02-01"), (" 12 marzo 2020 ", "2020-03-12"), ("03/04/2024 x", None), ("2024-01-05", "2024-01-05"), ("", None)]),
    (values.read_money, [("Totale EUR 1.234,56", "1234.56"), (": 1.234,56 €", "1234.56"), ("€ -5,00", "-5.00"), ("- 12,50", "12.50"), ("12/03/2024 100,00", "100.00"), ("12", None), ("1,234.5 eur", "1234.50"), ("€ 5", "5.00"), ("=-3,10", "-3.10"), ("-0,00", "0.00"), ("31/02/2024 7,5", "7.50")]),
    (values.parse_decimal, [("1.234", "1234"), ("1.234,5", "1234.5"), ("1,5", "1.5"), ("1,234,567", "1234567"), ("12.5", "12.5"), ("-3", "-3")]),
    (values.read_integer, [("n 1.234", "1234"), ("3,5", None), ("12", "12")]),
    (values.read_percentage, [("22 %", "22"), ("150", None), ("4,5%", "4.5")]),
    (values.read_boolean, [(": Sì", "true"), ("no", "false"), ("forse", None)]),
    (values.read_token, [(" n. 12/2024", "12/2024"), (": 2024-01-05", None), (" 7", None), (": 7", "7"), (" ABC", None)]),
    (values.read_rea, [(": RO - 160649", "RO - 160649"), ("n. 123456", "123456"), (": NO - 123456", "NO - 123456")]),
    (values.read_iban, [(": IT60 X054 2811 1010 0000 0123 456", "IT60X0542811101000000123456"), ("no", None)]),
    (values.fold_identifier, [("it 00743110157", "00743110157"), ("", None), ("ab-1", "AB1")]),
    (text.fold, [("Città  n° 5!", "citta n 5"), ("  ", ""), (None, None)]),
    (lambda c: validators.validate("iban_checksum", c), [("IT60X0542811101000000123456", None), ("IT61X0542811101000000123456", "INVALID_IBAN"), ("", "EMPTY"), (None, "EMPTY")]),
    (lambda c: validators.validate("vat_number_format", c), [("00743110157", None), ("IT00743110157", None), ("00743110158", "INVALID_VAT_CHECKSUM"), ("00000000000", "INVALID_VAT_CHECKSUM"), ("12", "INVALID_VAT_FORMAT")]),
    (lambda c: validators.validate("italian_tax_code_format", c), [("RSSMRA85T10A562S", None), ("RSSMRA85T10A562X", "INVALID_CF_CHECKSUM"), ("RSSMRA", "INVALID_CF_FORMAT")]),
    (lambda c: validators.validate("valid_date", c), [("2024-02-29", None), ("2023-02-29", "INVALID_DATE")]),
    (lambda c: validators.validate("vehicle_plate", c), [("ab 123-cd", None), ("A1", "INVALID_VEHICLE_PLATE")]),
    (lambda c: validators.validate("non_negative_money", c), [("-1.00", "NEGATIVE_MONEY"), ("0.00", None), ("x", None)]),
    (lambda c: validators.validate("no such validator", c), [("x", None)]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_literals(spark, case):
    f, pairs = CASES[case]
    assert apply(spark, f, [x for x, _ in pairs]) == [y for _, y in pairs]


def test_offsets_point_into_the_text(spark):
    line = "  Città: n° 5 – Größe"
    tokens = apply(spark, text.tokens_with_offsets, [line])[0]
    assert [(t["word"], line[t["at"] : t["at"] + len(t["word"])].lower()) for t in tokens][0] == ("citta", "città")


def test_cleanup_and_bounds(spark):
    df = spark.createDataFrame([("Fattura n 12", "Fattura n. 12", True), ("abc", "xyz", False)], "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select(text.is_cleanup(F.col("a"), F.col("b")).alias("got"), "want").collect())
    assert apply(spark, lambda c: text.word_bounded(F.lit("tot 12.5 (a)"), c), ["12.5", "2.5", "(a)"]) == [True, False, True]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.decimals(min_value=0, max_value=10**9, places=2), min_size=20, max_size=60))
def test_amounts_round_trip(spark, amounts):
    written = spark.createDataFrame([(i, str(a)) for i, a in enumerate(amounts)], "i int, a string")
    rows = written.select("i", values.read_money(F.concat(F.lit(": "), italian_amount(F.col("a").cast("decimal(18,2)")))).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in rows] == [f"{a:.2f}" for a in amounts]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10**9 - 1), min_size=20, max_size=40))
def test_generated_vat_numbers_are_valid(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long").select(validators.validate("vat_number_format", vat_of(F.col("k"), "1")).alias("e"))
    assert df.where("e is not null").count() == 0


def test_fold_takes_marks_off_any_latin_letter(spark):
    rows = spark.createDataFrame([("Kovač Erdős",), ("e\u0301te\u0301 Ångström",), ("Łódź – Çağ",), (None,)], "t string")
    assert [r[0] for r in rows.select(fold(F.col("t"))).collect()] == ["kovac erdos", "ete angstrom", "odz cag", None]


def test_listing_sorts_numbers_of_any_length(spark):
    names = ["n100000000000000000000", "n20000000000000", "n3", "n010", "n9"]
    entries = spark.createDataFrame([(i, n, False, None) for i, n in enumerate(names)], "id long, name string, is_folder boolean, target_id long")
    rows = listing(entries, entries.drop("target_id").limit(0)).collect()
    assert [r["name"] for r in rows] == ["n3", "n9", "n010", "n20000000000000", "n100000000000000000000"]
