"""Values read at once in their commonest forms are those of the whole readers; a computed column is compiled; documents' lines aren't broadcast."""

import pytest
from pyspark.sql import functions as F

from docfacts.functions import text, validators, values
from docfacts.operators import extraction

TAILS = [": EUR 1.234,50", " 007,50", ": 12,5", ": 1.234,50\n", ":: 99/99/2020", ": 31/12/2020", ": 29/02/2021", ": 01/02/0000", ". 12", " n", " no1", ". 7", "7", ": IT60X0542811101000000123456", ": it60x0542811101000000123456", " 12345678901", ": 123456789012", "", None]
READERS = {"money": (values.read_money, "PLAIN_MONEY"), "date": (values.read_date, "PLAIN_DATE"), "token": (values.read_token, "PLAIN_TOKEN"), "vat": (values.read_vat, "PLAIN_VAT"), "iban": (values.read_iban, "PLAIN_IBAN")}


@pytest.mark.parametrize("kind", READERS)
def test_plain_forms_read_the_same(spark, monkeypatch, kind):
    read, pattern = READERS[kind]
    rows = spark.createDataFrame([(x,) for x in TAILS], "x string")
    fast = [r[0] for r in rows.select(read(F.col("x"))).collect()]
    monkeypatch.setattr(values, pattern, r"(?!)")  # nothing is plain
    assert fast == [r[0] for r in rows.select(read(F.col("x"))).collect()]


def test_a_bound_value_is_not_interpreted(spark):
    df = extraction.once(spark.range(3), "x", F.size(F.transform(F.array("id"), lambda v: v + 1)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Generate" in row and "lambda" in row for row in plan.splitlines()) and [r["x"] for r in df.collect()] == [1, 1, 1]


def test_folded_columns_and_ibans(spark):
    rows = spark.createDataFrame([("Perché  no",), ("à É-b",), ("Fattura n. 1",), ("",), (None,)], "x string")
    assert all(r[0] == r[1] for r in rows.select(text.fold(F.col("x")), text.fold_column(F.col("x"))).collect())
    ibans = spark.createDataFrame([("IT60X0542811101000000123456",), ("IT61X0542811101000000123456",), ("GB82 WEST 1234 5698 7654 32",), ("è",)], "x string")
    assert [bool(r[0]) for r in ibans.select(validators.valid_iban(F.col("x"))).collect()] == [True, False, True, False]


def test_bare_digits_are_checked_as_whole_ids(spark, monkeypatch):
    ids = ["12345678903", "12345678904", "00000000000", "IT12345678903", "it 123 4567 8903", "12345678903\n", "1234567890", "123456789012", "RSSMRA80A01H501U", "", " ", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string")

    def got():
        return [tuple(r) for r in rows.select("i", validators.vat_check(F.col("x")), validators.tax_id_check(F.col("x"))).orderBy("i").collect()]

    fast = got()
    assert fast[0][1:] == ("VALID", "VALID") and fast[1][1:] == ("BAD_CHECKSUM", "BAD_CHECKSUM")
    monkeypatch.setattr(validators, "BARE_DIGITS", r"(?!)")  # nothing is bare
    assert fast == got()
