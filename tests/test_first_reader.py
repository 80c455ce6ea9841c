"""The first reader: keywords, citations, shapes on the first page, confidences and the plan."""

import pytest
from pyspark.sql import functions as F

from docfacts.functions import values
from docfacts.operators import first_reader as first
from docfacts.plans.display import FIRST_READER
from docfacts.sources import render

INVOICE = ["ALFA S.R.L.", "FATTURA n. 114/2026 del 08/09/2026", "Destinatario: Beta: Costruzioni S.p.A.", "Totale imponibile EUR 70.836,07", "Importo totale EUR 1,00", "Totale documento EUR 86.420,00"]
MORE = [*FIRST_READER, ("taxable_amount", first.MONEY, False, ["totale imponibile", "imponibile"])]


def read(spark, documents, fields=MORE):
    """doc_id -> {field: (value, confidence, page, line)}; documents: doc_id -> [(page, source, lines)]."""
    rows = [(d, page, i, text, source, "x") for d, pages in documents.items() for page, source, lines in pages for i, text in enumerate(lines)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line int, text string, text_source string, value string")
    out = {}
    for r in first.prefill(lines, spark.createDataFrame(fields, first.FIELD_SCHEMA)).collect():
        out.setdefault(r["doc_id"], {})[r["field_id"]] = (r["value"], r["confidence"], r["page"], r["line"])
    return out


def test_prefill(spark):
    got = read(spark, {
        1: [(1, "NATIVE_TEXT", INVOICE)],
        2: [(3, "NATIVE_TEXT", ["Documento emesso in data odierna", "legge n. 5", "08/09/2026"]), (4, "OCR", ["Allegato", "Totale documento EUR 5,00"])],
        3: [(1, "NATIVE_TEXT", ["COMUNICAZIONE", "Prot. n. 2026/554321", None, ""])],
        4: [(1, "NATIVE_TEXT", ["Fattura n. 114 - Prot. n. 2026/554321", "Fattura n. 114 - Prot. n. 2026/554321"])],
        5: [(1, "NATIVE_TEXT", ["ai sensi del D.Lgs. 9 aprile 2008, n. 81", "Totale da pagare al 31.12.2025: EUR 1.234,56", "niente"]), (2, "NATIVE_TEXT", ["01/01/2020"])],
        6: [(1, "NATIVE_TEXT", ["Cliente: " + "x" * 201, "Cliente:", "Cod. fisc. rssmra80a01h501u"])],
        7: [(1, "OCR", ["08/09/2026"])],
    })
    assert got[1] == {
        "document_number": ("114/2026", 0.85, 1, 1), "issue_date": ("2026-09-08", 0.85, 1, 1), "recipient_name": ("Beta: Costruzioni S.p.A.", 0.85, 1, 2), "taxable_amount": ("70836.07", 0.85, 1, 3),
        "total_amount": ("86420.00", 0.85, 1, 5), "amount": ("1.00", 0.85, 1, 4),
    }
    assert got[2] == {"issue_date": ("2026-09-08", 0.7, 3, 2), "total_amount": ("5.00", 0.75, 4, 1)}
    assert got[3] == {"protocol_number": ("2026/554321", 0.85, 1, 1)}
    assert got[4] == {"document_number": ("114", 0.85, 1, 0), "protocol_number": ("2026/554321", 0.85, 1, 0)}
    assert got[5] == {"total_amount": ("1234.56", 0.85, 1, 1), "issue_date": ("2025-12-31", 0.7, 1, 1)}
    assert got[6] == {"tax_code": ("RSSMRA80A01H501U", 0.85, 1, 2)}
    assert got[7] == {"issue_date": ("2026-09-08", 0.6, 1, 0)}


def test_no_documents_or_keywords(spark):
    assert read(spark, {1: [(1, "OCR", [None])]}) == {}
    assert read(spark, {1: [(1, "OCR", INVOICE)]}, [("a", first.MONEY, False, [])]) == {}
    assert read(spark, {1: [(1, "OCR", INVOICE)]}, [("a", first.MONEY, False, ["--", "Totale  Documento!"])]) == {1: {"a": ("86420.00", 0.75, 1, 5)}}


def test_too_large_a_catalogue_is_refused(spark, monkeypatch):
    monkeypatch.setattr(first, "MOST_KEYWORDS", 3)
    with pytest.raises(ValueError, match="keywords"):
        read(spark, {1: [(1, "OCR", INVOICE)]})


def test_finders(spark):
    rows = ["P.IVA 12345678903", "C.F. RSSMRA80A01H501U e 12345678903", "n. 12/03/2024 n. 7", "contratton. 5", "Prot. n.: 9 numero A-1/b", "numero: xyz", "protocollo  12", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", values.find_tax_code(F.col("t"), True).alias("a"), values.find_tax_code(F.col("t"), False).alias("b"), values.find_number(F.col("t")).alias("n"), values.find_protocol(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r["a"] for r in got] == ["12345678903", "RSSMRA80A01H501U"] + [None] * 6
    assert [r["b"] for r in got] == [None, "RSSMRA80A01H501U"] + [None] * 6
    assert [r["n"] for r in got] == [None, None, "7", None, "A-1/b", None, None, None]
    assert [r["p"] for r in got] == [None, None, None, None, "9", None, "12", None]


def test_lines_do_not_meet_all_keywords(spark, sf_dir):
    lines = render.pages(spark, sf_dir).select("doc_id", "page", "text_source", F.posexplode("lines").alias("line", "text"))
    plan = first.prefill(lines, spark.createDataFrame(FIRST_READER, first.FIELD_SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


LINES = [
    "Data di emissione: 08/09/2026", "Data: 31/02/2026", "del 2026-02-30: 08/09/2026", "Totale EUR: 1.234,50", "Totale: EUR 1.234,5", "Totale: EUR 12.34.567,00", "Importo EUR: 007,50", "Totale 5: 1,00", "Partita IVA: 12345678903", "Codice: RSSMRA80A01H501U",
    "Fattura n. 12", "numero n. 5", "Prot n. 5", "Documento n. 12/3", "Cliente: Beta", "Cliente:  Beta ", "Nota: il cliente", "Cliente: a: b", "Cliente: " + "x" * 200, "Cliente: " + "x" * 201, "Cliente di: \u00a0x", "Totale: 1,00\n", "", None,
]


def test_plain_lines_read_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(i, x, k) for i, x in enumerate(LINES) for k in (*first.READERS, first.TEXT)], "i int, text string, kind string")

    def got():
        return [tuple(r) for r in rows.select("i", "kind", first.value_of(F.col("kind"), F.col("text"), F.lit("cliente"))).orderBy("i", "kind").collect()]

    fast = got()
    monkeypatch.setattr(first, "PLAIN", dict.fromkeys(first.PLAIN, "(?!)"))  # nothing is plain
    assert fast == got()


def test_lines_are_gone_through_once(spark, sf_dir):
    lines = render.pages(spark, sf_dir).select("doc_id", "page", "text_source", F.posexplode("lines").alias("line", "text"))
    plan = first.prefill(lines, spark.createDataFrame(FIRST_READER, first.FIELD_SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_values_by_shape_stand_on_the_first_page_with_a_text(spark):
    got = read(spark, {1: [(1, "x", [None]), (2, "x", ["niente"]), (3, "x", ["08/09/2026"])], 2: [(1, "x", [None]), (2, "x", ["niente", "08/09/2026", "07/09/2026"])], None: [(1, "x", ["08/09/2026", "Totale: 1,00"])]})
    assert got == {2: {"issue_date": ("2026-09-08", 0.7, 2, 1)}, None: {"total_amount": ("1.00", 0.85, 1, 1)}}
