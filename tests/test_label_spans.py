"""Labels found by their first words are those found among all runs of words, and a span's offsets are those of the words in the text."""

from pyspark.sql import functions as F

from docfacts.functions.text import fold, tokens_with_offsets
from docfacts.operators import extraction

TEXTS = ["Fattura n. 12", "  Nº  fattura - N 7: fattura n", "à  É", "n", "", "...", "Totale documento: EUR 1.000,00 totale", "\tP. IVA: 01234567890 (P IVA)", None]
LABELS = ["fattura n", "n", "totale", "totale documento", "p iva", "e"]


def test_first_words_lose_no_label(spark):
    rows = spark.createDataFrame([(i, "t", x) for i, x in enumerate(TEXTS)], "line int, document_type string, text string").withColumn("folded", fold(F.col("text")))
    labels = spark.createDataFrame([("t", x) for x in LABELS], "document_type string, label string")
    got = [sorted(map(str, extraction.occurrences(rows, labels, 2, heads=heads).select("line", "label", "g").collect())) for heads in (None, ["fattura", "n", "totale", "p", "e"])]
    assert got[0] == got[1] and len(got[0]) >= 10


def test_spans_are_the_words_places(spark):
    rows = spark.createDataFrame([(x,) for x in TEXTS if x], "text string").withColumn("words", tokens_with_offsets(F.col("text"))).where("size(words) > 0")
    pairs = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("words") - 1))).withColumn("j", F.explode(F.sequence("i", F.size("words") - 1)))
    want = F.struct(F.get("words", F.col("i"))["at"], F.get("words", F.col("j"))["at"] + F.length(F.get("words", F.col("j"))["word"]))
    for r in pairs.select(extraction.word_span(F.col("text"), F.col("i"), F.col("j")).alias("got"), want.alias("want")).collect():
        assert tuple(r["got"]) == tuple(r["want"])


def test_a_line_without_markers_cites_nothing(spark):
    texts = ["Rif. fattura n. 12", "fattura n. 12", "Via Fattura n. 12", "fattura n. 12 del D.Lgs. 1 art. 3", "artigiani fattura n 1"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", fold(F.col("text")).alias("folded"))
    first = F.array_position(F.split("folded", " "), "fattura").cast("int") - 1
    whole = extraction.cited(F.col("text"), first, F.lit(2))
    for r in rows.select("text", whole.alias("want"), (F.col("folded").rlike(extraction.ANY_MARKER) & whole).alias("got")).collect():
        assert r["got"] == r["want"], r["text"]
