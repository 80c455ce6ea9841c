"""Acquisition, picks, anchors, sinks and manifest checks on small tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docfacts.operators import picks, profiles, scoring
from docfacts.sources import acquisition, sinks


def docx(paragraphs):
    w = acquisition.WORD[1:-1]
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["Contratto  n. 5", " ", "Data: 1/2/2024"]))
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.txt").write_text("no")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in acquisition.docx_pages(acquisition.files(spark, str(tmp_path))).collect()}
    assert rows["a.docx"]["lines"] == ["Contratto n. 5", "Data: 1/2/2024"] and rows["b.docx"]["error"] == "BadZipFile" and len(rows) == 2


def test_ocr_lines_in_reading_order(spark):
    blocks = [{"paragraphs": [{"lines": ["a  b", " "]}, {"lines": ["c"]}]}, {"paragraphs": [{"lines": ["d"]}]}]
    df = spark.createDataFrame([(1, 1, blocks)], "doc_id long, page int, blocks array<struct<paragraphs: array<struct<lines: array<string>>>>>")
    assert [r["text"] for r in acquisition.ocr_lines(df).orderBy("line").collect()] == ["a b", "c", "d"]


def test_area_text_breaks_lines_at_gaps(spark):
    chars = [(1, 1, 0.0, 0.0, 100.0, 100.0, c, 5.0 + i, y, 10.0, i) for i, (c, y) in enumerate([("a", 10.0), ("b", 12.0), ("c", 30.0), ("x", 500.0)])]
    df = spark.createDataFrame(chars, "doc_id long, area int, x double, y double, w double, h double, char string, cx double, cy double, ch double, seq int")
    assert acquisition.area_text(df).first()["text"] == "ab\nc"


def test_degenerate_placement_has_no_box(spark):
    m = F.struct(*[F.lit(v).alias(n) for n, v in zip("abcdef", (1.0, 1.0, 1.0, 1.0, 0.0, 0.0), strict=True)])
    assert spark.range(1).select(acquisition.place_box(m, *[F.lit(1.0)] * 4).alias("b")).first()["b"] is None


def test_boxes(spark):
    b = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip("xywh", v, strict=True)])
    r = spark.range(1).select(picks.union_box(F.array(b(0, 0, 2, 2), b(1, 1, 4, 4))).alias("u"), picks.overlaps(b(0, 0, 4, 4), b(1, 1, 4, 4)).alias("yes"), picks.overlaps(b(0, 0, 4, 4), b(1, 3, 4, 4)).alias("no")).first()
    assert tuple(r["u"]) == (0, 0, 5, 5) and r["yes"] and not r["no"]


def test_overlapping_occurrences(spark):
    assert spark.range(1).select(picks.occurrences_of(F.lit("aaa b"), F.lit("aa")).alias("o")).first()["o"] == [0, 1]


def test_locate(spark):
    rows = [(1, 0, 3, False, 9.0), (2, 0, 0, True, 5.0), (2, 4, 0, False, 0.1), (3, 0, 0, True, 1.0), (3, 0, 9, True, 3.0), (4, 0, 0, True, 1.0), (4, 0, 9, True, 1.5)]
    df = spark.createDataFrame(rows, "pick long, line int, start int, on_line boolean, distance double")
    assert {r["pick"]: r["how"] for r in picks.locate(df).collect()} == {1: "UNIQUE", 2: "LINES", 3: "NEAREST"}


def test_unique_place(spark):
    lines = spark.createDataFrame([(1, 1, 0, "Totale 10,00"), (1, 1, 1, "Acconto 5,00"), (1, 1, 2, "Saldo 5,00"), (1, 1, 3, "110,00")], "doc_id long, page int, line int, text string")
    wanted = spark.createDataFrame([(1, "a", ["10.00", "10,00"]), (1, "b", ["5,00"]), (1, "c", ["9"])], "doc_id long, key string, variants array<string>")
    assert [(r["key"], r["line"]) for r in picks.unique_place(lines, wanted).collect()] == [("a", 0)]


@pytest.mark.parametrize(("before", "labels"), [("Numero protocollo interno: ", ["interno", "protocollo interno", "numero protocollo interno"]), ("Art 5 comma ", ["comma"]), ("Nome: Rossi; CF", []), ("12", [])])
def test_candidate_labels(spark, before, labels):
    assert spark.range(1).select(picks.candidate_labels(F.lit(before)).alias("l")).first()["l"] == labels


def test_anchor_is_the_shortest_unambiguous_label(spark):
    df = spark.createDataFrame([(1, "interno", 2, True), (1, "protocollo interno", 1, True), (1, "numero protocollo interno", 1, True), (2, "x", 1, False)], "pick long, label string, reads int, at_selection boolean")
    assert [(r["pick"], r["label"]) for r in picks.derive_anchor(df).collect()] == [(1, "protocollo interno")]
    assert spark.range(1).select(picks.made_of(F.lit("mario rossi"), F.array(F.lit("rossi"), F.lit("mario"))).alias("m")).first()["m"]


@pytest.mark.parametrize("format", ["parquet", "json", "csv"])
def test_sinks_round_trip(spark, tmp_path, format):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    sinks.write(df, str(tmp_path / "out"), format)
    back = spark.read.schema("id long, v string").option("header", "true").format(format).load(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]


def test_unknown_sink(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write(spark.range(1), str(tmp_path), "xlsx")


def test_manifest_errors(spark):
    rows = [("a", "t", ["f"], []), ("a", "t", [], []), ("b", None, ["f"], []), ("c", "t", ["f", "g"], ["g"])]
    df = spark.createDataFrame(rows, "file string, document_type string, fields array<string>, absent array<string>")
    assert {(r["file"], r["error"]) for r in scoring.manifest_errors(df).collect()} == {("a", "REPEATED_FILE"), ("b", "FIELDS_WITHOUT_TYPE"), ("c", "EXPECTED_AND_ABSENT")}


def test_edit_errors(spark):
    rows = [("STATE", "required", "excluded", True, None), ("STATE", None, "maybe", True, "BAD_STATE"), ("CARDINALITY", "one", "two", True, "BAD_CARDINALITY"), ("STATE", "required", "required", True, "NO_CHANGE"), ("STATE", None, "required", False, "UNKNOWN_FIELD")]
    df = spark.createDataFrame(rows, "kind string, before string, after string, known boolean, want string")
    assert all(r["got"] == r["want"] for r in df.select(profiles.edit_error(F.col("kind"), F.col("before"), F.col("after"), F.col("known")).alias("got"), "want").collect())
