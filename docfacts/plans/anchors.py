"""Learning that reads again: documents of three layouts whose labels no catalogue has, anchors from the reviewed ones, values of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.operators import anchors, extraction
from docfacts.sources.render import italian_amount

KINDS = [("document.number", "identifier", None, None), ("document.issue_date", "date", None, None), ("money.total", "money", None, None)]


def written() -> dict[str, Column]:
    """Each field's value as the documents write it."""
    return {"document.number": (F.col("o_orderkey") + 1_000_000).cast("string"), "document.issue_date": F.date_format("o_orderdate", "dd/MM/yyyy"), "money.total": F.concat(F.lit("EUR "), italian_amount(F.col("o_totalprice")))}


def layouts() -> tuple[Column, Column]:
    """The lines of an order's document in its customer's layout, and the lines that the three fields' values stand on."""
    number, date, total = written().values()
    other = F.concat(F.lit("EUR "), italian_amount(F.col("o_totalprice") + 1))
    a = [F.lit("Spett.le ditta"), F.concat(F.lit("Protocollo interno: "), number), F.concat(F.lit("Emessa il "), date), F.concat(F.lit("Importo finale: "), total), F.concat(F.lit("Importo sospeso: "), other)]
    b = [F.lit("Codice pratica"), number, F.concat(F.lit("Totale merce: "), other), F.concat(F.lit("Giorno della stipula: "), date), F.concat(F.lit("Totale netto da versare: "), total)]
    c = [
        F.concat(F.lit("Commessa interna "), (F.col("o_orderkey") + 2_000_000).cast("string")), F.concat(F.lit("Commessa cliente "), number), F.lit("Data ordine 01/02/1990"), F.concat(F.lit("Data consegna "), date),
        F.concat(F.lit("Acconto finale: "), other), F.concat(F.lit("Saldo finale: "), total),
    ]
    layout = F.col("o_custkey") % 3
    lines = F.when(layout == 0, F.array(*a)).when(layout == 1, F.array(*b)).otherwise(F.array(*c))
    places = F.when(layout == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).when(layout == 1, F.array(F.lit(1), F.lit(3), F.lit(4))).otherwise(F.array(F.lit(1), F.lit(3), F.lit(5)))
    return lines, places


def documents_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages of all orders, with their templates; doc_id and template of each; and the selections that a reviewer made in pending ones."""
    lines, places = layouts()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("lines", lines)
    template = F.concat(F.lit("layout."), (F.col("o_custkey") % 3).cast("string"))
    pages = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit("NATIVE_TEXT").alias("text_source"), F.lit("unknown").alias("document_type"), template.alias("template"), "lines")
    texts = F.array(*[F.struct(F.lit(f).alias("field_id"), F.get(places, F.lit(i)).alias("line"), w.alias("written")) for i, (f, w) in enumerate(written().items())])
    chosen = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), template.alias("template"), "lines", F.explode(texts).alias("t"))
    column = anchors.column_of(F.get("lines", F.col("t.line")), F.col("t.written"))
    kinds = spark.createDataFrame(KINDS, "field_id string, type string, format string, scale string")
    picks = chosen.select("doc_id", "page", "template", "t.field_id", "t.line", column.alias("column"), F.concat_ws(":", "doc_id", "t.field_id").alias("pick")).join(F.broadcast(kinds), "field_id")
    return pages, orders.select(F.col("o_orderkey").alias("doc_id"), template.alias("template")), picks


def anchors_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages, documents, picks = documents_of(spark, sf_dir)
    rows = extraction.lines(pages, "template")
    derived = anchors.derive_anchors(rows, picks, "template", "field_id")
    return rows, documents, anchors.learned_anchors(derived)


def derived_anchors(spark, sf_dir):
    """The anchor learned for each layout's field, and how many selections support it."""
    return anchors_of(spark, sf_dir)[2]


def learned_readings(spark, sf_dir):
    """What the learned anchors read in every document of the three layouts."""
    rows, documents, learned = anchors_of(spark, sf_dir)
    return anchors.read_again(rows, documents, learned, spark.createDataFrame(KINDS, "field_id string, type string, format string, scale string"))


LABELS = """(VALUES (0, 'document.number', 'interno', 'same-line'), (0, 'document.issue_date', 'emessa il', 'same-line'), (0, 'money.total', 'finale', 'same-line'),
  (1, 'document.number', 'pratica', 'next-line'), (1, 'document.issue_date', 'stipula', 'same-line'), (1, 'money.total', 'versare', 'same-line'),
  (2, 'document.number', 'cliente', 'same-line'), (2, 'document.issue_date', 'consegna', 'same-line'), (2, 'money.total', 'saldo finale', 'same-line')) l(layout, field_id, label, relation)"""
QUERIES = {f.__name__: f for f in (derived_anchors, learned_readings)}
ORACLE_SQL = {
    "derived_anchors": f"SELECT 'layout.' || layout AS template, field_id, label, relation, count(*) AS n FROM orders JOIN {LABELS} ON layout = o_custkey % 3 WHERE o_orderstatus = 'P' GROUP BY ALL",
    "learned_readings": f"""SELECT o_orderkey AS doc_id, field_id, label, CASE field_id WHEN 'document.number' THEN (o_orderkey + 1000000)::VARCHAR WHEN 'document.issue_date' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_totalprice::DECIMAL(18, 2)::VARCHAR END AS value
        FROM orders JOIN {LABELS} ON layout = o_custkey % 3""",
}
