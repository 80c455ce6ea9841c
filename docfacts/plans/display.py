"""Queries of the review workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.operators import extraction, learning, queue, workspace
from docfacts.operators import first_reader as first
from docfacts.plans.facts import EXPECTED
from docfacts.plans.learning import PROOFS, proofs_of
from docfacts.plans.review import FIELDS, fields_of
from docfacts.sources import render


def decoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored rows with odd values: statuses and sources are decoded, boxes parsed where they are whole."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    box = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.col("event_id").cast("double").alias("w"), F.lit(4.0).alias("h")))).when(F.col("event_id") % 3 == 1, F.lit('{"x": 1')).otherwise(F.lit('{"x": 1.0}'))
    status = F.when(F.col("event_type") == "view", "REVIEWED").when(F.col("event_type") == "click", "LOST").otherwise("DISCARDED")
    rows = workspace.decoded(e.select("event_id", status.alias("status"), F.lit("odd").alias("band"), F.when(F.col("event_type") == "error", "OCR").otherwise("x").alias("source"), box.alias("bbox_json")))
    return rows.groupBy("status", "band", F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"), F.count("bbox").alias("boxes"), F.coalesce(F.sum("bbox.w"), F.lit(0.0)).alias("width"))


def review_groups(spark, sf_dir):
    l = fields_of(spark, sf_dir).withColumn("ord", F.col("part"))  # noqa: E741
    return workspace.review_groups(l).groupBy("document_id", "grp").agg(F.count("*").alias("n"), F.min_by("role", "place").alias("first_role"))


def suggested_types(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    type_ = F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderkey") % 7 == 0, "UNKNOWN").otherwise("t")
    margin = F.floor(F.col("o_totalprice") % 100) / 100
    return o.groupBy(workspace.suggests_candidates(type_, F.lit(1.0), F.lit(1.0) - margin).alias("suggest")).agg(F.count("*").alias("n"))


def document_warnings(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    codes = queue.warnings(F.col("lang") == "en", F.when(F.length("text") < 100, "OCR_FAILED").when(F.length("text") < 400, "OCR"), F.col("doc_id") % 3)
    return d.select(F.array_join(codes, ",").alias("warnings")).groupBy("warnings").agg(F.count("*").alias("n"))


def rules_listed(spark, sf_dir):
    """Places in the list of all rules, by status, support and age."""
    states = learning.rule_states(proofs_of(spark, sf_dir)).select("rule_id", F.when(F.col("positive") > F.col("negative") * 4, "ACTIVE").otherwise("CANDIDATE").alias("status"), F.col("positive").alias("support"), F.col("negative").alias("updated_at"))
    return workspace.rules_listed(states, status="ACTIVE").select("rule_id", "support")


def item_counts(spark, sf_dir):
    rows = fields_of(spark, sf_dir).select(F.col("document_id").alias("field_id"), F.substring("name", 7, 3).cast("int").alias("item_index"), "value", "corrected_value", (F.col("part") % 29 == 0).alias("removed"))
    return workspace.next_item_index(rows).select("field_id", F.col("next_index").cast("long").alias("next_index"), "filled")


def classifier_audit(spark, sf_dir):
    """Metrics of runs: two in three have a classifier's part, one of them broken JSON."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"))
    metrics = F.when(F.col("id") % 3 == 0, F.concat(F.lit('{"classifier": {"source": "s'), (F.col("id") % 4).cast("string"), F.lit('", "confidence": 0.5}}'))).when(F.col("id") % 3 == 1, F.lit("{broken")).otherwise(F.lit("{}"))
    return workspace.classifier_audit(e.withColumn("metrics_json", metrics)).groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"), F.count("confidence").alias("with_confidence"))


ROWS_A_TASK = 250_000  # line items that a task sorts
#: Keywords of the fields that the rendered documents may hold, and two that they don't.
FIRST_READER = [
    ("issue_date", first.DATE, True, ["data di emissione", "data emissione", "data documento", "data fattura", "emessa il", "emesso il", "rilasciato il", "data del", "del"]),
    ("total_amount", first.MONEY, False, ["totale complessivo", "totale documento", "totale da pagare", "totale fattura", "importo totale", "totale"]),
    ("amount", first.MONEY, False, ["importo dovuto", "ammontare", "importo"]),
    ("document_number", first.NUMBER, True, ["numero documento", "numero fattura", "fattura n", "documento n", "numero", "nr", "n"]),
    ("protocol_number", first.PROTOCOL, False, ["numero di protocollo", "protocollo n", "protocollo", "prot"]),
    ("tax_code", first.TAX_CODE, False, ["codice fiscale", "partita iva", "cod fisc", "p iva", "c f"]),
    ("recipient_name", first.TEXT, False, ["destinatario", "intestatario", "committente", "cessionario", "spettabile", "cliente"]),
    ("account_identifier", first.TEXT, False, ["numero contratto", "codice cliente", "codice utente", "numero conto", "matricola", "iban", "pod", "pdr"]),
]


def first_reader(spark, sf_dir):
    """What the first reader finds in every rendered document."""
    lines = render.pages(spark, sf_dir).select("doc_id", "page", "text_source", F.posexplode("lines").alias("line", "text"))
    return first.prefill(lines, spark.createDataFrame(FIRST_READER, first.FIELD_SCHEMA)).select("doc_id", "field_id", "value", "confidence")


def by_order(lineitem):
    """Line items by order in as many parts as their number asks for: what a task sorts doesn't grow with the table, and all that is keyed by order keeps to these parts."""
    parts = max(lineitem.sparkSession.sparkContext.defaultParallelism, -(-lineitem.count() // ROWS_A_TASK))
    return lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey").repartition(parts, "l_orderkey")


def one_to_many(spark, sf_dir):
    """Each order's first line as the single field, all lines as the list that it becomes."""
    l = by_order(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).groupBy(F.col("l_orderkey").alias("field_id"), (F.col("l_linenumber") - 1).alias("item_index")).agg(F.max("l_returnflag").alias("value"), F.max("l_partkey").alias("k"))  # noqa: E741
    old = l.where("item_index = 0").select("field_id", F.when(F.col("k") % 4 == 0, "gone").otherwise(F.col("value")).alias("value"), F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "new").alias("corrected_value"))
    out = workspace.one_to_many(old, l.select("field_id", "item_index", "value"))
    return out.groupBy("origin").agg(F.count("*").alias("n"), F.count("corrected_value").alias("corrected"), F.count_if("removed").alias("removed"))


def many_to_one(spark, sf_dir):
    l = by_order(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).groupBy(F.col("l_orderkey").alias("field_id"), F.col("l_linenumber").alias("item_index")).agg(F.max("l_returnflag").alias("value"), F.max("l_partkey").alias("k"))  # noqa: E741
    items = l.select("field_id", "item_index", "value", F.when(F.col("k") % 5 == 0, "Z").alias("corrected_value"), (F.col("k") % 2 == 0).alias("removed"))
    new = l.groupBy("field_id").agg(F.lit("Z").alias("value"))
    return workspace.many_to_one(items, new)


def learned_rules_bundle(spark, sf_dir):
    """Fingerprint over the keys of the rules with more than ten confirmations."""
    counts = learning.counts(learning.effects(proofs_of(spark, sf_dir)))
    rules = counts.select(F.when(F.col("support") > 10, "ACTIVE").otherwise("CANDIDATE").alias("status"), learning.rule_key(F.lit("FIELD_ANCHOR"), F.when(F.col("rule_id") % 2 == 0, "TEMPLATE").otherwise("CLASS"), F.lit("t"), F.lit("f"), F.col("rule_id").cast("string"), F.lit("SAME_LINE"), F.lit("x")).alias("rule_key"))
    return learning.snapshot_fingerprint(rules)


def type_aliases(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(workspace.alias_of(F.col("o_orderpriority"), {"1-URGENT": "urgent", "5-LOW": "low"}).alias("type"))
    return o.groupBy("type").agg(F.count("*").alias("n"))


def recoded_statuses(spark, sf_dir):
    """Old one-letter statuses in the words of today; a second run changes nothing."""
    names = {"F": "REVIEWED", "O": "NEEDS_REVIEW", "P": "DISCARDED"}
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(workspace.alias_of(workspace.alias_of(F.col("o_orderstatus"), names), names).alias("status"))
    return o.groupBy("status").agg(F.count("*").alias("n"))


def shared_evidence(spark, sf_dir):
    """Documents whose single VAT line stands outside any section: issuer and recipient claim it alike."""
    pages = render.pages(spark, sf_dir)
    bare = pages.withColumn("lines", F.filter("lines", lambda x: ~x.isin("Fornitore", "Cliente"))).withColumn("lines", F.slice(F.filter("lines", lambda x: x.startswith("Partita")), 1, 1))
    rows = extraction.facts(bare, spark).where("field_id in ('issuer.vat_number', 'recipient.vat_number')")
    return rows.groupBy("field_id", "status").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (decoded_rows, review_groups, suggested_types, document_warnings, rules_listed, item_counts, classifier_audit, first_reader, one_to_many, many_to_one, learned_rules_bundle, type_aliases, recoded_statuses, shared_evidence)}
ORACLE_SQL = {
    "decoded_rows": """SELECT CASE event_type WHEN 'view' THEN 'REVIEWED' WHEN 'click' THEN 'NEEDS_REVIEW' ELSE 'DISCARDED' END AS status, 'LOW' AS band, CASE WHEN event_type = 'error' THEN 'OCR' ELSE 'none' END AS source,
        count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS boxes, coalesce(sum(event_id) FILTER (event_id % 3 = 0), 0)::DOUBLE AS width FROM events GROUP BY 1, 2, 3""",
    "review_groups": FIELDS + """SELECT document_id, CASE WHEN now IS NULL THEN 'TO_FILL' ELSE 'PROPOSED' END AS grp, count(*) AS n, CASE min(CASE role WHEN 'required' THEN 0 WHEN 'optional' THEN 1 ELSE 2 END) WHEN 0 THEN 'required' WHEN 1 THEN 'optional' END AS first_role
        FROM f GROUP BY 1, 2""",
    "suggested_types": "SELECT o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR 1.0::DOUBLE - (1.0::DOUBLE - floor(o_totalprice % 100) / 100) < 0.2::DOUBLE AS suggest, count(*) AS n FROM orders GROUP BY 1",
    "document_warnings": """SELECT concat_ws(',', CASE WHEN lang = 'en' THEN 'UNTYPED' END, CASE WHEN length(text) BETWEEN 100 AND 399 THEN 'OCR' WHEN length(text) < 100 THEN 'OCR_FAILED' END, CASE WHEN doc_id % 3 > 0 THEN 'MISSING_REQUIRED' END) AS warnings,
        count(*) AS n FROM documents GROUP BY 1""",
    "rules_listed": "SELECT user_id AS rule_id, (count(*) FILTER (event_type <> 'error'))::INT AS support FROM events GROUP BY 1 HAVING count(*) FILTER (event_type <> 'error') > 4 * count(*) FILTER (event_type = 'error')",
    "item_counts": FIELDS + "SELECT document_id AS field_id, (max(substr(name, 7)::INT) + 1)::BIGINT AS next_index, count(*) FILTER (now IS NOT NULL AND part % 29 > 0) AS filled FROM f GROUP BY 1",
    "classifier_audit": "SELECT CASE WHEN event_id % 3 = 0 THEN 's' || (event_id % 4) ELSE 'none' END AS source, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS with_confidence FROM events GROUP BY 1",
    "first_reader": EXPECTED + """, r AS (
          SELECT doc_id, flaw, CASE field_id WHEN 'document.number' THEN 'document_number' WHEN 'document.issue_date' THEN 'issue_date' WHEN 'money.total' THEN 'total_amount' WHEN 'issuer.vat_number' THEN 'tax_code' WHEN 'recipient.name' THEN 'recipient_name'
            WHEN 'payment.iban' THEN 'account_identifier' ELSE 'amount' END AS field_id, CASE field_id WHEN 'items.amount' THEN split_part(value, ';', 1) WHEN 'document.number' THEN doc_id::VARCHAR ELSE value END AS value
          FROM expected WHERE field_id <> 'recipient.vat_number' AND NOT (field_id = 'money.total' AND flaw IN (3, 5))
        ) SELECT doc_id, field_id, value, CASE WHEN flaw = 4 THEN 0.75 ELSE 0.85 END::DOUBLE AS confidence FROM r""",
    "one_to_many": """WITH l AS (SELECT l_orderkey AS f, l_linenumber - 1 AS i, max(l_returnflag) AS v, max(l_partkey) AS k FROM lineitem GROUP BY 1, 2), o AS (SELECT f, CASE WHEN k % 4 = 0 THEN 'gone' ELSE v END AS v, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'new' END AS c FROM l WHERE i = 0),
        m AS (SELECT o.*, coalesce((SELECT bool_or(l.v = o.v) FROM l WHERE l.f = o.f), false) AS met FROM o WHERE c IS NOT NULL)
        SELECT 'ENGINE' AS origin, (SELECT count(*) FROM l) AS n, count(*) FILTER (met AND c <> '') AS corrected, count(*) FILTER (met AND c = '') AS removed FROM m
        UNION ALL SELECT 'REVIEWER', count(*), count(*), 0 FROM m WHERE NOT met AND c <> '' HAVING count(*) > 0""",
    "many_to_one": """WITH l AS (SELECT l_orderkey AS field_id, l_linenumber AS i, max(l_returnflag) AS v, max(l_partkey) AS k FROM lineitem GROUP BY 1, 2),
        j AS (SELECT field_id, bool_or(k % 2 = 0 OR k % 5 = 0) AS edited, coalesce(string_agg(CASE WHEN k % 5 = 0 THEN 'Z' ELSE v END, '; ' ORDER BY i) FILTER (k % 2 > 0), '') AS s FROM l GROUP BY 1)
        SELECT field_id, 'Z' AS value, CASE WHEN edited AND s <> 'Z' THEN s END AS corrected_value FROM j""",
    "learned_rules_bundle": PROOFS + """SELECT substr(sha256(coalesce(string_agg(k, chr(10) ORDER BY k), '')), 1, 16) AS fingerprint FROM (SELECT 'FIELD_ANCHOR|' || CASE WHEN rule_id % 2 = 0 THEN 'TEMPLATE|t|f|' ELSE 'CLASS|t|*|' END || rule_id || '|SAME_LINE|x' AS k
        FROM effects GROUP BY rule_id HAVING count(*) FILTER (effect = 'POSITIVE') > 10)""",
    "type_aliases": "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS type, count(*) AS n FROM orders GROUP BY 1",
    "recoded_statuses": "SELECT CASE o_orderstatus WHEN 'F' THEN 'REVIEWED' WHEN 'O' THEN 'NEEDS_REVIEW' ELSE 'DISCARDED' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "shared_evidence": "SELECT unnest(['issuer.vat_number', 'recipient.vat_number']) AS field_id, 'CONFLICT' AS status, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_custkey IN (SELECT c_custkey FROM customer)",
}
