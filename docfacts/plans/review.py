"""Review-overlay queries: line items play the fields of reviewed documents, their order the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.operators import review

COMPANY_ID, COMPANY_NAME = "IT10000000850", "Customer#000000085 S.r.l."


def fields_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, name, role, value, corrected_value, computed."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    value = F.when(k % 11 == 0, None).otherwise(F.col("l_returnflag"))
    corrected = F.when(k % 13 == 0, F.col("l_linestatus")).when(k % 17 == 0, "").when(k % 19 == 0, value)
    return l.select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("field_"), n.cast("string")).alias("name"), F.when(n <= 2, "required").when(n <= 5, "optional").alias("role"), value.alias("value"), corrected.alias("corrected_value"), (k % 23 == 0).alias("computed"), F.col("l_partkey").alias("part"))


def reviewed_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("type."), F.substring("o_orderpriority", 1, 1)).alias("document_type"))


def corrections(spark, sf_dir):
    """Fields whose value in force isn't the proposal, by kind."""
    kind = review.correction_kind(F.col("value"), F.col("corrected_value"))
    return fields_of(spark, sf_dir).withColumn("kind", kind).where("kind is not null").groupBy("name", "kind").agg(F.count("*").alias("n"))


def item_corrections(spark, sf_dir):
    kind = review.item_correction_kind(F.col("value"), F.col("corrected_value"), F.col("part") % 29 == 0)
    return fields_of(spark, sf_dir).withColumn("kind", F.coalesce(kind, F.lit("NONE"))).groupBy("kind").agg(F.count("*").alias("n"))


def current_values(spark, sf_dir):
    current = review.current_value(F.col("value"), F.col("corrected_value"))
    return fields_of(spark, sf_dir).groupBy("document_id").agg(F.count(current).alias("filled"), F.count_if(current.isNull()).alias("empty"))


def field_outcomes(spark, sf_dir):
    rows = fields_of(spark, sf_dir).withColumn("outcome", review.outcome(F.col("value"), F.col("corrected_value")))
    return rows.groupBy("name", "outcome").agg(F.count("*").alias("n"))


def type_measure(spark, sf_dir):
    return review.type_measure(fields_of(spark, sf_dir), reviewed_of(spark, sf_dir))


def merge_reextraction(spark, sf_dir):
    """Corrections carried from the first extraction to a second that lost field_4 and calls field_1 field_one."""
    first = lambda df: df.groupBy("document_id", "name").agg(F.max("value").alias("value"), F.max("corrected_value").alias("corrected_value"))
    old = first(fields_of(spark, sf_dir))
    new = old.where("name <> 'field_4'").select("document_id", F.when(F.col("name") == "field_1", "field_one").otherwise(F.col("name")).alias("name"), "value")
    return review.merge_reextraction(old, new, {"field_1": "field_one"})


def merge_items(spark, sf_dir):
    """Items of each order: a re-extraction that finds only the first three lines; corrections of the later ones follow them."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("field_id"), F.col("l_linenumber").alias("n")).agg(F.max("l_returnflag").alias("value"), F.max("l_linestatus").alias("fix"), F.max("l_partkey").alias("k"))  # noqa: E741
    old = l.select("field_id", (F.col("n") - 1).alias("item_index"), "value", F.when(F.col("k") % 3 == 0, F.col("fix")).alias("corrected_value"), F.when(F.col("k") % 5 == 0, "REVIEWER").otherwise("ENGINE").alias("origin"))
    new = l.where("n <= 3").select("field_id", (F.col("n") - 1).alias("item_index"), "value")
    return review.merge_items(old, new).select("field_id", F.col("item_index").cast("long").alias("item_index"), "value", "corrected_value", "origin")


def direction(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    types = F.when(F.col("o_orderkey") % 4 == 0, "hr.contratto").otherwise("accounting.fattura")
    id_ = lambda x: F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("1"), F.lpad(x.cast("string"), 9, "0"), F.lit("0")))
    docs = o.join(c, "o_custkey").select(
        F.col("o_orderkey").alias("id"), types.alias("document_type"), id_(F.col("o_custkey")).alias("issuer_id"), id_(F.col("o_orderkey") % 200).alias("recipient_id"),
        F.concat(F.col("c_name"), F.lit(" SRL")).alias("issuer_name"), F.lit("Altra S.p.A.").alias("recipient_name"),
    )
    return review.direction(docs, [COMPANY_ID], COMPANY_NAME).select("id", "direction", "matched_by")


def value_origins(spark, sf_dir):
    rows = fields_of(spark, sf_dir).withColumn("origin", review.item_origin(F.col("value"), F.col("corrected_value"), F.col("computed")))
    lists = rows.groupBy("document_id").agg(review.list_origin(F.collect_list("origin")).alias("origin"))
    return lists.groupBy(F.coalesce("origin", F.lit("none")).alias("origin")).agg(F.count("*").alias("documents"))


def dataset_flat(spark, sf_dir):
    """The flat export: a row per field of each reviewed document, with value in force and origin."""
    rows = fields_of(spark, sf_dir).join(reviewed_of(spark, sf_dir), F.col("document_id") == F.col("id"))
    return rows.select("document_id", "document_type", "name", F.coalesce("role", F.lit("extra")).alias("role"), review.current_value(F.col("value"), F.col("corrected_value")).alias("final"), review.item_origin(F.col("value"), F.col("corrected_value"), F.col("computed")).alias("origin"))


def dataset_documents(spark, sf_dir):
    """The nested export: a JSON object per reviewed document, hashed, fields by name."""
    rows = dataset_flat(spark, sf_dir)
    item = F.struct("name", F.coalesce("final", F.lit("")).alias("final"), F.coalesce("origin", F.lit("")).alias("origin"))
    docs = rows.groupBy("document_id", "document_type").agg(F.array_sort(F.collect_list(item)).alias("fields"))
    return docs.select("document_id", F.size("fields").cast("long").alias("n_fields"), F.sha2(F.to_json(F.struct("document_type", "fields")), 256).alias("sha256"))


FIELDS = """
WITH fields AS (
  SELECT l_orderkey AS document_id, 'field_' || l_linenumber AS name, CASE WHEN l_linenumber <= 2 THEN 'required' WHEN l_linenumber <= 5 THEN 'optional' END AS role, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_returnflag END AS value,
    CASE WHEN l_partkey % 13 = 0 THEN l_linestatus WHEN l_partkey % 17 = 0 THEN '' WHEN l_partkey % 19 = 0 THEN CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_returnflag END END AS corrected, l_partkey % 23 = 0 AS computed, l_partkey AS part FROM lineitem
), f AS (
  SELECT *, nullif(coalesce(corrected, value), '') AS now, nullif(value, '') AS was, CASE WHEN corrected IS NOT NULL THEN 'REVIEWER' WHEN computed THEN 'COMPUTED' WHEN value IS NOT NULL THEN 'ENGINE' END AS origin FROM fields
), o AS (SELECT *, CASE WHEN now IS NULL THEN 'EMPTY' WHEN was IS NULL THEN 'MANUAL' WHEN was = now THEN 'CONFIRMED' ELSE 'CORRECTED' END AS outcome FROM f),
reviewed AS (SELECT o_orderkey AS id, 'type.' || substr(o_orderpriority, 1, 1) AS document_type FROM orders WHERE o_orderstatus = 'F')
"""
QUERIES = {f.__name__: f for f in (corrections, item_corrections, current_values, field_outcomes, type_measure, merge_reextraction, merge_items, direction, value_origins, dataset_flat, dataset_documents)}
ORACLE_SQL = {
    "corrections": FIELDS + "SELECT name, CASE WHEN was IS NULL THEN 'FILLED' WHEN now IS NULL THEN 'CLEARED' ELSE 'CHANGED' END AS kind, count(*) AS n FROM f WHERE was IS DISTINCT FROM now GROUP BY ALL",
    "item_corrections": FIELDS + """SELECT CASE WHEN was IS NOT DISTINCT FROM x THEN 'NONE' WHEN was IS NULL THEN 'ADDED' WHEN x IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS kind, count(*) AS n
        FROM (SELECT was, CASE WHEN part % 29 <> 0 THEN now END AS x FROM f) GROUP BY 1""",
    "current_values": FIELDS + "SELECT document_id, count(now) AS filled, count(*) - count(now) AS empty FROM f GROUP BY 1",
    "field_outcomes": FIELDS + "SELECT name, outcome, count(*) AS n FROM o GROUP BY ALL",
    "type_measure": FIELDS + """, t AS (SELECT document_type, name, count(*) FILTER (outcome = 'CONFIRMED') AS confirmed, count(*) FILTER (outcome = 'CORRECTED') AS corrected, count(*) FILTER (outcome = 'MANUAL') AS manual,
        count(*) FILTER (outcome = 'EMPTY') AS empty, max(role) AS role FROM o JOIN reviewed ON id = document_id GROUP BY 1, 2), d AS (SELECT document_type, count(*) AS documents FROM reviewed GROUP BY 1)
        SELECT t.*, documents, floor((confirmed + corrected + manual) / documents * 10000 + 0.5) / 10000 AS fill_rate, CASE WHEN confirmed + corrected + manual > 0 THEN floor(confirmed / (confirmed + corrected + manual) * 10000 + 0.5) / 10000 ELSE 0.0 END AS confirmed_rate,
        CASE WHEN role IS NOT NULL AND confirmed + corrected + manual = 0 THEN 'NEVER_USED' WHEN role IS NULL AND confirmed + corrected + manual > 0 THEN 'MISSING_FROM_PROFILE' END AS signal FROM t JOIN d USING (document_type)""",
    "merge_reextraction": FIELDS + """, old AS (SELECT document_id, CASE name WHEN 'field_1' THEN 'field_one' ELSE name END AS name, max(value) AS value, max(corrected) AS c FROM f GROUP BY 1, 2)
        SELECT document_id, name, CASE WHEN name <> 'field_4' THEN value END AS value, CASE WHEN c IS DISTINCT FROM CASE WHEN name <> 'field_4' THEN value END THEN c END AS corrected_value FROM old WHERE name <> 'field_4' OR c IS NOT NULL""",
    "merge_items": """WITH l AS (SELECT l_orderkey AS field_id, l_linenumber AS n, max(l_returnflag) AS value, max(l_linestatus) AS fix, max(l_partkey) AS k FROM lineitem GROUP BY 1, 2),
        old AS (SELECT field_id, n - 1 AS i, value, CASE WHEN k % 3 = 0 THEN fix END AS c, k % 5 = 0 AS by_hand FROM l),
        last AS (SELECT field_id, max(n) - 1 AS last FROM l WHERE n <= 3 GROUP BY 1),
        late AS (SELECT o.*, coalesce(last, -1) AS last FROM old o LEFT JOIN last USING (field_id) WHERE (c IS NOT NULL OR by_hand) AND (by_hand OR i > coalesce(last, -1)))
        SELECT l.field_id, (n - 1)::BIGINT AS item_index, l.value, CASE WHEN NOT by_hand THEN c END AS corrected_value, 'ENGINE' AS origin FROM l JOIN old o ON o.field_id = l.field_id AND o.i = n - 1 WHERE n <= 3
        UNION ALL SELECT field_id, last + row_number() OVER (PARTITION BY field_id ORDER BY by_hand, i), NULL, coalesce(c, value), 'REVIEWER' FROM late""",
    "direction": """WITH d AS (SELECT o_orderkey AS id, o_orderkey % 4 > 0 AS ok, o_orderkey % 3 > 0 AND o_custkey = 85 AS a, o_orderkey % 3 > 0 AND o_orderkey % 200 = 85 AS b, o_custkey = 85 AS named FROM orders)
        SELECT id, CASE WHEN NOT ok THEN NULL WHEN a <> b THEN CASE WHEN a THEN 'EMESSO' ELSE 'RICEVUTO' END WHEN a AND b THEN NULL WHEN named THEN 'EMESSO' END AS direction,
        CASE WHEN NOT ok THEN NULL WHEN a <> b THEN 'FISCAL_ID' WHEN a AND b THEN NULL WHEN named THEN 'NAME' END AS matched_by FROM d""",
    "value_origins": FIELDS + "SELECT coalesce(g, 'none') AS origin, count(*) AS documents FROM (SELECT document_id, CASE WHEN count(DISTINCT origin) > 1 THEN 'MIXED' ELSE max(origin) END AS g FROM f GROUP BY 1) GROUP BY 1",
    "dataset_flat": FIELDS + "SELECT document_id, document_type, name, coalesce(role, 'extra') AS role, now AS final, origin FROM f JOIN reviewed ON id = document_id",
    "dataset_documents": FIELDS + """SELECT document_id, count(*) AS n_fields, sha256('{"document_type":"' || document_type || '","fields":[' || string_agg('{"name":"' || name || '","final":"' || coalesce(now, '') || '","origin":"' || coalesce(origin, '') || '"}', ','
        ORDER BY name, coalesce(now, ''), coalesce(origin, '')) || ']}') AS sha256 FROM f JOIN reviewed ON id = document_id GROUP BY document_id, document_type""",
}
