"""Audit of a catalogue drawn from parts: brands are types of documents, types and sizes of parts are fields; remainders of the least part number plant faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.operators import audit


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(*cases: tuple[Column, list[str]]) -> Column:
    out = F.lit(None).cast("array<string>")
    for when, values in reversed(cases):
        out = F.when(when, F.array(*[F.lit(v) for v in values]).cast("array<string>")).otherwise(out)
    return out


def drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """types, asked, overrides, fields of the drawn catalogue."""
    part, k = read(spark, sf_dir, "part"), F.col("k")
    key = F.concat_ws(".", "p_type", F.col("p_size").cast("string"))
    column = lambda i, label, t: F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(t).alias("type"))
    fields = part.groupBy(key.alias("key")).agg(F.min("p_partkey").alias("k"), F.min("p_type").alias("label")).select(
        "key", F.when(k % 11 == 0, F.concat("key", F.lit("x"))).otherwise(F.col("key")).alias("field_id"), "label", F.when(k % 4 == 0, "object").when(k % 4 == 1, "money").otherwise("date").alias("type"),
        F.lit(None).cast("string").alias("format"), F.when(k % 10 == 0, "0_1").when(k % 10 == 1, "0_100").alias("scale"), F.when(k % 3 == 0, "one").otherwise("many").alias("cardinality"),
        F.when(k % 7 == 0, F.col("label")).when(k % 7 == 1, "").when(k % 7 > 2, "what it is").alias("description"), words((k % 13 == 0, ["made_up", "valid_date", "also"]), (k % 4 == 1, ["non_negative_money"])).alias("validators"),
        F.when(k % 5 == 0, F.array(F.upper("label"), F.lit("b"))).when(k % 5 == 1, F.array(F.lit("a"), F.lit("A"))).when(k % 5 > 2, F.array(F.lit("a"))).alias("aliases"), words((k % 6 == 0, ["x", "x", "y"]), (k % 6 == 1, ["x", " "]), (k % 6 == 2, ["x", "y"])).alias("enum"),
        F.when(k % 8 == 0, F.array(column("c", "C", "money"), column("c", "", "odd"))).when(k % 8 == 1, F.array(column("c", "C", "date"))).alias("columns"), (k % 2 == 0).alias("evidence_required"), (k % 9 == 0).alias("derived"),
    )
    field = F.when(F.col("p_partkey") % 17 == 0, F.concat(key, F.lit(".gone"))).otherwise(key)
    role = F.when(F.col("p_partkey") % 3 == 0, "required").when(F.col("p_partkey") % 3 == 1, "optional").otherwise("derived")
    asked = part.select(F.col("p_brand").alias("document_type"), role.alias("role"), field.alias("field_id"))
    overrides = part.where("p_partkey % 23 = 0").select(F.col("p_brand").alias("document_type"), F.concat_ws(".", "p_type", ((F.col("p_size") + F.col("p_partkey") % 2) % 50).cast("string")).alias("field_id"))
    types = part.select(F.col("p_brand").alias("document_type")).unionByName(read(spark, sf_dir, "nation").select(F.col("n_name").alias("document_type")))
    return types, asked, overrides, fields


def catalogue_violations(spark, sf_dir):
    return audit.violations(*drawn(spark, sf_dir))


VIOLATIONS = """
WITH p AS (SELECT *, p_type || '.' || p_size AS key FROM part), f AS (SELECT key, min(p_partkey) AS k, min(p_type) AS label FROM p GROUP BY 1),
a AS (SELECT p_brand AS t, p_partkey % 3 AS role, CASE WHEN p_partkey % 17 = 0 THEN key || '.gone' ELSE key END AS field FROM p),
c AS (SELECT t, field, count(*) FILTER (role = 0) AS r, count(*) FILTER (role = 1) AS o, count(*) FILTER (role = 2) AS d FROM a GROUP BY 1, 2),
j AS (SELECT c.*, f.key, k % 9 = 0 AS derived FROM c LEFT JOIN f ON f.key = field),
t AS (SELECT DISTINCT t FROM (SELECT p_brand AS t FROM part UNION ALL SELECT n_name FROM nation)),
s AS (SELECT t, coalesce(sum(r), 0) AS r, coalesce(sum(r + o), 0) AS reads FROM t LEFT JOIN c USING (t) GROUP BY 1)
SELECT 'id_differs_from_key' AS rule, key AS subject, key || 'x' AS detail FROM f WHERE k % 11 = 0
UNION ALL SELECT 'unknown_validator', key, 'also,made_up' FROM f WHERE k % 13 = 0
UNION ALL SELECT 'mute_description', key, CASE WHEN k % 7 = 0 THEN label ELSE '' END FROM f WHERE k % 7 < 3
UNION ALL SELECT 'alias_repeats', key, CASE WHEN k % 5 = 0 THEN lower(label) ELSE 'a' END FROM f WHERE k % 5 < 2
UNION ALL SELECT 'object_of_one', key, 'one' FROM f WHERE k % 12 = 0
UNION ALL SELECT unnest(['column_id_repeats', 'column_type_unknown', 'column_without_label']), key, unnest(['c', 'odd', '']) FROM f WHERE k % 8 = 0
UNION ALL SELECT 'columns_on_scalar', key, 'money' FROM f WHERE k % 8 = 1
UNION ALL SELECT 'enum_blank_or_repeated', key, CASE WHEN k % 6 = 0 THEN 'x' ELSE '' END FROM f WHERE k % 6 < 2
UNION ALL SELECT 'derived_wants_evidence', key, '' FROM f WHERE k % 18 = 0
UNION ALL SELECT 'scale_unknown', key, '0_1' FROM f WHERE k % 10 = 0
UNION ALL SELECT 'unknown_field', t, field FROM j WHERE key IS NULL
UNION ALL SELECT 'required_and_optional', t, field FROM j WHERE r > 0 AND o > 0
UNION ALL SELECT 'listed_twice', t, field FROM j WHERE greatest(r, o, d) > 1
UNION ALL SELECT 'derived_and_read', t, field FROM j WHERE d > 0 AND r + o > 0
UNION ALL SELECT 'derived_undeclared', t, field FROM j WHERE d > 0 AND NOT derived
UNION ALL SELECT 'type_without_fields', t, '' FROM s WHERE reads = 0
UNION ALL SELECT 'type_without_required', t, '' FROM s WHERE r = 0
UNION ALL SELECT DISTINCT 'override_unused', p_brand, p_type || '.' || (p_size + p_partkey % 2) % 50 FROM part
  WHERE p_partkey % 23 = 0 AND NOT EXISTS (FROM j WHERE j.t = p_brand AND j.key = p_type || '.' || (p_size + p_partkey % 2) % 50 AND r + o > 0)
"""
QUERIES = {f.__name__: f for f in (catalogue_violations,)}
ORACLE_SQL = {"catalogue_violations": VIOLATIONS}
