"""Queries over a catalogue whose entries are JSON, drawn from parts: types and sizes are fields, brands document types, some parts are reviewers' decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.operators import profiles
from docfacts.sources import catalogue_files as files
from docfacts.sources.registry import apply_overlay


def parts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, brand, key: the part's field, other: the field a decision on the part is about, which every other time is another one."""
    name = lambda size: F.concat_ws(".", "p_type", size.cast("string"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("brand"), name(F.col("p_size")).alias("key"), name(F.col("p_size") + F.col("p_partkey") % 2).alias("other"), F.col("p_type").alias("label"))


def entry(**members: Column) -> Column:
    return F.parse_json(F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]))).alias("value")


def drawn(spark: SparkSession, sf_dir: str) -> files.Catalogue:
    """Fields are at most as many as there are kinds of parts times sizes, and so is a type's list, however many parts there are."""
    parts, k = parts_of(spark, sf_dir), F.col("k")
    type_ = F.when(k % 4 == 0, "object").when(k % 4 == 1, "money").when(k % 4 == 2, "integer").otherwise("date")
    labels = F.when(k % 5 > 0, F.array(F.lower("label"))).otherwise(F.array().cast("array<string>"))
    fields = parts.groupBy("key").agg(F.min("p_partkey").alias("k"), F.min("label").alias("label")).select(
        "key", entry(id=F.col("key"), label_it=F.col("label"), type=type_, default_cardinality=F.when(k % 3 == 0, "many").otherwise("one"), label_aliases_it=labels, note=F.struct(k.alias("first_part"))),
    )
    roles = parts.groupBy("brand", "key").agg((F.min("p_partkey") % 2 == 0).alias("required"))
    of = lambda required: F.array_sort(F.collect_list(F.when(F.col("required") == required, F.col("key"))))
    types = roles.groupBy(F.col("brand").alias("key")).agg(of(True).alias("required"), of(False).alias("optional")).select(
        "key", entry(document_type_id=F.col("key"), required_fields=F.col("required"), optional_fields=F.col("optional"), note=F.struct(F.lower("key").alias("from"))),
    )
    return files.catalogue(fields, types, spark.createDataFrame([], "party string, heading string"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_type, field_id, state: every seventh part, the least of each pair."""
    k = F.min("p_partkey")
    rows = parts_of(spark, sf_dir).where("p_partkey % 7 = 0").groupBy(F.col("brand").alias("document_type"), F.col("other").alias("field_id"))
    return rows.agg(F.when(k % 3 == 0, "required").when(k % 3 == 1, "optional").otherwise("excluded").alias("state"))


def registry_overlay(spark, sf_dir):
    """What types ask for after the reviewers' decisions."""
    return apply_overlay(drawn(spark, sf_dir).asked, decisions(spark, sf_dir)).select("document_type", "field_id", "role")


def profile_changelog(spark, sf_dir):
    before = drawn(spark, sf_dir).asked
    return profiles.changelog(before, apply_overlay(before, decisions(spark, sf_dir))).select("document_type", "field_id", "change")


def json_schema(spark, sf_dir):
    """JSON-Schema property type of each field: numbers for amounts, arrays for repeated fields."""
    base = F.when(F.col("type").isin("money", "number", "percentage"), "number").when(F.col("type").isin("integer", "boolean", "object"), F.col("type")).otherwise("string")
    fields = drawn(spark, sf_dir).fields.select("field_id", base.alias("base"), "cardinality")
    return fields.select("field_id", F.when(F.col("cardinality") == "many", F.concat(F.lit("array<"), "base", F.lit(">"))).otherwise(F.col("base")).alias("json_type"))


def corrected_types(spark, sf_dir):
    """Exported types: their lists with the decisions, and the key that the engine doesn't know."""
    listed = lambda name: F.array_join(F.array_sort(files.at("value", name, "array<string>")), ",")
    rows = files.corrected_types(drawn(spark, sf_dir), decisions(spark, sf_dir))
    return rows.select("key", listed("required_fields").alias("required"), listed("optional_fields").alias("optional"), files.at("value", "note.from", "string").alias("note"))


def corrected_fields(spark, sf_dir):
    """Exported fields: labels that reviewers added, cardinalities they set, and the key that the engine doesn't know."""
    parts = parts_of(spark, sf_dir)
    hints = parts.where("p_partkey % 11 = 0").select(F.col("key").alias("field_id"), F.lower("brand").alias("label"))
    many = parts.where("p_partkey % 13 = 0").select(F.col("key").alias("field_id"), F.lit("many").alias("cardinality")).distinct()
    rows = files.corrected_fields(drawn(spark, sf_dir), hints, many)
    return rows.select("key", F.array_join(files.at("value", "label_aliases_it", "array<string>"), ",").alias("labels"), files.at("value", "default_cardinality", "string").alias("cardinality"), files.at("value", "note.first_part", "long").alias("note"))


def registry_audit(spark, sf_dir):
    """Counters: decisions on fields that no entry has, fields without a label besides their name, fields that no type asks for after the decisions, labels that several fields share."""
    found, wanted = drawn(spark, sf_dir), decisions(spark, sf_dir)
    asked = apply_overlay(found.asked, wanted)
    gaps = {
        "unknown_references": wanted.join(found.fields, "field_id", "left_anti"),
        "fields_without_alias": found.fields.where("size(aliases) = 0"),
        "unused_fields": found.fields.join(asked, "field_id", "left_anti"),
        "shared_labels": found.fields.groupBy("label").agg(F.count("*").alias("n")).where("n > 1"),
    }
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("counter"), F.count("*").alias("n")) for name, rows in gaps.items()])


def catalogue_bundle(spark, sf_dir):
    """The corrected catalogue: a JSON list per type, its fields in order, those that reviewers added last."""
    item = F.struct("ord", F.struct("field_id", "role").alias("f"))
    rows = apply_overlay(drawn(spark, sf_dir).asked, decisions(spark, sf_dir)).groupBy("document_type").agg(F.array_sort(F.collect_list(item)).alias("i"))
    return rows.select("document_type", F.to_json(F.transform("i", lambda x: x["f"])).alias("fields"))


PARTS = """WITH p AS (SELECT p_partkey AS k, p_brand AS t, p_type || '.' || p_size AS f, p_type || '.' || (p_size + p_partkey % 2) AS g, p_type AS label FROM part),
f AS (SELECT f, min(k) AS k, min(label) AS label FROM p GROUP BY 1),
a AS (SELECT t, f, CASE WHEN min(k) % 2 = 0 THEN 'required' ELSE 'optional' END AS role FROM p GROUP BY 1, 2),
d AS (SELECT t, g AS f, ['required', 'optional', 'excluded'][min(k) % 3 + 1] AS state FROM p WHERE k % 7 = 0 GROUP BY 1, 2),
o AS (SELECT t, f, role, state, coalesce(state, role) AS now FROM a FULL JOIN d USING (t, f))
"""
QUERIES = {f.__name__: f for f in (registry_overlay, profile_changelog, json_schema, corrected_types, corrected_fields, registry_audit, catalogue_bundle)}
ORACLE_SQL = {
    "registry_overlay": PARTS + "SELECT t AS document_type, f AS field_id, now AS role FROM o WHERE now <> 'excluded'",
    "profile_changelog": PARTS
    + """SELECT t AS document_type, f AS field_id, CASE WHEN role IS NULL THEN 'ADDED' WHEN now = 'excluded' THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM o
        WHERE NOT (role IS NULL AND now = 'excluded') AND now IS DISTINCT FROM role""",
    "catalogue_bundle": PARTS
    + """SELECT t AS document_type, '[' || string_agg('{"field_id":"' || f || '","role":"' || now || '"}', ',' ORDER BY CASE role WHEN 'required' THEN 0 WHEN 'optional' THEN 1 ELSE 2 END, f) || ']' AS fields
        FROM o WHERE now <> 'excluded' GROUP BY 1""",
    "json_schema": PARTS + "SELECT f AS field_id, CASE WHEN k % 3 = 0 THEN 'array<' || j || '>' ELSE j END AS json_type FROM (SELECT *, ['object', 'number', 'integer', 'string'][k % 4 + 1] AS j FROM f)",
    "corrected_types": PARTS
    + """SELECT t AS key, coalesce(string_agg(f, ',' ORDER BY f) FILTER (now = 'required'), '') AS required, coalesce(string_agg(f, ',' ORDER BY f) FILTER (now = 'optional'), '') AS optional, lower(t) AS note FROM o GROUP BY t""",
    "corrected_fields": PARTS
    + """, h AS (SELECT f, string_agg(DISTINCT lower(t), ',' ORDER BY lower(t)) AS more FROM p WHERE k % 11 = 0 GROUP BY 1)
        SELECT f.f AS key, concat_ws(',', CASE WHEN k % 5 > 0 THEN lower(label) END, more) AS labels, CASE WHEN k % 3 = 0 OR f.f IN (SELECT f FROM p WHERE k % 13 = 0) THEN 'many' ELSE 'one' END AS cardinality, k AS note FROM f LEFT JOIN h USING (f)""",
    "registry_audit": PARTS
    + """SELECT 'unknown_references' AS counter, count(*) AS n FROM d WHERE f NOT IN (SELECT f FROM f) UNION ALL SELECT 'fields_without_alias', count(*) FROM f WHERE k % 5 = 0
        UNION ALL SELECT 'unused_fields', count(*) FROM f WHERE f NOT IN (SELECT f FROM o WHERE now <> 'excluded') UNION ALL SELECT 'shared_labels', count(*) FROM (SELECT label FROM f GROUP BY 1 HAVING count(*) > 1)""",
}
