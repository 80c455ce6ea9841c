"""What is wrong with a catalogue, as rows: each rule is a plan that yields (rule, subject, detail), and all are one table.

Rules of single fields are told in one scan of the fields, an array of faults a row; those of types and their fields by
grouping or by an anti-join. Nothing is collected, so a catalogue of any size goes the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.functions.validators import VALIDATORS

#: Types that a column of a repeated object may have, and scales that a reader knows.
COLUMN_TYPES, SCALES = ["string", "identifier", "date", "money", "number", "integer", "boolean"], ["0_100"]
FIELD_COLUMNS = "key string, field_id string, label string, type string, format string, scale string, cardinality string, description string, validators array<string>, aliases array<string>, enum array<string>, columns array<struct<id:string,label:string,type:string>>, evidence_required boolean, derived boolean"


def fault(rule: str, wrong: Column, detail: Column) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail")))


def repeated(values: Column) -> Column:
    """The values of an array that stand in it more than once, each once, in order."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: F.size(F.filter(values, lambda y: y == x)) > 1)))


def listed(values: Column) -> Column:
    return F.array_join(values, ",")


def field_faults(fields: DataFrame) -> DataFrame:
    """rule, subject (the field's key), detail: faults that a field shows by itself. fields: `FIELD_COLUMNS`; null arrays count as empty."""
    empty = lambda name: F.coalesce(F.col(name), F.array().cast(fields.schema[name].dataType))
    f = fields.select("key", "field_id", "label", "type", "scale", "cardinality", "description", "evidence_required", F.coalesce("derived", F.lit(False)).alias("derived"), *[empty(n).alias(n) for n in ("validators", "aliases", "enum", "columns")])
    c = lambda name: F.col(f"columns.{name}")
    unknown = F.array_sort(F.array_distinct(F.filter("validators", lambda v: ~v.isin(list(VALIDATORS)))))
    names = F.transform(F.concat(F.array("label"), "aliases"), lambda x: F.lower(x))
    blank = F.exists("enum", lambda x: F.coalesce(F.trim(x), F.lit("")) == "")
    odd = F.array_sort(F.array_distinct(F.filter(c("type"), lambda t: ~F.coalesce(t.isin(COLUMN_TYPES), F.lit(False)))))
    checks = F.array(
        fault("id_differs_from_key", F.col("field_id") != F.col("key"), F.col("field_id")),
        fault("unknown_validator", F.size(unknown) > 0, listed(unknown)),
        fault("mute_description", (F.coalesce("description", F.lit("")) == "") | (F.col("description") == F.col("label")), F.col("description")),
        fault("alias_repeats", F.size(repeated(names)) > 0, listed(repeated(names))),
        fault("object_of_one", (F.col("type") == "object") & (F.col("cardinality") != "many"), F.col("cardinality")),
        fault("column_id_repeats", F.size(repeated(c("id"))) > 0, listed(repeated(c("id")))),
        fault("column_type_unknown", F.size(odd) > 0, listed(odd)),
        fault("column_without_label", F.exists(c("label"), lambda x: F.coalesce(x, F.lit("")) == ""), F.lit("")),
        fault("columns_on_scalar", (F.size("columns") > 0) & (F.col("type") != "object"), F.col("type")),
        fault("enum_blank_or_repeated", blank | (F.size(repeated(F.col("enum"))) > 0), listed(repeated(F.col("enum")))),
        fault("derived_wants_evidence", F.col("derived") & F.coalesce("evidence_required", F.lit(True)), F.lit("")),
        fault("scale_unknown", ~F.col("scale").isin(SCALES), F.col("scale")),
    )
    return f.select(F.col("key").alias("subject"), F.explode(F.array_compact(checks)).alias("v")).select("v.rule", "subject", "v.detail")


def map_faults(types: DataFrame, asked: DataFrame, overrides: DataFrame, fields: DataFrame) -> DataFrame:
    """rule, subject (the type), detail (the field): faults of what types ask for.

    types: document_type; asked: document_type, role (required, optional, derived), field_id, a row per mention; overrides: document_type, field_id, a row per exception.
    """
    counts = asked.groupBy("document_type", "field_id").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("required", "optional", "derived")])
    known = fields.groupBy(F.col("key").alias("field_id")).agg(F.bool_or(F.coalesce("derived", F.lit(False))).alias("is_derived"))
    rows = counts.join(known, "field_id", "left")
    read = F.col("required") + F.col("optional") > 0
    checks = F.array(
        fault("unknown_field", F.col("is_derived").isNull(), F.col("field_id")),
        fault("required_and_optional", (F.col("required") > 0) & (F.col("optional") > 0), F.col("field_id")),
        fault("listed_twice", (F.col("required") > 1) | (F.col("optional") > 1) | (F.col("derived") > 1), F.col("field_id")),
        fault("derived_and_read", read & (F.col("derived") > 0), F.col("field_id")),
        fault("derived_undeclared", (F.col("derived") > 0) & ~F.col("is_derived"), F.col("field_id")),
    )
    pairs = rows.select(F.col("document_type").alias("subject"), F.explode(F.array_compact(checks)).alias("v")).select("v.rule", "subject", "v.detail")
    of_type = types.select("document_type").distinct().join(counts.groupBy("document_type").agg(F.sum(F.col("required")).alias("required"), F.sum(F.col("required") + F.col("optional")).alias("read")), "document_type", "left")
    whole = F.array(fault("type_without_fields", F.coalesce("read", F.lit(0)) == 0, F.lit("")), fault("type_without_required", F.coalesce("required", F.lit(0)) == 0, F.lit("")))
    bare = of_type.select(F.col("document_type").alias("subject"), F.explode(F.array_compact(whole)).alias("v")).select("v.rule", "subject", "v.detail")
    usable = counts.where(read).join(known.select("field_id"), "field_id", "left_semi").select("document_type", "field_id")
    stray = overrides.select("document_type", "field_id").distinct().join(usable, ["document_type", "field_id"], "left_anti")
    return reduce(DataFrame.unionByName, [pairs, bare, stray.select(F.lit("override_unused").alias("rule"), F.col("document_type").alias("subject"), F.col("field_id").alias("detail"))])


def violations(types: DataFrame, asked: DataFrame, overrides: DataFrame, fields: DataFrame) -> DataFrame:
    """rule, subject, detail of all faults; a sound catalogue has none, and so have empty tables."""
    return field_faults(fields).unionByName(map_faults(types, asked, overrides, fields))


def require_references(types: DataFrame, asked: DataFrame, overrides: DataFrame, fields: DataFrame) -> None:
    """Raises with the number of references that lead nowhere and the first of them; one row reaches the driver."""
    broken = map_faults(types, asked, overrides, fields).where(F.col("rule").isin("unknown_field", "override_unused"))
    r = broken.agg(F.count("*").alias("n"), F.min(F.struct("subject", "detail")).alias("first")).first()
    if r["n"]:
        raise PySparkValueError(f"{r['n']} references to fields that are missing or not asked for (first: {r['first']['subject']}: {r['first']['detail']})")
