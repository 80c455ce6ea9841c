"""A catalogue kept as two JSON files, one of fields and one of what each document type asks for; each entry stays as it is written.

An entry is (key, value), the value a VARIANT: what the engine reads is taken out by path, and keys that it doesn't know
survive an export, which replaces only what reviewers have decided. A file is re-read at each `load`, so a reload is another call.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions.text import fold
from docfacts.operators import audit
from docfacts.sources.registry import apply_overlay

FIELDS_FILE, TYPES_FILE = "fields.json", "document-fields.json"
#: Lists and exceptions of a type's entry.
ROLES = {"required": "required_fields", "optional": "optional_fields", "derived": "derived_fields"}
OVERRIDES = ["field_validator_overrides", "field_pii_overrides", "field_description_overrides"]
MOST_ENTRIES = 200_000  # of one file, which is written as one text


@dataclass
class Catalogue:
    """field_entries, type_entries: key, value as written; fields: `audit.FIELD_COLUMNS`; asked: document_type, role, field_id, ord; overrides: document_type, field_id; sections: party, heading."""

    field_entries: DataFrame
    type_entries: DataFrame
    fields: DataFrame
    types: DataFrame
    asked: DataFrame
    overrides: DataFrame
    sections: DataFrame


def at(value: str | Column, path: str, type_: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", type_)


def is_list(value: str | Column, path: str) -> Column:
    """Whether there is a list of nothing but texts."""
    found = at(value, path, "array<variant>")
    return F.coalesce(F.forall(found, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))), F.lit(False))


def unfold(rows: DataFrame, value: Column, *keep: str) -> DataFrame:
    """keep..., key, value: a row per key of an object."""
    spark = rows.sparkSession
    return rows.select(*keep, value.alias("object")).lateralJoin(spark.tvf.variant_explode(F.col("object").outer())).select(*keep, "key", "value").where("key is not null")


def whole_file(spark: SparkSession, folder: str, file: str, member: str) -> DataFrame:
    """The file's only row, `whole`; refused if it isn't JSON or lacks its version or its member."""
    whole = spark.read.text(f"{folder}/{file}", wholetext=True).select(F.try_parse_json("value").alias("whole"))
    ok = F.col("whole").isNotNull() & at("whole", "version", "string").isNotNull() & at("whole", member, "map<string,variant>").isNotNull()
    found = whole.agg(F.count("*").alias("n"), F.count_if(ok).alias("ok")).first()
    if found["n"] != 1 or found["ok"] != 1:
        raise PySparkValueError(f"{file} isn't a JSON object with a version and {member}")
    return whole


def typed_fields(entries: DataFrame) -> DataFrame:
    """`audit.FIELD_COLUMNS` of fields' entries; what isn't there or has another type is null."""
    column = lambda x: F.struct(at(x, "id", "string").alias("id"), at(x, "label_it", "string").alias("label"), at(x, "type", "string").alias("type"))
    texts = ["type", "format", "scale"]
    return entries.select(
        "key", at("value", "id", "string").alias("field_id"), at("value", "label_it", "string").alias("label"), *[at("value", x, "string").alias(x) for x in texts], at("value", "default_cardinality", "string").alias("cardinality"),
        at("value", "description", "string").alias("description"), at("value", "validators", "array<string>").alias("validators"), at("value", "label_aliases_it", "array<string>").alias("aliases"), at("value", "enum", "array<string>").alias("enum"),
        F.transform(at("value", "columns", "array<variant>"), column).alias("columns"), at("value", "evidence_required", "boolean").alias("evidence_required"), at("value", "derived", "boolean").alias("derived"),
    )


def asked_fields(entries: DataFrame) -> DataFrame:
    """document_type, role, field_id, ord: a row per mention in a type's lists, in order."""
    named = lambda role: F.transform(F.coalesce(at("value", ROLES[role], "array<string>"), F.array().cast("array<string>")), lambda f: F.struct(F.lit(role).alias("role"), f.alias("field_id")))
    rows = entries.select(F.col("key").alias("document_type"), F.posexplode(F.concat(*map(named, ROLES))).alias("ord", "f"))
    return rows.select("document_type", "f.role", "f.field_id", "ord")


def overridden(entries: DataFrame) -> DataFrame:
    """document_type, field_id: a row per field that has an exception of its own in a type."""
    own = entries.withColumnRenamed("key", "document_type")
    rows = reduce(DataFrame.unionByName, [unfold(own, at("value", name, "variant"), "document_type") for name in OVERRIDES])
    return rows.select("document_type", F.col("key").alias("field_id")).distinct()


def require_shapes(field_entries: DataFrame, type_entries: DataFrame) -> None:
    """Raises with the number of entries that lack a list they must have, and the first; one row reaches the driver."""
    bad_fields = field_entries.where(~is_list("value", "label_aliases_it")).select(F.lit(FIELDS_FILE).alias("file"), "key")
    bad_types = type_entries.where(~(is_list("value", ROLES["required"]) & is_list("value", ROLES["optional"]))).select(F.lit(TYPES_FILE).alias("file"), "key")
    r = bad_fields.unionByName(bad_types).agg(F.count("*").alias("n"), F.min(F.struct("file", "key")).alias("first")).first()
    if r["n"]:
        raise PySparkValueError(f"{r['n']} entries lack a list of labels or fields (first: {r['first']['file']}: {r['first']['key']})")


def catalogue(field_entries: DataFrame, type_entries: DataFrame, sections: DataFrame) -> Catalogue:
    types = type_entries.select(F.col("key").alias("document_type"))
    return Catalogue(field_entries, type_entries, typed_fields(field_entries), types, asked_fields(type_entries), overridden(type_entries), sections)


def load(spark: SparkSession, folder: str) -> Catalogue:
    """The catalogue of a folder; refused with count and first offender if entries lack their lists or name fields that aren't there."""
    fields, types = whole_file(spark, folder, FIELDS_FILE, "fields"), whole_file(spark, folder, TYPES_FILE, "document_types")
    headings = unfold(fields, at("whole", "sections", "variant")).select(F.col("key").alias("party"), F.explode(F.col("value").cast("array<string>")).alias("heading"))
    sections = headings.select("party", fold(F.col("heading")).alias("heading")).where("heading <> ''").orderBy(F.length("heading").desc(), "heading")
    out = catalogue(unfold(fields, at("whole", "fields", "variant")), unfold(types, at("whole", "document_types", "variant")), sections)
    require_shapes(out.field_entries, out.type_entries)
    audit.require_references(out.types, out.asked, out.overrides, out.fields)
    return out


def replaced(value: Column, parts: dict[str, Column]) -> Column:
    """An entry with some keys set anew, where the new value (JSON text) isn't null; all others as they are."""

    def put(entry: Column, name: str, text: Column) -> Column:
        others = F.map_filter(entry, lambda k, _: k != name)
        return F.when(text.isNotNull(), F.map_concat(others, F.map_from_arrays(F.array(F.lit(name)), F.array(F.parse_json(text))))).otherwise(entry)

    return F.parse_json(F.to_json(reduce(lambda out, part: put(out, *part), parts.items(), value.cast("map<string,variant>"))))


def corrected_types(found: Catalogue, decisions: DataFrame) -> DataFrame:
    """key, value of the types with reviewers' decisions (document_type, field_id, state) in their lists; fields added come last, by name. Types that the catalogue lacks are left out."""
    read = found.asked.where("role <> 'derived'")
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("ord", "field_id")))), lambda x: x["field_id"])
    lists = apply_overlay(read, decisions).groupBy(F.col("document_type").alias("key")).agg(F.to_json(of("required")).alias("required"), F.to_json(of("optional")).alias("optional"))
    parts = {ROLES[r]: F.coalesce(r, F.lit("[]")) for r in ("required", "optional")}
    return found.type_entries.join(lists, "key", "left").select("key", replaced(F.col("value"), parts).alias("value"))


def corrected_fields(found: Catalogue, hints: DataFrame, cardinalities: DataFrame) -> DataFrame:
    """key, value of the fields with labels added (hints: field_id, label) and cardinalities set (field_id, cardinality, one row a field)."""
    more = hints.groupBy(F.col("field_id").alias("key")).agg(F.array_sort(F.collect_set("label")).alias("more"))
    both = found.field_entries.join(more, "key", "left").join(cardinalities.select(F.col("field_id").alias("key"), "cardinality"), "key", "left")
    labels = F.array_distinct(F.concat(at("value", "label_aliases_it", "array<string>"), "more"))
    return both.select("key", replaced(F.col("value"), {"label_aliases_it": F.to_json(labels), "default_cardinality": F.concat(F.lit('"'), "cardinality", F.lit('"'))}).alias("value"))


def file_text(spark: SparkSession, folder: str, file: str, member: str, entries: DataFrame) -> DataFrame:
    """The file's text, one row `value`, with the member made of these entries and all else as the folder's file has it."""
    if (n := entries.count()) > MOST_ENTRIES:
        raise PySparkValueError(f"{n} entries are too many for one file")
    whole = whole_file(spark, folder, file, member)
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    pairs = F.array_sort(F.collect_list(F.concat(quoted(F.col("key")), F.lit(":"), F.to_json("value"))))
    made = entries.agg(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("body"))
    both = whole.unionByName(made, allowMissingColumns=True).agg(F.any_value("whole", True).alias("whole"), F.any_value("body", True).alias("body"))
    return both.select(F.to_json(replaced(F.col("whole"), {member: F.col("body")})).alias("value"))
