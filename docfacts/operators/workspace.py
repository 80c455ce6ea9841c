"""What a review workspace shows: decoded rows, fields to fill, suggestions, rule lists, item counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfacts.operators.review import blank_to_null

#: Vocabularies of stored rows, and what an unknown value is read as.
STATUSES, BANDS, SOURCES = ["NEEDS_REVIEW", "REVIEWED", "DISCARDED"], ["HIGH", "MEDIUM", "LOW"], ["NATIVE_TEXT", "OCR", "DOCX", "OCR_FAILED"]
#: Order of rules in a list.
STATUS_RANK = {"ACTIVE": 0, "CANDIDATE": 1, "SUSPENDED": 2, "REJECTED": 3}
UNKNOWN_TYPE, LEAST_MARGIN = "UNKNOWN", 0.1


def one_of(x: Column, allowed: list[str], default: str | None) -> Column:
    """A stored value if it is in the vocabulary, else the default."""
    return F.when(x.isin(allowed), x).otherwise(F.lit(default))


def decoded(rows: DataFrame) -> DataFrame:
    """status, band and source within their vocabularies; box from JSON, null where that is broken or incomplete."""
    box = F.from_json("bbox_json", "x double, y double, w double, h double")
    whole = box["x"].isNotNull() & box["y"].isNotNull() & box["w"].isNotNull() & box["h"].isNotNull()
    return rows.withColumns({"status": one_of(F.col("status"), STATUSES, "NEEDS_REVIEW"), "band": one_of(F.col("band"), BANDS, "LOW"), "source": one_of(F.col("source"), SOURCES, None), "bbox": F.when(whole, box)})


def review_groups(fields: DataFrame) -> DataFrame:
    """Adds grp (TO_FILL without proposal or correction, else PROPOSED) and place: required fields first, in stored order."""
    empty = blank_to_null(F.coalesce("corrected_value", "value")).isNull()
    marked = fields.withColumn("grp", F.when(empty, "TO_FILL").otherwise("PROPOSED")).withColumn("rank", F.when(F.col("role") == "required", 0).when(F.col("role") == "optional", 1).otherwise(2))
    return marked.withColumn("place", F.row_number().over(Window.partitionBy("document_id", "grp").orderBy("rank", "ord"))).drop("rank")


def suggests_candidates(document_type: Column, best: Column, second: Column) -> Column:
    """Whether to offer other types: none assigned, unknown, or a margin under twice the least."""
    return document_type.isNull() | (document_type == UNKNOWN_TYPE) | F.coalesce(best - second < 2 * LEAST_MARGIN, F.lit(False))


def rules_listed(rules: DataFrame, status: str | None = None, kind: str | None = None, document_type: str | None = None, field_id: str | None = None) -> DataFrame:
    """Rules that match all given filters, with their place in the list: by status, support, then newest."""
    for name, value in (("status", status), ("kind", kind), ("document_type", document_type), ("field_id", field_id)):
        if value is not None:
            rules = rules.where(F.col(name) == value)
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair]), F.col("status")), F.lit(9))
    return rules.withColumn("rank", rank).orderBy("rank", F.col("support").desc(), F.col("updated_at").desc(), "rule_id")


def next_item_index(items: DataFrame) -> DataFrame:
    """Per field: the index that an added item gets, and how many items are filled and not removed."""
    filled = blank_to_null(F.coalesce("corrected_value", "value")).isNotNull() & ~F.col("removed")
    return items.groupBy("field_id").agg((F.max("item_index") + 1).alias("next_index"), F.count_if(filled).alias("filled"))


def classifier_audit(rows: DataFrame) -> DataFrame:
    """source, confidence and candidates count of a run's metrics JSON; nulls where the shape is another."""
    m = F.try_parse_json("metrics_json")
    return rows.select("id", F.try_variant_get(m, "$.classifier.source", "string").alias("source"), F.try_variant_get(m, "$.classifier.confidence", "double").alias("confidence"))


def one_to_many(old: DataFrame, items: DataFrame) -> DataFrame:
    """A single field read as a list now: its correction goes to the item that equals the old proposal, else becomes an item of its own; a blank one removes that item.

    old: field_id, value, corrected_value; items: field_id, item_index, value. Returns field_id, item_index, value, corrected_value, removed, origin.
    """
    o = old.where("corrected_value is not null").select("field_id", F.col("value").alias("old_value"), "corrected_value")
    first = Window.partitionBy("field_id").orderBy("item_index")
    joined = items.join(o, "field_id", "left").withColumn("same", F.coalesce(F.col("value") == F.col("old_value"), F.lit(False)))
    joined = joined.withColumn("mine", F.col("same") & (F.sum(F.col("same").cast("int")).over(first) == 1))
    kept = joined.select("field_id", "item_index", "value", F.when(F.col("mine") & (F.trim("corrected_value") != ""), F.col("corrected_value")).alias("corrected_value"), (F.col("mine") & (F.trim("corrected_value") == "")).alias("removed"), F.lit("ENGINE").alias("origin"))
    met = joined.groupBy("field_id").agg(F.bool_or("mine").alias("met"), F.max("item_index").alias("last"))
    added = o.join(met, "field_id", "left").where("not coalesce(met, false) and trim(corrected_value) <> ''").select("field_id", (F.coalesce("last", F.lit(-1)) + 1).alias("item_index"), F.lit(None).cast("string").alias("value"), "corrected_value", F.lit(False).alias("removed"), F.lit("REVIEWER").alias("origin"))
    return kept.unionByName(added)


def many_to_one(items: DataFrame, new: DataFrame) -> DataFrame:
    """A list read as a single value now: corrected items are joined with "; ", a wholly removed list is a blank correction, and what equals the new proposal is none.

    items: field_id, item_index, value, corrected_value, removed; new: field_id, value.
    """
    now = F.when(~F.col("removed"), blank_to_null(F.coalesce("corrected_value", "value")))
    edited = F.bool_or(F.col("removed") | F.col("corrected_value").isNotNull())
    kept = F.array_sort(F.collect_list(F.when(now.isNotNull(), F.struct("item_index", now.alias("v")))))
    joined = items.groupBy("field_id").agg(edited.alias("edited"), F.array_join(F.transform(kept, lambda x: x["v"]), "; ").alias("joined"))
    out = new.join(joined.where("edited"), "field_id", "left")
    return out.select("field_id", "value", F.when(F.col("joined").eqNullSafe(F.col("value")), None).otherwise(F.col("joined")).alias("corrected_value"))


def alias_of(x: Column, aliases: dict[str, str]) -> Column:
    """A type's name in another catalogue, or its own."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair]), x), x)
