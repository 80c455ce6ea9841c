"""The review overlay: current values, corrections, re-extraction merge, outcomes, type measures, direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.functions.text import fold
from docfacts.functions.values import fold_identifier, normalize_date

#: Fixed values.
DIRECTIONAL = ["accounting.fattura", "accounting.fattura_proforma", "accounting.nota_di_credito", "procurement.preventivo"]
LEGAL_FORMS = r"\b(s\s?r\s?l\s?s?|s\s?p\s?a|s\s?n\s?c|s\s?a\s?s|s\s?s|s\s?c\s?a\s?r\s?l|soc(?:ieta)?\s+cooperativa|societa\s+semplice|impresa\s+individuale|ditta\s+individuale)\b"


def blank_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def current_value(value: Column, corrected: Column) -> Column:
    """The correction if there is one (a blank one clears), else the proposal; blank is null."""
    return blank_to_null(F.coalesce(corrected, value))


def correction_kind(value: Column, corrected: Column) -> Column:
    """CHANGED, FILLED or CLEARED; null where the value in force is the proposal."""
    before, after = blank_to_null(value), current_value(value, corrected)
    return F.when(before.eqNullSafe(after), None).when(before.isNull(), "FILLED").when(after.isNull(), "CLEARED").otherwise("CHANGED")


def item_correction_kind(value: Column, corrected: Column, removed: Column) -> Column:
    """Of a repeated field's item: ADDED (no proposal), REMOVED or CHANGED."""
    before, after = blank_to_null(value), F.when(~removed, current_value(value, corrected))
    return F.when(before.eqNullSafe(after), None).when(before.isNull(), "ADDED").when(after.isNull(), "REMOVED").otherwise("CHANGED")


def normal_edit(edit: Column, is_date: bool) -> Column:
    """An edit as it is stored: trimmed, and a text that is wholly a date as that date."""
    return F.coalesce(normalize_date(F.trim(edit)), F.trim(edit)) if is_date else F.trim(edit)


def resolve_edit(proposal: Column, edit: Column, is_date: bool = False) -> Column:
    """What a reviewer's edit leaves as correction: none if it is null or equals the proposal, a blank one if it clears it."""
    return F.nullif(normal_edit(edit, is_date), F.trim(F.coalesce(proposal, F.lit(""))))


def resolve_item_edit(origin: Column, value: Column, corrected: Column, edit: Column, is_date: bool = False) -> Column:
    """struct<action, value>: what an edit does to a repeated field's item. MANUAL items are deleted by a blank or null edit, the engine's
    removed by a blank and reset by a null edit or their own value; else NONE (no change) or CORRECT."""
    e = normal_edit(edit, is_date)
    manual = F.when(F.coalesce(e, F.lit("")) == "", "DELETE").when(e.eqNullSafe(corrected), "NONE").otherwise("CORRECT")
    engine = F.when(e.isNull() | (e == F.trim(F.coalesce(value, F.lit("")))), "RESET").when(e == "", "REMOVE").otherwise("CORRECT")
    action = F.when(origin == "MANUAL", manual).otherwise(engine)
    return F.struct(action.alias("action"), F.when(action == "CORRECT", e).alias("value"))


def review_payloads(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """id, decision, changes (array<struct<place, name, before, after>>): what a closed review reports.

    documents: id, action (SAVE or DISCARD); fields: document_id, name, item_index (null: a single field), value, corrected_value, removed.
    A discard REJECTs; a save with changes CORRECTs, one without APPROVEs. Single fields come first (place -1), then items.
    """
    value, corrected = F.col("value"), F.col("corrected_value")
    item = F.col("item_index").isNotNull()
    single = corrected.isNotNull() & ~corrected.eqNullSafe(value)
    changed = fields.where(F.when(item, item_correction_kind(value, corrected, F.col("removed")).isNotNull()).otherwise(single))
    after = F.when(item, F.coalesce(F.when(~F.col("removed"), current_value(value, corrected)), F.lit(""))).otherwise(corrected)
    before = F.when(item, F.coalesce(value, F.lit(""))).otherwise(value)
    change = F.struct(F.coalesce("item_index", F.lit(-1)).alias("place"), "name", before.alias("before"), after.alias("after"))
    of = changed.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(change)).alias("changes"))
    decision = F.when(F.col("action") == "DISCARD", "REJECT").when(F.size("changes") > 0, "CORRECT").otherwise("APPROVE")
    return documents.join(of, "id", "left").select("id", decision.alias("decision"), F.coalesce("changes", F.array().cast("array<struct<place:int,name:string,before:string,after:string>>")).alias("changes"))


def outcome(value: Column, corrected: Column) -> Column:
    """CONFIRMED, CORRECTED, MANUAL (filled by hand) or EMPTY."""
    before, after = blank_to_null(value), current_value(value, corrected)
    return F.when(after.isNull(), "EMPTY").when(before.isNull(), "MANUAL").when(before == after, "CONFIRMED").otherwise("CORRECTED")


def rate(n: Column, of: Column) -> Column:
    return F.when(of > 0, F.floor(n / of * 10000 + 0.5) / 10000).otherwise(0.0)


def type_measure(fields: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Per type and field: outcome tallies, the share of the type's reviewed documents that have it filled, and a signal.

    fields: document_id, name, role (null outside the profile), value, corrected_value; reviewed: id, document_type.
    """
    documents = reviewed.groupBy("document_type").agg(F.count("*").alias("documents"))
    rows = fields.join(reviewed, fields["document_id"] == reviewed["id"]).withColumn("outcome", outcome(F.col("value"), F.col("corrected_value")))
    tallies = rows.groupBy("document_type", "name").agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("CONFIRMED", "CORRECTED", "MANUAL", "EMPTY")], F.max("role").alias("role"))
    filled = F.col("confirmed") + F.col("corrected") + F.col("manual")
    signal = F.when(F.col("role").isNotNull() & (filled == 0), "NEVER_USED").when(F.col("role").isNull() & (filled > 0), "MISSING_FROM_PROFILE")
    return tallies.join(documents, "document_type").withColumn("fill_rate", rate(filled, F.col("documents"))).withColumn("confirmed_rate", rate(F.col("confirmed"), filled)).withColumn("signal", signal)


def merge_reextraction(old: DataFrame, new: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Corrections carried over to a new extraction of the same documents, by field name or its legacy alias.

    old, new: document_id, name, value (and corrected_value in old). Corrections of fields that the new extraction lacks stay
    as rows without a proposal; proposals without correction are the new ones.
    """
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.expr("cast(map() as map<string,string>)")
    kept = old.where("corrected_value is not null").select("document_id", F.coalesce(F.try_element_at(names, F.col("name")), F.col("name")).alias("name"), "corrected_value")
    kept = kept.groupBy("document_id", "name").agg(F.max("corrected_value").alias("corrected_value"))
    merged = new.select("document_id", "name", "value").join(kept, ["document_id", "name"], "full_outer")
    return merged.withColumn("corrected_value", F.when(F.col("corrected_value").eqNullSafe(F.col("value")), None).otherwise(F.col("corrected_value")))


def merge_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """Item corrections of repeated fields carried by index; those past the new proposals' end follow them as reviewer items.

    old: field_id, item_index, value, corrected_value, origin; new: field_id, item_index, value. Items of no longer read
    fields keep their order. Returns field_id, item_index, value, corrected_value, origin.
    """
    carried = old.where("corrected_value is not null or origin = 'REVIEWER'").select("field_id", "item_index", "corrected_value", F.col("value").alias("old_value"), F.col("origin").alias("old_origin"))
    last = new.groupBy("field_id").agg(F.max("item_index").alias("last"))
    engine = carried.where("old_origin <> 'REVIEWER'").select("field_id", "item_index", "corrected_value")
    kept = new.join(engine, ["field_id", "item_index"], "left").select("field_id", "item_index", "value", "corrected_value", F.lit("ENGINE").alias("origin"))
    orphans = carried.join(last, "field_id", "left").withColumn("last", F.coalesce("last", F.lit(-1))).where((F.col("old_origin") == "REVIEWER") | (F.col("item_index") > F.col("last")))
    from pyspark.sql import Window

    order = Window.partitionBy("field_id").orderBy((F.col("old_origin") == "REVIEWER").cast("int"), "item_index")
    appended = orphans.select("field_id", (F.col("last") + F.row_number().over(order)).alias("item_index"), F.lit(None).cast("string").alias("value"), F.coalesce("corrected_value", "old_value").alias("corrected_value"), F.lit("REVIEWER").alias("origin"))
    return kept.unionByName(appended)


def fold_company(name: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(fold(name), LEGAL_FORMS, " "), r"\s+", " ")), F.lit(""))


def direction(docs: DataFrame, company_ids: list[str], company_name: str | None) -> DataFrame:
    """Adds direction and matched_by: the company's fiscal id on exactly one side decides, on both nothing does, on none its name may.

    docs: document_type, issuer_id, recipient_id, issuer_name, recipient_name.
    """
    ours = F.array(*[fold_identifier(F.lit(i)) for i in company_ids]) if company_ids else F.array().cast("array<string>")
    has = lambda c: F.coalesce(F.array_contains(ours, fold_identifier(F.col(c))), F.lit(False))
    named = lambda c: F.coalesce(fold_company(F.col(c)) == fold_company(F.lit(company_name)), F.lit(False))
    by_id, by_name = has("issuer_id") != has("recipient_id"), named("issuer_name") != named("recipient_name")
    side = lambda issuer: F.when(issuer, "EMESSO").otherwise("RICEVUTO")
    eligible = F.col("document_type").isin(DIRECTIONAL)
    undecided = has("issuer_id") & has("recipient_id")
    way = F.when(~eligible, None).when(by_id, side(has("issuer_id"))).when(undecided, None).when(by_name, side(named("issuer_name")))
    matched = F.when(~eligible, None).when(by_id, "FISCAL_ID").when(undecided, None).when(by_name, "NAME")
    return docs.withColumn("direction", way).withColumn("matched_by", matched)


def item_origin(value: Column, corrected: Column, computed: Column) -> Column:
    return F.when(corrected.isNotNull(), "REVIEWER").when(computed, "COMPUTED").when(value.isNotNull(), "ENGINE")


def list_origin(origins: Column) -> Column:
    """The origin that all of a list's items share, else MIXED."""
    distinct = F.array_distinct(F.filter(origins, lambda o: o.isNotNull()))
    return F.when(F.size(distinct) > 1, "MIXED").otherwise(F.get(distinct, F.lit(0)))
