"""The review queue: upserts, filters, counts, feeds and latest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows by id after a sync, with is_new, and is_stale where the incoming version is newer or the stored one unknown."""
    e, i = existing.select("id", F.col("at").alias("old_at"), F.col("name").alias("old_name")), incoming.select("id", F.col("at").alias("new_at"), F.col("name").alias("new_name"))
    both = e.join(i, "id", "full_outer")
    stale = F.col("new_at").isNotNull() & (F.col("old_at").isNull() | (F.col("new_at") > F.col("old_at")))
    return both.select("id", F.coalesce("new_name", "old_name").alias("name"), F.greatest("new_at", "old_at").alias("at"), F.col("old_name").isNull().alias("is_new"), stale.alias("is_stale"))


def filtered(docs: DataFrame, status: str | None = None, document_type: str | None = None, band: str | None = None, hits: DataFrame | None = None) -> DataFrame:
    """The document list: document_type "(none)" stands for null, a null band is LOW; newest first."""
    if status:
        docs = docs.where(F.col("status") == status)
    if document_type:
        docs = docs.where(F.col("document_type").isNull() if document_type == "(none)" else F.col("document_type") == document_type)
    if band:
        docs = docs.where(F.coalesce("band", F.lit("LOW")) == band)
    if hits is not None:
        docs = docs.join(hits.select("id"), "id", "left_semi")
    return docs


def kpis(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "NEEDS_REVIEW").alias("needs_review"), F.count_if(F.coalesce("band", F.lit("LOW")) == "LOW").alias("low_band"), F.count_if(F.col("document_type").isNull()).alias("untyped"))


def type_counts(docs: DataFrame) -> DataFrame:
    return docs.where("document_type is not null").groupBy("document_type").agg(F.count("*").alias("n"))


def tally(rows: DataFrame, by: str) -> DataFrame:
    """Counts by value; null counts as "null"."""
    return rows.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("null")).alias("value")).agg(F.count("*").alias("n"))


def recent_feed(events: DataFrame, docs: DataFrame, most: int = 500) -> DataFrame:
    """Newest events with their document's fields."""
    return events.join(docs, "document_id").orderBy(F.col("at").desc(), F.col("seq").desc()).limit(most)


def latest_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in `order`."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def needing_extraction(docs: DataFrame, runs: DataFrame, engine: str) -> DataFrame:
    """Documents to review without a run of this engine that hasn't failed."""
    done = runs.where((F.col("engine_version") == engine) & (F.col("status") != "FAILED_OCR")).select("document_id").distinct()
    return docs.where("status = 'NEEDS_REVIEW'").join(done, docs["id"] == done["document_id"], "left_anti")


def cache_usage(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def warnings(untyped: Column, source: Column, missing: Column) -> Column:
    """Codes of what a reviewer is warned of."""
    return F.array_compact(F.array(F.when(untyped, "UNTYPED"), F.when(source == "OCR", "OCR"), F.when(source == "OCR_FAILED", "OCR_FAILED"), F.when(missing > 0, "MISSING_REQUIRED")))


def field_order(fields: DataFrame, universal: list[str]) -> DataFrame:
    """Adds place within the document: universal fields first, in their own order, then the others by label. fields: document_id, name, label."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in universal]), F.col("name")), F.lit(0)), F.lit(len(universal) + 1))
    return fields.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(rank, F.lower("label"), "name")))
