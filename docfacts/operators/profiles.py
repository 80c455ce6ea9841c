"""Profile edits as an append-only log, the state they add up to, exports of corrected catalogues, and the queue of what to read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edit_error(kind: Column, before: Column, after: Column, known: Column) -> Column:
    """Why an edit isn't legal, or null: unknown fields, no change, a cardinality outside one and many, a state outside three."""
    state = (kind == "STATE") & ~F.coalesce(after.isin("required", "optional", "excluded"), F.lit(False))
    cardinality = (kind == "CARDINALITY") & ~F.coalesce(after.isin("one", "many"), F.lit(False))
    return F.when(~known, "UNKNOWN_FIELD").when(state, "BAD_STATE").when(cardinality, "BAD_CARDINALITY").when(before.eqNullSafe(after), "NO_CHANGE")


def standing(log: DataFrame) -> DataFrame:
    """The newest un-reverted edit of each (document_type, field_id, kind)."""
    newest = Window.partitionBy("document_type", "field_id", "kind").orderBy(F.col("at").desc(), F.col("seq").desc())
    return log.where("reverted_at is null and reverts_id is null").withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def revertable(log: DataFrame) -> DataFrame:
    """Edits that may be reverted: the standing ones, and every hint label."""
    hints = log.where("reverted_at is null and reverts_id is null and kind = 'HINT'")
    return standing(log.where("kind <> 'HINT'")).select("id").unionByName(hints.select("id"))


def activity(edits: DataFrame, actions: DataFrame, most: int = 400) -> DataFrame:
    """Edits and rule actions in one feed, newest first. Both: id, at, seq, title."""
    both = edits.select("id", "at", "seq", "title", F.lit("MAP").alias("origin")).unionByName(actions.select("id", "at", "seq", "title", F.lit("RULE").alias("origin")))
    return both.orderBy(F.col("at").desc(), F.col("seq").desc(), "origin").limit(most)


def changelog(before: DataFrame, after: DataFrame) -> DataFrame:
    """ADDED, REMOVED or CHANGED rows between two profiles (document_type, field_id, role)."""
    b, a = before.select("document_type", "field_id", F.col("role").alias("old_role")), after.select("document_type", "field_id", F.col("role").alias("new_role"))
    both = b.join(a, ["document_type", "field_id"], "full_outer")
    kind = F.when(F.col("old_role").isNull(), "ADDED").when(F.col("new_role").isNull(), "REMOVED").when(F.col("old_role") != F.col("new_role"), "CHANGED")
    return both.withColumn("change", kind).where("change is not null")


def to_reprocess(docs: DataFrame, changed: DataFrame, by: str) -> DataFrame:
    """Documents still to review whose type (or exact template) has changed."""
    return docs.where("status = 'NEEDS_REVIEW'").join(changed.select(by).distinct(), by, "left_semi")


def rename_fields(fields: DataFrame, names: dict[str, str]) -> DataFrame:
    """Legacy field names to new ones, unless the document already has the new one."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    target = F.try_element_at(table, F.col("name"))
    there = fields.select(F.col("document_id").alias("d"), F.col("name").alias("t")).distinct()
    marked = fields.withColumn("target", target)
    joined = marked.join(there, (F.col("document_id") == F.col("d")) & (F.col("target") == F.col("t")), "left")
    return joined.withColumn("name", F.when(F.col("t").isNull(), F.coalesce("target", "name")).otherwise(F.col("name"))).drop("target", "d", "t")


def files_manifest(files: DataFrame, expected: DataFrame) -> DataFrame:
    """name, sha256, matches: each exported file's digest against the one recorded. files: name, content; expected: name, sha256."""
    digest = files.select("name", F.sha2("content", 256).alias("sha256"))
    return digest.join(expected.select("name", F.col("sha256").alias("recorded")), "name", "left").select("name", "sha256", F.coalesce(F.col("sha256") == F.col("recorded"), F.lit(False)).alias("matches"))


def expiry(date: Column, years: Column) -> Column:
    """A derived expiry date: the same day so many years on, 29 February becoming the 28th."""
    return F.add_months(date, years * 12)
