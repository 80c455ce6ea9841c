"""From closed reviews to learning: decisions as events, retraction of earlier closures, proofs, the mode gate, and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfacts.operators.review import blank_to_null, current_value


def type_decision(predicted: Column, final: Column) -> Column:
    return F.when(predicted.isNull() & final.isNull(), None).when(predicted.isNull(), "FILLED").when(final.isNull(), "CLEARED").when(predicted == final, "CONFIRMED").otherwise("CHANGED")


def field_decision(value: Column, corrected: Column) -> Column:
    before, after = blank_to_null(value), current_value(value, corrected)
    return F.when(before.isNull() & after.isNull(), None).when(before.isNull(), "FILLED").when(after.isNull(), "CLEARED").when(before == after, "CONFIRMED").otherwise("CHANGED")


def review_events(fields: DataFrame) -> DataFrame:
    """One event per field of a closed review that has something to say: document_id, field_id, outcome, at."""
    return fields.withColumn("outcome", field_decision(F.col("value"), F.col("corrected_value"))).where("outcome is not null").select("document_id", F.col("name").alias("field_id"), "outcome", "at")


def last_closures(closures: DataFrame) -> DataFrame:
    """Of each document's closures only the last counts, and none if that was a discard: earlier proofs are retracted."""
    last = Window.partitionBy("document_key").orderBy(F.col("at").desc(), F.col("seq").desc())
    return closures.withColumn("rn", F.row_number().over(last)).where("rn = 1 and status <> 'DISCARDED'").drop("rn")


def template_proofs(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Type decisions as proofs of the template's rules: the rule's own type confirms it, another denies it. events: document_key, template, document_type, at."""
    r = rules.select("rule_id", "template", F.col("document_type").alias("rule_type"))
    return events.join(r, "template").select("rule_id", "document_key", F.when(F.col("rule_type") == F.col("document_type"), "POSITIVE").otherwise("NEGATIVE").alias("effect"), "at")


def field_proofs(events: DataFrame) -> DataFrame:
    """The rule that proposed a value is confirmed by its confirmation and denied by all else. events: rule_id, document_key, outcome, at."""
    return events.where("rule_id is not null").select("rule_id", "document_key", F.when(F.col("outcome") == "CONFIRMED", "POSITIVE").otherwise("NEGATIVE").alias("effect"), "at")


def writes(mode: str) -> bool:
    """Only LEARNING records proofs."""
    return mode == "LEARNING"


def applies_rules(mode: str) -> bool:
    """LEARNING and FROZEN read with learned rules, BASELINE without."""
    return mode != "BASELINE"


def replay(closures: DataFrame, done: DataFrame) -> DataFrame:
    """Closures to learn from that the log doesn't hold yet, at their original time; running it again adds nothing."""
    return last_closures(closures).join(done.select("document_key").distinct(), "document_key", "left_anti").orderBy("at", "seq")
