"""Scoring of extracted values against a manifest of expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.functions.text import fold
from docfacts.functions.values import fold_identifier, normalize_date, parse_decimal


def normal_value(value: Column, type_: Column) -> Column:
    """The form in which two values of a field's type are compared."""
    return F.when(type_ == "date", F.coalesce(normalize_date(value), value)).when(type_.isin("money", "number"), F.coalesce(parse_decimal(value), value)).when(type_ == "identifier", fold_identifier(value)).otherwise(fold(value))


def same_list(a: Column, b: Column) -> Column:
    """Equality as multisets."""
    return F.array_sort(a) == F.array_sort(b)


def rate(n: Column, of: Column) -> Column:
    return F.when(of > 0, F.floor((n * 20000 + of) / (of * 2)) / 10000)


def field_outcomes(expected: DataFrame, read: DataFrame) -> DataFrame:
    """CORRECT, WRONG or MISSING per expected field. Both: doc_id, field_id, value."""
    r = read.select("doc_id", "field_id", F.col("value").alias("got"))
    joined = expected.join(r, ["doc_id", "field_id"], "left")
    return joined.withColumn("outcome", F.when(F.col("got").isNull(), "MISSING").when(F.col("got") == F.col("value"), "CORRECT").otherwise("WRONG"))


def summary(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates to four places."""
    n = F.count("*")
    tallies = outcomes.groupBy(*by).agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("CORRECT", "WRONG", "MISSING")], n.alias("n"))
    return tallies.select(*by, "correct", "wrong", "missing", rate(F.col("correct"), F.col("n")).alias("accuracy"), rate(F.col("wrong"), F.col("n")).alias("error_rate"), rate(F.col("missing"), F.col("n")).alias("missing_rate"))


def filled_though_absent(absent: DataFrame, read: DataFrame) -> DataFrame:
    """Fields read in documents that are known not to have them."""
    return read.where("value is not null").join(absent.select("doc_id", "field_id"), ["doc_id", "field_id"], "left_semi")


def outside_profile(expected: DataFrame, profiles: DataFrame) -> DataFrame:
    """Expected fields that the document's type doesn't ask for."""
    return expected.join(profiles.select("document_type", "field_id"), ["document_type", "field_id"], "left_anti")


def type_accuracy(docs: DataFrame) -> DataFrame:
    """Types predicted against types expected: correct, wrong and abstained, with the accuracy over all and over what was predicted."""
    right = F.col("predicted") == F.col("expected")
    t = docs.agg(F.count_if(right).alias("correct"), F.count_if(~right).alias("wrong"), F.count_if(F.col("predicted").isNull()).alias("abstained"))
    return t.withColumn("accuracy", rate(F.col("correct"), F.col("correct") + F.col("wrong") + F.col("abstained"))).withColumn("precision", rate(F.col("correct"), F.col("correct") + F.col("wrong")))


def manifest_errors(manifest: DataFrame) -> DataFrame:
    """file, error: repeated files, fields without a type, fields both expected and absent. manifest: file, document_type, fields array<string>, absent array<string>."""
    repeated = manifest.groupBy("file").agg(F.count("*").alias("n")).where("n > 1").select("file", F.lit("REPEATED_FILE").alias("error"))
    untyped = manifest.where("document_type is null and size(fields) > 0").select("file", F.lit("FIELDS_WITHOUT_TYPE").alias("error"))
    both = manifest.where(F.arrays_overlap("fields", "absent")).select("file", F.lit("EXPECTED_AND_ABSENT").alias("error"))
    return repeated.unionByName(untyped).unionByName(both)
