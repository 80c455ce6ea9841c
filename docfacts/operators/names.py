"""Names that don't collide, whatever case they are in: repeated stems get a number that no other file's own stem ends in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_names(rows: DataFrame, order: str) -> DataFrame:
    """Adds file: the stem for the first of those that share it, in `order` (unique), and the stem with the next free number, from 2 on, for the others.

    rows: `order`, stem, and what else there is but file, place, number, own and taken. A file whose own stem is "a-2" keeps it, so no second "a" gets
    that name, whichever comes first: names don't depend on a walk over all files. A null stem counts as "file".

    The k-th repeated file of a stem wants the k-th number that isn't taken. If the i-th of the taken numbers, ascending, is t, then t - 1 - i
    free ones lie below it; so the files with a greater k than that step over it. Taken numbers and files are put in one order and the steps are a running
    count: one window a stem, with neither a list of numbers nor rounds over what still collides.
    """
    stem = F.coalesce("stem", F.lit("file"))
    files = rows.withColumns({"stem": stem, "own": F.lower(stem)})
    ranked = files.withColumn("place", F.row_number().over(Window.partitionBy("own").orderBy(order)) - 1)
    ends = F.regexp_extract("own", r"^(.+)-([1-9]\d{0,17})$", 2)
    numbered = files.where(ends != "").select(F.regexp_extract("own", r"^(.+)-([1-9]\d{0,17})$", 1).alias("own"), ends.cast("long").alias("number")).distinct().where("number >= 2")
    below = F.col("number") - 1 - F.row_number().over(Window.partitionBy("own").orderBy("number"))
    steps = numbered.withColumn("place", below).select("own", "place", F.lit(1).alias("taken"))
    both = ranked.withColumn("taken", F.lit(0)).unionByName(steps, allowMissingColumns=True)
    # a step at place p concerns the files of places above it
    run = Window.partitionBy("own").orderBy("place", F.col("taken")).rowsBetween(Window.unboundedPreceding, 0)
    named = both.withColumn("number", F.col("place") + 1 + F.sum("taken").over(run)).where("taken = 0")
    file = F.when(F.col("place") == 0, F.col("stem")).otherwise(F.concat_ws("-", "stem", F.col("number").cast("string")))
    return named.withColumn("file", file).drop("own", "place", "number", "taken")
