"""A search index in segments: changed documents are written as a new segment, earlier rows of theirs are dead and skipped when read.

Under the index's folder lie, by segment: `postings` (as `search.postings`, each file in the order of words, so that row groups and pages of other
words are skipped; a segment is cut by document if its rows were `search.spread`, and its postings move no more), `rows` (doc_id, page, n_words), `touched` (documents whose earlier rows are dead) and `stats` (what the segment added and
what it killed). `stats` is written last: a segment without it was broken off, isn't read, and is written anew by the next call. One writer at
a time; readers go on with the segments they began with. All rows read and written are spread over tasks; the driver learns four sums a segment.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.operators.search import postings

SCHEMAS = {
    "postings": "prefix string, term string, doc_id long, page int, tf int, n_words int, segment long", "rows": "doc_id long, page int, n_words int, segment long", "touched": "doc_id long, segment long",
    "stats": "n_rows long, n_sized long, n_words long, dead_rows long, dead_sized long, dead_words long, segment long",
}
BROADCAST_ROWS = 1_000_000


def stored(spark: SparkSession, path: str, part: str) -> DataFrame:
    """A part of all segments; without rows where no segment has it yet."""
    try:
        return spark.read.schema(SCHEMAS[part]).parquet(f"{path}/{part}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMAS[part])


def last_segment(spark: SparkSession, path: str) -> int:
    """The newest whole segment; -1 for an index that is empty."""
    newest = stored(spark, path, "stats").agg(F.max("segment")).first()[0]
    return -1 if newest is None else newest


def live(spark: SparkSession, path: str, part: str, newest: int) -> DataFrame:
    """Rows of a part up to a segment that no later one has replaced."""
    deaths = stored(spark, path, "touched").where(F.col("segment").between(1, newest)).groupBy("doc_id").agg(F.max("segment").alias("since"))
    few = deaths.count() <= BROADCAST_ROWS
    rows = stored(spark, path, part).where(F.col("segment") <= newest).join(F.broadcast(deaths) if few else deaths, "doc_id", "left")
    return rows.where("since is null or segment >= since").drop("since")


def write(df: DataFrame, path: str, part: str, segment: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{part}/segment={segment}")


def tally(rows: DataFrame) -> DataFrame:
    """A segment's stats, in one row; rows: n_words, dead."""
    def of(dead: bool, name: str) -> list[Column]:
        n_words = F.when(F.col("dead") == dead, F.col("n_words"))
        return [F.count_if(F.col("dead") == dead).alias(f"{name}_rows"), F.count(n_words).alias(f"{name}_sized"), F.coalesce(F.sum(n_words), F.lit(0)).alias(f"{name}_words")]

    return rows.agg(*of(False, "n"), *of(True, "dead"))


def add(spark: SparkSession, path: str, rows: DataFrame, deleted: DataFrame | None = None) -> int:
    """Writes a segment with the rows (doc_id, page, terms) of new and changed documents, which replace all earlier ones of theirs, and marks `deleted` (doc_id) as gone. Returns its number.

    Only these rows are written, only lengths of earlier ones are read. Rows with a null doc_id are kept and never replaced. Rows without terms count as rows, those of null terms have no length; repeated rows count as often as they come.
    """
    newest = last_segment(spark, path)
    segment = newest + 1
    rows = rows.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "terms")
    touched = rows.select("doc_id")
    if deleted is not None:
        touched = touched.unionByName(deleted.select(F.col("doc_id").cast("long")))
    write(touched.where("doc_id is not null").distinct(), path, "touched", segment)
    write(postings(rows).sortWithinPartitions("term", "doc_id"), path, "postings", segment)
    write(rows.select("doc_id", "page", F.size("terms").alias("n_words")), path, "rows", segment)
    mine = stored(spark, path, "touched").where(F.col("segment") == segment)
    killed = live(spark, path, "rows", newest).join(mine.select("doc_id"), "doc_id", "left_semi")
    added = stored(spark, path, "rows").where(F.col("segment") == segment)
    write(tally(added.select("n_words", F.lit(False).alias("dead")).unionByName(killed.select("n_words", F.lit(True).alias("dead")))), path, "stats", segment)
    return segment


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Living postings and their lengths (n_rows, avg_len), for `search.search_postings`, which reads only the words that begin with its terms."""
    newest = last_segment(spark, path)
    whole = stored(spark, path, "stats").where(F.col("segment") <= newest)
    rows, sized, words = (F.coalesce(F.sum(F.col(f"n_{x}") - F.col(f"dead_{x}")), F.lit(0)) for x in ("rows", "sized", "words"))
    sizes = whole.agg(rows.alias("n_rows"), F.coalesce(F.try_divide(words, sized), F.lit(1.0)).alias("avg_len"))
    return live(spark, path, "postings", newest).drop("segment"), sizes


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Writes the living rows as the one segment of a new index in an empty folder, without the texts; readers of the old folder aren't disturbed."""
    newest = last_segment(spark, path)
    write(live(spark, path, "postings", newest).drop("segment").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), to, "postings", 0)
    write(live(spark, path, "rows", newest).drop("segment"), to, "rows", 0)
    write(spark.createDataFrame([], "doc_id long"), to, "touched", 0)
    write(tally(stored(spark, to, "rows").select("n_words", F.lit(False).alias("dead"))), to, "stats", 0)
