"""The corpus pipeline: quality, line dedup, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns
of documents. Nulls, empty texts and repeated rows are handled as the operators' own docstrings say: a null text is
empty, rows with a null doc_id pass the deduplicating stages as they are, repeated rows of an id stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm import decontamination, line_dedup, near_dedup, packing, quality
from docfacts.llm.common import checkpoint, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_QUALITY = 0.3
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't among `gone`; broadcast only up to a checked number of ids."""
    gone = checkpoint(gone.select("doc_id").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.fit(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), read_table(spark, sf_dir, "labels"), "quality", F.lit(True))
    return quality.score_quality(docs.select(*COLUMNS), model, *COLUMNS).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of 0.8 or more): 31 bands of 5 miss a pair at 0.8 once in 200,000."""
    return without(docs, near_dedup.near_duplicates(docs, percent=80, n_bands=31, band_rows=5).where("not kept"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return without(docs, decontamination.contaminated(docs, read_table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with the ids of their tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_good), ("line_dedup", drop_lines), ("near_dedup", keep_one_of_each), ("decontamination", keep_uncontaminated), ("packing", pack)]
#: SQL expresses neither the classifier nor the packing; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
