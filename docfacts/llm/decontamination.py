"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Test items are short, documents long, so a symmetric MinHash of whole sets says little. The search sketches the small
side alone: an item's sketch holds the k of its shingles with the smallest second hash (bottom-k MinHash), and the share
of the sketch that a document holds estimates the item's containment in it. Items are partitioned by the power of two of
their size; the partition's upper bound sets k so that an item contained to `threshold` or more cannot miss its sketch:
it lacks at most (1 - threshold) * n shingles, hence at least k minus that many sketch members are found. So the search
loses no pair; what it finds too much, the exact containment drops.

Main path: DataFrame functions alone. Documents are scanned, exploded to shingle hashes and probed against the sketches;
only hits are shuffled. The sketches are broadcast if they have at most `broadcast_rows` rows and joined by shuffle else.

Nulls: null texts and null items hold no shingle and match nothing; rows with a null doc_id or item_id are left out.
Repeated rows of an id count as one document with the most contained of its texts. A text or item of one to four words is
one shingle of all its words. Equal items are reported each. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm.common import SHINGLE_WORDS, SPACE, checkpoint, documents, let, read_table


def with_shingles(df: DataFrame, *keep: str) -> DataFrame:
    """`keep` and shingles: 64-bit hashes of the five-word shingles of lower-cased text, in order, repeats included."""
    words = F.filter(F.split(F.lower("text"), SPACE), lambda w: w != "")
    return df.select(*keep, let(F.transform(words, lambda w: F.xxhash64(w)), shingles_of).alias("shingles"))


def shingles_of(hashes: Column) -> Column:
    last = F.size(hashes) - SHINGLE_WORDS
    full = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + F.lit(k)) for k in range(SHINGLE_WORDS)]))
    short = F.array(F.xxhash64(F.concat_ws(",", F.transform(hashes, lambda h: h.cast("string")))))
    return F.when(last >= 0, full).when(F.size(hashes) > 0, short).otherwise(F.array().cast("array<bigint>"))


def item_sketches(items: DataFrame, threshold: float) -> DataFrame:
    """item_id, shingles (a set), n, missing (most that may lack), k and sketch of each item with a shingle."""
    sets = with_shingles(items, "item_id").select("item_id", F.array_distinct("shingles").alias("shingles")).where("size(shingles) > 0")
    sized = sets.withColumn("n", F.size("shingles")).withColumn("missing", (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9)).cast("int"))
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1  # of the item's size partition
    sized = sized.withColumn("k", F.least(F.col("n"), (2 * F.floor((1 - threshold) * upper + 1e-9) + 4).cast("int")))
    ranked = F.array_sort(F.transform("shingles", lambda s: F.struct(F.xxhash64(s, F.lit(7)).alias("rank"), s.alias("s"))))
    return sized.withColumn("sketch", F.transform(F.slice(ranked, F.lit(1), F.col("k")), lambda x: x["s"]))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, n_item (shingles of the item), n_shared, containment of every pair of `threshold` or more."""
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null").distinct()
    items = checkpoint(item_sketches(items.withColumn("item_id", F.struct("item_id", F.xxhash64("text"))), threshold))
    rows = documents(docs).where("doc_id is not null")
    sized = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df

    sketch = items.select("item_id", "k", "missing", F.explode("sketch").alias("s"))
    probes = with_shingles(rows, "doc_id").select("doc_id", F.explode("shingles").alias("s"))
    found = probes.join(sized(sketch), "s").groupBy("doc_id", "item_id").agg(F.size(F.collect_set("s")).alias("hits"), F.first("k").alias("k"), F.first("missing").alias("missing"))
    candidates = checkpoint(found.where(F.col("hits") >= F.greatest(F.lit(1), F.col("k") - F.col("missing"))).select("doc_id", "item_id"))

    ids = candidates.groupBy("doc_id").agg(F.collect_list("item_id").alias("item_ids"))
    texts = with_shingles(rows.join(sized(ids), "doc_id"), "doc_id", "item_ids").select("doc_id", F.array_distinct("shingles").alias("doc_set"), F.explode("item_ids").alias("item_id"))
    shared = texts.join(sized(items.select("item_id", "shingles", "n")), "item_id").select("doc_id", "item_id", "n", F.size(F.array_intersect("doc_set", "shingles")).alias("n_shared"))
    best = shared.groupBy("doc_id", F.col("item_id.item_id").alias("item_id")).agg(F.max(F.struct(F.col("n_shared") / F.col("n"), "n_shared", "n")).alias("b"))
    out = best.select("doc_id", "item_id", F.col("b.n").cast("long").alias("n_item"), F.col("b.n_shared").cast("long").alias("n_shared"), F.col("b.col1").alias("containment"))
    return out.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_item") - 1e-9))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 1, item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark WHERE item_id IS NOT NULL
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM rows_ WHERE len(w) > 0)
), sizes AS (SELECT id AS item_id, count(*) AS n_item FROM shingles WHERE kind = 1 GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared
  FROM shingles d JOIN shingles b ON d.s = b.s AND d.kind = 0 AND b.kind = 1 GROUP BY ALL
)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item_id) WHERE 10 * n_shared >= 8 * n_item
"""
