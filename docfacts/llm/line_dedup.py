"""Line dedup by distinct-site spread.

Every line is hashed (trimmed, lower-cased). A HyperLogLog sketch of the sites of each line is made in the map tasks and
merged by aggregation. A line whose estimate lies clearly over `min_sites` is boilerplate; the lines near it, and only
those, get an exact distinct count. Boilerplate lines are removed from all texts; with `keep_first`, the occurrence in the
lowest doc_id (and line) stays, so that no content goes altogether.

Main path: DataFrame functions alone. Sketches, not site lists, are shuffled, so a line that every document has costs one
small row a task. What is to be removed, as line numbers, is joined by doc_id and text hash; a text's lines are kept by a set difference of numbers, linear in
its length. The set of boilerplate lines is broadcast if it has at most `broadcast_rows` rows and joined by shuffle else, each line
in `SALTS` copies, so that a line of all documents is spread over as many tasks.

Nulls: a null text is empty, a null site is a site of its own. Rows with a null doc_id are counted, and stay as they are.
Lines of fewer than `min_words` words are left alone. Repeated rows: each counts; rows of an id are cleaned each by the lines of its own text, and with
`keep_first` the lowest doc_id's line stays in every text of that id that has it in that place. A text that is boilerplate throughout becomes empty; its row stays. Other columns pass through, whatever their names; only text, n_lines and
n_removed are set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm.common import checkpoint, read_table

SALTS = 16


def line_key(line: Column) -> Column:
    """96 bits of hash of the normal form."""
    form = F.lower(F.trim(line))
    return F.struct(F.xxhash64(form).alias("a"), F.hash(form).alias("b"))


def counted_line(line: Column, min_words: int) -> Column:
    return line.rlike(r"(?:[^ ]+ +){%d}[^ ]" % (min_words - 1)) if min_words > 1 else F.trim(line) != ""


def lines_of(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    exploded = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return exploded.where(counted_line(F.col("line"), min_words)).select("doc_id", "mark", "site", "pos", line_key(F.col("line")).alias("key"))


def boilerplate_lines(docs: DataFrame, site: str = "source", min_sites: int = 5, min_words: int = 4, lg_k: int = 12) -> DataFrame:
    """key and first (doc_id, pos) of the lines that stand on `min_sites` sites or more."""
    lines = lines_of(docs, site, min_words)
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "pos"))).alias("first")
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), first).withColumn("about", F.hll_sketch_estimate("sketch"))
    margin = max(1, round(0.1 * min_sites))  # six standard errors and more
    spread = checkpoint(spread.where(F.col("about") >= min_sites - margin).select("key", "first", "about"))
    sure, near = spread.where(F.col("about") > min_sites + margin), spread.where(F.col("about") <= min_sites + margin)
    exact = lines.join(F.broadcast(near.select("key")) if near.count() <= 1_000_000 else near.select("key"), "key", "left_semi")
    exact = exact.groupBy("key", "site").agg(F.lit(1)).groupBy("key").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.select("key", "first").unionByName(near.join(exact, "key", "left_semi").select("key", "first"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = 5, min_words: int = 4, keep_first: bool = True, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The table with boilerplate lines removed from text, and n_lines, n_removed."""
    common = checkpoint(boilerplate_lines(docs, site, min_sites, min_words))
    lines = lines_of(docs, site, min_words).where("doc_id is not null")
    if common.count() <= broadcast_rows:
        hits = lines.join(F.broadcast(common), "key")
    else:
        salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    stays = F.lit(keep_first) & (F.col("doc_id") == F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))
    removal = hits.where(~F.coalesce(stays, F.lit(False))).groupBy(F.col("doc_id").alias("id"), "mark").agg(F.collect_set("pos").alias("gone"))

    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("doc"), F.split(whole, "\n").alias("lines"), F.xxhash64(whole).alias("own"))
    joined = rows.join(removal.hint("shuffle_hash"), (F.col("doc.doc_id") == F.col("id")) & (F.col("own") == F.col("mark")), "left")
    numbers = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(F.transform(numbers, lambda i: F.get("lines", i)), "\n"))
    new = {"text": text, "n_lines": F.size("lines").cast("long"), "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    kept = [new.pop(c).alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return joined.select(*kept, *[value.alias(c) for c, value in new.items()])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the cleaned text of every document."""
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


ORACLE_SQL = r"""
WITH numbered AS (
  SELECT *, row_number() OVER () AS rn FROM documents
), lines AS (
  SELECT rn, doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM numbered
), keyed AS (
  SELECT *, CASE WHEN regexp_matches(line, '([^ ]+ +){3}[^ ]') THEN lower(trim(line, ' ')) END AS key FROM lines
), common AS (
  SELECT key, min((doc_id, pos)) AS first FROM keyed WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT site) >= 5
), marked AS (
  SELECT k.*, c.key IS NOT NULL AND c.first <> (k.doc_id, k.pos) AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS clean_sha256
FROM marked GROUP BY rn, doc_id
"""
