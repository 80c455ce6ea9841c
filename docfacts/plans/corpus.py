"""Text, template and audit queries over documents, pages and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions import text as T
from docfacts.operators import names, templates
from docfacts.sources import render


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_documents(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded_sha256"))


def tokenize_documents(spark, sf_dir):
    words = docs_of(spark, sf_dir).select("doc_id", T.folded_words(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def lines_explode(spark, sf_dir):
    """Lines of each document: trimmed, blank ones dropped."""
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return docs_of(spark, sf_dir).select("doc_id", F.posexplode(lines).alias("line", "text")).select("doc_id", F.col("line").cast("long").alias("line"), F.length("text").cast("long").alias("n_chars"))


def template_fingerprint(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select("doc_id", templates.fingerprint(F.split("text", "\n")).alias("fingerprint"))
    return rows


def template_clusters(spark, sf_dir):
    """Rendered documents by signature."""
    return templates.template_counts(render.pages(spark, sf_dir)).groupBy().agg(F.count("*").alias("templates"), F.sum("documents").alias("documents"))


def template_similarity(spark, sf_dir):
    """Nations' name features against regions' as rules: Jaccard of letter sets."""
    letters = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x.rlike("[a-z]"))))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), letters(F.col("p_type")).alias("features"))
    rules = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("rule_id"), letters(F.col("n_name")).alias("features"))
    return templates.similar_to_rules(parts, rules, 0.3)


def near_cleanup(spark, sf_dir):
    """Customers whose name is a clean-up of the name of the customer with the next key."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    other = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("other"))
    return c.join(other, "c_custkey").where(T.is_cleanup(F.col("c_name"), F.col("other"))).select("c_custkey", F.levenshtein(T.fold(F.col("c_name")), T.fold(F.col("other"))).cast("long").alias("distance"))


def content_sha(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.sha2("html", 256).alias("sha256"))


def json_fields(spark, sf_dir):
    """Keys of the events' properties; a broken object counts as empty."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.explode(F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n"))


def corpus_manifest(spark, sf_dir):
    """Value-free counts of the corpus, and how many texts leak an IBAN or a personal tax code."""
    leak = F.col("text").rlike(r"(?<![A-Za-z0-9_])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9_])") | F.col("text").rlike(r"(?<![A-Za-z0-9_])[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z](?![A-Za-z0-9_])")
    return docs_of(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.count_if(leak).alias("leaks"))


def file_names(spark, sf_dir):
    """Safe and distinct stems of parts' names and numbers: the names repeat, and some stems end in a number themselves."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("-"), (F.col("p_size") % 7).cast("string"))).otherwise(F.col("p_type"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.safe_stem(name).alias("stem"))
    return names.distinct_names(parts, "p_partkey").select("p_partkey", "file")


ROWS = "SELECT doc_id, list_filter(string_split(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents"
QUERIES = {f.__name__: f for f in (fold_documents, tokenize_documents, lines_explode, template_fingerprint, template_clusters, template_similarity, near_cleanup, content_sha, json_fields, corpus_manifest, file_names)}
ORACLE_SQL = {
    "fold_documents": "SELECT doc_id, sha256(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))) AS folded_sha256 FROM documents",
    "tokenize_documents": f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM ({ROWS})",
    "lines_explode": r"""SELECT doc_id, unnest(range(0, len(l))) AS line, length(unnest(l)) AS n_chars
        FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)""",
    "template_fingerprint": r"""WITH head AS (
          SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1:20] AS l FROM documents
        ), labels AS (
          SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(l, lambda x: array_to_string(list_filter(string_split_regex(lower(strip_accents(
            CASE WHEN trim(string_split_regex(x, ':|\t|\s{2,}')[1], ' ') = '' THEN x ELSE trim(string_split_regex(x, ':|\t|\s{2,}')[1], ' ') END)), '[^\p{L}\p{N}]+'),
            lambda w: length(w) >= 3 AND NOT regexp_matches(w, '\p{N}') AND regexp_matches(w, '\p{L}')), ' ')), lambda x: x <> ''))) AS s FROM head
        ) SELECT doc_id, CASE WHEN len(s) >= 3 THEN substr(sha256(array_to_string(s, chr(10))), 1, 16) END AS fingerprint FROM labels""",
    "template_similarity": """WITH f AS (SELECT p_partkey AS id, list_distinct(list_filter(string_split(lower(p_type), ''), lambda x: regexp_matches(x, '[a-z]'))) AS a FROM part),
        r AS (SELECT n_nationkey AS rule_id, list_distinct(list_filter(string_split(lower(n_name), ''), lambda x: regexp_matches(x, '[a-z]'))) AS b FROM nation)
        SELECT id AS doc_id, rule_id, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS similarity FROM f, r
        WHERE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) >= 0.3""",
    "near_cleanup": """WITH f AS (SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS a FROM customer)
        SELECT f.c_custkey, levenshtein(f.a, o.a) AS distance FROM f JOIN f o ON o.c_custkey = f.c_custkey + 1 WHERE levenshtein(f.a, o.a) <= greatest(1, greatest(length(f.a), length(o.a)) // 4)""",
    "content_sha": "SELECT page_id, sha256(html) AS sha256 FROM pages",
    "json_fields": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1",
    "corpus_manifest": r"""SELECT lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars,
        count(*) FILTER (regexp_matches(text, '(^|[^A-Za-z0-9_])[A-Z]{2}\d{2}[A-Z0-9]{11,30}($|[^A-Za-z0-9_])') OR regexp_matches(text, '(^|[^A-Za-z0-9_])[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]($|[^A-Za-z0-9_])')) AS leaks FROM documents GROUP BY 1""",
    "file_names": r"""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN p_type || '-' || p_size % 7 ELSE p_type END, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g')[1:80] AS s FROM part),
        o AS (SELECT *, row_number() OVER (PARTITION BY lower(s) ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY lower(s)) AS size FROM s),
        free AS (SELECT stem, n, row_number() OVER (PARTITION BY stem ORDER BY n) AS k FROM (SELECT stem, unnest(range(2, size + 1000)) AS n FROM (SELECT lower(s) AS stem, max(size) AS size FROM o GROUP BY 1)) WHERE NOT EXISTS (FROM s WHERE lower(s.s) = stem || '-' || n))
        SELECT p_partkey, CASE WHEN o.k = 0 THEN s ELSE s || '-' || n END AS file FROM o LEFT JOIN free ON stem = lower(s) AND free.k = o.k""",
}
