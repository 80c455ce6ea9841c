"""Queue, search and feed queries over orders, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.operators import queue, search
from docfacts.operators.extraction import band, four_places


def queue_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review queue: one document per order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    confidence = F.floor(F.col("o_totalprice") % 100) / 100
    status = F.when(F.col("o_orderstatus") == "O", "NEEDS_REVIEW").when(F.col("o_orderstatus") == "F", "REVIEWED").otherwise("DISCARDED")
    type_ = F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.concat(F.lit("type."), F.substring("o_orderpriority", 1, 1)))
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), type_.alias("document_type"), confidence.alias("confidence"), F.when(F.col("o_orderkey") % 7 > 0, band(confidence)).alias("band"), F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("owner"))


def queue_kpis(spark, sf_dir):
    return queue.kpis(queue_documents(spark, sf_dir))


def type_counts(spark, sf_dir):
    return queue.type_counts(queue_documents(spark, sf_dir))


def filtered_queue(spark, sf_dir):
    """Documents to review, of low confidence, untyped."""
    docs = queue.filtered(queue_documents(spark, sf_dir), status="NEEDS_REVIEW", document_type="(none)", band="LOW")
    return docs.select("id", F.col("at").alias("received_at"), "owner")


def mean_confidence(spark, sf_dir):
    """Mean confidence and its band, by owner."""
    rows = queue_documents(spark, sf_dir).groupBy("owner").agg(four_places(F.avg("confidence")).alias("confidence"))
    return rows.withColumn("band", band(F.col("confidence")))


def tally_status(spark, sf_dir):
    return queue.tally(queue_documents(spark, sf_dir), "document_type")


def events_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("document_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("title"))


def recent_feed(spark, sf_dir):
    docs = queue_documents(spark, sf_dir).select(F.col("id").alias("document_id"), "status")
    return queue.recent_feed(events_of(spark, sf_dir), docs).select("document_id", "seq", "title", "status")


def latest_run(spark, sf_dir):
    """The newest event of each document."""
    return queue.latest_by(events_of(spark, sf_dir), ["document_id"], [F.col("at").desc(), F.col("seq").desc()]).select("document_id", "seq", "title")


def upsert_documents(spark, sf_dir):
    """Yesterday's orders synchronised with today's: customers' newest order against their newest before 2000."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    newest = lambda rows: rows.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("at"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("name"))
    return queue.upsert(newest(o.where("o_orderdate < '2000-01-01'")), newest(o.where("o_orderkey % 3 = 0"))).select("id", "name", "is_new", "is_stale")


def needing_extraction(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("document_id"), F.lit("v2").alias("engine_version"), F.when(F.col("event_type") == "error", "FAILED_OCR").otherwise("COMPLETED").alias("status"))
    return queue.needing_extraction(queue_documents(spark, sf_dir), runs, "v2").select("id")


def cache_usage(spark, sf_dir):
    return queue.cache_usage(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("n_chars").alias("length")))


def pages_needing_ocr(spark, sf_dir):
    """Documents whose trimmed text is under 100 characters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.where(F.length(F.trim("text")) < 100).select("doc_id", F.length("text").cast("long").alias("n"))


def search_bm25(spark, sf_dir):
    """All documents that match two prefixes, with rank."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("page"), "text")
    found = search.search(search.page_rows(docs), search.query_terms("The oner"), limit=None)
    return found.select("doc_id", F.round("rank", 6).alias("rank"))


def search_hits(spark, sf_dir):
    """The fifty best hits' documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("page"), "text")
    return search.search(search.page_rows(docs), search.query_terms("the oner")).select("doc_id")


def search_snippets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("page"), "text")
    return search.snippets(search.page_rows(docs), search.query_terms("the oner"))


QUEUE = """
WITH queue AS (
  SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'NEEDS_REVIEW' WHEN 'F' THEN 'REVIEWED' ELSE 'DISCARDED' END AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'type.' || substr(o_orderpriority, 1, 1) END AS document_type, floor(o_totalprice % 100) / 100 AS confidence,
    CASE WHEN o_orderkey % 7 > 0 THEN CASE WHEN floor(o_totalprice % 100) / 100 >= 0.9 THEN 'HIGH' WHEN floor(o_totalprice % 100) / 100 >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END END AS band,
    o_orderdate AS received_at, o_custkey AS owner FROM orders
)
"""
FOLDED = r"""
WITH rows_ AS (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents
), tf AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: starts_with(x, 'the'))) AS a, len(list_filter(w, lambda x: starts_with(x, 'oner'))) AS b FROM rows_),
stats AS (SELECT count(*) AS rows, avg(n) AS l, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM tf),
ranked AS (
  SELECT doc_id, ln(1 + (rows - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / l)) + ln(1 + (rows - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / l)) AS rank
  FROM tf, stats WHERE a > 0 AND b > 0
)
"""
QUERIES = {f.__name__: f for f in (queue_kpis, type_counts, filtered_queue, mean_confidence, tally_status, recent_feed, latest_run, upsert_documents, needing_extraction, cache_usage, pages_needing_ocr, search_bm25, search_hits, search_snippets)}
ORACLE_SQL = {
    "queue_kpis": QUEUE + "SELECT count(*) AS total, count(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (coalesce(band, 'LOW') = 'LOW') AS low_band, count(*) FILTER (document_type IS NULL) AS untyped FROM queue",
    "type_counts": QUEUE + "SELECT document_type, count(*) AS n FROM queue WHERE document_type IS NOT NULL GROUP BY 1",
    "filtered_queue": QUEUE + "SELECT id, received_at, owner FROM queue WHERE status = 'NEEDS_REVIEW' AND document_type IS NULL AND coalesce(band, 'LOW') = 'LOW'",
    "mean_confidence": QUEUE + "SELECT owner, c AS confidence, CASE WHEN c >= 0.9 THEN 'HIGH' WHEN c >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (SELECT owner, floor(avg(confidence) * 10000 + 0.5) / 10000 AS c FROM queue GROUP BY 1)",
    "tally_status": QUEUE + "SELECT coalesce(document_type, 'null') AS value, count(*) AS n FROM queue GROUP BY 1",
    "recent_feed": QUEUE + "SELECT user_id AS document_id, event_id AS seq, event_type AS title, status FROM events JOIN queue ON id = user_id ORDER BY ts DESC, event_id DESC LIMIT 500",
    "latest_run": "SELECT user_id AS document_id, event_id AS seq, event_type AS title FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "upsert_documents": """WITH old AS (SELECT o_custkey AS id, max(o_orderdate) AS at, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS name FROM orders WHERE o_orderdate < '2000-01-01' GROUP BY 1),
        new AS (SELECT o_custkey AS id, max(o_orderdate) AS at, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS name FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
        SELECT id, coalesce(new.name, old.name) AS name, old.name IS NULL AS is_new, new.at IS NOT NULL AND (old.at IS NULL OR new.at > old.at) AS is_stale FROM old FULL JOIN new USING (id)""",
    "needing_extraction": QUEUE + "SELECT id FROM queue WHERE status = 'NEEDS_REVIEW' AND NOT EXISTS (FROM events WHERE user_id = id AND event_type <> 'error')",
    "cache_usage": "SELECT count(*) AS files, coalesce(sum(n_chars), 0)::BIGINT AS bytes FROM documents",
    "pages_needing_ocr": "SELECT doc_id, length(text) AS n FROM documents WHERE length(trim(text, ' ')) < 100",
    "search_bm25": FOLDED + "SELECT doc_id, round(rank, 6) AS rank FROM ranked",
    "search_snippets": FOLDED + """, seen AS (SELECT doc_id, w, i - 1 AS i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM rows_ JOIN ranked USING (doc_id))),
        ends AS (SELECT doc_id, w, i, max(CASE WHEN starts_with(x, 'the') THEN i END) OVER o AS a, max(CASE WHEN starts_with(x, 'oner') THEN i END) OVER o AS b FROM seen WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        run AS (SELECT doc_id, w, len(w) AS n, least(a, b) AS s, i - least(a, b) + 1 AS l FROM ends WHERE a IS NOT NULL AND b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i - least(a, b), i) = 1),
        shown AS (SELECT doc_id, w, CASE WHEN l >= 12 THEN s ELSE greatest(0, least(s - (12 - l) // 2, greatest(n - 12, s - (12 - l)))) END AS f FROM run)
        SELECT doc_id, 1 AS page, array_to_string(list_transform(w[f + 1 : f + 12], lambda x: CASE WHEN starts_with(x, 'the') OR starts_with(x, 'oner') THEN '[' || x || ']' ELSE x END), ' ') AS snippet FROM shown""",
    "search_hits": FOLDED + "SELECT doc_id FROM ranked ORDER BY rank DESC, doc_id LIMIT 50",
}
