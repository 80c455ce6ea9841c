"""Queries of acquisition, learning events, profile edits and scoring over logs derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.operators import events, profiles, scoring
from docfacts.plans.relational import QUEUE, queue_documents
from docfacts.plans.review import FIELDS, fields_of
from docfacts.sources import acquisition
from docfacts.sources.render import italian_amount


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def drive_listing(spark, sf_dir):
    """Nations as folders, parts as files; every tenth part is a shortcut to the next one, every hundredth a broken one."""
    p, n = read(spark, sf_dir, "part"), read(spark, sf_dir, "nation")
    k = F.col("p_partkey")
    files = p.select(k.alias("id"), F.concat(F.col("p_name"), F.lit(" "), k.cast("string")).alias("name"), F.lit(False).alias("is_folder"), F.when(k % 100 == 0, F.lit(-5)).when(k % 10 == 0, k + 1).alias("target_id"))
    folders = n.select((-100 - F.col("n_nationkey")).cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(True).alias("is_folder"), F.lit(None).cast("long").alias("target_id"))
    return acquisition.listing(files.unionByName(folders), files.where("target_id is null").drop("target_id")).select("id", "is_folder")


def files_to_fetch(spark, sf_dir):
    remote = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("modified"))
    stored = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("modified"), (F.max("o_orderkey") % 4 > 0).alias("cached"))
    return acquisition.to_fetch(remote, stored).select("id")


def acquired_pages(spark, sf_dir):
    """Documents in a language other than English have no text layer; all of them but one source's were recognised."""
    d = read(spark, sf_dir, "documents").withColumn("page", (F.col("doc_id") % 2 + 1).cast("int"))
    native = d.select("doc_id", "page", F.when(F.col("lang") == "en", F.col("text")).otherwise("").alias("text"))
    ocr = d.where("lang <> 'en' and source <> 'src3'").select("doc_id", "page", "text")
    pages = acquisition.acquire(native, ocr)
    return pages.groupBy("text_source").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


def document_sources(spark, sf_dir):
    """Sources of whole documents, ten pages each."""
    d = read(spark, sf_dir, "documents")
    pages = d.select((F.col("doc_id") / 10).cast("long").alias("doc_id"), (F.col("doc_id") % 10).cast("int").alias("page"), F.when(F.length("text") < 100, "OCR_FAILED").when(F.length("text") < 400, "OCR").otherwise("NATIVE_TEXT").alias("text_source"))
    return acquisition.document_source(pages).select("doc_id", "text_source", F.array_join(F.transform("ocr_pages", lambda p: p.cast("string")), ",").alias("ocr_pages"), F.array_join(F.transform("failed_pages", lambda p: p.cast("string")), ",").alias("failed_pages"))


def runs_to_lines(spark, sf_dir):
    """Customers as lines of three runs, out of order, on slightly uneven baselines."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    run = lambda i, text, x, dy: F.struct((k * 3 + i).alias("seq"), text.alias("text"), F.lit(float(x)).alias("x"), (k % 20 * 12.0 + dy).alias("y"))
    runs = c.select((k / 20).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(run(0, F.col("c_mktsegment"), 200, 0.0), run(1, k.cast("string"), 10, 1.5), run(2, F.col("c_name"), 60, -1.5))).alias("r"))
    lines = acquisition.group_runs(runs.select("doc_id", "page", "r.*", F.lit(40.0).alias("w"), F.lit(9.0).alias("h")))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), "text", "x", "w", "h")


def placed_boxes(spark, sf_dir):
    """Line items as boxes, scaled, turned by a right angle and moved."""
    m = acquisition.compose(F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("abcdef", (0, 1, -1, 0, 50, 5), strict=True)]), F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("abcdef", (2, 0, 0, 3, 0, 0), strict=True)]))
    box = acquisition.place_box(m, F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.lit(4.0), F.lit(2.0))
    return read(spark, sf_dir, "lineitem").select(box.alias("b")).groupBy().agg(F.sum("b.x").alias("x"), F.sum("b.y").alias("y"), F.max("b.w").alias("w"), F.max("b.h").alias("h"))


def review_events(spark, sf_dir):
    rows = fields_of(spark, sf_dir).withColumn("at", F.current_timestamp())
    return events.review_events(rows).groupBy("field_id", "outcome").agg(F.count("*").alias("n"))


def closures_of(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 97).alias("document_key"), F.when(F.col("event_type") == "error", "DISCARDED").otherwise("REVIEWED").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("document_type"))


def last_closures(spark, sf_dir):
    return events.last_closures(closures_of(spark, sf_dir)).select("document_key", "seq")


def replay_reviews(spark, sf_dir):
    """Closures that the log of even documents lacks."""
    done = closures_of(spark, sf_dir).where("document_key % 2 = 0").select("document_key")
    return events.replay(closures_of(spark, sf_dir), done).select("document_key", "seq")


def template_proofs(spark, sf_dir):
    c = closures_of(spark, sf_dir).withColumn("template", F.col("document_key") % 10)
    rules = spark.range(20).select(F.col("id").alias("rule_id"), (F.col("id") % 10).alias("template"), F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("document_type"))
    return events.template_proofs(c, rules).groupBy("rule_id", "effect").agg(F.count("*").alias("n"))


def edits_of(spark, sf_dir):
    """A log of profile edits: purchases revert what came before them."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "HINT").when(F.col("event_type") == "view", "CARDINALITY").otherwise("STATE")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("document_type"), (F.col("event_id") % 13).alias("field_id"), kind.alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, F.col("ts")).alias("reverted_at"), F.when(F.col("event_type") == "purchase", F.col("event_id") - 1).alias("reverts_id"), F.col("event_type").alias("title"))


def standing_edits(spark, sf_dir):
    return profiles.standing(edits_of(spark, sf_dir)).select("document_type", "field_id", "kind", "id")


def revertable_edits(spark, sf_dir):
    return profiles.revertable(edits_of(spark, sf_dir))


def activity_feed(spark, sf_dir):
    """The newest four hundred of edits and rule actions."""
    log = edits_of(spark, sf_dir)
    return profiles.activity(log.where("kind <> 'STATE'"), log.where("kind = 'STATE'")).select("id", "origin")


def reprocess_queue(spark, sf_dir):
    changed = spark.createDataFrame([("type.1",), ("type.3",)], "document_type string")
    return profiles.to_reprocess(queue_documents(spark, sf_dir), changed, "document_type").select("id")


def rename_fields(spark, sf_dir):
    """field_1 becomes field_2 where the document has no such field yet."""
    rows = fields_of(spark, sf_dir).select("document_id", "name", "part")
    return profiles.rename_fields(rows, {"field_1": "field_2"}).groupBy("name").agg(F.count("*").alias("n"))


def files_manifest(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    files = pages.groupBy(F.col("url").alias("name")).agg(F.max("html").alias("content"))
    recorded = files.select("name", F.when(F.length("content") % 4 > 0, F.sha2("content", 256)).otherwise("changed").alias("sha256"))
    return profiles.files_manifest(files, recorded)


def expiries(spark, sf_dir):
    """Order dates one to four years on."""
    o = read(spark, sf_dir, "orders")
    years = (F.col("o_orderkey") % 4 + 1).cast("int")
    return o.select("o_orderkey", F.date_format(profiles.expiry(F.to_date("o_orderdate"), years), "yyyy-MM-dd").alias("expires"))


def scoring_by_type(spark, sf_dir):
    """Line statuses as readings of the return flags, scored by ship year."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    key = [F.col("l_orderkey").alias("doc_id"), F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_extendedprice").cast("string")).alias("field_id")]
    expected = l.select(*key, F.col("l_linestatus").alias("value"), F.year("l_shipdate").alias("year")).dropDuplicates(["doc_id", "field_id"])
    got = l.select(*key, F.when(F.col("l_partkey") % 9 == 0, None).when(F.col("l_partkey") % 7 == 0, "x").otherwise(F.col("l_linestatus")).alias("value")).dropDuplicates(["doc_id", "field_id"])
    return scoring.summary(scoring.field_outcomes(expected, got), ["year"])


def type_accuracy(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderpriority").alias("expected"), F.when(F.col("o_orderkey") % 6 == 0, None).when(F.col("o_orderkey") % 5 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("predicted"))
    return scoring.type_accuracy(docs)


def normal_values(spark, sf_dir):
    """Amounts and dates in other spellings become equal."""
    o = read(spark, sf_dir, "orders")
    amount = scoring.normal_value(italian_amount(F.col("o_totalprice")), F.lit("money")) == scoring.normal_value(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("number"))
    date = scoring.normal_value(F.date_format("o_orderdate", "d.M.yyyy"), F.lit("date")) == scoring.normal_value(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("date"))
    return o.agg(F.count_if(amount).alias("amounts"), F.count_if(date).alias("dates"))


CLOSURES = "WITH c AS (SELECT event_id % 97 AS document_key, event_type = 'error' AS discarded, ts, event_id AS seq, 't' || (user_id % 4) AS document_type FROM events), last AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY document_key ORDER BY ts DESC, seq DESC) = 1) "
EDITS = "WITH log AS (SELECT event_id AS id, 't' || (user_id % 4) AS document_type, event_id % 13 AS field_id, CASE event_type WHEN 'click' THEN 'HINT' WHEN 'view' THEN 'CARDINALITY' ELSE 'STATE' END AS kind, ts, event_id % 7 = 0 AS reverted, event_type = 'purchase' AS reverts FROM events), live AS (SELECT * FROM log WHERE NOT reverted AND NOT reverts), newest AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY document_type, field_id, kind ORDER BY ts DESC, id DESC) = 1) "
QUERIES = {f.__name__: f for f in (drive_listing, files_to_fetch, acquired_pages, document_sources, runs_to_lines, placed_boxes, review_events, last_closures, replay_reviews, template_proofs, standing_edits, revertable_edits, activity_feed, reprocess_queue, rename_fields, files_manifest, expiries, scoring_by_type, type_accuracy, normal_values)}
ORACLE_SQL = {
    "drive_listing": "SELECT p_partkey AS id, false AS is_folder FROM part WHERE p_partkey % 10 > 0 UNION SELECT p_partkey + 1, false FROM part WHERE p_partkey % 10 = 0 AND p_partkey % 100 > 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part) UNION SELECT (-100 - n_nationkey)::BIGINT, true FROM nation",
    "files_to_fetch": """WITH r AS (SELECT o_custkey AS id, max(o_orderdate) AS m FROM orders GROUP BY 1), s AS (SELECT o_custkey AS id, max(o_orderdate) AS m, max(o_orderkey) % 4 > 0 AS cached FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
        SELECT r.id FROM r LEFT JOIN s USING (id) WHERE s.m IS NULL OR r.m > s.m OR NOT cached""",
    "acquired_pages": """WITH n AS (SELECT doc_id, text AS o, CASE WHEN lang = 'en' THEN text ELSE '' END AS t, lang <> 'en' AND source <> 'src3' AS r FROM documents),
        p AS (SELECT CASE WHEN length(trim(t, ' ')) < 100 THEN CASE WHEN r AND length(o) >= length(t) THEN 'OCR' WHEN r THEN 'NATIVE_TEXT' ELSE 'OCR_FAILED' END ELSE 'NATIVE_TEXT' END AS text_source, o, t FROM n)
        SELECT text_source, count(*) AS pages, sum(length(CASE WHEN text_source = 'OCR' THEN o ELSE t END))::BIGINT AS chars FROM p GROUP BY 1""",
    "document_sources": """WITH p AS (SELECT doc_id // 10 AS doc_id, doc_id % 10 AS page, CASE WHEN length(text) < 100 THEN 'OCR_FAILED' WHEN length(text) < 400 THEN 'OCR' ELSE 'NATIVE_TEXT' END AS s FROM documents)
        SELECT doc_id, CASE WHEN bool_or(s = 'OCR_FAILED') THEN 'OCR_FAILED' WHEN bool_or(s = 'OCR') THEN 'OCR' ELSE 'NATIVE_TEXT' END AS text_source, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (s = 'OCR'), '') AS ocr_pages,
        coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (s = 'OCR_FAILED'), '') AS failed_pages FROM p GROUP BY 1""",
    "runs_to_lines": "SELECT c_custkey // 20 AS doc_id, row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) - 1 AS line, c_custkey || c_name || c_mktsegment AS text, 10.0::DOUBLE AS x, 230.0::DOUBLE AS w, 12.0::DOUBLE AS h FROM customer",
    "placed_boxes": "SELECT sum(50 - 3 * (l_linenumber + 2))::DOUBLE AS x, sum(5 + 2 * l_quantity) AS y, 6.0::DOUBLE AS w, 8.0::DOUBLE AS h FROM lineitem",
    "review_events": FIELDS + "SELECT name AS field_id, CASE WHEN was IS NULL THEN 'FILLED' WHEN now IS NULL THEN 'CLEARED' WHEN was = now THEN 'CONFIRMED' ELSE 'CHANGED' END AS outcome, count(*) AS n FROM f WHERE was IS NOT NULL OR now IS NOT NULL GROUP BY ALL",
    "last_closures": CLOSURES + "SELECT document_key, seq FROM last WHERE NOT discarded",
    "replay_reviews": CLOSURES + "SELECT document_key, seq FROM last WHERE NOT discarded AND document_key % 2 = 1",
    "template_proofs": CLOSURES + "SELECT id AS rule_id, CASE WHEN c.document_type = 't' || (id % 4) THEN 'POSITIVE' ELSE 'NEGATIVE' END AS effect, count(*) AS n FROM c JOIN range(20) r(id) ON id % 10 = document_key % 10 GROUP BY ALL",
    "standing_edits": EDITS + "SELECT document_type, field_id, kind, id FROM newest",
    "revertable_edits": EDITS + "SELECT id FROM newest WHERE kind <> 'HINT' UNION ALL SELECT id FROM live WHERE kind = 'HINT'",
    "activity_feed": EDITS + "SELECT id, CASE WHEN kind = 'STATE' THEN 'RULE' ELSE 'MAP' END AS origin FROM log ORDER BY ts DESC, id DESC LIMIT 400",
    "reprocess_queue": QUEUE + "SELECT id FROM queue WHERE status = 'NEEDS_REVIEW' AND document_type IN ('type.1', 'type.3')",
    "rename_fields": FIELDS + "SELECT CASE WHEN name = 'field_1' AND document_id NOT IN (SELECT document_id FROM fields WHERE name = 'field_2') THEN 'field_2' ELSE name END AS name, count(*) AS n FROM fields GROUP BY 1",
    "files_manifest": "SELECT url AS name, sha256(html) AS sha256, length(html) % 4 > 0 AS matches FROM (SELECT url, max(html) AS html FROM pages GROUP BY 1)",
    "expiries": "SELECT o_orderkey, strftime(o_orderdate::DATE + to_years((o_orderkey % 4 + 1)::INT), '%Y-%m-%d') AS expires FROM orders",
    "scoring_by_type": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, year(l_shipdate) AS year FROM lineitem)
        SELECT year, count(*) FILTER (l_partkey % 9 > 0 AND l_partkey % 7 > 0) AS correct, count(*) FILTER (l_partkey % 9 > 0 AND l_partkey % 7 = 0) AS wrong, count(*) FILTER (l_partkey % 9 = 0) AS missing,
        ((correct * 20000 + count(*)) // (count(*) * 2)) / 10000 AS accuracy, ((wrong * 20000 + count(*)) // (count(*) * 2)) / 10000 AS error_rate, ((missing * 20000 + count(*)) // (count(*) * 2)) / 10000 AS missing_rate FROM l GROUP BY 1""",
    "type_accuracy": """WITH o AS (SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'A' WHEN o_orderkey % 5 > 0 OR o_orderpriority = '1-URGENT' THEN 'C' ELSE 'W' END AS r FROM orders), t AS (SELECT count(*) FILTER (r = 'C') AS correct, count(*) FILTER (r = 'W') AS wrong, count(*) FILTER (r = 'A') AS abstained, count(*) AS n FROM o)
        SELECT correct, wrong, abstained, ((correct * 20000 + n) // (n * 2)) / 10000 AS accuracy, ((correct * 20000 + correct + wrong) // ((correct + wrong) * 2)) / 10000 AS precision FROM t""",
    "normal_values": "SELECT count(*) AS amounts, count(*) AS dates FROM orders",
}
