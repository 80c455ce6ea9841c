"""Queries of closed reviews, settled rules, template rules, selections in texts and the stored search index."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.operators import learning, picks, queue, review, search, segments, templates
from docfacts.plans.corpus import ORACLE_SQL as CORPUS_SQL
from docfacts.plans.learning import proofs_of
from docfacts.plans.relational import FOLDED
from docfacts.plans.review import FIELDS, fields_of
from docfacts.sources import acquisition


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def review_payloads(spark, sf_dir):
    """Orders as reviews, pending ones as discards; line items outside the profile are items of repeated fields, of which some are removed."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "DISCARD").otherwise("SAVE").alias("action"))
    item = F.when(F.col("role").isNull(), F.substring("name", 7, 1).cast("int"))
    fields = fields_of(spark, sf_dir).select("document_id", "name", item.alias("item_index"), "value", "corrected_value", (F.col("part") % 29 == 0).alias("removed"))
    shown = F.transform("changes", lambda c: F.concat_ws("", c["place"].cast("string"), F.lit(" "), c["name"], F.lit(" "), F.coalesce(c["before"], F.lit("~")), F.lit(">"), c["after"]))
    return review.review_payloads(orders, fields).select("id", "decision", F.size("changes").cast("long").alias("n_changes"), F.array_join(shown, ",").alias("changes"))


def resolved_edits(spark, sf_dir):
    """Return flags edited to line statuses, ship dates written in two ways."""
    items = read(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_tax") == 0, None).when(F.col("l_linestatus") == "F", F.concat(F.lit(" "), F.col("l_returnflag"))).otherwise(F.col("l_linestatus"))
    italian, iso = F.date_format("l_shipdate", "dd/MM/yyyy"), F.date_format("l_shipdate", "yyyy-MM-dd")
    rows = items.select(review.resolve_edit(F.col("l_returnflag"), flag).alias("flag"), review.resolve_edit(F.when(F.col("l_linenumber") > 2, iso), italian, True).alias("shipped"))
    return rows.groupBy("flag", "shipped").agg(F.count("*").alias("n"))


def resolved_items(spark, sf_dir):
    """What edits of line items do, a seventh of them added by hand."""
    origin = F.when(F.col("part") % 7 == 0, "MANUAL").otherwise("ENGINE")
    edit = F.when(F.col("computed"), None).when(F.col("part") % 5 == 0, " ").otherwise(F.concat(F.lit("A"), F.lit(" ")))
    done = review.resolve_item_edit(origin, F.col("value"), F.col("corrected_value"), edit)
    return fields_of(spark, sf_dir).select(done.alias("d")).groupBy("d.action", "d.value").agg(F.count("*").alias("n"))


def settled_rules(spark, sf_dir):
    """Users' rules: active since their last purchase, if they have one, else candidates, and every ninth rejected. Those of users with a signup are touched."""
    events = read(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("rule_id")).agg(F.max("ts").alias("active_at"))
    log = proofs_of(spark, sf_dir)
    template = F.when(F.col("scope") == "TEMPLATE", F.concat(F.lit("t"), (F.col("rule_id") % 5).cast("string")))
    status = F.when(F.col("rule_id") % 9 == 8, "REJECTED").when(F.col("active_at").isNotNull(), "ACTIVE").otherwise("CANDIDATE")
    rules = log.select("rule_id", "kind", "scope").distinct().join(purchases, "rule_id", "left")
    rules = rules.select("rule_id", "kind", "scope", status.alias("status"), F.concat(F.lit("type."), (F.col("rule_id") % 7).cast("string")).alias("document_type"), template.alias("template"), "active_at")
    return learning.settle(rules, learning.effects(log), events.where("event_type <> 'click'").select(F.col("user_id").alias("rule_id")))


def parts_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, document_type, template, features, manual_type, brand: parts by the words of their type, their brand and size."""
    kind = F.split("p_type", " ")
    words = F.concat(kind, F.array(F.col("p_brand"), F.concat(F.lit("kind:"), F.get(kind, F.lit(0))), F.concat(F.lit("size:"), (F.col("p_size") % 5).cast("string"))))
    manual = F.when(F.col("p_size") == 1, "by.hand")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.get(kind, F.lit(0)).alias("document_type"), F.concat("p_type", "p_brand").alias("template"), F.array_sort(F.array_distinct(words)).alias("features"), manual.alias("manual_type"), F.col("p_brand").alias("brand"))


def rules_of_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule learned from the first part of each brand and type of document."""
    first = parts_as_documents(spark, sf_dir).groupBy("brand", "document_type").agg(F.min_by(F.struct("doc_id", "template", "features"), "doc_id").alias("d"))
    k = F.col("d.doc_id")
    return first.select(
        k.alias("rule_id"), F.when(k % 2 == 0, "EXTRACTION_ANCHOR").otherwise("TEMPLATE_TYPE").alias("kind"), F.when(k % 5 == 0, "CANDIDATE").otherwise("ACTIVE").alias("status"), F.when(k % 4 == 0, "CLASS").otherwise("TEMPLATE").alias("scope"),
        "document_type", F.lit("document.number").alias("field_id"), F.col("brand").alias("label"), F.lit("SAME_LINE").alias("relation"), "d.template", "d.features", k.alias("updated_at"),
    )


def learned_labels(spark, sf_dir):
    return templates.learned_labels(parts_as_documents(spark, sf_dir), rules_of_brands(spark, sf_dir)).select("doc_id", "rule_id", "label", "scope")


def remembered_types(spark, sf_dir):
    return templates.remembered_types(parts_as_documents(spark, sf_dir), rules_of_brands(spark, sf_dir))


def first_page_fingerprints(spark, sf_dir):
    """Fingerprints of texts, none of recognised ones (those in a language other than English play them)."""
    source = F.when(F.col("lang") == "en", "NATIVE_TEXT").otherwise("OCR")
    return read(spark, sf_dir, "documents").select("doc_id", templates.first_page_fingerprint(F.split("text", "\n"), source).alias("fingerprint"))


def picked_lines(spark, sf_dir):
    """Line items as lines, by discount and number; one selection an order."""
    box = lambda x, y, w, h: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("line"), box(F.col("l_discount") * 100, F.col("l_linenumber") * 10, F.col("l_quantity"), F.lit(10)).alias("box"))
    drawn = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pick"), F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), box(F.lit(6), F.lit(12), F.lit(20), F.lit(14)).alias("box"))
    return picks.lines_under(drawn, lines)


EVIDENCE = " \n ALL  rights\treserved \nsecond line"


def text_ranges(spark, sf_dir):
    """Where a licence's words stand, however they are spaced and written; the evidence's second line isn't sought."""
    place = picks.text_range(F.col("text"), F.lit(EVIDENCE))
    return read(spark, sf_dir, "documents").select("doc_id", place.alias("r")).where("r is not null").select("doc_id", F.col("r.start").cast("long").alias("from_char"), F.col("r.end").cast("long").alias("to_char"))


def matched_spans(spark, sf_dir):
    """Which words of a document, as fragments of a page, hold a licence's words."""
    place = picks.matched_spans(F.split("text", " "), F.lit(EVIDENCE))
    return read(spark, sf_dir, "documents").select("doc_id", place.alias("r")).where("r is not null").select("doc_id", F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"))


def recorded_picks(spark, sf_dir):
    """Part names selected, sizes apart typed as they are, without a letter, or anew."""
    size, name = F.col("p_size"), F.col("p_name")
    value = F.when(size < 20, name).when(size < 40, F.expr("substring(p_name, 2)")).when(size < 45, F.col("p_brand")).otherwise("")
    edits = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), name, F.lit("  ")).alias("text"), value.alias("value"), F.when(size % 2 == 0, "OCR").otherwise("TEXT").alias("method"))
    return picks.recorded_picks(edits).select("p_partkey", "text_corrected")


def page_lines(spark, sf_dir):
    """Lines of documents, stored for those of a single line."""
    stored = F.when(F.contains(F.col("text"), F.lit("\n")), F.array().cast("array<string>")).otherwise(F.array("text"))
    rows = read(spark, sf_dir, "documents").select("doc_id", acquisition.page_lines(stored, F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.sha2(F.array_join("l", "|"), 256).alias("lines_sha256"))


def field_order(spark, sf_dir):
    fields = fields_of(spark, sf_dir).withColumn("label", F.concat_ws(" ", F.coalesce("value", F.lit("z")), "name"))
    return queue.field_order(fields, ["field_4", "field_2"]).select("document_id", "name", "place")


def index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return search.indexed(d.select("doc_id", F.lit(1).alias("page"), "text"), d.select("doc_id", F.concat_ws(" ", "source", F.col("doc_id").cast("string"), F.lit("Perché.pdf")).alias("name")))


def index_rows(spark, sf_dir):
    """The index after documents that aren't English were renamed and lost their text."""
    index = index_of(spark, sf_dir)
    changed = read(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id", F.lit(0).alias("page"), F.split(F.lit("gone"), " ").alias("terms"))
    return search.reindexed(index, changed).groupBy("page").agg(F.count("*").alias("n_rows"), F.sum(F.size("terms")).alias("words"))


def postings_by_prefix(spark, sf_dir):
    return search.postings(index_of(spark, sf_dir)).groupBy("prefix").agg(F.count_distinct("term").alias("terms"), F.count("*").alias("n_rows"), F.sum("tf").alias("words"))


def search_postings(spark, sf_dir):
    """All documents that match two prefixes, with rank, through postings: the rows of `search_bm25`."""
    rows = search.page_rows(read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text"))
    found = search.search_postings(search.postings(rows), search.lengths(rows), search.query_terms("The oner"), limit=None)
    return found.select("doc_id", F.round("rank", 6).alias("rank"))


def search_segments(spark, sf_dir):
    """Ranks through a stored index in segments: all documents, then those that aren't English anew without their first word, then one source's gone."""
    docs = read(spark, sf_dir, "documents")
    place = f"{spark.conf.get('spark.sql.warehouse.dir')}/index_{uuid4().hex}"
    segments.add(spark, place, search.page_rows(search.spread(docs.select("doc_id", F.lit(1).alias("page"), "text"))))
    changed = docs.where("lang <> 'en'").select("doc_id", F.lit(1).alias("page"), F.expr("substring(text, instr(text, ' ') + 1)").alias("text"))
    segments.add(spark, place, search.page_rows(search.spread(changed)))
    segments.add(spark, place, search.page_rows(changed.where(F.lit(False))), docs.where("source = 'src3'"))
    index, sizes = segments.read(spark, place)
    found = search.search_postings(index, sizes, search.query_terms("The oner"), limit=None)
    return found.select("doc_id", F.round("rank", 6).alias("rank"))


PARTS = """
WITH d0 AS (SELECT p_partkey AS doc_id, string_split(p_type, ' ') AS kind, p_type || p_brand AS template, p_brand AS brand, CASE WHEN p_size = 1 THEN 'by.hand' END AS manual_type, p_size FROM part),
d AS (SELECT doc_id, kind[1] AS document_type, template, brand, manual_type, list_distinct(list_concat(kind, [brand, 'kind:' || kind[1], 'size:' || p_size % 5])) AS features FROM d0),
r AS (SELECT k AS rule_id, CASE WHEN k % 2 = 0 THEN 'EXTRACTION_ANCHOR' ELSE 'TEMPLATE_TYPE' END AS kind, CASE WHEN k % 5 = 0 THEN 'CANDIDATE' ELSE 'ACTIVE' END AS status, CASE WHEN k % 4 = 0 THEN 'CLASS' ELSE 'TEMPLATE' END AS scope, d.*
  FROM (SELECT min(doc_id) AS k FROM d GROUP BY brand, document_type) f JOIN d ON d.doc_id = f.k),
m AS (SELECT d.doc_id, r.rule_id, d.document_type, d.manual_type, r.document_type AS rule_type, r.brand, r.kind, r.status, r.scope, CASE WHEN d.template = r.template THEN 1.0::DOUBLE ELSE len(list_intersect(d.features, r.features))::DOUBLE / (len(d.features) + len(r.features) - len(list_intersect(d.features, r.features))) END AS similarity FROM d, r)
"""
INDEX = r"""
WITH i AS (SELECT doc_id, 1 AS page, lang, text FROM documents UNION ALL SELECT doc_id, 0, lang, source || ' ' || doc_id || ' Perché.pdf' FROM documents),
w AS (SELECT doc_id, page, lang, list_filter(string_split(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM i)
"""
QUERIES = {f.__name__: f for f in (review_payloads, resolved_edits, resolved_items, settled_rules, learned_labels, remembered_types, first_page_fingerprints, picked_lines, text_ranges, matched_spans, recorded_picks, page_lines, field_order, index_rows, postings_by_prefix, search_postings, search_segments)}
ORACLE_SQL = {
    "settled_rules": """WITH log AS (SELECT user_id AS rule_id, event_id % 50 AS document_key, event_type = 'error' AS no, ts AS t, event_id AS seq FROM events),
        e AS (SELECT rule_id, bool_or(no) AS no, coalesce(min(row(t, seq)) FILTER (no), min(row(t, seq))) AS m FROM log GROUP BY rule_id, document_key),
        a AS (SELECT user_id AS rule_id, max(ts) AS active_at FROM events WHERE event_type = 'purchase' GROUP BY 1),
        r AS (SELECT rule_id, rule_id % 3 = 0 AS by_type, rule_id % 2 = 0 AS of_template, active_at IS NOT NULL AS active, count(*) FILTER (NOT no) AS p, count(*) FILTER (no) AS n,
          list(no ORDER BY m DESC) FILTER (active_at IS NULL OR m[1] > active_at) AS later
          FROM e LEFT JOIN a USING (rule_id) WHERE rule_id % 9 <> 8 AND rule_id IN (SELECT user_id FROM events WHERE event_type <> 'click') GROUP BY rule_id, active_at),
        s AS (SELECT *, NOT active AND CASE WHEN by_type THEN p >= 3 AND n = 0 WHEN of_template THEN p >= 2 AND n = 0 ELSE p >= 3 AND p / (p + n) >= 0.9 END AS up,
          active AND CASE WHEN by_type THEN coalesce(list_contains(later, true), false) ELSE coalesce(later[1] AND later[2], false) OR (coalesce(len(later), 0) >= 5 AND len(list_filter(later, lambda x: NOT x)) / len(later) < 0.7) END AS down FROM r)
        SELECT rule_id, CASE WHEN up THEN 'CANDIDATE' ELSE 'ACTIVE' END AS before, CASE WHEN up THEN 'ACTIVE' ELSE 'SUSPENDED' END AS after, CASE WHEN up THEN 'RULE_PROMOTED' ELSE 'RULE_SUSPENDED' END AS action,
          CASE WHEN by_type AND of_template THEN 'template' ELSE 'document_type' END AS reprocess_by, CASE WHEN by_type AND of_template THEN 't' || rule_id % 5 ELSE 'type.' || rule_id % 7 END AS reprocess FROM s WHERE up OR down""",
    "review_payloads": FIELDS + """, c AS (
          SELECT document_id, CASE WHEN role IS NULL THEN substr(name, 7, 1)::INT ELSE -1 END AS place, name, CASE WHEN role IS NULL THEN coalesce(value, '') ELSE value END AS before,
            CASE WHEN role IS NULL THEN coalesce(CASE WHEN part % 29 <> 0 THEN now END, '') ELSE corrected END AS after FROM f
          WHERE CASE WHEN role IS NULL THEN was IS DISTINCT FROM CASE WHEN part % 29 <> 0 THEN now END ELSE corrected IS NOT NULL AND corrected IS DISTINCT FROM value END
        ), g AS (SELECT document_id, count(*) AS n, string_agg(place || ' ' || name || ' ' || coalesce(before, '~') || '>' || after, ',' ORDER BY place, name, before NULLS FIRST, after) AS changes FROM c GROUP BY 1)
        SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'REJECT' WHEN n > 0 THEN 'CORRECT' ELSE 'APPROVE' END AS decision, coalesce(n, 0) AS n_changes, coalesce(changes, '') AS changes FROM orders LEFT JOIN g ON document_id = o_orderkey""",
    "resolved_edits": """SELECT CASE WHEN e = l_returnflag THEN NULL ELSE e END AS flag, CASE WHEN l_linenumber > 2 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS shipped, count(*) AS n FROM (
        SELECT *, CASE WHEN l_tax = 0 THEN NULL WHEN l_linestatus = 'F' THEN l_returnflag ELSE l_linestatus END AS e FROM lineitem) GROUP BY 1, 2""",
    "resolved_items": FIELDS + """, e AS (SELECT part % 7 = 0 AS by_hand, value, corrected, CASE WHEN computed THEN NULL WHEN part % 5 = 0 THEN '' ELSE 'A' END AS edit FROM fields),
        a AS (SELECT edit, CASE WHEN by_hand THEN CASE WHEN coalesce(edit, '') = '' THEN 'DELETE' WHEN edit IS NOT DISTINCT FROM corrected THEN 'NONE' ELSE 'CORRECT' END
          WHEN edit IS NULL OR edit = coalesce(value, '') THEN 'RESET' WHEN edit = '' THEN 'REMOVE' ELSE 'CORRECT' END AS action FROM e)
        SELECT action, CASE WHEN action = 'CORRECT' THEN edit END AS value, count(*) AS n FROM a GROUP BY 1, 2""",
    "learned_labels": PARTS + """SELECT doc_id, rule_id, brand AS label, scope FROM m WHERE kind = 'EXTRACTION_ANCHOR' AND status = 'ACTIVE' AND document_type = rule_type AND (scope = 'CLASS' OR similarity >= 0.68)""",
    "remembered_types": PARTS + """SELECT doc_id, manual_type AS document_type, 1.0::DOUBLE AS confidence FROM d WHERE manual_type IS NOT NULL
        UNION ALL SELECT doc_id, rule_type, floor(similarity * 0.74 * 100 + 0.5) / 100 FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule_id DESC) AS n FROM m WHERE manual_type IS NULL AND kind = 'TEMPLATE_TYPE' AND status = 'ACTIVE' AND similarity >= 0.68) WHERE n = 1""",
    "first_page_fingerprints": CORPUS_SQL["template_fingerprint"].replace("CASE WHEN len(s) >= 3", "CASE WHEN lang = 'en' AND len(s) >= 3").replace("FROM labels", "FROM labels JOIN documents USING (doc_id)"),
    "picked_lines": """SELECT o_orderkey AS pick, l_linenumber AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        WHERE least(26.0::DOUBLE, l_discount * 100 + l_quantity) - greatest(6.0::DOUBLE, l_discount * 100) > 0 AND least(26, l_linenumber * 10 + 10) - greatest(12, l_linenumber * 10) >= 5""",
    "text_ranges": r"""SELECT doc_id, strpos(text, m) - 1 AS from_char, strpos(text, m) - 1 + length(m) AS to_char FROM (SELECT doc_id, text,
        CASE WHEN regexp_matches(text, 'ALL\s+rights\s+reserved') THEN regexp_extract(text, 'ALL\s+rights\s+reserved') ELSE regexp_extract(text, '(?i)ALL\s+rights\s+reserved') END AS m FROM documents) WHERE m <> ''""",
    "matched_spans": r"""WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(regexp_replace(x, '\s+', '', 'g'))) AS n, regexp_replace(text, '\s+', '', 'g') AS j FROM documents),
        p AS (SELECT doc_id, n, CASE WHEN contains(j, 'ALLrightsreserved') THEN strpos(j, 'ALLrightsreserved') ELSE strpos(lower(j), 'allrightsreserved') END AS pos FROM w),
        u AS (SELECT doc_id, pos, unnest(range(0, len(n))) AS i, unnest(n) AS n FROM p WHERE pos > 0), e AS (SELECT doc_id, pos, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u)
        SELECT doc_id, min(i) FILTER (e >= pos) AS first, min(i) FILTER (e >= pos + 16) AS last FROM e GROUP BY 1""",
    "recorded_picks": r"""WITH e AS (SELECT p_partkey, p_size, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS read, CASE WHEN p_size < 20 THEN p_name WHEN p_size < 40 THEN substr(p_name, 2) WHEN p_size < 45 THEN p_brand ELSE '' END AS value FROM part),
        f AS (SELECT *, trim(regexp_replace(lower(read), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) AS b FROM e)
        SELECT p_partkey, read <> value AS text_corrected FROM f WHERE trim(value) <> '' AND read <> '' AND (read = value OR (p_size % 2 = 0 AND levenshtein(a, b) <= greatest(1, greatest(length(a), length(b)) // 4)))""",
    "page_lines": r"""WITH l AS (SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') ELSE [text] END AS l FROM documents)
        SELECT doc_id, len(l) AS n_lines, sha256(coalesce(array_to_string(l, '|'), '')) AS lines_sha256 FROM l""",
    "field_order": FIELDS + """SELECT document_id, name, row_number() OVER (PARTITION BY document_id ORDER BY CASE name WHEN 'field_4' THEN 1 WHEN 'field_2' THEN 2 ELSE 3 END, lower(coalesce(value, 'z') || ' ' || name), name) AS place FROM fields""",
    "index_rows": INDEX + "SELECT page, count(*) AS n_rows, sum(n)::BIGINT AS words FROM (SELECT page, CASE WHEN lang = 'en' THEN len(w) ELSE 1 END AS n FROM w WHERE lang = 'en' OR page = 0) GROUP BY 1",
    "postings_by_prefix": INDEX + "SELECT substr(x, 1, 2) AS prefix, count(DISTINCT x) AS terms, count(DISTINCT (x, doc_id, page)) AS n_rows, count(*) AS words FROM (SELECT doc_id, page, unnest(w) AS x FROM w) WHERE length(x) > 1 GROUP BY 1",
    "search_segments": FOLDED.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN lang <> 'en' THEN substr(text, strpos(text, ' ') + 1) ELSE text END AS text FROM documents WHERE source <> 'src3')") + "SELECT doc_id, round(rank, 6) AS rank FROM ranked",
    "search_postings": FOLDED + "SELECT doc_id, round(rank, 6) AS rank FROM ranked",
}
