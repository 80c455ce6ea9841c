"""Learning queries: events are proofs of rules, users the rules, event ids modulo 50 the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.operators import learning


def proofs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule_id, kind, scope, document_key, effect, at, seq: errors deny, all other events confirm."""
    e, u = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("user_id")
    kind = F.when(u % 3 == 0, "TEMPLATE_TYPE").otherwise("FIELD_ANCHOR")
    return e.select(u.alias("rule_id"), kind.alias("kind"), F.when(u % 2 == 0, "TEMPLATE").otherwise("CLASS").alias("scope"), (F.col("event_id") % 50).alias("document_key"), F.when(F.col("event_type") == "error", "NEGATIVE").otherwise("POSITIVE").alias("effect"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def rule_effects(spark, sf_dir):
    return learning.effects(proofs_of(spark, sf_dir)).select("rule_id", "document_key", "effect")


def rule_reliability(spark, sf_dir):
    return learning.counts(learning.effects(proofs_of(spark, sf_dir)))


def rule_status(spark, sf_dir):
    """Every rule's status after all its effects, one a document."""
    return learning.rule_states(learning.effects(proofs_of(spark, sf_dir), "kind", "scope"))


def effects_since_active(spark, sf_dir):
    """Effects after each rule's last purchase, which stands for its activation."""
    log = proofs_of(spark, sf_dir)
    purchases = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'").select(F.col("user_id").alias("rule_id"), F.col("ts").alias("at"))
    return learning.since_active(log, purchases).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if(F.col("effect") == "NEGATIVE").alias("negatives"))


def rules_by_status(spark, sf_dir):
    """Rules of each status; statuses without rules count 0."""
    states = rule_status(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([("ACTIVE",), ("CANDIDATE",), ("REJECTED",), ("SUSPENDED",)], "status string")
    return every.join(states, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def manual_transitions(spark, sf_dir):
    """Changes of a rule's status that events ask for, and whether a reviewer may make them."""
    status = lambda i: F.element_at(F.array(*[F.lit(x) for x in ("ACTIVE", "CANDIDATE", "REJECTED", "SUSPENDED")]), (i % 4 + 1).cast("int"))
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select(status(F.col("event_id")).alias("before"), status(F.col("user_id")).alias("after"))
    return asked.withColumn("legal", learning.legal_transition(F.col("before"), F.col("after"))).groupBy("before", "after", "legal").agg(F.count("*").alias("n"))


PROOFS = "WITH log AS (SELECT user_id AS rule_id, event_id % 50 AS document_key, CASE WHEN event_type = 'error' THEN 'NEGATIVE' ELSE 'POSITIVE' END AS effect, ts AS at FROM events), effects AS (SELECT rule_id, document_key, CASE WHEN bool_or(effect = 'NEGATIVE') THEN 'NEGATIVE' ELSE 'POSITIVE' END AS effect FROM log GROUP BY 1, 2) "
STATES = """WITH log AS (SELECT user_id AS rule_id, event_id % 50 AS document_key, event_type = 'error' AS no, ts AS t, event_id AS seq FROM events),
first_ AS (SELECT rule_id, document_key, bool_or(no) AS no, coalesce(min(row(t, seq)) FILTER (no), min(row(t, seq))) AS m FROM log GROUP BY 1, 2),
numbered AS (SELECT rule_id, no, row_number() OVER w AS i, count(*) FILTER (NOT no) OVER w AS p, count(*) FILTER (no) OVER w AS n, lag(no) OVER w AS before
  FROM first_ WINDOW w AS (PARTITION BY rule_id ORDER BY m)),
ready AS (SELECT rule_id, min(i) AS i1 FROM numbered WHERE CASE WHEN rule_id % 3 = 0 THEN p >= 3 AND n = 0 WHEN rule_id % 2 = 0 THEN p >= 2 AND n = 0 ELSE p >= 3 AND p / (p + n) >= 0.9 END GROUP BY 1),
active AS (SELECT rule_id, i AS i0, p AS p0, n AS n0 FROM numbered JOIN ready USING (rule_id) WHERE i = i1),
bad AS (SELECT DISTINCT rule_id FROM numbered JOIN active USING (rule_id) WHERE i > i0 AND CASE WHEN rule_id % 3 = 0 THEN n > n0 ELSE (no AND before AND i - i0 >= 2) OR (i - i0 >= 5 AND (p - p0) / (i - i0) < 0.7) END),
states AS (SELECT rule_id, CASE WHEN b.rule_id IS NOT NULL THEN 'SUSPENDED' WHEN a.rule_id IS NOT NULL THEN 'ACTIVE' ELSE 'CANDIDATE' END AS status, max(p)::INT AS positive, max(n)::INT AS negative,
  (b.rule_id IS NOT NULL)::INT + (a.rule_id IS NOT NULL)::INT AS changes FROM numbered LEFT JOIN active a USING (rule_id) LEFT JOIN bad b USING (rule_id) GROUP BY rule_id, a.rule_id, b.rule_id)
"""
QUERIES = {f.__name__: f for f in (rule_effects, rule_reliability, rule_status, effects_since_active, rules_by_status, manual_transitions)}
ORACLE_SQL = {
    "rule_status": STATES + "SELECT * FROM states",
    "rules_by_status": STATES + "SELECT s AS status, count(rule_id) AS n FROM (VALUES ('ACTIVE'), ('CANDIDATE'), ('REJECTED'), ('SUSPENDED')) v(s) LEFT JOIN states ON status = s GROUP BY 1",
    "rule_effects": PROOFS + "SELECT * FROM effects",
    "rule_reliability": PROOFS + "SELECT *, support / (support + negatives) AS precision, (support + 1) / (support + negatives + 2) AS reliability FROM (SELECT rule_id, count(*) FILTER (effect = 'POSITIVE') AS support, count(*) FILTER (effect = 'NEGATIVE') AS negatives FROM effects GROUP BY 1)",
    "effects_since_active": PROOFS + ", a AS (SELECT user_id AS rule_id, max(ts) AS active_at FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT rule_id, count(*) AS n, count(*) FILTER (effect = 'NEGATIVE') AS negatives FROM log LEFT JOIN a USING (rule_id) WHERE active_at IS NULL OR log.at > active_at GROUP BY 1",
    "manual_transitions": "WITH s AS (SELECT ['ACTIVE', 'CANDIDATE', 'REJECTED', 'SUSPENDED'] AS s), c AS (SELECT s[event_id % 4 + 1] AS before, s[user_id % 4 + 1] AS after FROM events, s) SELECT before, after, (before, after) IN (('ACTIVE', 'SUSPENDED'), ('ACTIVE', 'REJECTED'), ('SUSPENDED', 'ACTIVE'), ('SUSPENDED', 'REJECTED'), ('CANDIDATE', 'REJECTED')) AS legal, count(*) AS n FROM c GROUP BY 1, 2",
}
