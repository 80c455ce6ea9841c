"""Streaming queries over events, run to the end of their input."""

from __future__ import annotations

from docfacts.streaming import events


def stream_tumbling(spark, sf_dir):
    return events.run_to_table(events.tumbling(events.source(spark, sf_dir)), spark, "complete")


def stream_sliding(spark, sf_dir):
    return events.run_to_table(events.sliding(events.source(spark, sf_dir)), spark, "complete")


def stream_sessions(spark, sf_dir):
    """Batch form: in append mode a stream holds back sessions that are open at the watermark."""
    return events.sessions(spark.read.schema(events.SCHEMA).parquet(f"{sf_dir}/events.parquet"))


def stream_rule_counters(spark, sf_dir):
    return events.run_to_table(events.rule_counters(events.source(spark, sf_dir)), spark, "update", ["rule_id"])


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_sessions, stream_rule_counters)}
ORACLE_SQL = {
    "stream_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT start, count(*) AS n FROM (SELECT date_trunc('day', ts) - to_days(i::INT) AS start FROM events, range(2) r(i)) GROUP BY 1",
    "stream_sessions": """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
        (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
    "stream_rule_counters": "SELECT rule_id, count(*) FILTER (NOT denied) AS support, count(*) FILTER (denied) AS negatives FROM (SELECT user_id AS rule_id, event_id % 50 AS d, bool_or(event_type = 'error') AS denied FROM events GROUP BY 1, 2) GROUP BY 1",
}
