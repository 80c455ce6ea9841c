"""Every query with a DuckDB form gives its rows; the others hold against plain loops."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from docfacts.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", catalogue.ORACLE_SQL)
def test_against_sql(spark, sf_dir, duck, name):
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    expected = sorted([normal(r[i]) for i in order] for r in want.fetchall())
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    assert sorted([normal(r[c]) for c in columns] for r in df.collect()) == expected


def fold(kind, scope, proofs):
    """The rule machine as a plain loop."""
    status, p, n, since = "CANDIDATE", 0, 0, []
    for effect in proofs:
        p, n = p + (effect == "POSITIVE"), n + (effect == "NEGATIVE")
        if status == "ACTIVE":
            since.append(effect)
        if status == "CANDIDATE":
            if kind == "TEMPLATE_TYPE":
                ready = p >= 3 and n == 0
            else:
                ready = p >= (2 if scope == "TEMPLATE" else 3) and p / (p + n) >= (1 if scope == "TEMPLATE" else 0.9)
            status = "ACTIVE" if ready else status
        elif status == "ACTIVE":
            if kind == "TEMPLATE_TYPE":
                bad = "NEGATIVE" in since
            else:
                bad = since[-2:] == ["NEGATIVE"] * 2 or (len(since) >= 5 and since.count("POSITIVE") / len(since) < 0.7)
            status = "SUSPENDED" if bad else status
    return status, p, n


def test_rule_states_do_not_depend_on_how_time_is_cut(spark):
    """Random logs with ties and null times, and one rule with most of all proofs: the plain loop's states, in one stretch or in many."""
    from docfacts.operators import learning

    r = random.Random(5)
    rows = [(rule := r.choice((1, 1, 1, *range(40))), "TEMPLATE_TYPE" if rule % 3 == 0 else "ANCHOR", "TEMPLATE" if rule % 2 else "CLASS", r.choice(("POSITIVE", "POSITIVE", "POSITIVE", "NEGATIVE")), r.choice((None, *range(30))), i) for i in range(900)]
    rows += [(99, "ANCHOR", "CLASS", "POSITIVE" if i < 400 or i % 3 else "NEGATIVE", i // 4, i) for i in range(1500)]
    log = {}
    for row in sorted(rows, key=lambda x: (x[4] is None, x[4] or 0, x[5])):
        log.setdefault(row[:3], []).append(row[3])
    want = {k[0]: fold(k[1], k[2], v) for k, v in log.items()}
    df = spark.createDataFrame(rows, "rule_id long, kind string, scope string, effect string, at long, seq long")
    for chunks in (1, 2, 32):
        states = learning.rule_states(df, chunks)
        assert {x["rule_id"]: (x["status"], x["positive"], x["negative"]) for x in states.collect()} == want
        assert "collect_list" not in states._jdf.queryExecution().optimizedPlan().toString()
    assert want[99][0] == "ACTIVE" and {s for s, _, _ in want.values()} == {"ACTIVE", "CANDIDATE", "SUSPENDED"}
    assert learning.rule_states(df.limit(0)).collect() == []


def test_snapshot_fingerprint(spark):
    import hashlib

    from docfacts.operators import learning

    keys = [f"k{i}é" for i in range(1000)]
    rules = spark.createDataFrame([("ACTIVE", k) for k in keys] + [("CANDIDATE", "x"), ("ACTIVE", None)], "status string, rule_key string")
    for rows, want in ((rules, "\n".join(sorted(keys))), (rules.limit(0), "")):
        out = learning.snapshot_fingerprint(rows)
        assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert [r["fingerprint"] for r in out.collect()] == [hashlib.sha256(want.encode()).hexdigest()[:16]]


def test_snippets_mark_matches(spark, sf_dir):
    rows = catalogue.QUERIES["search_snippets"](spark, sf_dir).collect()
    assert rows and all(("[the" in r["snippet"] or "[oner" in r["snippet"]) and len(r["snippet"].split()) <= 12 for r in rows)


def test_template_clusters(spark, sf_dir):
    r = catalogue.QUERIES["template_clusters"](spark, sf_dir).first()
    assert 1 < r["templates"] < 20 and r["documents"] > 1000
