"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from docfacts.llm import decontamination, fingerprints, line_dedup, near_dedup, packing, quality, secrets, suffix_tree, token_counts, toxicity
from docfacts.llm.common import documents

from .conftest import BASE, EDGES, texts


def plain(df):
    return documents(df)


ROWWISE = {
    "tokens": token_counts.count_tokens,
    "secrets": secrets.find_secrets,
    "fingerprints": fingerprints.fingerprint_pairs,
    "near": near_dedup.near_duplicates,
    "lines": line_dedup.dedup_lines,
    "lm": lambda d: suffix_tree.score_documents(plain(d).withColumn("teaches", F.lit(True))),
    "quality": lambda d: quality.score_quality(d, None, "doc_id"),
    "toxicity": lambda d: toxicity.score_toxicity(plain(d), 0.1),
}


@pytest.mark.parametrize("name", ROWWISE)
def test_a_row_for_every_row(name, edges):
    out = ROWWISE[name](edges).collect()
    key = lambda x: (x is not None, x or 0)
    assert sorted((r["doc_id"] for r in out), key=key) == sorted((i for i, _ in EDGES), key=key)


@pytest.mark.parametrize("name", ROWWISE)
def test_empty_table(name, nothing):
    assert ROWWISE[name](nothing).collect() == []


def test_packing_keeps_every_token(edges, nothing):
    rows = packing.pack_documents(edges).collect()
    tokens = {}
    for r in rows:
        tokens.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert tokens[1] == [(0, 1, 1)] and sum(n for _, n, _ in tokens[5]) == 2 * tokens[5][0][2]
    assert packing.pack_documents(nothing).collect() == []


def test_decontamination(spark, edges, nothing):
    items = spark.createDataFrame([(1, " ".join(BASE.split()[20:60])), (2, None), (3, ""), (4, "one two"), (None, BASE), (5, "five words that are nowhere"), (5, "a repeated id")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], round(r["containment"], 2)) for r in decontamination.contaminated(edges, items).collect()}
    assert {(d, i) for d, i, _ in found} >= {(4, 1), (5, 1), (3, 4)} and all(i in (1, 4) for _, i, _ in found)
    assert decontamination.contaminated(nothing, items).collect() == []
    assert decontamination.contaminated(edges, items.limit(0)).collect() == []


def test_classifiers_on_edges(edges, labels, nothing):
    for fit, score in ((lambda d, l: quality.fit(d, l, "quality", F.lit(True)), lambda d, m: quality.score_quality(d, m, "doc_id")), (lambda d, l: toxicity.fit(d, l, "toxic", F.lit(True)), toxicity.score_toxicity)):
        model = fit(plain(edges), labels)
        assert all(0 <= r["score"] <= 1 for r in score(plain(edges), model).collect())
        assert all(0 <= r["score"] <= 1 for r in score(plain(edges), fit(plain(edges), labels.limit(0))).collect())
        assert score(plain(nothing), model).collect() == []


def test_classifiers_learn(spark, labels):
    docs = texts(spark)
    held = F.col("doc_id") % 5 == 0
    good = quality.score_quality(docs, quality.fit(docs, labels, "quality", ~held), "doc_id").where(held).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in good)
    bad = toxicity.score_toxicity(docs, toxicity.fit(docs, labels, "toxic", ~held)).where(held).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in bad)
