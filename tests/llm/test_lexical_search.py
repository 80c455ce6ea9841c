"""Ranked search held against plain scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docfacts.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    nd, total = len(held), sum(c.total() for _, c in held)
    df, out = Counter(t for _, c in held for t in c), {}
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * c.total() * nd // total
            s = sum(math.floor(1000 * math.log((2 * nd + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out[item] = [(i, -s) for s, i in sorted(scores)[:k]]
    return {i: r for i, r in out.items() if r}


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["item_id"], r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


@pytest.mark.parametrize(("shard_docs", "block_terms"), [(4096, 500_000), (7, 200), (1, 500_000)])
def test_query_against_plain_scores(spark, sf_dir, shard_docs, block_terms):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    sizes = lexical_search.corpus_sizes(docs)
    got = found(lexical_search.ranked_search(lexical_search.lexical_index(docs, sizes, shard_docs), items, sizes[0], 20, block_terms).collect())
    assert got == plain(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect(), 20)
    if shard_docs == 4096:
        assert found(lexical_search.op13_lexical_search(spark, sf_dir).collect()) == got


def test_ties_and_small_batches():
    """Few words, many equal documents: order by doc_id among equals, whatever is opened first."""
    r = random.Random(2)
    docs = [(i, " ".join(r.choice("abcd") for _ in range(r.choice((1, 2, 3))))) for i in r.sample(range(10_000), 300)]
    counts = [Counter(lexical_search.terms_of(t)) for _, t in docs]
    total = sum(c.total() for c in counts)
    shard = lexical_search.Shard(lexical_search.build_shard(0, [i for i, _ in docs], counts, [c.total() for c in counts], 300, total))
    df = Counter(t for c in counts for t in c)
    for item in ("a", "a b", "d d c", "b zz", "zz"):
        asked = [(t, lexical_search.weight(300, df[t]) * n) for t, n in Counter(lexical_search.terms_of(item)).items() if t in df]
        for batch in (1, 5, 1000):
            for k in (1, 20, 400):
                assert [(i, s) for s, i in shard.top(asked, k, batch)] == plain(docs, [(0, item)], k).get(0, [])


def test_edges(spark, edges, nothing):
    docs = edges.select("doc_id", "text").collect()
    rows = [(1, "ünï 日本語 ONE two"), (2, None), (3, ""), (4, docs[3]["text"]), (None, "one"), (5, "-- \x00 !"), (6, "nowhere"), (7, "one")]
    items = spark.createDataFrame(rows, "item_id long, text string").withColumn("term", F.lit("clash"))
    sizes = lexical_search.corpus_sizes(edges)
    got = found(lexical_search.ranked_search(lexical_search.lexical_index(edges), items, sizes[0], 5).collect())
    assert got == plain(docs, [r for r in rows if r[0] is not None], 5) and set(got) == {1, 4, 7}
    assert lexical_search.ranked_search(lexical_search.lexical_index(nothing), items, 0).collect() == []
    assert lexical_search.ranked_search(lexical_search.lexical_index(edges), items.limit(0), sizes[0]).collect() == []


def test_a_repeated_item_has_the_terms_of_all_its_rows(spark, edges):
    once, twice = ([(1, "one the of")], [(1, "one the"), (1, "of")])
    index, n = lexical_search.lexical_index(edges), lexical_search.corpus_sizes(edges)[0]
    a, b = (lexical_search.ranked_search(index, spark.createDataFrame(rows, "item_id long, text string"), n).collect() for rows in (once, twice))
    assert sorted(a) == sorted(b) != []


def test_an_index_can_be_stored(spark, edges, tmp_path):
    lexical_search.lexical_index(edges, shard_docs=3).write.parquet(str(tmp_path / "index"))
    items, n = spark.createDataFrame([(1, "one two the")], "item_id long, text string"), lexical_search.corpus_sizes(edges)[0]
    stored = lexical_search.ranked_search(spark.read.parquet(str(tmp_path / "index")), items, n).collect()
    assert sorted(stored) == sorted(lexical_search.ranked_search(lexical_search.lexical_index(edges), items, n).collect())
