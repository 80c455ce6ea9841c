"""The similarity join and the verification within groups held against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfacts.llm import near_dedup, ngram_join, similar_groups
from docfacts.llm.common import WordHashes, shingle_hashes

from .conftest import BASE, EDGES, prose
from .test_brute_force import components, shingles


@pytest.mark.parametrize(("block", "bucket"), [(1500, 32), (10, 2)])
def test_join_against_all_pairs(spark, sf_dir, block, bucket, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", bucket)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"] or "") for r in docs.collect()}
    want = components(sets, 80)
    rows = ngram_join.similar_documents(docs, block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(s), want[i]) for i, s in sets.items()}


def variants(n, words, edits, seed):
    """n texts, each `BASE`-like with some words changed: some similar to the rest, some to a few alone, some to none."""
    r, base = random.Random(seed), prose(seed, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for i in r.sample(range(words), r.choice(edits)):
            w[i] = f"x{r.randrange(30)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("operator", "percent"), [(ngram_join.similar_documents, 80), (near_dedup.near_duplicates, 85)])
def test_dense_groups_in_small_blocks(spark, operator, percent):
    texts = variants(150, 200, (0, 1, 2, 3, 4, 9, 14), 7) + variants(60, 60, (0, 1, 2, 6), 8)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    rows = operator(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=40).collect()
    want = components(sets, percent)
    assert {r["doc_id"]: r["component_id"] for r in rows} == want and 1 < len(set(want.values())) < 200


def test_links_of_random_sets():
    """Between labelled sets, and between two sides; what the links and labels connect is what all similar pairs connect."""
    r = random.Random(3)
    for round_ in range(60):
        pool = [[r.getrandbits(63) for _ in range(r.choice((3, 12, 40)))] for _ in range(4)]
        sets = []
        for _ in range(r.randint(2, 25)):
            s = set(r.choice(pool))
            for _ in range(r.choice((0, 1, 2, 5))):
                s.discard(r.choice(sorted(s)))
                s.add(r.getrandbits(63))
            sets.append(np.array(sorted(s), np.uint64))
        labels = np.array([r.choice((i, i, 0)) for i in range(len(sets))])
        sides = None if round_ % 2 else np.array([r.random() < 0.4 for _ in sets])
        masks = (None, None) if sides is None else (sides, np.ones(len(sets), bool))
        root = {int(x): int(x) for x in labels}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        want = dict(root)
        similar = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (k := len(set(sets[i].tolist()) & set(sets[j].tolist()))) >= 80 * (len(sets[i]) + len(sets[j]) - k)]
        for i, j in similar_groups.joining_links(sets, labels, *masks, 80):
            assert (max(i, j), min(i, j)) in similar
            root[find(int(labels[i]))] = find(int(labels[j]))
        got = {x: find(x) for x in want}
        root.update(want)
        for i, j in similar:
            if sides is None or sides[i] or sides[j]:
                a, b = find(int(labels[i])), find(int(labels[j]))
                root[a] = b
        full = {x: find(x) for x in want}
        assert all((got[x] == got[y]) == (full[x] == full[y]) for x in want for y in want)


def test_prefixes_of_similar_sets_meet_under_any_order():
    r, hashes = random.Random(4), WordHashes()
    for n in (5, 6, 9, 30, 200):
        w = prose(n, n).encode().split()
        other = w[: n - n // 25] + [b"other"] * (n // 25)
        a, b = (shingle_hashes(x, hashes) for x in (w, other))
        if 100 * (k := similar_groups.common(a, b)) < 80 * (len(a) + len(b) - k):
            continue
        words = np.unique([hashes[x] for x in w]).astype(np.uint64)
        for copied in (np.array([r.getrandbits(63)], np.uint64), a[::2], a[:0]):
            for counts in (np.ones(len(words)), np.array([r.randrange(1, 10**6) for _ in words])):
                known = ngram_join.Frequencies(copied, words, counts)
                (s, p), (t, q) = (ngram_join.prefix(x, hashes, known, 80) for x in (w, other))
                assert s.tolist() == a.tolist() and t.tolist() == b.tolist()
                assert len(set(p.tolist()) & set(q.tolist())) >= similar_groups.shared_least(np.array([len(a)]), len(b), 80)[0]


def test_edges(spark, edges, nothing):
    rows = ngram_join.similar_documents(edges).collect()
    assert len(rows) == len(EDGES)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (1, 3) and by[8] == (0, 8) and by[4][1] == by[5][1] == by[6][1] == 4
    assert sorted((r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is None) == [(0, None), (36, None)]
    assert ngram_join.similar_documents(nothing).collect() == []


def test_null_ids_and_texts_of_one_id(spark):
    a, b = prose(21, 300), prose(22, 300)
    near = lambda t: t.replace(t.split()[9], "other", 1)
    rows = [(7, a), (7, b), (8, near(a)), (9, near(b)), (4, BASE), (None, near(b)), (None, "one two"), (3, "TWO one"), (2, "one\ttwo")]
    out = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("token", F.lit("clash"))).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in out) == [(0, 2), (0, 7), (2, 2), (3, 3), (4, 4), (7, 7), (7, 7), (8, 7), (9, 7)]


def test_components_by_stars_and_in_one_task(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(30)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, stars = (sorted(similar_groups.connected_components(df, small).collect()) for small in (10**6, 0))
    low = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert one == stars == sorted((x, c) for x, c in low.items() if x != c)
