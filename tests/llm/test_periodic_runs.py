"""Periodic runs held against a plain scan of every period."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from docfacts.llm import periodic_runs

from .conftest import EDGES


def plain_runs(words, least=24):
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 3 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    listing = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_a_plain_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, periodic_runs.op11_periodic_runs(spark, sf_dir).collect()))
    assert got == sorted(plain_row(*d) for d in docs) and any(r[1] for r in got)


def test_runs_of_random_words():
    r = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(r.randint(1, 4)):
            n, letters = r.choice([0, 1, 5, 23, 24, 25, 60, 150]), r.choice([1, 2, 2, 3, 30])
            words = [r.randrange(letters) for _ in range(n)]
            if n > 4 and r.random() < 0.6:
                s = r.randrange(n)
                p = r.randint(1, n // 4)
                words = [w if i < s or s + (i - s) % p >= n else words[s + (i - s) % p] for i, w in enumerate(words)]
            texts.append(words)
        bounds = np.cumsum([0, *map(len, texts)])
        got = periodic_runs.runs_of(np.array([w for t in texts for w in t], np.int64), bounds).tolist()
        assert got == [[i, *x] for i, t in enumerate(texts) for x in plain_runs(t)]


def test_pairs_in_small_chunks(monkeypatch):
    words = np.array([0] * 100 + list(range(1, 30)) * 5 + [7, 8] * 40, np.int64)
    whole = periodic_runs.runs_of(words, np.array([0, len(words)])).tolist()
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    assert periodic_runs.runs_of(words, np.array([0, len(words)])).tolist() == whole == [[0, *x] for x in plain_runs(words.tolist())]


def test_a_failed_comparison_is_done_again(monkeypatch):
    """Hashes that call everything equal give wrong stretches; these are found out and other hashes are taken."""
    real, seeds = periodic_runs.PrefixHashes.equal, []
    monkeypatch.setattr(periodic_runs.PrefixHashes, "equal", lambda self, i, k, p: np.ones(len(i), bool) if len(seeds) == 1 else real(self, i, k, p))
    init = periodic_runs.PrefixHashes.__init__
    monkeypatch.setattr(periodic_runs.PrefixHashes, "__init__", lambda self, words, seed: (seeds.append(seed), init(self, words, seed))[1])
    words = np.array(list(range(40)) + [5, 6, 7] * 12 + list(range(50, 90)), np.int64)
    assert periodic_runs.runs_of(words, np.array([0, len(words)])).tolist() == [[0, *x] for x in plain_runs(words.tolist())] and seeds == [0, 1]


def test_edges(spark, edges, nothing):
    rows = periodic_runs.periodic_runs(edges).collect()
    want = [(i, [tuple(x) for x in plain_runs((t or "").encode().split())] if len(t or "") < 50_000 else []) for i, t in EDGES]
    key = lambda x: (x[0] is not None, x[0] or 0, str(x[1]))
    assert sorted(((r["doc_id"], [tuple(x) for x in r["runs"]]) for r in rows), key=key) == sorted(want, key=key)
    assert {r["doc_id"]: r["collapsed"] for r in rows}[8] == ""
    assert periodic_runs.periodic_runs(nothing).collect() == []
    docs = spark.createDataFrame([(1, "a b " * 100_000 + "c\x1cd ünï"), (2, "x\ty\x85z " * 30)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert [tuple(x) for x in out[1]["runs"]] == [(0, 200_000, 2)] and out[1]["collapsed"] == "a b c\x1cd ünï"
    assert [tuple(x) for x in out[2]["runs"]] == [(0, 60, 2)] and out[2]["collapsed"] == "x y\x85z"


def test_other_columns_do_not_matter(edges):
    plain = edges.select("doc_id", "text").where("doc_id = 7")
    assert periodic_runs.planted(edges).columns == ["doc_id", "text"]
    assert periodic_runs.periodic_runs(plain.withColumn("runs", F.lit(1))).collect() == periodic_runs.periodic_runs(plain).collect()
