"""Operators held against plain versions on whole small tables."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docfacts.llm import fingerprints, line_dedup, near_dedup, packing, quality, secrets, suffix_tree, token_counts, toxicity
from docfacts.llm.common import documents
from docfacts.llm.quality import op1_quality_classifier

from .conftest import EDGES, prose


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


def shingles(text):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_token_counts(spark, sf_dir, corpus):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in token_counts.op4_token_counts(spark, sf_dir).collect():
        text = corpus[r["doc_id"]] or ""
        assert r["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids) and r["n_bytes"] == len(text.encode())


def test_packing(spark, sf_dir, corpus):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.op5_packing(spark, sf_dir).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, text in corpus.items():
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # full or a power of two: no padding


def test_packed_pieces_hold_their_ids(spark, sf_dir, corpus):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for rows in (packing.pack_documents(docs).collect(), corpus_pipeline.pack(spark, docs, sf_dir).collect()):
        ids = defaultdict(list)
        for r in sorted(rows, key=lambda r: r["start"]):
            assert len(r["ids"]) == 4 * r["length"]
            ids[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in corpus.items()}


def test_base_spans(spark, sf_dir, corpus):
    kinds = [(re.compile(secrets.ASSIGN, re.I | re.A), lambda m: len(m[2]) >= 12), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]
    for r in secrets.op2_secret_scan(spark, sf_dir).collect():
        spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in p.finditer(corpus[r["doc_id"]]) if ok(m))
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_markov_models_add_random_strings(spark):
    key, name = "x9Qz7LmP2vT8wRb4KsY1uNd6", "internationalizationsettings"
    docs = spark.createDataFrame([(1, f"use {key} with {name} now")], "doc_id long, text string")
    r = random.Random(1)
    strings = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(24)) for _ in range(200)]
    samples = spark.createDataFrame([(s, True) for s in strings] + [(w, False) for w in ["internationalize", "settingsname", "configurationvalue", "nationalisation", "zationsettings"] * 40], "value string, is_secret boolean")
    spans = secrets.find_secrets(docs, samples).first()["added"]
    assert [(s["start"], s["end"]) for s in spans] == [(4, 4 + len(key))]


def test_fingerprints(spark, sf_dir, corpus):
    ids, errors = sorted(corpus), []
    for r in fingerprints.op6_document_fingerprints(spark, sf_dir).collect():
        text, nxt = corpus[r["doc_id"]], corpus[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        a, b = shingles(text), shingles(edited)
        errors.append(r["near_edited"] - len(a & b) / max(1, len(a | b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_secret_models_learn_from_all_documents(spark):
    docs = spark.createDataFrame([(i, f"identifier{i} ordinary") for i in range(2500)], "doc_id long, text string")
    assert secrets.labelled_samples(docs).count() == 5000


def test_rest_of_a_run_around_a_base_span_is_scored(spark):
    r = random.Random(5)
    rest, other = ("".join(r.choice(string.ascii_uppercase) for _ in range(24)) for _ in range(2))
    docs = spark.createDataFrame([(1, f"x {rest}0123456789abcdef{other} y"), (2, f"x {rest}0123456789abcdefSHORT y"), (3, f"x {rest} y")], "doc_id long, text string")
    samples = spark.createDataFrame([("".join(r.choice(string.ascii_uppercase) for _ in range(400)), True), ("abcabcabc" * 9, False)], "value string, is_secret boolean")
    added = {x["doc_id"]: [(s["start"], s["end"]) for s in x["added"]] for x in secrets.find_secrets(docs, samples).collect()}
    assert added == {1: [(2, 26), (42, 66)], 2: [(2, 26)], 3: [(2, 26)]}


def test_equal_texts_have_equal_fingerprints(edges):
    rows = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint_pairs(edges).collect()}
    assert rows[4] == rows[5] != rows[6] and rows[1] == rows[8] == ""


def components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = defaultdict(list)
    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in by_shingle[s]).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            by_shingle[s].append(i)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("block", [1500, 2])
def test_near_duplicates(spark, sf_dir, corpus, block):
    sets = {i: shingles(t) for i, t in corpus.items()}
    want = components(sets, 85)
    rows = near_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_all_texts_of_an_id_count(spark):
    a, b = prose(21, 300), prose(22, 300)
    near = lambda t: t.replace(t.split()[9], "other", 1)
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, prose(23, 300)), (None, near(b))]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in out) == [(0, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_a_chained_group_is_verified_by_buckets(spark):
    """Each class shares a band with its neighbours alone; another group is one bucket."""
    chain, star = [(i, 10, [i, i + 1]) for i in range(24)], [(100 + i, 10, [200]) for i in range(9)]
    rows = near_dedup.candidate_groups(spark.createDataFrame(chain + star, "cid long, size long, bands array<long>"), 8, 10**9).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["grp"]["chained"], r["grp"]["g"], r["blocks"]].append(r["cid"])
    assert {k: sorted(v) for k, v in groups.items()} == {**{(True, i, 1): [i - 1, i] for i in range(1, 24)}, (False, 100, 2): list(range(100, 109))}


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) for n in (600, 200, 200))
    s = near_dedup.super_minhash([np.concatenate([shared, a]), np.concatenate([shared, b]), shared[:3]])
    assert abs(float((s[0] == s[1]).mean()) - 0.6) < 0.12 and s.shape[1] == near_dedup.BANDS * near_dedup.ROWS
    assert (s[2] < np.iinfo(np.uint64).max).all()


def suffix_tree_scores(texts, teach, rules):
    """log10 of each text's probability by a tree of dictionaries; the states; and its conditional probability function."""
    root = Counter(w for t, on in zip(texts, teach, strict=True) for w in t if on)
    total, distinct = sum(root.values()), len(root)
    states, considered, length = {}, {()}, 1

    def p(context, w):
        """In the state of the longest suffix that is one."""
        for k in range(len(context)):
            if context[k:] in states:
                n = states[context[k:]]
                return (max(n[w] - 1, 0) + len(n) * p(context[k + 1 :], w)) / sum(n.values())
        return (root[w] + 1) / (total + distinct + 1)

    while True:
        follow = defaultdict(Counter)
        for t, on in zip(texts, teach, strict=True):
            for i in range(length, len(t)):
                s = tuple(t[i - length : i])
                if on and s[:-1] in considered and (length == 1 or s[1:] in states):
                    follow[s][t[i]] += 1
        follow = {s: n for s, n in follow.items() if sum(n.values()) >= rules.least_count}
        found = {}
        for s, n in follow.items():
            c, gain = sum(n.values()), 0.0
            for w, m in n.items():
                suffix = p(s[1:], w)
                gain += m * math.log((max(m - 2, 0) + (len(n) - (m == 1)) * suffix) / (c - 1) / suffix)
            if gain >= rules.least_gain:
                found[s] = n
        if not found:
            break
        states.update(found)
        considered, length = set(follow), length + 1
    longest = max(map(len, states), default=0)
    return [sum(math.log10(p(tuple(t[max(0, i - longest) : i]), w)) for i, w in enumerate(t)) for t in texts], states, p


def test_lm_scores(spark, sf_dir, corpus):
    """All rows against the dictionaries' tree, over many blocks and buckets."""
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in corpus.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    rules = suffix_tree.Rules(least_count=3, least_gain=1.0)
    want, states, _ = suffix_tree_scores(tokens.values(), [not held[i] for i in tokens], rules)
    want = dict(zip(tokens, want, strict=True))
    docs = spark.createDataFrame([(i, held[i], corpus[i], not held[i]) for i in tokens], "doc_id long, held_out boolean, text string, teaches boolean")
    rows = suffix_tree.score_documents(docs, rules, 10_000, 5_000).collect()
    assert len(rows) == len(tokens) and max(map(len, states)) > 2
    for r in rows:
        t = tokens[r["doc_id"]]
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-6)
    assert sum(r["score"] - r["base_score"] for r in rows if r["held_out"]) > 0


def test_lm_hot_contexts(spark):
    """The default rules; most contexts are hot, their numbers are added up over buckets. A length of context takes one exchange, so stages are few."""
    r = np.random.default_rng(5)
    likely, texts = r.uniform(0.05, 0.95, 16), []
    for _ in range(30):
        bits = [0, 0, 0, 0]
        for _ in range(500):
            bits.append(int(r.random() < likely[int("".join(map(str, bits[-4:])), 2)]))
        texts.append(" ".join(f"w{b}" for b in bits))
    texts += ["w0 w1 w1 w0", "", "w0 unseen w1"]
    teach = [i % 7 != 2 for i in range(len(texts))]
    tokens = [[*t.encode().split(), b"\n"] for t in texts]
    want, states, _ = suffix_tree_scores(tokens, teach, suffix_tree.Rules())
    spark.sparkContext.setJobGroup("hot contexts", "")
    rows = suffix_tree.score_documents(spark.createDataFrame([(i, t, on) for i, (t, on) in enumerate(zip(texts, teach, strict=True))], "doc_id long, text string, teaches boolean"), None, 3_000, 300).collect()
    tracker, lengths = spark.sparkContext.statusTracker(), max(map(len, states)) + 1
    stages = {x for j in tracker.getJobIdsForGroup("hot contexts") if (job := tracker.getJobInfo(j)) for x in job.stageIds}
    spark.sparkContext.setJobGroup("", "")
    assert len(rows) == len(texts) and lengths > 4
    assert all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-6) for r in rows)
    assert len(stages) <= 24 * lengths, (len(stages), lengths)


def test_suffix_tree_states_are_distributions():
    texts = [t.split() for t in ["a b c a b c a b d a b c"] * 4 + ["a b c", "b c a c a b"] * 3]
    _, states, p = suffix_tree_scores(texts, [True] * len(texts), suffix_tree.Rules(2, 0.1))
    assert states and all(math.isclose(sum(p(s, w) for w in [*"abcd", "unknown"]), 1, rel_tol=1e-9) for s in states)


def test_maximal_segments():
    scores = np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5.0])
    assert [(s, e) for s, e, _ in toxicity.maximal_segments(scores)] == [(0, 1), (2, 3), (4, 11)]


def segments_by_definition(scores, lo, hi):
    """The best segment of [lo, hi), then those left and right of it."""
    above = np.concatenate([[0.0], np.cumsum(scores)])
    best = max(((above[j] - above[i], i - j, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return [*segments_by_definition(scores, lo, i), (i, j), *segments_by_definition(scores, j, hi)]


def test_maximal_segments_by_definition():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 30, 40):
        for _ in range(6):
            scores = rng.normal(-0.2, 1, n)
            assert [(s, e) for s, e, _ in toxicity.maximal_segments(scores)] == segments_by_definition(scores, 0, n)


def test_toxicity_of_every_row(spark, sf_dir, corpus):
    """All rows against a plain scorer with the same fitted tables."""
    docs = documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "toxic", F.lit(True))
    for r in toxicity.score_toxicity(docs, model).collect():
        words, scores = corpus[r["doc_id"]].lower().split(), []
        for w in words:
            w = "".join(c for c in w if c.isalpha())
            known = [w[:n] for n in range(len(w), 0, -1) if (n == len(w) or n >= 4) and w[:n] in model.table]
            scores.append(model.scores[model.table[known[0]] if known else 0])
        if len(words) > 150:
            continue
        found = segments_by_definition(np.array(scores), 0, len(scores))
        best = sorted((sum(scores[i:j]) for i, j in found), reverse=True) or [0.0]
        top, total = -math.inf, 0.0
        for k, s in enumerate(best, 1):
            total += model.rate * s - math.log(model.k * max(len(words), 1))
            if total > 0 or k == 1:
                top = max(top, total - (k - 1) * math.log(max(total, 1)) + math.lgamma(k + 1) + math.lgamma(k) - k * math.log(2))
        assert math.isclose(r["score"], float(np.interp(top, model.at, model.value)), rel_tol=1e-6, abs_tol=1e-9)
        for p in r["passages"]:
            assert 0 <= p["start"] < p["end"] <= len(corpus[r["doc_id"]])


def test_labelled_copies_weigh_together(spark):
    line = "a line that many documents have in common at their end"
    rows = [(i, prose(50, 80), 0) for i in range(4)] + [(10 + i, f"{prose(60 + i, 80)} {line}", 0) for i in range(4)] + [(20, "", 1)]
    weights = dict(toxicity.weighed(spark.createDataFrame(rows, "doc_id long, text string, y int")).collect())
    assert [weights[i] for i in range(4)] == [0.25] * 4 and all(weights[10 + i] == 1 for i in range(4)) and 20 not in weights


def test_quality_gradients():
    rng = np.random.default_rng(2)
    bags, y = np.array([3, 1, 4, 2]), np.array([1.0, 0.0, 1.0, 0.0])
    x = rng.normal(size=(10, 5))
    model = quality.train(x, bags, y, width=4, gate=3, steps=2)
    loss = lambda: float(np.mean(-y * np.log(model.forward(x, bags)["y"]) - (1 - y) * np.log(1 - model.forward(x, bags)["y"])))
    model.weights["d"] = np.array(model.weights["d"])
    for name, g in model.gradients(x, bags, y, 0.0).items():
        w, g = model.weights[name], np.asarray(g)
        for i in np.ndindex(*w.shape):
            at = w[i].copy()
            w[i] = at + 1e-5
            up = loss()
            w[i] = at - 1e-5
            assert math.isclose(g[i], (up - loss()) / 2e-5, rel_tol=1e-4, abs_tol=1e-7)
            w[i] = at


def test_quality_forward_pass():
    rng = np.random.default_rng(3)
    bags, x = np.array([2, 5, 1]), rng.normal(size=(8, 5))
    model = quality.train(x, bags, np.array([1.0, 0.0, 1.0]), width=4, gate=3, steps=5)
    p, at = model.weights, 0
    for n, got in zip(bags, model.score(x, bags), strict=True):
        h = np.tanh(((x[at : at + n] - model.mean) / model.scale) @ p["W"] + p["b"])
        e = np.exp([np.dot(p["w"], np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) for v in h])
        assert math.isclose(got, 1 / (1 + math.exp(-(e @ h / e.sum() @ p["c"] + p["d"]))), rel_tol=1e-9)
        at += n


def test_secret_models_precision_and_recall(spark):
    r = random.Random(11)
    parts = "inter national configur ation setting name value docu ment token izer hand ler man ager fact ory".split()
    key = lambda: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(20, 40)))
    name = lambda: ("_" if r.random() < 0.5 else "").join(r.choice(parts) for _ in range(6))
    samples = spark.createDataFrame([(key(), True) for _ in range(300)] + [(name(), False) for _ in range(300)], "value string, is_secret boolean")
    docs = spark.createDataFrame([(i, f"see {key() if i % 2 else name()} here") for i in range(400)], "doc_id long, text string")
    found = {x["doc_id"] for x in secrets.find_secrets(docs, samples).collect() if x["added"]}
    true = sum(i % 2 for i in found)
    assert true / len(found) > 0.97 and true / 200 > 0.95


def test_secrets_of_a_text_with_very_many(spark):
    r = random.Random(12)
    runs = ["".join(r.choice("0123456789abcdef") for _ in range(32)) for _ in range(50_000)]
    row = secrets.find_secrets(spark.createDataFrame([(1, " ".join(runs))], "doc_id long, text string")).first()
    assert [(s["start"], s["end"]) for s in row["base"]] == [(33 * i, 33 * i + 32) for i in range(50_000)] and not row["added"]


def test_tokens_of_odd_characters(edges):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["н֋", "த౜", "→₝", "a\U0001fadfb", "áb́", "ſtraße İ ǅ", "x\u2028y\x85z\x1c", "ﬁ ½ ² \u0378"]
    counter = token_counts.counter_of(public_tokenizers.path("word_bpe_49k.json"))
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert [counter.count(t) for t in odd] == list(map(count, odd))
    for r in token_counts.count_tokens(edges).select("doc_id", "n_tokens").distinct().collect():
        texts = [t for i, t in EDGES if i == r["doc_id"]]
        assert r["n_tokens"] in [count(t or "") for t in texts]


def test_lines_of_a_long_text_and_clashing_columns(spark):
    line = lambda i: f"this boilerplate line is number {i}"
    long = "\n".join(line(i) for i in range(30_000))
    rows = [(d, long if d == 9 else "\n".join(line(i) for i in range(d % 3, 30_000, 3)), f"s{d}", 1, 2, 3, 4) for d in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id int, _removal int, n_lines int, id int")
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, broadcast_rows=10).collect()}
    assert out[9]["n_lines"] == 30_000 and out[9]["text"] == "" and out[9]["n_removed"] == 30_000 and (out[9]["_id"], out[9]["_removal"], out[9]["id"]) == (1, 2, 4)
    assert [out[d]["n_removed"] for d in (0, 1, 2, 3)] == [0, 0, 0, 10_000]


def test_pipeline_near_duplicates(spark, sf_dir, corpus):
    """The stage keeps the smallest id of every group at 80 %."""
    want = components({i: shingles(t) for i, t in corpus.items()}, 80)
    kept = corpus_pipeline.keep_one_of_each(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, c in want.items() if i == c}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect())
    held = [(r["predicted"], labels[r["doc_id"]]) for r in op1_quality_classifier(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in held]) > 0.95
