"""Snippets: the shortest run of words that has all terms."""

import random

from pyspark.sql import functions as F

from docfacts.operators import search


def by_loop(words, terms, width):
    runs = [(j - i, i) for i in range(len(words)) for j in range(i, len(words)) if all(any(w.startswith(t) for w in words[i : j + 1]) for t in terms)]
    if not runs:
        return None
    length, start = min(runs)[0] + 1, min(runs)[1]
    room = max(width - length, 0)
    start = max(0, min(start - room // 2, max(len(words) - width, start - room)))
    return " ".join(f"[{w}]" if any(w.startswith(t) for t in terms) else w for w in words[start : start + width])


def test_against_loop(spark):
    r = random.Random(2)
    rows = [(i, 1, [r.choice(["ab", "abc", "b", "cd", "x", "y", "z"]) for _ in range(r.randrange(25))]) for i in range(300)] + [(900, 1, None), (901, 1, [])]
    df = spark.createDataFrame(rows, "doc_id long, page int, terms array<string>")
    for terms, width in ((["ab", "cd"], 5), (["b"], 4), (["ab", "abc", "cd"], 3), (["a", "z", "b"], 12), (["q"], 5)):
        got = {x["doc_id"]: x["snippet"] for x in search.snippets(df, terms, width).collect()}
        want = {d: s for d, _, w in rows if w and (s := by_loop(w, terms, width)) is not None}
        assert got == want
    assert search.snippets(df, []).collect() == []


def test_the_run_is_shown(spark):
    words = ["the"] + [f"w{i}" for i in range(40)] + ["the", "x", "oner"] + ["y"] * 3
    df = spark.createDataFrame([(1, 1, words)], "doc_id long, page int, terms array<string>")
    assert search.snippets(df, ["the", "oner"]).first()["snippet"] == "w34 w35 w36 w37 w38 w39 [the] x [oner] y y y"
    assert df.select(search.narrowest(F.col("terms"), ["the", "none"]).alias("r")).first()["r"] is None
