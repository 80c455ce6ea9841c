"""Evidence found again in texts and fragments, and names that don't collide."""

import random
import re

from docfacts.operators import names, picks
from pyspark.sql import functions as F


def test_text_range_takes_the_first_line(spark):
    rows = [
        ("Acme Srl\nTotale 5", "Acme  Srl\nother line"), ("x ACME\t srl", " \r\n acme srl \nTotale 5"), ("acme srl Acme Srl", "Acme Srl"), ("a+b (c) [d]", "(c)\n"),
        ("a.b", "axb"), ("axb", "a.b"), ("text", " \n\t"), ("text", None), (None, "text"), ("", "x"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, e string")
    got = [r["r"] and tuple(r["r"]) for r in df.select("i", picks.text_range(F.col("t"), F.col("e")).alias("r")).orderBy("i").collect()]
    assert got == [(0, 8), (2, 11), (9, 17), (4, 7), None, None, None, None, None, None]


def spans_by_loop(spans, evidence):
    needle = re.sub(r"\s+", "", next((x.strip() for x in re.split(r"\r?\n", evidence) if x.strip()), ""))
    compact = [re.sub(r"\s+", "", s) for s in spans]
    owners = [i for i, s in enumerate(compact) for _ in s]
    at = "".join(compact).find(needle)
    at = at if at >= 0 else "".join(compact).lower().find(needle.lower())
    return (owners[at], owners[at + len(needle) - 1]) if needle and at >= 0 else None


def test_matched_spans(spark):
    r = random.Random(3)
    rows = [(["Tota", "le: ", " 12", "", ",50 EUR"], "Totale:  12,50\nEUR"), (["", " "], "x"), ([], "x"), (["a", "b"], " \n"), (["A", "cme S", "rl"], "acme srl")]
    rows += [(["".join(r.choice("abA  ") for _ in range(r.randrange(4))) for _ in range(r.randrange(8))], "".join(r.choice("abA \n") for _ in range(r.randrange(1, 6)))) for _ in range(400)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, s array<string>, e string")
    got = [x["r"] and tuple(x["r"]) for x in df.select("i", picks.matched_spans(F.col("s"), F.col("e")).alias("r")).orderBy("i").collect()]
    assert got == [spans_by_loop(*x) for x in rows] and got[0] == (0, 4) and got[4] == (0, 2)
    odd = spark.createDataFrame([(["a", None], "a"), (None, "a"), (["a"], None)], "s array<string>, e string")
    assert [x["r"] for x in odd.select(picks.matched_spans(F.col("s"), F.col("e")).alias("r")).collect()] == [None] * 3


def names_by_loop(stems):
    """Repeated stems take the next number that no stem ends in."""
    own, used, out = {s.lower() for s in stems}, {}, []
    for s in stems:
        n = used.get(s.lower(), 0) + 1
        while n > 1 and f"{s.lower()}-{n}" in own:
            n += 1
        used[s.lower()] = n
        out.append(s if n == 1 else f"{s}-{n}")
    return out


def test_distinct_names(spark):
    r = random.Random(4)
    cases = [["a", "a", "a-2"], ["a", "A", "a-3", "a", "a", "A-3", "a-3-2", "a-02", "a-5", "a-4"], ["x"], ["file", None, "b-1", "b-1"]]
    cases += [[r.choice("aAb") + "".join(f"-{r.randrange(1, 9)}" for _ in range(r.choice((0, 0, 1, 1, 2)))) for _ in range(r.randrange(1, 60))] for _ in range(12)]
    for stems in cases:
        df = spark.createDataFrame([(i, s, "kept") for i, s in enumerate(stems)], "i int, stem string, label string")
        out = names.distinct_names(df, "i").orderBy("i").collect()
        files = [x["file"] for x in out]
        assert files == names_by_loop([s or "file" for s in stems])
        assert len({f.lower() for f in files}) == len(stems) and {x["label"] for x in out} == {"kept"}
    assert names.distinct_names(df.limit(0), "i").collect() == []
