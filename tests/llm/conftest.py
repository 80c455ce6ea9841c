import random

import pytest

WORDS = "the of and to in is that for with was ably eren thatin oner ster ationed hes reand ingly".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(WORDS) for _ in range(r.choice((1, 1, 2, 3)))) for _ in range(n))


BASE = prose(1, 200)
NEAR = BASE.replace(BASE.split()[50], "changed", 1)
#: doc_id and text: empty, null, short, long, equal, near, repeated rows, null ids, odd characters.
EDGES = [
    (1, ""), (2, None), (3, "one two"), (4, BASE), (5, BASE.upper()), (5, BASE.upper()), (6, NEAR), (7, prose(2, 20_000)), (8, "  \n\t "), (9, "ünï ☃ 日本語 \x1c\x85   👩‍👩‍👧 <|endoftext|> ß"),
    (None, prose(3, 40)), (None, None), (10, "a" * 5000), (11, prose(4, 300)), (12, prose(5, 6)), (2**60 + 1, prose(6, 30)), (-5, prose(7, 30)),
]
#: Other columns whose names the operators might use themselves.
EXTRA = "source string, lang string, n_chars long, id long, digest string, bands string, n long, word string, row long, bits string, key string, score double, y int, next string, shingles string, item_id long, component string"


@pytest.fixture(scope="session")
def edges(spark):
    row = ("src1", "en", 5, 1, "d", "b", 2, "w", 3, "x", "k", 0.5, 1, "n", "s", 9, "c")
    return spark.createDataFrame([(*e, *row) for e in EDGES], f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    """Odd documents are good and clean; null labels and unknown ids teach nothing."""
    rows = [(i, i % 2, 1 - i % 2) for i in range(200)] + [(None, 1, 0), (3, None, None), (10**9, 0, 1), (4, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def texts(spark, n=200):
    """Even documents shout, and hold insults; odd ones are prose."""
    def one(i):
        t = prose(100 + i, 120)
        if i % 2:
            return t
        w = t.upper().split()
        w[10] = w[70] = "fiend"
        return "!! ".join(w)

    return spark.createDataFrame([(i, one(i)) for i in range(n)], "doc_id long, text string")
