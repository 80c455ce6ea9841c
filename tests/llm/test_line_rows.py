"""Line dedup where rows share a doc_id."""

from docfacts.llm import line_dedup


def test_rows_of_one_id_are_cleaned_each_by_its_own_lines(spark):
    common, own = "this boilerplate line stands everywhere", "a precious unique opening line of this text"
    rows = [(i, f"{common}\nbody {i} has words of its own", f"site{i}") for i in range(8)]
    rows += [(50, f"{common}\nsome other words follow here", "site50"), (50, f"{own}\nand its second line stays too", "site50"), (50, None, "site50")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    texts = sorted(r["text"] or "" for r in out if r["doc_id"] == 50)
    assert texts == ["", f"{own}\nand its second line stays too", "some other words follow here"]
    assert sorted(r["n_removed"] for r in out) == [0, 0, 0] + [1] * 8  # the first occurrence, in document 0, stays


def test_the_first_line_stays_in_every_text_of_the_lowest_id(spark):
    common = "this boilerplate line stands everywhere"
    rows = [(0, f"{common}\nfirst text", "s0"), (0, f"{common}\nsecond text", "s0"), (0, f"before it\n{common}", "s0")] + [(i, common, f"s{i}") for i in range(1, 8)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r["text"] for r in out if r["doc_id"] == 0) == ["before it", f"{common}\nfirst text", f"{common}\nsecond text"]
    assert all(r["text"] == "" for r in out if r["doc_id"])
