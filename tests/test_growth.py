"""What made queries grow: runs of words that begin no label, a second rendering, documents moved once more, and tasks that sort more as tables grow."""

import pytest
from pyspark.sql import functions as F

from docfacts.functions.text import fold
from docfacts.operators import extraction
from docfacts.plans import display, facts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_lines_with_a_labels_first_word_are_cut_into_runs(spark, sf_dir):
    assert "arrays_overlap" in plan_of(facts.citation_suppression(spark, sf_dir))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["fattura n 1 fattura n", "totale", "", "rif fattura", None])], "line int, folded string")
    got = [sorted(map(str, extraction.with_runs(rows, 2, heads).where("label in ('fattura', 'fattura n')").select("line", "label", "g").collect())) for heads in (None, ["fattura"], ["fattura"] + [f"x{i}" for i in range(60)])]
    assert got[0] == got[1] == got[2] and len(got[0]) == 5


def test_a_lines_markers_tell_whether_it_may_be_cited(spark):
    texts = ["Rif. fattura n. 12", "fattura n. 12", "fattura n. 12 del D.Lgs. 1 art. 3", "Ns. fattura", None]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", fold(F.col("text")).alias("folded"))
    first = F.array_position(F.split("folded", " "), "fattura").cast("int") - 1
    for r in rows.select("text", extraction.cited(F.col("text"), first, F.lit(2)).alias("want"), extraction.cited_line(F.col("text"), F.col("folded"), first, F.lit(2)).alias("got")).collect():
        assert r["got"] == r["want"], r["text"]


def test_sections_keep_to_the_orders_parts(spark, sf_dir, no_broadcast):
    assert "hashpartitioning(doc_id" not in plan_of(facts.section_parties(spark, sf_dir))


def test_picks_render_once(spark, sf_dir):
    plan = plan_of(facts.inferred_picks(spark, sf_dir))
    assert plan.count("lineitem.parquet") == 1


def test_parts_grow_with_line_items(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert display.by_order(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(display, "ROWS_A_TASK", 300)
    assert display.by_order(rows).rdd.getNumPartitions() == -(-rows.count() // 300)
