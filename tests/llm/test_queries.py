"""Queries with a DuckDB form give its rows; the pipeline's stages keep what they should."""

import duckdb
import pytest

import corpus_pipeline
from docfacts.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = dict(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").collect())
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.checkpoint(stage(spark, docs, sf_dir))
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    good = {d for d, q in labels.items() if q == 1}
    assert len(good - kept["quality"]) <= 0.02 * len(good)
    assert kept["line_dedup"] == kept["quality"] and kept["packing"] == kept["decontamination"] <= kept["near_dedup"] <= kept["line_dedup"]


def test_pipeline_on_edges(spark, edges, sf_dir):
    docs = edges
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.checkpoint(stage(spark, docs, sf_dir))
    assert docs.count() > 0


def test_pipeline_on_an_empty_table(spark, edges, sf_dir):
    docs = edges.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.checkpoint(stage(spark, docs, sf_dir))
    assert docs.count() == 0
