"""Registered queries against their SQL, and the pipeline against its parts."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.oracle import compare
from visitframe.llm import registry, simhash
from visitframe.llm.common import running_total

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    compare(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - {"op12_prefix_trie"}))
def test_one_row_per_input_row(spark, name):
    table = {"op3_html": "pages", "op10_e8_neighbors": "embeddings"}.get(name, "documents")
    assert registry.queries()[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def test_stages_return_documents_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns, name
        if name == "near_dedup":
            found = simhash.near_duplicates(docs, words=5)
            assert found.select("component_id").distinct().count() == docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert 0 < last.count() <= 3 * n
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.select("doc_id", "ids_sha256").exceptAll(last.select("doc_id", "ids_sha256")).isEmpty()
    assert whole.count() == last.count()


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL) if docs.columns else docs
    assert docs.count() == 0


def test_running_total_over_buckets(spark):
    rows = [(k % 2, k // 10, k, k * 3) for k in range(100)]
    df = spark.createDataFrame(rows, "g int, b int, at int, v long")
    got = {r["at"]: r["t"] for r in running_total(df, ["g"], "b", [df["at"]], "v", "t").collect()}
    assert got == {k: sum(3 * j for j in range(k % 2, k + 1, 2)) for k in range(100)}
