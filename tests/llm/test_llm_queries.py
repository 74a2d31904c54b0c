"""Registered queries against their SQL, and the pipeline against its stages."""

from __future__ import annotations

import pytest
from fixtures import documents
from pyspark.sql import functions as F

import corpus_pipeline
from hyperloom.llm import queries
from oracle import connect, same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_awkward_rows(spark, sf_dir, name, stage):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns and empty tables."""
    docs = documents(spark).withColumn("_k1", F.lit("own")).withColumn("_text", F.lit("own"))
    found = stage(spark, docs, sf_dir)
    rows = found.collect()
    assert found.columns == docs.columns and len(rows) <= docs.count()
    assert {r["_k1"] for r in rows} <= {"own"} and {r["n_words"] for r in rows} <= {"clash"}
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
    if name == "line_dedup":
        assert len(rows) == docs.count()
    nothing = stage(spark, docs.where("false"), sf_dir)
    assert nothing.columns == docs.columns and nothing.collect() == []


def test_pipeline(spark, sf_dir):
    """Each stage keeps a part of its input, changes only texts, and the last rows are run()'s."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "decontaminate", "mixing"]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toArrow())
        kept = [r[0] for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and len(set(kept)) == len(kept) and set(kept) <= ids
        ids = set(kept)
    assert ids == {r[0] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()}
