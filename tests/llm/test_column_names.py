"""Operators that return all columns of their input, where those have the names of helper columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fixtures import documents, empty, rows_of
from hyperloom.llm import decontaminate, line_dedup, mixing, quality, simhash, substring_dedup

HELPERS = ("_k1", "_K2", "_copy", "_text", "_split", "_dropped", "_stay", "_hits", "_source", "_lang", "_p", "_s_n_words")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(16)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")


OPERATORS = {
    "line_dedup": lambda spark, docs: line_dedup.drop_common_lines(docs, min_docs=2),
    "substring_dedup": lambda spark, docs: substring_dedup.drop_repeats(docs, window=8),
    "simhash": lambda spark, docs: simhash.keep_one_per_component(docs),
    "decontaminate": lambda spark, docs: decontaminate.drop_contaminated(docs, benchmark(spark)),
    "quality": lambda spark, docs: quality.drop_rejected(docs, labels(spark)),
    "mixing": lambda spark, docs: mixing.sample(docs, topic=mixing.by_length(F.col("text"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_helper_names(spark, name):
    plain = documents(spark, clashes=False)
    named = plain.withColumns({c: F.lit(c) for c in HELPERS})
    want = OPERATORS[name](spark, plain)
    found = OPERATORS[name](spark, named)
    assert [c for c in found.columns if c not in HELPERS] == want.columns
    assert rows_of(found.select(*want.columns)) == rows_of(want)
    assert {tuple(r) for r in found.select(*HELPERS).collect()} <= {HELPERS}


def test_helper_names_of_nothing(spark):
    named = empty(spark).withColumns({c: F.lit(c) for c in HELPERS})
    assert not rows_of(line_dedup.drop_common_lines(named))
