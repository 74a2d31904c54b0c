"""The corpus pipeline: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame with the columns of ``documents``. ``run``
writes each stage's rows to the shared folder and reads them again as the next one's input, so a
lost executor costs one stage at most; a stage's rows are deleted once the next one has its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import decontaminate, line_dedup, mixing, quality, simhash
from hyperloom.llm.common import discard, written
from hyperloom.sources import table

#: The share of the clean documents' tokens that the mixing stage keeps.
MIX_BUDGET = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten or more of them share; ``n_chars`` follows the text."""
    cleaned = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return simhash.keep_one_per_component(docs, shingle=4, max_distance=4)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no notable share of benchmark passages."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=13, gram=5, share=20)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of ``MIX_BUDGET`` of all tokens, with the target shares by source, language and length
    class as far as the cells have the documents for them."""
    return mixing.sample(docs, topic=mixing.by_length(F.col("text")), temper=0.5, rounds=10, max_rounds=100, budget=MIX_BUDGET)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("line_dedup", own_lines),
    ("simhash", one_of_near_copies),
    ("decontaminate", clean_of_benchmark),
    ("mixing", mixed),
]

#: SQL can't express the first stage (a fitted classifier) or the third (components).
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages leave of ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
