"""Exact duplicates: skew-safe combining of equal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.common import broadcast_if_small, lower_ascii, written

#: Partial groups of one text that are merged apart before their winners meet.
SALTS = 32


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: its id, the id that stays for its text, and the group's size.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. Columns:
    ``doc_id, keep_id, group_size, kept, text_sha256``. Rows are combined in three stages, each
    keyed by the digest *and* the full text: within each map task (Spark's partial aggregation),
    then by digest, text and salt, then by digest and text. A text that fills a third of the table
    so reaches any task as a bounded number of partial rows. Members find their group again by digest
    where it has one text, which is counted; digests that several texts share are joined by the full
    text as well. So groups are compared by content everywhere, and no text is shuffled once more.

    Defined cases: of equal texts the row with the largest id stays; a null id is smaller than
    any other, and a group of null ids only keeps null. Repeated rows with the staying id are all
    marked ``kept``. An empty table gives an empty result. Other columns are ignored.
    """
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).withColumn("_digest", digest(F.col("_text")))
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = salted.groupBy("_digest", "_text", "_salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = merged.groupBy("_digest", "_text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    by_digest = winners.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts"), F.max("keep_id").alias("keep_id"), F.max("n").alias("group_size"))
    # Written, so that the join shuffles both sides for itself and may split a group of many copies.
    groups = written(by_digest, "groups")
    members = rows.select("doc_id", "_digest").join(groups.where("_texts = 1"), "_digest").select("doc_id", "_digest", "keep_id", "group_size")
    shared = groups.where("_texts > 1").select("_digest")
    if not shared.isEmpty():
        shared = broadcast_if_small(shared)
        texts = written(winners.join(shared, "_digest", "left_semi").withColumnRenamed("n", "group_size"), "texts-of-one-digest")
        some = rows.join(shared, "_digest", "left_semi").join(texts, ["_digest", "_text"])
        members = members.union(some.select("doc_id", "_digest", "keep_id", "group_size"))
    return members.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
