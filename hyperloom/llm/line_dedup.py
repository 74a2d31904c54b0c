"""Lines that many documents share are dropped from all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.common import BLANKS, broadcast_if_small, hash128, lower_ascii, passes_columns, row_key, written


@passes_columns
def drop_common_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text_col`` cleaned of lines whose key stands in ``min_docs`` documents or more.

    A line's key is the line, stripped of ASCII blanks at both ends and with A-Z lower-cased; keys
    of fewer than ``min_chars`` code points are never dropped. Keys are compared by 128-bit hash.
    Pairs of key and id are made distinct first, within map tasks and then dealt out by both, so a
    line that every document has gathers nowhere; the count that follows combines within map tasks.
    Only (document, position) of dropped lines travels back; texts are shuffled once, by document,
    and reassembled by position. Work is linear in lines, whatever number of them a document has.

    Adds the columns ``n_lines`` (before dropping) and ``n_dropped``, replacing columns of these
    names. Defined cases: null or empty text is one empty line and comes back as ``''``; a
    document that loses all lines comes back as ``''``; rows of one id count as one document, rows
    of null ids as one each; an empty table gives an empty result.
    """
    key = row_key(F.col(id_col), F.col(text_col))
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    keys = F.transform(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))
    # Rows without an id are told apart by number, so that each counts as one document.
    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    hashed = docs.select(*key, F.col(id_col).alias("_id"), alone.alias("_alone"), keys.alias("_keys")).select(
        "_k1", "_k2", "_id", "_alone", F.transform("_keys", lambda k: F.when(F.char_length(k) >= min_chars, hash128(k))).alias("_lines")
    )
    frequent = written(
        hashed.select("_id", "_alone", F.explode("_lines").alias("_line"))
        .where("_line IS NOT NULL")
        .select("_line.h1", "_line.h2", "_id", "_alone")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("_docs"))
        .where(F.col("_docs") >= min_docs)
        .select("h1", "h2"),
        "lines",
    )
    frequent = broadcast_if_small(frequent)
    dropped = (
        hashed.select("_k1", "_k2", F.posexplode("_lines").alias("_pos", "_line"))
        .select("_k1", "_k2", "_pos", F.col("_line.h1").alias("h1"), F.col("_line.h2").alias("h2"))
        .join(frequent, ["h1", "h2"])
        .groupBy("_k1", "_k2")
        .agg(F.collect_set("_pos").alias("_dropped"))
    )
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    gone = F.coalesce(F.col("_dropped"), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.element_at("_split", i + 1)), "\n")
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    return (
        docs.select("*", *key)
        .join(dropped, ["_k1", "_k2"], "left")
        .withColumn("_split", lines)
        .select(
            *[kept.alias(text_col) if c == text_col else F.col(c) for c in docs.columns if c in others or c == text_col],
            F.size("_split").cast("long").alias("n_lines"),
            F.size(gone).cast("long").alias("n_dropped"),
        )
    )
