"""Shards by rendezvous hashing: every key ranks all shards, and the first of its ranking takes it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.common import passes_columns, written
from hyperloom.plans.tables import numbered

#: Sixteen shards of one weight.
EQUAL = (1.0,) * 16
BITS = 52


def draw(key: Column, shard: Column, seed: int) -> Column:
    """An integer of ``BITS`` bits for a key and a shard, independent of all others."""
    mark = F.concat(F.lit(f"{seed}|"), shard.cast("string"), F.lit("|"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(mark.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def ranking(key: Column, weights: Sequence[float], seed: int) -> Column:
    """An array of (score, shard), in the order of shards; the least score takes the key.

    A score is exponential with the shard's weight as its rate, so a shard is first for a share of
    the keys that is its share of all weights. It depends on the key and that shard alone: shards
    that are added or get heavier only take keys, shards that go or get lighter only give keys away.
    """
    if not weights or min(weights) < 0 or not max(weights) > 0:
        raise ValueError("weights must be at least zero, one of them positive")
    heavy = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w > 0])
    uniform = lambda i: (draw(key, i, seed) + F.lit(0.5)) / F.lit(2.0**BITS)
    return F.transform(heavy, lambda x: F.struct((-F.ln(uniform(x["i"])) / x["w"]).alias("score"), x["i"].alias("shard")))


def shard_of(key: Column, weights: Sequence[float] = EQUAL, seed: int = 42) -> Column:
    """The shard of a key; equal scores go to the lower shard."""
    return F.array_min(ranking(key, weights, seed))["shard"]


@passes_columns
def assign(docs: DataFrame, *, key_col: str = "doc_id", weights: Sequence[float] = EQUAL, seed: int = 42) -> DataFrame:
    """``docs`` with ``shard``, decided by ``key_col`` and the weights alone, in one pass without a shuffle.

    Rows of one key share a shard. The id as key treats copies of a text apart; give a column of the
    text's digest to keep copies together. Null keys are one key (the empty string), as are keys of
    equal text form. A column named ``shard`` is replaced; an empty table gives an empty result.
    """
    return docs.withColumn("shard", shard_of(F.col(key_col), weights, seed))


def write_shards(docs: DataFrame, path: str, *, key_col: str = "doc_id", weights: Sequence[float] = EQUAL, seed: int = 42, rows_per_file: int = 1 << 20) -> None:
    """Parquet files under ``path/shard=0``, ...: whole rows, dealt by range over (shard, draw, hash of
    the row), so several tasks write a shard and a hot key has no task of its own."""
    placed = assign(docs, key_col=key_col, weights=weights, seed=seed)
    order = (draw(F.col(key_col), F.col("shard"), seed), F.xxhash64(*docs.columns))
    placed.repartitionByRange("shard", *order).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def slots(
    docs: DataFrame, *, weights: Sequence[float] = EQUAL, added: Sequence[float] = (1.0,), id_col: str = "doc_id", text_col: str = "text", seed: int = 42
) -> DataFrame:
    """One row per row of ``docs``: its shard, its place there, and its shard once ``added`` shards have come.

    Columns: ``doc_id, size`` (bytes of the text and 1), ``text_crc32, law`` (``key``), ``shard, slot``
    (from 0 without gaps in each shard, in the order of the key's draw, id, size and checksum) and
    ``grown_shard``. Texts are read once; what is sorted are the narrow rows, by range over shard and
    place with the row's number as the last part, so neither a hot key nor many copies of a row meet
    in one task. Places are counted for each range and added up, never by a window over a shard.

    Defined cases: a null text has size 1 and checksum 0; null ids are one key; repeated rows get a
    slot each; rows that tie in all columns are alike; an empty table gives an empty result; other
    columns are ignored.
    """
    key, text = F.col(id_col), F.col(text_col)
    ranked = docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        ranking(key, [*weights, *added], seed).alias("_ranks"),
    )
    first = F.filter("_ranks", lambda x: x["shard"] < len(weights))
    rows = ranked.select("doc_id", "size", "text_crc32", F.array_min(first)["shard"].alias("shard"), F.array_min("_ranks")["shard"].alias("grown_shard"))
    rows = written(rows.withColumn("_draw", draw(F.col("doc_id"), F.col("shard"), seed)), "shards")
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = numbered(rows, ["shard", "_draw", "doc_id", "size", "text_crc32", "_tie"], "_place")
    # One row for each shard.
    starts = F.broadcast(placed.groupBy("shard").agg(F.min("_place").alias("_start")))
    return placed.join(starts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_place") - F.col("_start")).alias("slot"), "grown_shard"
    )
