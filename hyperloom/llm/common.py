"""Text expressions that the operators share, and the scratch tables of the core."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.plans import tables
from hyperloom.plans.tables import broadcast_if_small, discard, scratch_path, shared_folder, size_in_bytes, written

__all__ = [
    "broadcast_if_small", "discard", "hash128", "join_counted", "lower_ascii", "meeting", "passes_columns", "row_key", "scratch_path", "shared_folder",
    "size_in_bytes", "written",
]

#: The characters that separate words and are stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"
#: Separators of alphanumeric words: all ASCII but digits and letters.
NON_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Rows of one key above which a join deals it apart, and partitions that it may take then.
HOT_ROWS = 100_000
SALTS = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed.

    Where every character is one byte, ``lower`` does just this and is several times as fast.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def row_key(*columns: Column) -> list[Column]:
    """128 bits that stand for the values of a row, as the longs ``_k1`` and ``_k2``.

    Rows that agree in all values share a key, so a table with one row per key can be joined
    back whatever the input repeats, and null identifiers need no special case.
    """
    return [F.xxhash64(F.lit(seed), *columns).alias(f"_k{seed}") for seed in (1, 2)]


def passes_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that return all columns of ``docs``: their own helper columns start with ``_``,
    so columns of the input that do so have other names meanwhile."""

    @wraps(operator)
    def run(docs: DataFrame, *args: object, **options: object) -> DataFrame:
        meant = [v for v in options.values() if isinstance(v, str)]
        away = {c: f"aside-{i}-{c}" for i, c in enumerate(docs.columns) if c.startswith("_") and c not in meant}
        if not away:
            return operator(docs, *args, **options)
        return operator(docs.withColumnsRenamed(away), *args, **options).withColumnsRenamed({v: k for k, v in away.items()})

    return run


def hash128(value: Column) -> Column:
    """Two independently seeded 64-bit hashes of ``value``."""
    return F.struct(F.xxhash64(F.lit(1), value).alias("h1"), F.xxhash64(F.lit(2), value).alias("h2"))


def join_counted(rows: DataFrame, found: DataFrame, key: str, count: str, *, hot: int | None = None, limit: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``found``, which has one row for each value of ``key`` and says in
    ``count`` how many of ``rows`` have it. Nulls are one value.

    No value meets in one task, whatever adaptive execution does: a small ``found`` is broadcast;
    else only values of up to ``hot`` rows are shuffled, and those above, of which there are few, are
    broadcast, or salted where even they are many. Both tables should be cheap to read twice.
    """
    named = found.withColumnsRenamed({key: "_key"})
    same = F.col(key).eqNullSafe(F.col("_key"))
    limit, hot = tables.BROADCAST_BYTES if limit is None else limit, HOT_ROWS if hot is None else hot
    if limit and size_in_bytes(named) <= limit:
        return rows.join(F.broadcast(named), same).drop("_key", count)
    large, small = named.where(F.col(count) > hot), named.where(F.col(count) <= hot)
    size = size_in_bytes(large)
    if not size:
        return rows.join(named, same).drop("_key", count)
    if size <= limit:
        apart = rows.join(F.broadcast(large), same)
        rest = rows.join(F.broadcast(large.select("_key")), same, "left_anti")
    else:
        dealt = rows.withColumn("_own", F.pmod(F.xxhash64(F.spark_partition_id(), *rows.columns), F.lit(SALTS)))
        salted = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = dealt.join(salted, same & (F.col("_own") == F.col("_salt")), "left").drop("_own")
        apart = met.where(F.col("_salt").isNotNull()).drop("_salt")
        rest = met.where(F.col("_salt").isNull()).select(*rows.columns)
    return apart.unionByName(rest.join(small, same)).drop("_key", count)


def meeting(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is one of ``known``, a table of distinct ones.

    A ``known`` too large to broadcast first meets the distinct keys of ``rows``, counted within tasks;
    what is met comes back with its count, so a key that a third of the rows have is dealt apart.
    """
    if size_in_bytes(known) <= tables.BROADCAST_BYTES:
        return rows.join(F.broadcast(known), key, "left_semi")
    met = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).join(known, key), "met-keys")
    return join_counted(rows, met, key, "_rows").select(*rows.columns)
