"""Vectors of groups as aggregates of built-in functions: they combine within map tasks, and mix with other aggregates.

``bundle_sql`` and ``bind_sql`` are texts for any ``SELECT ... GROUP BY``, ``bundle_agg`` and ``bind_agg`` the
same as Columns: an aggregate for each element, for vectors of up to some hundred elements. ``bundle_groups``
and ``bind_groups`` take vectors of any size, in blocks of ``BLOCK`` elements, or element by element for BSC bundles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.architectures import BSC, HRR, MAP, VTB, Architecture
from hyperloom.functions import vectors

#: Elements of a block: with more than 100 fields Spark gives up whole-stage code generation.
BLOCK = 64
#: A turn of a phase in integer units: sums of up to 2^32 rows are exact, whatever their order.
TURN = 1 << 32


def _array(vec: str, size: int, element: Callable[[int], str]) -> str:
    """An array of aggregates; null for a group without vectors."""
    return f"CASE WHEN count({vec}) > 0 THEN array({', '.join(element(i) for i in range(size))}) END"


def bundle_sql(arch: Architecture, vec: str, size: int, *, tie: str | None = None, order: str | None = None) -> str:
    """SQL for the unnormalized bundle of the vectors ``vec`` of a group, nulls skipped.

    BSC: for each element the bit of the last row by ``order`` whose bit in ``tie`` (an array, as
    ``vectors.tie_bits`` makes) is its own bit; where none is, the bit of the first row, of first rows that
    share their order the least bit. Rows that share an order must share their ``tie``.
    """
    if arch.kind != BSC:
        return _array(vec, size, lambda i: f"sum(get({vec}, {i}))")
    if tie is None or order is None:
        raise ValueError("BSC bundles need tie bits and an order")

    def last(i: int) -> str:
        x = f"get({vec}, {i})"
        agrees = f"{x} = get({tie}, {i})"
        return f"coalesce(max_by({x}, CASE WHEN {agrees} THEN struct({order}) END), min_by({x}, CASE WHEN {x} IS NOT NULL THEN struct({order}, {x}) END))"

    return _array(vec, size, last)


def bind_sql(arch: Architecture, vec: str, size: int) -> str:
    """SQL for the product of the normalized vectors ``vec`` of a group, for BSC and MAP; nulls are skipped."""
    if arch.kind == BSC:
        return _array(vec, size, lambda i: f"bit_xor(get({vec}, {i}))")
    if arch.kind == MAP:
        return _array(vec, size, lambda i: f"CAST(1 - 2 * (count_if(get({vec}, {i}) < 0) % 2) AS TINYINT)")
    raise ValueError("products of real vectors are no sums of elements: see bind_groups")


def bundle_agg(arch: Architecture, vec: str, size: int, *, tie: str | None = None, order: str | None = None) -> Column:
    """``bundle_sql`` as a Column."""
    return F.expr(bundle_sql(arch, vec, size, tie=tie, order=order))


def bind_agg(arch: Architecture, vec: str, size: int) -> Column:
    """``bind_sql`` as a Column."""
    return F.expr(bind_sql(arch, vec, size))


def bundle_groups(
    df: DataFrame, keys: list[str], vec: str, arch: Architecture, size: int, *, order_by: str | None = None, normalized: bool = False
) -> DataFrame:
    """``keys..., vec``: the bundle of each group's vectors of ``size`` elements; null vectors are skipped, a
    group without others has null. Another size raises an error when the row is read.

    BSC needs ``order_by``; tie bits are named by its values, as in ``Subset.bundle_dataset``.
    """
    if arch.kind == BSC and order_by is None:
        raise ValueError("this fold depends on the order of rows: name a column in order_by")
    if arch.kind == BSC:
        return _last_agreeing(df, keys, vec, arch, size, order_by)
    found = _blockwise(df, keys, {"v": _checked(vec, size)}, size, bundle_agg(arch, "_v", BLOCK), vec)
    return found.withColumn(vec, vectors.normalize(arch, F.col(f"`{vec}`"))) if normalized else found


def _last_agreeing(df: DataFrame, keys: list[str], vec: str, arch: Architecture, size: int, order_by: str) -> DataFrame:
    """Bundles of BSC, aggregated by (keys, element): a few plain aggregates keep to generated code, where
    some for each of a block's elements would not. Tasks send one row for each group and element that they have.

    Rows that share an order share their tie bits, so where none agrees, first rows of one order have equal bits.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    tie = vectors.tie_bits(arch, size, F.lit("row"), F.coalesce(F.col(f"`{order_by}`").cast("string"), F.lit("None")))
    there = F.col(f"`{vec}`").isNotNull()
    rows = df.select(
        *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, named, strict=True)],
        F.when(there, F.col(f"`{order_by}`")).alias("_o"),
        F.posexplode_outer(F.when(there, F.arrays_zip(_checked(vec, size).alias("x"), tie.alias("t")))).alias("_dim", "_e"),
    )
    rows = rows.select(*named, "_o", "_dim", F.col("_e.x").alias("_x"), (F.col("_e.x") == F.col("_e.t")).alias("_agrees"))
    known, unordered = F.col("_x").isNotNull(), F.col("_o").isNull()
    bit = F.coalesce(
        F.max_by("_x", F.when(F.col("_agrees"), F.col("_o"))),
        # Null is the first of all orders.
        F.max(F.when(F.col("_agrees") & unordered, F.col("_x"))),
        F.min(F.when(unordered, F.col("_x"))),
        F.min_by("_x", F.when(known, F.col("_o"))),
    )
    bits = rows.groupBy(*named, "_dim").agg(bit.alias("_bit"))
    whole = bits.groupBy(*named).agg(F.sort_array(F.collect_list(F.when(F.col("_dim").isNotNull(), F.struct("_dim", "_bit")))).alias("_all"))
    made = F.when(F.size("_all") > 0, F.col("_all._bit"))
    return whole.select(*[F.col(n).alias(k) for k, n in zip(keys, named, strict=True)], made.alias(vec))


def bind_groups(df: DataFrame, keys: list[str], vec: str, arch: Architecture, size: int) -> DataFrame:
    """``keys..., vec``: the product of each group's normalized vectors; nulls as in ``bundle_groups``.

    HRR's spectra multiply: logarithms of magnitudes and turns of phases are added up, and a product beyond the
    range of doubles has unit length. VTB's product depends on the order of rows: ``Subset`` folds it.
    """
    if arch.kind == VTB:
        raise ValueError("a VTB product depends on the order of rows: fold it with Subset.bind_dataset")
    if arch.kind != HRR:
        return _blockwise(df, keys, {"v": _checked(vec, size)}, size, bind_agg(arch, "_v", BLOCK), vec)
    half = size // 2 + 1

    @F.pandas_udf("v array<double>, t array<bigint>")
    def spectrum(rows: pd.Series) -> pd.DataFrame:
        there = rows.notna().to_numpy()
        logs, turns = np.full(len(rows), None, object), np.full(len(rows), None, object)
        if there.any():
            found = np.fft.rfft(np.stack(rows[there].to_list()).astype(np.float64))
            with np.errstate(divide="ignore"):
                parts = np.maximum(np.log(np.abs(found)), -1e300)
            whole = np.rint(np.angle(found) / (2 * np.pi) * TURN).astype(np.int64)
            for at, a, b in zip(np.flatnonzero(there), parts, whole, strict=True):
                logs[at], turns[at] = a, b
        return pd.DataFrame({"v": logs, "t": turns})

    @F.pandas_udf("array<double>")
    def back(logs: pd.Series, turns: pd.Series) -> pd.Series:
        out = np.full(len(logs), None, object)
        for i, (a, b) in enumerate(zip(logs, turns, strict=True)):
            if a is not None:
                top = max(float(np.max(a)), -1e305)
                values = np.fft.irfft(np.exp(a - top) * np.exp(2j * np.pi * (np.asarray(b) % TURN) / TURN), size)
                norm = np.sqrt((values * values).sum())
                # Spectra that are zero everywhere have top near -1e300: their product is zero.
                out[i] = np.zeros(size) if top < -1e299 else values * np.exp(top) if norm == 0 or abs(np.log(norm) + top) < 700 else values / norm
        return pd.Series(out)

    parts = df.select(*[F.col(f"`{k}`") for k in keys], spectrum(_checked(vec, size)).alias("_s"))
    sums = F.struct(F.expr(_array("_v", BLOCK, lambda i: f"sum(get(_v, {i}))")).alias("v"), F.expr(_array("_t", BLOCK, lambda i: f"sum(get(_t, {i}))")).alias("t"))
    found = _blockwise(parts, keys, {"v": F.col("_s.v"), "t": F.col("_s.t")}, half, sums, "_s", fields=("v", "t"))
    return found.select(*[F.col(f"`{k}`") for k in keys], back(F.col("_s.v"), F.col("_s.t")).alias(vec))


def _checked(vec: str, size: int) -> Column:
    column = F.col(f"`{vec}`")
    wrong = F.raise_error(F.concat(F.lit(f"a vector has not {size} elements but "), F.size(column).cast("string")))
    return F.when(column.isNull() | (F.size(column) == size), column).otherwise(wrong)


def _blockwise(
    df: DataFrame, keys: list[str], arrays: dict[str, Column], size: int, made: Column, name: str, fields: tuple[str, ...] = ()
) -> DataFrame:
    """Rows as blocks of their ``arrays``, aggregated by (keys, block), and each group's blocks put together.

    Tasks send one row for each group and block that they have, a group's last step gets size / BLOCK rows.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, named, strict=True)],
        *[c.alias(f"_{a}") for a, c in arrays.items()],
    )
    starts = F.sequence(F.lit(0), F.lit((size - 1) // BLOCK))
    cut = lambda b: F.struct(b.alias("b"), *[F.slice(f"_{a}", b * BLOCK + 1, F.lit(BLOCK)).alias(a) for a in arrays])
    rows = rows.select(*named, F.explode(F.transform(starts, cut)).alias("_x")).select(*named, F.col("_x.b").alias("_b"), *[F.col(f"_x.{a}").alias(f"_{a}") for a in arrays])
    sums = rows.groupBy(*named, "_b").agg(made.alias("_p"))
    whole = sums.groupBy(*named).agg(F.sort_array(F.collect_list(F.struct("_b", "_p"))).alias("_all"))

    def joined(path: str) -> Column:
        parts = F.col(f"_all._p{path}")
        return F.when(parts[0].isNotNull(), F.slice(F.flatten(parts), 1, size))

    out = F.struct(*[joined(f".{f}").alias(f) for f in fields]) if fields else joined("")
    return whole.select(*[F.col(n).alias(k) for k, n in zip(keys, named, strict=True)], out.alias(name))
