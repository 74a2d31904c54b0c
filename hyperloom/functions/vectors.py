"""Vector algebra on array columns.

BSC and MAP, and whatever is elementwise, are built-in functions. Convolution (HRR) and matrix
products (VTB) are NumPy kernels over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hyperloom.architectures import BSC, HRR, MAP, VTB, Architecture
from hyperloom.functions import kernels, symbols


def permute(vec: Column, shifts: int | Column) -> Column:
    """Rotated right by ``shifts``: element i goes to (i + shifts) mod size. An empty vector stays."""
    n = F.size(vec)
    s = F.pmod(F.lit(shifts) if isinstance(shifts, int) else shifts, F.greatest(n, F.lit(1)))
    return F.when(s == 0, vec).otherwise(F.concat(F.slice(vec, n - s + 1, s), F.slice(vec, F.lit(1), n - s)))


def bind(arch: Architecture, left: Column, right: Column) -> Column:
    """``left * right`` of normalized vectors. VTB: the order matters."""
    if arch.kind == BSC:
        return F.zip_with(left, right, lambda a, b: a.bitwiseXOR(b))
    if arch.kind == MAP:
        return F.zip_with(left, right, lambda a, b: (a * b).cast("tinyint"))
    return _bind_real(arch.kind)(left, right)


def bind_accumulator(arch: Architecture, acc: Column, vec: Column) -> Column:
    """An accumulator times a normalized vector, whichever stood left: the accumulator comes first."""
    if arch.kind == MAP:
        return F.zip_with(acc, vec, lambda a, b: a.cast("bigint") * b.cast("bigint"))
    return bind(arch, acc, vec)


def _bind_real(kind: str):
    """Pairs of a batch are bound as matrices, one for each size; null where a side is."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(a)
        sizes: dict[tuple[int, int], list[int]] = {}
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            if x is not None and y is not None:
                sizes.setdefault((len(x), len(y)), []).append(i)
        for at in sizes.values():
            for i, vec in zip(at, kernels.bind(kind, np.stack(a.iloc[at].to_list()), np.stack(b.iloc[at].to_list())), strict=True):
                out[i] = vec
        return pd.Series(out, dtype=object)

    return run


def bundle(arch: Architecture, acc: Column, vec: Column, tie: Column | None = None) -> Column:
    """``acc + vec``; BSC keeps agreeing bits and takes the others from ``tie``, an array of bits."""
    if arch.kind == BSC:
        if tie is None:
            raise ValueError("BSC bundles need tie bits")
        both = F.arrays_zip(acc.alias("a"), vec.alias("v"), tie.alias("t"))
        return F.transform(both, lambda x: F.when(x["a"] == x["v"], x["a"]).otherwise(x["t"]))
    if arch.kind == MAP:
        return F.zip_with(acc, vec, lambda a, b: a.cast("bigint") + b.cast("bigint"))
    return F.zip_with(acc, vec, lambda a, b: a + b)


def tie_bits(arch: Architecture, size: int, *keys: Column) -> Column:
    """The bits that settle disagreements of one bundling step, named by ``keys``."""
    name = F.concat_ws("|", F.lit("tie"), *[k.cast("string") for k in keys])
    return symbols.bits(arch.key, name, size).cast("array<tinyint>")


def normalize(arch: Architecture, acc: Column) -> Column:
    """BSC: itself. MAP: signs, zero counts as +1. HRR, VTB: unit length, a zero vector stays."""
    if arch.kind == BSC:
        return acc
    if arch.kind == MAP:
        return F.transform(acc, lambda v: F.when(v >= 0, 1).otherwise(-1).cast("tinyint"))
    norm = F.sqrt(F.aggregate(acc, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(acc, lambda v: F.when(norm == 0, v).otherwise(v / norm))


def denormalize(arch: Architecture, vec: Column) -> Column:
    """A normalized vector as an accumulator."""
    return vec.cast(f"array<{arch.element(False)}>")


def similarity(arch: Architecture, a: Column, b: Column) -> Column:
    """BSC, MAP: (agreeing - differing) / size. HRR, VTB: cosine, 0 if either is zero."""
    if arch.kind in (BSC, MAP):
        same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(-1)), F.lit(0), lambda s, v: s + v)
        return same / F.size(a)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def inverse(arch: Architecture, vec: Column) -> Column:
    """HRR: involution; VTB: transpose. BSC and MAP have none: they are their own inverse."""
    n = F.size(vec)
    if arch.kind == HRR:
        return F.concat(F.slice(vec, 1, 1), F.reverse(F.slice(vec, F.lit(2), F.greatest(n - 1, F.lit(0)))))
    if arch.kind == VTB:
        d = F.sqrt(n).cast("int")
        return F.transform(vec, lambda _, k: F.element_at(vec, (k % d) * d + (k / d).cast("int") + 1))
    raise TypeError(f"{arch.name} vectors are their own inverse")


def parse(arch: Architecture, numbers: Column, size: int | None = None) -> Column:
    """Numbers as a normalized vector: BSC v >= 0.5, MAP v >= 0, else as they are; null if ``size`` doesn't fit."""
    limit = {BSC: 0.5, MAP: 0.0}.get(arch.kind)
    if limit is None:
        out = numbers.cast("array<double>")
    else:
        low = 0 if arch.kind == BSC else -1
        out = F.transform(numbers, lambda v: F.when(v >= limit, 1).otherwise(low).cast("tinyint"))
    n = F.size(numbers)
    fits = n > 0 if size is None else n == size
    if arch.kind == VTB:
        fits = fits & (F.pow(F.floor(F.sqrt(n)), 2) == n)
    if size is not None and not arch.valid_size(size):
        fits = F.lit(False)
    return F.when(fits, out)


def serialize(arch: Architecture, vec: Column, normalized: bool = True) -> Column:
    """Elements as doubles; normalized MAP vectors as 1 and 0, not as 1 and -1."""
    if arch.kind == MAP and normalized:
        return F.transform(vec, lambda v: ((v + 1) / 2).cast("double"))
    return vec.cast("array<double>")


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once, however often the functions within ask for it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def pack(vec: Column) -> Column:
    """A BSC or MAP vector as 64-bit words, lowest bit first; the last word is filled up with zeros."""
    word = lambda part: F.aggregate(
        part,
        F.struct(F.lit(0).cast("bigint").alias("bits"), F.lit(0).alias("i")),
        lambda acc, v: F.struct(
            acc["bits"].bitwiseOR(F.call_function("shiftleft", (v > 0).cast("bigint"), acc["i"])).alias("bits"), (acc["i"] + 1).alias("i")
        ),
        lambda acc: acc["bits"],
    )
    words = lambda v: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / 64).cast("int") - 1), lambda w: word(F.slice(v, w * 64 + 1, 64)))
    return once(vec, words)


def packed_similarity(a: Column, b: Column, size: int) -> Column:
    """Similarity of packed vectors by counting differing bits."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return (F.lit(size) - 2 * differ) / F.lit(size)


def equal(a: Column, b: Column) -> Column:
    """Same size and elements."""
    return a == b


