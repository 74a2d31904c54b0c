"""Symbols as Column expressions: vectors are MD5 digits of (seed, name, block)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hyperloom.architectures import Architecture

#: A digest has 32 hexadecimal digits: bits of 128 elements, or four numbers of 32 bits.
BITS_A_BLOCK = 128
REALS_A_BLOCK = 4


def digest(prefix: str, name: Column, block: Column) -> Column:
    return F.md5(F.concat(F.lit(prefix), name, F.lit("|"), block.cast("string")).cast("binary"))


def bit(hexdigits: Column, at: Column) -> Column:
    """Bit ``at`` (0 to 127) of a digest: four bits a digit, the lowest first."""
    digit = F.conv(F.substring(hexdigits, (at / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    return digit.bitwiseAND(F.pow(F.lit(2), at % 4).cast("int")) > 0


def bits(prefix: str, name: Column, size: int) -> Column:
    """The bits of all elements as an array of bigint: a digest is made once for each block, and read as four words."""
    # Where the bits of a word's eight digits stand, the lowest bit of each digit first.
    places = F.array(*[F.lit(28 - 4 * (d // 4) + d % 4) for d in range(32)])

    def of_word(word: Column) -> Column:
        return F.transform(places, lambda p: F.call_function("shiftright", word, p).bitwiseAND(F.lit(1).cast("bigint")))

    def of_block(hexdigits: Column) -> Column:
        words = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda w: F.conv(F.substring(hexdigits, w * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))
        return F.flatten(F.transform(words, of_word))

    blocks = F.transform(F.sequence(F.lit(0), F.lit((size - 1) // BITS_A_BLOCK)), lambda b: digest(prefix, name, b))
    return F.slice(F.flatten(F.transform(blocks, of_block)), 1, size)


def element(arch: Architecture, name: Column, dim: Column) -> Column:
    """Element ``dim`` of a symbol's vector before scaling: 0/1, -1/+1, or a number in [-1, 1)."""
    if arch.real:
        hexdigits = digest(arch.key, name, (dim / REALS_A_BLOCK).cast("int"))
        part = F.substring(hexdigits, (dim % REALS_A_BLOCK) * 8 + 1, F.lit(8))
        return F.conv(part, 16, 10).cast("double") * F.lit(2.0**-31) - F.lit(1.0)
    hexdigits = digest(arch.key, name, (dim / BITS_A_BLOCK).cast("int"))
    one = bit(hexdigits, dim % BITS_A_BLOCK)
    return F.when(one, 1).otherwise(0 if arch.kind == "bsc" else -1).cast("int")


def dims(size: int) -> Column:
    """All dimensions as an array."""
    return F.sequence(F.lit(0), F.lit(size - 1))


def symbol(arch: Architecture, name: Column, size: int) -> Column:
    """The vector of a symbol as an array; for a few rows. Many symbols are cheaper in tasks (``kernels``)."""
    if not arch.real:
        low = 0 if arch.kind == "bsc" else -1
        return F.transform(bits(arch.key, name, size), lambda b: F.when(b == 1, 1).otherwise(low)).cast(f"array<{arch.element()}>")
    raw = F.transform(dims(size), lambda d: element(arch, name, d))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(raw, lambda x: x / norm)
