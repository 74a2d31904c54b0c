"""BSC and MAP vectors as 64-bit words, one bit for each element: bind, permute and true majority.

Words are ``array<bigint>``, lowest bit first, a bit for 1 (BSC) or +1 (MAP); bits beyond the size are
zero. Bind and permute are built-in functions on words. The majority of many vectors is counted in
bit-sliced columns: plane i holds bit i of every element's count, so a word operation counts 64
elements, and two sets of planes are merged by a full adder.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.architectures import BSC, MAP, Architecture
from hyperloom.functions.vectors import once, pack

#: Words of planes that a task holds before it sends them, and partial counts that one task merges.
HELD_WORDS = 1 << 22
FAN_IN = 64


def _shift(name: str, word: Column, by: Column) -> Column:
    return F.call_function(name, word, by.cast("int"))


def _masked(words: Column, size: int) -> Column:
    """``words`` with zeros beyond ``size``."""
    if size % 64 == 0:
        return words
    mask, last = F.lit((1 << (size % 64)) - 1).cast("bigint"), size // 64
    return F.transform(words, lambda x, i: F.when(i == last, x.bitwiseAND(mask)).otherwise(x))


def bind(arch: Architecture, left: Column, right: Column, size: int) -> Column:
    """BSC: the bits that differ. MAP: the bits that agree, since a bit is +1."""
    differ = F.zip_with(left, right, lambda a, b: a.bitwiseXOR(b))
    if arch.kind == BSC:
        return differ
    if arch.kind == MAP:
        return _masked(F.transform(differ, F.bitwise_not), size)
    raise TypeError(f"{arch.name} vectors have no bits")


def permute(words: Column, shifts: int, size: int) -> Column:
    """Rotated right by ``shifts`` elements, across words: bit i goes to (i + shifts) mod size."""
    shifts %= size
    return once(words, lambda w: _permuted(w, shifts, size)) if shifts else words


def _permuted(words: Column, shifts: int, size: int) -> Column:
    def from_bit(at: Column) -> Column:
        """64 bits from bit ``at`` on, zeros beyond the end."""
        word, inside = (at / 64).cast("int"), at % 64
        low = _shift("shiftrightunsigned", F.coalesce(F.get(words, word), F.lit(0).cast("bigint")), inside)
        high = _shift("shiftleft", F.coalesce(F.get(words, word + 1), F.lit(0).cast("bigint")), 64 - inside)
        return F.when(inside == 0, low).otherwise(low.bitwiseOR(high))

    def out(w: Column) -> Column:
        at = F.pmod(w * 64 - shifts, F.lit(size))
        left = F.lit(size) - at
        head = from_bit(at)
        return F.when(left >= 64, head).otherwise(head.bitwiseOR(_shift("shiftleft", from_bit(F.lit(0)), left)))

    moved = F.transform(F.sequence(F.lit(0), F.lit((size - 1) // 64)), out)
    return F.when(words.isNotNull(), _masked(moved, size))


def unpack(arch: Architecture, words: Column, size: int) -> Column:
    """The array of elements."""
    return once(words, lambda w: _unpacked(arch, w, size))


def _unpacked(arch: Architecture, words: Column, size: int) -> Column:
    low = 0 if arch.kind == BSC else -1
    bit = lambda d: _shift("shiftrightunsigned", F.get(words, (d / 64).cast("int")), d % 64).bitwiseAND(F.lit(1).cast("bigint"))
    found = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: F.when(bit(d) == 1, 1).otherwise(low).cast("tinyint"))
    return F.when(words.isNotNull(), found)


@dataclass
class Counts:
    """How many vectors there were, and for each element how many of them had its bit set, in planes."""

    n: int = 0
    planes: list[np.ndarray] = field(default_factory=list)

    def add(self, words: np.ndarray) -> None:
        """The rows of a matrix of words: three planes of one weight become one of it and one of the next."""
        self.n += len(words)
        level = 0
        waiting = [*words]
        while waiting:
            if level < len(self.planes):
                waiting.append(self.planes[level])
            carried = []
            while len(waiting) > 2:
                a, b, c = waiting.pop(), waiting.pop(), waiting.pop()
                half = a ^ b
                waiting.append(half ^ c)
                carried.append(a & b | half & c)
            if len(waiting) == 2:
                a, b = waiting
                waiting, carried = [a ^ b], [*carried, a & b]
            if level == len(self.planes):
                self.planes.append(waiting[0])
            else:
                self.planes[level] = waiting[0]
            waiting, level = [c for c in carried if c.any()], level + 1

    def merge(self, other: Counts) -> None:
        """Add the other's counts, plane by plane with carry."""
        self.n += other.n
        carry = None
        for k in range(max(len(self.planes), len(other.planes)) + 1):
            parts = [p[k] for p in (self.planes, other.planes) if k < len(p)] + ([carry] if carry is not None else [])
            if not parts:
                break
            total, carry = parts[0], None
            for p in parts[1:]:
                total, over = total ^ p, total & p
                carry = over if carry is None else carry | over
            if k == len(self.planes):
                self.planes.append(total)
            else:
                self.planes[k] = total
            carry = carry if carry is not None and carry.any() else None

    def majority(self) -> np.ndarray:
        """Words whose bits were set in at least half of the vectors: counts are compared from the highest plane down."""
        need = (self.n + 1) // 2
        width = len(self.planes[0])
        above, same = np.zeros(width, np.uint64), np.full(width, ~np.uint64(0))
        for k in range(max(len(self.planes), need.bit_length()) - 1, -1, -1):
            plane = self.planes[k] if k < len(self.planes) else np.zeros(width, np.uint64)
            if need >> k & 1:
                same = same & plane
            else:
                above, same = above | same & plane, same & ~plane
        return above | same


def majority(df: DataFrame, words_col: str, size: int, *, group_by: Sequence[str] = ()) -> DataFrame:
    """``group..., n, words``: for each group the bits that at least half of its vectors have set.

    Unlike the BSC bundle, which depends on the order of rows, every vector has one vote; a tie is 1 (as the
    MAP bundle's zero is +1). Tasks send a few planes of words for each group, which are merged
    FAN_IN at a time: a group of any size never meets in one task.

    Defined cases: null vectors have no vote; null keys are a group; a group of nulls only, and an
    empty table, give no rows; vectors of another size raise an error.
    """
    keys, names, width = list(group_by), [f"_g{i}" for i in range(len(group_by))], -(-size // 64)
    rows = df.where(F.col(words_col).isNotNull()).select(*[F.col(f"`{g}`").alias(n) for g, n in zip(keys, names, strict=True)], F.col(words_col).alias("_words"))
    schema = T.StructType([*rows.schema.fields[:-1]]).add("_part", "long").add("_n", "long").add("_planes", T.ArrayType(T.LongType()))

    def made(types: list[pa.DataType], found: dict[tuple, Counts], part: int) -> pa.RecordBatch:
        keyed = [pa.array([key[i] for key in found], t) for i, t in enumerate(types)]
        planes = [np.concatenate(c.planes).view(np.int64) for c in found.values()]
        return pa.RecordBatch.from_arrays([*keyed, pa.array([part] * len(found), pa.int64()), pa.array([c.n for c in found.values()], pa.int64()), pa.array(planes, pa.list_(pa.int64()))], schema.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Counts] = {}
        types: list[pa.DataType] = []
        part = 0
        for batch in batches:
            types, part = [batch.column(i).type for i in range(len(names))], batch.column(len(names) + 1)[0].as_py() if batch.num_rows else part
            words = batch.column(len(names))
            if (np.asarray(words.value_lengths()) != width).any():
                raise ValueError(f"packed vectors of {size} elements have {width} words")
            matrix = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width)
            at: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[batch.column(k).to_pylist() for k in range(len(names))], strict=True) if names else [()] * batch.num_rows):
                at.setdefault(key, []).append(i)
            for key, chosen in at.items():
                found.setdefault(key, Counts()).add(matrix[chosen])
            if len(found) * width * 16 > HELD_WORDS:
                yield made(types, found, part)
                found = {}
        if found:
            yield made(types, found, part)

    def merge(table: pa.Table) -> pa.Table:
        total = Counts()
        for n, planes in zip(table["_n"].to_pylist(), table["_planes"].to_pylist(), strict=True):
            total.merge(Counts(n, list(np.array(planes, np.int64).view(np.uint64).reshape(-1, width))))
        key = tuple(table[name][0].as_py() for name in names)
        return pa.Table.from_batches([made([table[name].type for name in names], {key: total}, table["_part"][0].as_py() // FAN_IN)])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = zip(batch.column(len(names) + 1).to_pylist(), batch.column(len(names) + 2).to_pylist(), strict=True)
            words = [Counts(n, list(np.array(p, np.int64).view(np.uint64).reshape(-1, width))).majority().view(np.int64) for n, p in counts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], batch.column(len(names) + 1), pa.array(words, pa.list_(pa.int64()))], out.names)

    found = rows.withColumn("_part", F.spark_partition_id().cast("long")).mapInArrow(count, schema)
    for _ in range(2):
        found = found.withColumn("_up", F.floor(F.col("_part") / FAN_IN)).groupBy(*names, "_up").applyInArrow(merge, schema)
    found = found.groupBy(*names).applyInArrow(merge, schema)
    out = T.StructType([T.StructField(g, f.dataType) for g, f in zip(keys, rows.schema.fields, strict=False)]).add("n", "long").add("words", T.ArrayType(T.LongType()))
    return found.mapInArrow(final, out)


__all__ = ["Counts", "bind", "majority", "pack", "permute", "unpack"]
