"""Folds over a table that is resolved against a codebook: each row, or all rows, as one vector.

Rows of an additive algebra (all but BSC) are counted by distinct cells or tuples first, within map
tasks and then by shuffle; only distinct ones are turned into vectors. Tasks send partial sums, one
row per dimension. BSC bundles take each dimension from the last row whose tie bit agrees with its
own bit: mostly the last few rows decide, and all rows are asked where these leave something open.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.architectures import BSC, HRR, MAP, VTB, ColumnNotFoundError, ColumnTypeMismatchError, ValueNotFoundError
from hyperloom.functions import kernels
from hyperloom.operators.codebook import Codebook, categories_of, holds_symbols
from hyperloom.operators.rows import ByColumn, ByPosition, Encoding, RowKernel, encoding_of
from hyperloom.plans.tables import BROADCAST_BYTES, broadcast_if_small, size_in_bytes, written

#: Last rows that a BSC bundle looks at first. Where their order values differ, a dimension is open after
#: them with probability 2^-256; what is open is decided by all rows.
TAIL_ROWS = 256
#: Elements of partial sums that a task holds before it sends them.
PARTIAL_ELEMENTS = 1 << 24
#: Segments of an ordered product that one task multiplies.
FAN_IN = 16


@dataclass(frozen=True)
class Subset:
    """``df`` against ``codebook``. ``order_by`` names a column outside the encoding that orders rows:
    BSC bundles and VTB products depend on it. Columns in ``group_by`` are not encoded either; folds
    then give one vector per group. ``enums`` declares categories of ``df``'s columns; a column of
    integers with categories holds codes, which are counted as they are. ``weight`` names a column of
    integers outside the encoding: in folds of whole tables a row counts that often, and not at all if
    it is null or less than one.
    """

    codebook: Codebook
    df: DataFrame
    order_by: str | None = None
    group_by: tuple[str, ...] = ()
    enums: dict[str, list[str]] | None = None
    weight: str | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (self.order_by, self.weight, *self.group_by)]

    @property
    def _counting(self) -> DataFrame:
        """The rows that count, with ``_n``: how often each does."""
        if self.weight is None:
            return self.df.withColumn("_n", F.lit(1).cast("long"))
        rows = self.df.withColumn("_n", F.col(f"`{self.weight}`").cast("long"))
        return rows.where(F.col("_n") >= 1)

    def validate(self) -> None:
        """Raise SubsetError unless columns, their kinds, and all values are known.

        Values are checked by one anti-join of the distinct ones against the codebook. The codebook's own
        table has no plain value that it lacks, so only declared categories are checked there.
        """
        if not self.columns:
            raise ValueError("a table without columns has no rows to encode")
        known = self.codebook.columns
        plain = []
        for name in self.columns:
            field = self.df.schema[name]
            if name not in known:
                raise ColumnNotFoundError(name)
            categories = categories_of(field, self.enums)
            if not holds_symbols(field, categories) or categories != known[name]:
                raise ColumnTypeMismatchError(name)
            plain.append((name, categories, isinstance(field.dataType, T.IntegralType)))
        source = self.codebook.source
        if source is not None and source.sameSemantics(self.df.select(*[F.col(f"`{c}`") for c in self.columns])):
            plain = [x for x in plain if x[1] is not None]
            if not plain:
                return
        structs = []
        for c, k, coded in plain:
            cell, bad = F.col(f"`{c}`"), F.lit(False)
            if coded:
                bad = ~cell.between(0, len(k) - 1)
                cell = F.when(bad, F.concat(F.lit("code "), cell.cast("string"))).otherwise(F.get(F.array(*map(F.lit, k)), F.when(~bad, cell).cast("int")))
            structs.append(F.struct(F.lit(c).alias("c"), cell.alias("name"), F.lit(k is not None).alias("e"), bad.alias("bad")))
        cells = self.df.select(F.explode(F.array(*structs)).alias("x")).where("x.name IS NOT NULL").select("x.*").distinct()
        allowed = [(c, v) for c, k, coded in plain if not coded for v in k or ()]
        coded = [c for c, _, coded in plain if coded]
        missing = cells.where("NOT e").join(self.codebook.names, "name", "left_anti").select("c", "name")
        if coded:
            missing = missing.union(cells.where("bad").select("c", "name"))
            cells = cells.where(~F.col("c").isin(coded))
        if allowed:
            listed = self.df.sparkSession.createDataFrame(allowed, "c string, name string")
            missing = missing.union(cells.where("e").select("c", "name").join(listed, ["c", "name"], "left_anti"))
        if (bad := missing.first()) is not None:
            raise ValueNotFoundError(bad["c"], bad["name"])

    # Rows

    def bundle_rows(self, *, encoding: str | Encoding = "column", normalized: bool = True) -> DataFrame:
        """``df`` with ``vector``: its cells bundled from left to right; null if it has none."""
        return self._rows(self._kernel("bundle", encoding, normalized))

    def bind_rows(self, *, encoding: str | Encoding = "column") -> DataFrame:
        """``df`` with ``vector``: its cells bound from left to right, not normalized again."""
        return self._rows(self._kernel("bind", encoding, True))

    def bundle_rows_combinatorial(self, ways: int) -> DataFrame:
        """``df`` with ``vector``: the unnormalized bundle of all products of up to ``ways`` of its cells."""
        return self._rows(self._kernel("combos", "column", False, ways))

    # Whole tables; each gives (group..., dim, value), no rows where there is no vector

    def bundle_dataset(self, *, encoding: str | Encoding = "column", rows_normalized: bool = True, normalized: bool = True) -> DataFrame:
        """Rows bundled, then bundled together."""
        kernel = self._kernel("bundle", encoding, rows_normalized)
        if self.codebook.arch.additive and not rows_normalized:
            return self._finish(self._cell_sums(kernel), normalized)
        return self._bundled(kernel, normalized)

    def bundle_dataset_combinatorial(self, ways: int) -> DataFrame:
        """The unnormalized bundle of all rows' products of up to ``ways`` cells."""
        return self._bundled(self._kernel("combos", "column", False, ways), False)

    def bundle_dataset_with_binding(self, *, encoding: str | Encoding = "column", normalized: bool = True) -> DataFrame:
        """Rows bound, then bundled together."""
        return self._bundled(self._kernel("bind", encoding, True), normalized)

    def bind_dataset(self, *, encoding: str | Encoding = "column") -> DataFrame:
        """Rows bundled and normalized, then bound together."""
        return self._bound(self._kernel("bundle", encoding, True))

    def bind_entire_dataset(self, *, encoding: str | Encoding = "column") -> DataFrame:
        """All cells bound, row by row."""
        return self._bound(self._kernel("bind", encoding, True))

    # How

    def _kernel(self, op: str, encoding: str | Encoding, normalized: bool, ways: int = 1) -> RowKernel:
        book = self.codebook
        ways = min(ways, len(self.columns))
        return RowKernel(book.arch, book.size, self.columns, encoding_of(encoding), op, normalized=normalized, ways=ways, codes=self._codes)

    @property
    def _codes(self) -> dict[int, tuple[str, ...]]:
        """Categories of the columns that hold codes, by position."""
        fields = [(k, self.df.schema[c]) for k, c in enumerate(self.columns)]
        coded = {k: categories_of(f, self.enums) for k, f in fields if isinstance(f.dataType, T.IntegralType)}
        return {k: c for k, c in coded.items() if c is not None}

    @property
    def _there(self) -> Column:
        """Whether a row has any cell."""
        return reduce(or_, [F.col(f"`{c}`").isNotNull() for c in self.columns])

    @property
    def _ordinal(self) -> Column:
        if self.order_by is None:
            raise ValueError("this fold depends on the order of rows: name a column in order_by")
        return F.col(f"`{self.order_by}`")

    def _element(self, kernel: RowKernel) -> T.DataType:
        kind = self.codebook.arch.kind
        if kind in (HRR, VTB):
            return T.DoubleType()
        return T.ByteType() if kind == BSC or kernel.normalized else T.LongType()

    def _rows(self, kernel: RowKernel) -> DataFrame:
        df, n = self.df, len(self.columns)
        draws = self.codebook.arch.kind == BSC and kernel.op != "bind"
        if not draws and (few := self._few_tuples()) is not None:
            return self._rows_by_tuple(few, kernel)
        ordinal = self._ordinal.cast("string") if draws else F.lit("")
        others = [F.col(f"`{c}`") for c in df.columns]
        rows = df.select(*others, *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(self.columns)], ordinal.alias("_o"))
        return self._vectors(rows, df, n, kernel, [*df.columns, "vector"])

    def _vectors(self, rows: DataFrame, kept: DataFrame, n: int, kernel: RowKernel, names: list[str]) -> DataFrame:
        """The columns ``kept``, which come first in ``rows``, with the vector of the ``n`` cells before the order (its last columns)."""
        element, size, keep = self._element(kernel), self.codebook.size, len(kept.columns)
        first = len(rows.columns) - n - 1
        np_type = {T.DoubleType(): np.float64, T.ByteType(): np.int8}.get(element, np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, kernel.step):
                    part = batch.slice(k, kernel.step)
                    acc, valid = kernel([part.column(first + i).to_pylist() for i in range(n)], part.column(first + n).to_pylist())
                    counts = np.append(0, np.cumsum(valid)).astype(np.int32) * size
                    flat = pa.array(acc[valid].astype(np_type).ravel())
                    vec = pa.ListArray.from_arrays(pa.array(counts), flat, mask=pa.array(~valid))
                    yield pa.RecordBatch.from_arrays([*part.columns[:keep], vec], names)

        return rows.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("vector", T.ArrayType(element))]))

    def _few_tuples(self) -> DataFrame | None:
        """The distinct tuples of cells if they may be broadcast with their vectors. An estimate, made in one scan
        without a shuffle of rows, comes first; the table that is returned is written and measured."""
        named = [F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(self.columns)]
        rows, vector = self.df.select(*named), self.codebook.size * 8
        width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in rows.columns), F.lit(0))
        kinds, mean = rows.agg(F.approx_count_distinct(F.xxhash64(*rows.columns)), F.avg(width)).first()
        if kinds * (vector + (mean or 0)) > BROADCAST_BYTES:
            return None
        tuples = written(rows.distinct(), "tuples")
        return tuples if size_in_bytes(tuples) + tuples.count() * vector <= BROADCAST_BYTES else None

    def _rows_by_tuple(self, tuples: DataFrame, kernel: RowKernel) -> DataFrame:
        """Vectors of distinct tuples, joined with the rows: no vector is made twice, nor sent to Python and back."""
        n, names = len(self.columns), [*tuples.columns, "vector"]
        vectors = self._vectors(tuples.select("*", F.lit("").alias("_o")), tuples, n, kernel, names)
        same = F.lit(True)
        for k, c in enumerate(self.columns):
            same = same & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r._c{k}"))
        joined = self.df.alias("l").join(F.broadcast(vectors).alias("r"), same)
        return joined.select(*[F.col(f"l.`{c}`") for c in self.df.columns], F.col("r.vector").alias("vector"))

    def _cell_sums(self, kernel: RowKernel) -> DataFrame:
        """Sums over cells: one vector for each distinct cell, times how often it occurs."""
        text, code = F.lit(None).cast("string"), F.lit(None).cast("long")
        pairs = [(text, F.col(f"`{c}`").cast("long")) if k in self._codes else (F.col(f"`{c}`"), code) for k, c in enumerate(self.columns)]
        cells = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v"), i.alias("i")) for k, (v, i) in enumerate(pairs)])
        groups = [F.col(f"`{g}`") for g in self.group_by]
        counted = self._counting.select(*groups, "_n", F.explode(cells).alias("x")).where("x.v IS NOT NULL OR x.i IS NOT NULL")
        counted = counted.groupBy(*groups, *[F.col(f"x.{c}").alias(f"_{c}") for c in "kvi"]).agg(F.sum("_n").alias("_n"))

        return self._sums(counted, self._cell_vector(kernel), 3, kernel)

    def _cell_vector(self, kernel: RowKernel):
        def vector(rows: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
            cells = zip(*[rows.column(at + i).to_pylist() for i in range(3)], strict=True)
            return np.stack([kernel.cell(k, code if text is None else text) for k, text, code in cells]), np.ones(rows.num_rows, bool)

        return vector

    def _tuples(self) -> DataFrame:
        """Distinct tuples of cells with their counts, those without cells left out."""
        groups = [F.col(f"`{g}`") for g in self.group_by]
        named = [F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(self.columns)]
        rows = self._counting.where(self._there).select(*groups, *named, "_n")
        return rows.groupBy(*rows.columns[:-1]).agg(F.sum("_n").alias("_n"))

    def _sums(self, counted: DataFrame, vector, width: int, kernel: RowKernel, parity: bool = False, add=None) -> DataFrame:
        """``group..., dim, value``: sums of count times vector (with ``parity``: counts of odd ones).

        ``add`` may take the place of that sum: it gets counts, vectors and the sum so far, or None.
        """
        keys, real, size, bsc = len(self.group_by), self.codebook.arch.real, self.codebook.size, self.codebook.arch.kind == BSC
        schema = T.StructType([counted.schema[g] for g in self.group_by])
        schema = schema.add("dim", "integer").add("value", "double" if real else "long")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, np.ndarray] = {}
            types: list[pa.DataType] = []

            def flush() -> Iterator[pa.RecordBatch]:
                for key, total in sums.items():
                    columns = [pa.array([k] * size, t) for k, t in zip(key, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], schema.names)
                sums.clear()

            for batch in batches:
                types = [batch.schema.field(i).type for i in range(keys)]
                for start in range(0, batch.num_rows, kernel.step):
                    part = batch.slice(start, kernel.step)
                    acc, valid = vector(part, keys)
                    n = part.column(keys + width).to_numpy(zero_copy_only=False)
                    if parity:
                        acc, n = (acc if bsc else acc < 0), n % 2
                    weights = np.where(valid, n, 0)
                    names = list(zip(*[part.column(i).to_pylist() for i in range(keys)], strict=True)) if keys else [()] * part.num_rows
                    members: dict[tuple, list[int]] = {}
                    for i in np.flatnonzero(valid):
                        members.setdefault(names[i], []).append(i)
                    for key, at in members.items():
                        chosen = acc[at] if len(at) < part.num_rows else acc
                        if add is not None:
                            sums[key] = add(weights[at], chosen, sums.get(key))
                            continue
                        total = weights[at].astype(np.float64 if real else np.int64) @ chosen.astype(np.float64 if real else np.int64)
                        sums[key] = sums[key] + total if key in sums else total
                    if len(sums) * size > PARTIAL_ELEMENTS:
                        yield from flush()
            yield from flush()

        partial = counted.mapInArrow(run, schema)
        total = F.sum("value").cast("double" if real else "long")
        return partial.groupBy(*[F.col(f"`{g}`") for g in self.group_by], "dim").agg(total.alias("value"))

    def _tuple_vector(self, kernel: RowKernel):
        n = len(self.columns)

        def vector(rows: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
            return kernel([rows.column(at + i).to_pylist() for i in range(n)], [""] * rows.num_rows)

        return vector

    def _bundled(self, kernel: RowKernel, normalized: bool) -> DataFrame:
        if not self.codebook.arch.additive:
            return self._last_writers(kernel)
        return self._finish(self._sums(self._tuples(), self._tuple_vector(kernel), len(self.columns), kernel), normalized)

    def _finish(self, sums: DataFrame, normalized: bool) -> DataFrame:
        """Accumulators as they are, or normalized."""
        if not normalized:
            return sums
        if self.codebook.arch.kind == MAP:
            return sums.withColumn("value", F.when(F.col("value") >= 0, 1).otherwise(-1).cast("long"))
        # One vector for each group: at most ``size`` rows.
        norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(*[F.col(f"`{g}`") for g in self.group_by])))
        return sums.withColumn("value", F.when(norm > 0, F.col("value") / norm).otherwise(F.col("value")))

    def _ordered(self) -> DataFrame:
        named = [F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(self.columns)]
        groups = [F.col(f"`{g}`") for g in self.group_by]
        return self._counting.where(self._there).select(*groups, *named, self._ordinal.alias("_o"), "_n")

    def _last_writers(self, kernel: RowKernel) -> DataFrame:
        """BSC: for each dimension the bit of the last row whose tie bit is its own bit, else of the first row.

        Tie bits follow the value of ``order_by``: rows that share it draw the same ones, so whichever
        of them agrees gives the same bit. Of first rows that share it the least by its cells counts.
        The last ``TAIL_ROWS`` rows (of each group) come from a top-k, so the table is scanned once and
        few rows are turned into vectors. Only groups with dimensions left open go through all rows.
        """
        rows, keys = self._ordered().drop("_n").withColumn("_key", F.to_json(F.struct(*[f"_c{k}" for k in range(len(self.columns))]))), len(self.group_by)
        groups = [F.col(f"`{g}`") for g in self.group_by]
        if groups:
            window = Window.partitionBy(*groups).orderBy(F.desc("_o"), F.desc("_key"))
            last = rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= TAIL_ROWS).drop("_rank")
        else:
            last = rows.orderBy(F.desc("_o"), F.desc("_key")).limit(TAIL_ROWS)
        base = T.StructType([rows.schema[g] for g in self.group_by]).add("dim", "integer").add("value", "long")
        size, n, arch = self.codebook.size, len(self.columns), self.codebook.arch

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("_o", "descending"), ("_key", "descending")])
            texts = table["_text"].to_pylist()
            acc, _ = kernel([table[f"_c{i}"].to_pylist() for i in range(n)], texts)
            out, open_ = acc[-1].astype(np.int64), np.ones(size, bool)
            for row, text in zip(acc, texts, strict=True):
                takes = open_ & (kernels.tie(arch, size, "row", text) == row)
                out[takes] = row[takes]
                open_ &= ~takes
                if not open_.any():
                    break
            columns = [pa.array([table.column(i)[0].as_py()] * size, table.column(i).type) for i in range(keys)]
            left = open_ & (len(texts) == TAIL_ROWS)
            return pa.table([*columns, pa.array(np.arange(size, dtype=np.int32)), pa.array(out), pa.array(left)], [*base.names, "_open"])

        text = F.col("_o").cast("string").alias("_text")
        schema = T.StructType([*base.fields, T.StructField("_open", T.BooleanType())])
        found = written(last.select("*", text).groupBy(*groups).applyInArrow(run, schema), "last-rows")
        unsure = found.where("_open").select(*groups, F.lit(1).alias("_one")).distinct()
        if unsure.isEmpty():
            return found.drop("_open")
        same = F.lit(True)
        for g in self.group_by:
            same = same & rows[g].eqNullSafe(unsure[g])
        asked = rows.join(broadcast_if_small(unsure), same, "left_semi") if groups else rows
        decided = self._by_all_rows(asked.distinct().select("*", text), kernel, base)
        closed = found.where("NOT _open").drop("_open")
        names = [*self.group_by, "dim"]
        fill = decided.alias("d").join(closed.alias("c"), [F.col(f"d.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in names], "left_anti")
        return closed.union(fill.select(*closed.columns))

    def _by_all_rows(self, rows: DataFrame, kernel: RowKernel, base: T.StructType) -> DataFrame:
        """What ``_last_writers`` gives, from all of ``rows``: each task finds the last row that agrees, for
        each dimension, and its first row; the last and the first of these count."""
        size, n, keys, arch = self.codebook.size, len(self.columns), len(self.group_by), self.codebook.arch
        order = T.StructType([rows.schema["_o"], rows.schema["_key"]])
        schema = T.StructType([*base.fields, *order.fields, T.StructField("_agrees", T.BooleanType())])

        def vectors(part: pa.RecordBatch) -> np.ndarray:
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            return kernel([columns[f"_c{i}"].to_pylist() for i in range(n)], columns["_text"].to_pylist())[0]

        def piece(row: pa.RecordBatch, dims: np.ndarray, vec: np.ndarray, agrees: bool) -> pa.RecordBatch:
            at = pa.array(np.zeros(len(dims), np.int64))
            columns = dict(zip(row.schema.names, row.columns, strict=True))
            made = [pa.array(dims.astype(np.int32)), pa.array(vec[dims].astype(np.int64)), columns["_o"].take(at), columns["_key"].take(at)]
            return pa.RecordBatch.from_arrays([*[row.column(i).take(at) for i in range(keys)], *made, pa.array([agrees] * len(dims), pa.bool_())], schema.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, before, open_ = None, None, np.zeros(size, bool)
            for batch in batches:
                names = list(zip(*[batch.column(i).to_pylist() for i in range(keys)], strict=True)) if keys else [()] * batch.num_rows
                for start in range(0, batch.num_rows, kernel.step):
                    part = batch.slice(start, kernel.step)
                    if not open_.any() and names[start] == now and names[start + part.num_rows - 1] == now:
                        before = part.slice(part.num_rows - 1)
                        continue
                    texts = part.column(part.schema.get_field_index("_text")).to_pylist()
                    for i, vec in enumerate(vectors(part)):
                        if names[start + i] != now:
                            if before is not None:
                                yield piece(before, np.arange(size), vectors(before)[0], False)
                            now, open_ = names[start + i], np.ones(size, bool)
                        if open_.any():
                            takes = open_ & (kernels.tie(arch, size, "row", texts[i]) == vec)
                            if takes.any():
                                yield piece(part.slice(i, 1), np.flatnonzero(takes), vec, True)
                            open_ &= ~takes
                        before = part.slice(i, 1)
            if before is not None:
                yield piece(before, np.arange(size), vectors(before)[0], False)

        sorted_ = rows.sortWithinPartitions(*[F.col(f"`{g}`") for g in self.group_by], F.desc("_o"), F.desc("_key"))
        at = F.struct("_o", "_key")
        last = F.max_by(F.when(F.col("_agrees"), F.col("value")), F.when(F.col("_agrees"), at))
        first = F.min_by(F.when(~F.col("_agrees"), F.col("value")), F.when(~F.col("_agrees"), at))
        return sorted_.mapInArrow(run, schema).groupBy(*[F.col(f"`{g}`") for g in self.group_by], "dim").agg(F.coalesce(last, first).alias("value"))

    def _bound(self, kernel: RowKernel) -> DataFrame:
        kind = self.codebook.arch.kind
        if kind == VTB:
            return self._ordered_product(kernel)
        if kind == HRR:
            return self._spectral_product(kernel)
        if kind == BSC and kernel.op == "bundle":
            return self._parity_by_row(kernel)
        odd = self._sums(self._tuples(), self._tuple_vector(kernel), len(self.columns), kernel, parity=True)
        odd = odd.withColumn("value", F.col("value") % 2)
        return odd if kind == BSC else odd.withColumn("value", 1 - 2 * F.col("value"))

    def _parity_by_row(self, kernel: RowKernel) -> DataFrame:
        """BSC rows draw tie bits of their own, so equal tuples can't be counted together."""
        n = len(self.columns)
        rows = self._ordered().withColumn("_o", F.col("_o").cast("string"))

        def vector(part: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
            return kernel([part.column(at + i).to_pylist() for i in range(n)], part.column(at + n).to_pylist())

        odd = self._sums(rows, vector, n + 1, kernel, parity=True)
        return odd.withColumn("value", F.col("value") % 2)

    def _spectral_product(self, kernel: RowKernel) -> DataFrame:
        """HRR: spectra multiply, so logarithms of magnitudes and phases add up.

        Phases are kept as turns and reduced after every sum. A product beyond the range of doubles
        is given with unit length.
        """
        size, half, n = self.codebook.size, self.codebook.size // 2 + 1, len(self.columns)
        inner = self._tuple_vector(kernel)

        def vector(rows: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
            acc, valid = inner(rows, at)
            spectrum = np.fft.rfft(acc)
            with np.errstate(divide="ignore"):
                parts = np.concatenate([np.maximum(np.log(np.abs(spectrum)), -1e300), np.angle(spectrum) / (2 * np.pi)], axis=1)
            return parts, valid

        def add(counts: np.ndarray, parts: np.ndarray, total: np.ndarray | None) -> np.ndarray:
            out = np.zeros(2 * half) if total is None else total
            out[:half] += counts @ parts[:, :half]
            # A count is taken as high * 2^20 + low: turns times 2^20 lose no digit before they are reduced.
            high, low, turns = counts >> 20, counts & ((1 << 20) - 1), parts[:, half:]
            whole = np.remainder(turns * (1 << 20), 1.0) * high[:, None] + turns * low[:, None]
            out[half:] = np.remainder(out[half:] + np.remainder(whole, 1.0).sum(axis=0), 1.0)
            return out

        wide = Subset(Codebook(self.codebook.arch, 2 * half, self.codebook.names, self.codebook.columns), self.df, self.order_by, self.group_by, self.enums, self.weight)
        sums = wide._sums(self._tuples(), vector, n, kernel, add=add)
        schema = T.StructType([sums.schema[g] for g in self.group_by]).add("dim", "integer").add("value", "double")
        keys = len(self.group_by)

        def back(table: pa.Table) -> pa.Table:
            values = np.zeros(2 * half)
            values[table.column(keys).to_numpy()] = table.column(keys + 1).to_numpy()
            top = max(values[:half].max(), -1e305)
            out = np.fft.irfft(np.exp(values[:half] - top) * np.exp(2j * np.pi * np.remainder(values[half:], 1.0)), size)
            columns = [pa.array([table.column(i)[0].as_py()] * size, table.column(i).type) for i in range(keys)]
            return pa.table([*columns, pa.array(np.arange(size, dtype=np.int32)), pa.array(_in_range(out, top))], schema.names)

        return sums.groupBy(*[F.col(f"`{g}`") for g in self.group_by]).applyInArrow(back, schema)

    def _ordered_product(self, kernel: RowKernel) -> DataFrame:
        """VTB: the left fold is root(d)^(k-1) A1 A2' ... Ak', which any split into ordered segments gives.

        Rows are in the order of ``order_by``, then of their cells, nulls first. What is equal in both is
        one row with a count, raised to its power, so neither a hot order value nor many equal rows
        stay in one task. Range partitions over (group, order, cells) cut the rows into segments, each of
        one group; a segment has two matrices, for the case that it comes first and that it doesn't.
        Only the first and last segments of partitions can have neighbours: those are multiplied FAN_IN
        at a time. The logarithm of a matrix's largest element is carried apart from it. A product
        beyond the range of doubles is given with unit length.
        """
        size, n, keys = self.codebook.size, len(self.columns), len(self.group_by)
        d, names = math.isqrt(size), [f"_g{i}" for i in range(len(self.group_by))]
        rows = self._ordered()
        rows = rows.toDF(*names, *rows.columns[keys:])
        rows = rows.groupBy(*rows.columns[:-1]).agg(F.sum("_n").alias("_n"))
        parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        order = [*names, "_o", *[f"_c{k}" for k in range(n)]]
        rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_seg", F.spark_partition_id().cast("long")).drop("_o")
        groups = [T.StructField(name, self.df.schema[g].dataType) for name, g in zip(names, self.group_by, strict=True)]
        schema = T.StructType([*groups])
        for name, kind in (("_seg", "long"), ("_edge", "boolean"), ("_first", "array<double>"), ("_first_log", "double"), ("_rest", "array<double>"), ("_rest_log", "double")):
            schema = schema.add(name, T.ArrayType(T.DoubleType()) if kind.startswith("array") else kind)
        step = max(1, PARTIAL_ELEMENTS // (8 * size))

        def made(types: list[pa.DataType], found: list[tuple]) -> pa.RecordBatch:
            keyed = [pa.array([f[0][i] for f in found], t) for i, t in enumerate(types)]
            firsts, rests = ([f[k] for f in found] for k in (3, 4))
            arrays = [pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.bool_())]
            for side in (firsts, rests):
                arrays += [pa.array([m.ravel() for m, _ in side], pa.list_(pa.float64())), pa.array([log for _, log in side], pa.float64())]
            return pa.RecordBatch.from_arrays([*keyed, *arrays], schema.names)

        def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            types, done, now, seg, edge, both = [], [], None, 0, True, None
            for batch in batches:
                types = [batch.column(i).type for i in range(keys)]
                for start in range(0, batch.num_rows, kernel.step):
                    part = batch.slice(start, kernel.step)
                    acc, _ = kernel([part.column(keys + i).to_pylist() for i in range(n)], [""] * part.num_rows)
                    counts, seg = part.column(keys + n).to_numpy(), part.column(keys + n + 1)[0].as_py()
                    of = list(zip(*[part.column(i).to_pylist() for i in range(keys)], strict=True)) if keys else [()] * part.num_rows
                    cuts = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1]), len(of)]
                    for a, b in itertools.pairwise(cuts):
                        if both is not None and of[a] != now:
                            done.append((now, seg, edge, *both))
                            both, edge = None, False
                        now, both = of[a], _extended(both, acc[a:b].reshape(-1, d, d), counts[a:b])
                        if len(done) >= step:
                            yield made(types, done)
                            done = []
            if both is not None:
                yield made(types, [*done, (now, seg, True, *both)])

        def merge(table: pa.Table) -> pa.Table:
            table = table.sort_by("_seg")
            firsts, rests = ([(np.reshape(m, (d, d)), log) for m, log in zip(table[c].to_pylist(), table[f"{c}_log"].to_pylist(), strict=True)] for c in ("_first", "_rest"))
            first, rest = firsts[0], rests[0]
            for more in rests[1:]:
                first, rest = _product(first, more), _product(rest, more)
            key = tuple(table[name][0].as_py() for name in names)
            return pa.Table.from_batches([made([table[name].type for name in names], [(key, table["_seg"][0].as_py() // FAN_IN, True, first, rest)])])

        out = T.StructType([T.StructField(g, f.dataType) for g, f in zip(self.group_by, groups, strict=True)]).add("dim", "integer").add("value", "double")

        def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, (m, log) in enumerate(zip(batch.column(keys).to_pylist(), batch.column(keys + 1).to_pylist(), strict=True)):
                    keyed = [batch.column(k).take(pa.array(np.full(size, i))) for k in range(keys)]
                    yield pa.RecordBatch.from_arrays([*keyed, pa.array(np.arange(size, dtype=np.int32)), pa.array(_in_range(np.array(m), log))], out.names)

        found = written(rows.mapInArrow(segment, schema), "segments")
        rim = found.where("_edge")
        while parts > FAN_IN:
            rim = rim.withColumn("_up", F.floor(F.col("_seg") / FAN_IN)).groupBy(*names, "_up").applyInArrow(merge, schema)
            parts = -(-parts // FAN_IN)
        whole = found.where("NOT _edge").unionByName(rim.groupBy(*names).applyInArrow(merge, schema))
        return whole.select(*names, "_first", "_first_log").mapInArrow(final, out)


def _extended(both: tuple | None, rows: np.ndarray, counts: np.ndarray) -> tuple[tuple[np.ndarray, float], tuple[np.ndarray, float]]:
    """A segment (a product that comes first, and one that doesn't) with more rows behind it, each as often as its count."""
    factors, logs = math.sqrt(rows.shape[-1]) * np.swapaxes(rows, -1, -2), np.zeros(len(rows))
    head = factors[0].copy()
    counts = counts.copy()
    if both is None:
        counts[0] -= 1
    for i in np.flatnonzero(counts != 1):
        factors[i], logs[i] = _power(factors[i], int(counts[i]))
    tail = _chain(factors, logs)
    if both is None:
        return _product((rows[0], 0.0), tail), _product((head, 0.0), tail)
    return _product(both[0], tail), _product(both[1], tail)


def _chain(mats: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, float]:
    """The product of matrices from left to right, neighbours at a time."""
    while len(mats) > 1:
        even = len(mats) // 2 * 2
        made, sums = mats[0:even:2] @ mats[1:even:2], logs[0:even:2] + logs[1:even:2]
        top = np.abs(made).max(axis=(1, 2))
        top[top == 0] = 1
        mats, logs = np.concatenate([made / top[:, None, None], mats[even:]]), np.concatenate([sums + np.log(top), logs[even:]])
    return mats[0], float(logs[0])


def _power(m: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """``m`` to the ``n``, by squaring."""
    out, base = (np.eye(len(m)), 0.0), (m, 0.0)
    while n:
        if n & 1:
            out = _product(out, base)
        base, n = _product(base, base), n >> 1
    return out


def _scaled(m: tuple[np.ndarray, float]) -> tuple[np.ndarray, float]:
    """The same product with a largest element of 1, and the logarithm of what it was divided by."""
    top = np.abs(m[0]).max()
    return (m[0] / top, m[1] + math.log(top)) if top > 0 else m


def _product(a: tuple[np.ndarray, float], b: tuple[np.ndarray, float]) -> tuple[np.ndarray, float]:
    return _scaled((a[0] @ b[0], a[1] + b[1]))


def _in_range(values: np.ndarray, log: float) -> np.ndarray:
    """``values`` times ``exp(log)`` where doubles can hold that, else ``values`` with unit length."""
    top = np.abs(values).max(initial=0.0)
    if top == 0 or abs(math.log(top) + log) < 700:
        return values * math.exp(log) if top else values
    return values / np.sqrt((values * values).sum())


__all__ = ["ByColumn", "ByPosition", "Subset"]
