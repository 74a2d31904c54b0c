"""The codebook: which symbols exist, in which order, and which columns they came from.

Vectors are functions of names, so the table holds names only; scans that need vectors make them
within their tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.architectures import Architecture, InvalidDataTypeError
from hyperloom.functions import kernels
from hyperloom.functions.algebra import ColumnVectorAlgebra, VectorAlgebra
from hyperloom.operators.search import most_similar
from hyperloom.plans.expression import Expression, UnknownValueError
from hyperloom.plans.tables import numbered, written

SCHEMA = "idx long, name string"
#: Extensions of a codebook after which its names are written, so that its plan stays short.
MOST_UNIONS = 16


@dataclass(frozen=True)
class Index:
    """A symbol by its position."""

    at: int


@dataclass(frozen=True)
class ColumnKey:
    """The symbol of a known column; as a selector, the symbols that its values may be."""

    name: str


@dataclass(frozen=True)
class Cell:
    """A value as a value of a known column."""

    column: str
    value: str


Key = str | Index | ColumnKey | Cell


def categories_of(field_: T.StructField, enums: Mapping[str, list[str]] | None) -> tuple[str, ...] | None:
    """Declared categories of a column: in ``enums``, or in its metadata as ``{"enum": [...]}``."""
    found = (enums or {}).get(field_.name, (field_.metadata or {}).get("enum"))
    return tuple(found) if found is not None else None


def holds_symbols(field_: T.StructField, categories: tuple[str, ...] | None) -> bool:
    """Strings, or integers that are codes of declared categories."""
    return isinstance(field_.dataType, T.StringType) or (isinstance(field_.dataType, T.IntegralType) and categories is not None)


def as_codes(df: DataFrame, enums: Mapping[str, list[str]]) -> DataFrame:
    """``df`` with the given string columns as integer codes, their categories as metadata.

    A code is the place in the list; nulls stay null, and a value that isn't listed raises an error
    when the row is read. Folds count codes and never see the strings again.
    """

    def code(name: str, categories: list[str]) -> Column:
        column = F.col(f"`{name}`")
        at = F.array_position(F.array(*map(F.lit, categories)).cast("array<string>"), column) - 1
        unknown = F.raise_error(F.concat(F.lit("value '"), column, F.lit(f"' not found in column '{name}'")))
        return F.when(column.isNull(), None).when(at >= 0, at.cast("int")).otherwise(unknown.cast("int")).alias(name, metadata={"enum": list(categories)})

    return df.select(*[code(c, list(enums[c])) if c in enums else F.col(f"`{c}`") for c in df.columns])


@dataclass(frozen=True)
class Codebook:
    """Immutable: adding symbols makes a new codebook.

    ``columns`` maps known columns to their categories, or to None for plain strings. ``origins``
    (``column, name``) says which plain columns a value stood in; it is read only where asked for.
    ``depth`` counts extensions since ``names`` was last written. ``source`` is the table that the
    codebook was made of, all of whose plain values it has.
    """

    arch: Architecture
    size: int
    names: DataFrame
    columns: Mapping[str, tuple[str, ...] | None] = field(default_factory=dict)
    origins: DataFrame | None = None
    depth: int = 0
    source: DataFrame | None = None

    @staticmethod
    def empty(spark: SparkSession, arch: Architecture, size: int) -> Codebook:
        arch.check_size(size)
        return Codebook(arch, size, spark.createDataFrame([], SCHEMA))

    @staticmethod
    def from_dataframe(
        arch: Architecture, size: int, df: DataFrame, *, enums: Mapping[str, list[str]] | None = None, order_by: str | None = None
    ) -> Codebook:
        """Symbols of all columns of ``df`` and of their values; nulls make none.

        Columns must be strings, or integer codes of declared categories; a column with declared
        categories has all of them as symbols, in that order, after its own name. Other columns give their values first: in order of first appearance
        by ``order_by`` (a column outside the codebook), else by name. One scan, combined within tasks.
        """
        arch.check_size(size)
        spark = df.sparkSession
        fields = [f for f in df.schema.fields if f.name != order_by]
        known = {f.name: categories_of(f, enums) for f in fields}
        for f in fields:
            if not holds_symbols(f, known[f.name]):
                raise InvalidDataTypeError(f.name, f.dataType.simpleString())
        fixed = []
        for k, (name, categories) in enumerate(known.items()):
            fixed.append((k, 0 if categories is not None else 2, 0, name))
            fixed += [(k, 1, i, c) for i, c in enumerate(categories or ())]
        order = F.col(order_by) if order_by else F.lit(None).cast("long")
        open_ = [(k, f.name) for k, f in enumerate(fields) if known[f.name] is None]
        found = spark.createDataFrame(fixed, "p int, kind int, i long, name string").select("p", "kind", "i", "name")
        if open_:
            cells = F.array(*[F.struct(F.lit(k).alias("p"), F.col(f"`{c}`").alias("name")) for k, c in open_])
            values = df.select(order.cast("long").alias("i"), F.explode(cells).alias("c")).where("c.name IS NOT NULL")
            values = values.groupBy("c.p", "c.name").agg(F.min("i").alias("i")).select("p", F.lit(1).alias("kind"), F.coalesce("i", F.lit(0)).alias("i"), "name")
            found = found.union(values)
        first = found.groupBy("name").agg(F.min(F.struct("p", "kind", "i")).alias("at"))
        first = numbered(first.select("at.p", "at.kind", "at.i", "name"), ["p", "kind", "i", "name"])
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("name")) for _, c in open_])
        origins = df.select(F.explode(cells).alias("c")).where("c.name IS NOT NULL").select("c.*").distinct() if open_ else None
        return Codebook(arch, size, first.select("idx", "name"), known, origins, source=df.select(*[F.col(f"`{c}`") for c in known]))

    def extend(self, names: Iterable[str]) -> Codebook:
        """With ``names`` added in order; those that exist, or repeat, stay as they are."""
        wanted = list(dict.fromkeys(names))
        there = {r["name"] for r in self.names.where(F.col("name").isin(wanted)).collect()} if wanted else set()
        new = [n for n in wanted if n not in there]
        if not new:
            return self
        top = self.names.agg(F.max("idx")).first()[0]
        start = 0 if top is None else top + 1
        more = self.names.sparkSession.createDataFrame([(start + i, n) for i, n in enumerate(new)], SCHEMA)
        names, depth = self.names.union(more), self.depth + 1
        if depth == MOST_UNIONS:
            names, depth = written(names, "names"), 0
        return Codebook(self.arch, self.size, names, self.columns, self.origins, depth, self.source)

    def push(self, name: str) -> Codebook:
        return self.extend([name])

    def values(self) -> DataFrame:
        """All names, those of columns included."""
        return self.names.select("name")

    def vectors(self, rows: DataFrame | None = None) -> DataFrame:
        """``rows`` of the codebook (all if None) with their vectors as ``vec`` arrays."""
        rows = self.names if rows is None else rows
        arch, size = self.arch, self.size
        at = rows.columns.index("name")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, (1 << 22) // size)
            for batch in batches:
                for k in range(0, batch.num_rows, step):
                    part = batch.slice(k, step)
                    flat = np.concatenate([kernels.symbol(arch, n, size) for n in part.column(at).to_pylist()])
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * size), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([*part.columns, vec], [*part.schema.names, "vec"])

        vec = T.StructField("vec", T.ArrayType(T.DoubleType() if arch.real else T.ByteType()))
        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, vec]))

    def _where(self, key: Key):
        """The filter for a key; None for a key that no symbol can have."""
        if isinstance(key, Index):
            return F.col("idx") == key.at
        if isinstance(key, ColumnKey):
            return F.col("name") == key.name if key.name in self.columns else None
        if isinstance(key, Cell):
            if key.column not in self.columns:
                return None
            categories = self.columns[key.column]
            return F.col("name") == key.value if categories is None or key.value in categories else None
        return F.col("name") == key

    def get(self, key: Key) -> DataFrame:
        """``idx, name, vec`` of the symbol of ``key``: one row or none."""
        where = self._where(key)
        return self.vectors(self.names.where(F.lit(False) if where is None else where))

    def __getitem__(self, key: Key) -> np.ndarray:
        found = self.get(key).first()
        if found is None:
            raise KeyError(key)
        return np.array(found["vec"], dtype=np.float64 if self.arch.real else np.int8)

    def select(self, selector: list[Key] | ColumnKey | None = None, *, scope: str = "store") -> DataFrame:
        """``pos, idx, name`` of selected symbols, to be ordered by ``pos``.

        None selects all. A list selects its keys in order: missing ones are skipped, repeated ones
        repeat. A column selects its categories in declared order; a plain string column selects the
        whole codebook, since any symbol can be its value, or with ``scope="column"`` the values that
        stood in it in the codebook's own table. An unknown column selects nothing.
        """
        if scope not in ("store", "column"):
            raise ValueError("scope can be 'store' or 'column'")
        if scope == "column" and self.origins is None and not any(self.columns.values()):
            raise ValueError("the codebook is made of no table")
        spark = self.names.sparkSession
        if isinstance(selector, ColumnKey):
            if selector.name not in self.columns:
                return self.names.where(F.lit(False)).select(F.lit(0).cast("long").alias("pos"), "idx", "name")
            categories = self.columns[selector.name]
            if categories is None and scope == "column":
                own = self.origins.where(F.col("column") == selector.name).select("name")
                return self.names.join(own, "name", "left_semi").select(F.col("idx").alias("pos"), "idx", "name")
            selector = list(categories) if categories is not None else None
        if selector is None:
            return self.names.select(F.col("idx").alias("pos"), "idx", "name")
        named, placed = [], []
        for i, key in enumerate(selector):
            if isinstance(key, Index):
                placed.append((i, key.at))
            elif self._where(key) is not None:
                named.append((i, key if isinstance(key, str) else key.name if isinstance(key, ColumnKey) else key.value))
        # The keys are a literal list of the caller's.
        by_name = self.names.join(F.broadcast(spark.createDataFrame(named, "pos long, name string")), "name").select("pos", "idx", "name")
        if not placed:
            return by_name
        by_place = self.names.join(F.broadcast(spark.createDataFrame(placed, "pos long, idx long")), "idx").select("pos", "idx", "name")
        return by_name.union(by_place)

    def get_multiple(self, selector: list[Key] | ColumnKey | None = None) -> DataFrame:
        """``pos, idx, name, vec`` of selected symbols."""
        return self.vectors(self.select(selector))

    def similarities(self, query: np.ndarray, selector: list[Key] | ColumnKey | None = None) -> DataFrame:
        """``pos, idx, name, similarity`` of selected symbols to a normalized vector.

        The query, of ``size`` elements, travels with the tasks; candidates' vectors are made and
        compared there and are never sent anywhere.
        """
        arch, size = self.arch, self.size
        query = np.asarray(query)
        if query.shape != (size,):
            raise ValueError(f"the vector has {query.size} elements, the codebook {size}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [float(kernels.similarity(arch.kind, kernels.symbol(arch, n, size), query)) for n in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], ["pos", "idx", "name", "similarity"])

        rows = self.select(selector)
        return rows.mapInArrow(run, "pos long, idx long, name string, similarity double")

    def find(self, query: np.ndarray, selector: list[Key] | ColumnKey | None = None, *, k: int = 1) -> DataFrame:
        """The ``k`` most similar of the selected symbols; of ties the later one comes first."""
        return self.similarities(query, selector).orderBy(F.desc("similarity"), F.desc("pos")).limit(k)

    def find_all(self, queries: DataFrame, selector: list[Key] | ColumnKey | None = None, *, k: int = 1, query_col: str = "id", vector_col: str = "vec") -> DataFrame:
        """``query, rank, pos, idx, name, similarity``: for each row of ``queries`` the ``k`` most similar of the
        selected symbols, as ``find`` gives them. Symbols' vectors are made within the tasks that compare them.
        """
        arch, size = self.arch, self.size
        rows = self.select(selector)

        def vectors(batch: pa.RecordBatch) -> np.ndarray:
            return np.stack([kernels.symbol(arch, n, size) for n in batch.column(batch.schema.get_field_index("name")).to_pylist()] or [np.empty(size)])[: batch.num_rows]

        found = most_similar(queries, rows, arch, k=k, query_col=query_col, id_col="pos", vector_col=vector_col, vectors=vectors)
        return found.withColumnRenamed("id", "pos").join(rows, "pos").select("query", "rank", "pos", "idx", "name", "similarity")

    def similarities_of(self, names: list[str], text: str) -> DataFrame:
        """``pos, name, similarity`` of each given name to the value of an expression.

        A name without a symbol has null; so have all names if ``text`` is blank.
        """
        spark = self.names.sparkSession
        asked = spark.createDataFrame(list(enumerate(names)), "pos long, name string")
        if not text.strip():
            return asked.select("pos", "name", F.lit(None).cast("double").alias("similarity"))
        found = self.similarities(self.execute(text), list(dict.fromkeys(names))).select("name", "similarity")
        return asked.join(found, "name", "left").select("pos", "name", "similarity")

    def evaluate(self, expression: Expression | str) -> DataFrame:
        """The same as ``execute`` as a table of one row, ``vec``.

        One row holds the vectors of the names that the expression has. BSC and MAP evaluate it as an
        expression of Columns, HRR and VTB in NumPy within that row's task.
        """
        expression = Expression.parse(expression) if isinstance(expression, str) else expression
        wanted = list(dict.fromkeys(expression.names()))
        vectors = self.vectors(self.names.where(F.col("name").isin(wanted)).select("name"))
        row = vectors.agg(*[F.max_by("vec", F.when(F.col("name") == n, 1)).alias(f"_{i}") for i, n in enumerate(wanted)])
        there = row.select(*[F.col(f"_{i}").isNotNull() for i in range(len(wanted))]).first()
        for name, known in zip(wanted, there, strict=True):
            if not known:
                raise UnknownValueError(name)
        if self.arch.real:
            arch, size = self.arch, self.size

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for vectors in batch.to_pylist():
                        made = expression.evaluate({n: np.array(vectors[f"_{i}"]) for i, n in enumerate(wanted)}.get, VectorAlgebra(arch, size))
                        yield pa.RecordBatch.from_pydict({"vec": [made]})

            return row.mapInArrow(run, "vec array<double>")
        columns = {n: F.col(f"_{i}") for i, n in enumerate(wanted)}
        return row.select(expression.column(columns, ColumnVectorAlgebra(self.arch, self.size)).alias("vec"))

    def execute(self, expression: Expression | str) -> np.ndarray:
        """The vector of an expression over symbols; an unknown name raises UnknownValueError first."""
        expression = Expression.parse(expression) if isinstance(expression, str) else expression
        wanted = list(dict.fromkeys(expression.names()))
        there = {r["name"] for r in self.names.where(F.col("name").isin(wanted)).collect()}
        for name in wanted:
            if name not in there:
                raise UnknownValueError(name)
        return expression.evaluate(lambda n: kernels.symbol(self.arch, n, self.size), VectorAlgebra(self.arch, self.size))
