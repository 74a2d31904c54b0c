"""Classes for interactive work: architectures, vectors, storages and subsets.

Single vectors are NumPy arrays on the driver; storages and subsets run as Spark plans. All errors
are ValueErrors, but for the abstract method.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom import architectures as A
from hyperloom.functions import kernels
from hyperloom.functions.algebra import VectorAlgebra
from hyperloom.operators.codebook import Cell, Codebook, ColumnKey
from hyperloom.operators.subset import Subset as Folds
from hyperloom.plans.expression import UnknownValueError


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _frame(df: Any) -> DataFrame:
    """A Spark table as it is; pandas and Arrow tables are imported. Their dictionary-encoded columns of
    strings stay so: as integer codes, with the categories in their order, unused ones included."""
    if isinstance(df, DataFrame):
        return df
    if isinstance(df, pd.DataFrame):
        if not any(isinstance(kind, pd.CategoricalDtype) for kind in df.dtypes):
            return _session().createDataFrame(df)
        df = pa.Table.from_pandas(df, preserve_index=False)
    if isinstance(df, pa.Table):
        return _coded(df)
    raise ValueError(f"not a table: {type(df).__name__}")


def _coded(table: pa.Table) -> DataFrame:
    columns, categories = [], {}
    for name, column in zip(table.column_names, table.unify_dictionaries().columns, strict=True):
        if pa.types.is_dictionary(column.type):
            values = column.chunk(0).dictionary if column.num_chunks else pa.array([], column.type.value_type)
            if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
                categories[name] = values.to_pylist()
                column = pa.chunked_array([c.indices.cast(pa.int32()) for c in column.chunks], pa.int32())
            else:
                column = column.cast(values.type)
        columns.append(column)
    df = _session().createDataFrame(pa.table(columns, names=table.column_names))
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={"enum": categories[c]}) if c in categories else F.col(f"`{c}`") for c in df.columns])


class VSA:
    """An architecture. The vectors that it draws are numbered from the seed."""

    kind = ""

    def __init__(self, seed: int = 42, stream: str = "") -> None:
        self.arch = A.Architecture(self.kind, seed, stream) if self.kind else None
        self._drawn, self._steps = count(), count()

    def architecture(self) -> str:
        return A.NAMES.get(self.kind, self.kind)

    def create_storage(self, num_elements: int) -> Storage:
        if self.arch is None:
            raise NotImplementedError("create_storage must be implemented by a concrete architecture subclass")
        return STORAGES[self.kind](self, num_elements)

    def random_vector(self, size: int) -> Vector:
        self.arch.check_size(size)
        return self._vector(kernels.symbol(self.arch, f"#{next(self._drawn)}", size), True)

    def parse(self, numbers: Iterable[float], size: int | None = None) -> Vector | None:
        """Numbers as a normalized vector; None if their count is invalid, or isn't ``size``."""
        data = np.asarray(list(numbers), np.float64)
        if (size is not None and len(data) != size) or not self.arch.valid_size(len(data)):
            return None
        limit = {A.BSC: 0.5, A.MAP: 0.0}.get(self.kind)
        low = 0 if self.kind == A.BSC else -1
        return self._vector(data if limit is None else np.where(data >= limit, 1, low).astype(np.int8), True)

    def from_normalized(self, numbers: Iterable[float]) -> Vector:
        """Elements of a normalized vector as they are: 0 and 1 for BSC, -1 and 1 for MAP, any for the others."""
        data = np.asarray(list(numbers), np.float64 if self.arch.real else np.int64)
        self.arch.check_size(len(data))
        allowed = {A.BSC: (0, 1), A.MAP: (-1, 1)}.get(self.kind)
        if allowed and not np.isin(data, allowed).all():
            raise ValueError(f"elements of a normalized vector are {allowed[0]} or {allowed[1]}")
        return self._vector(data if self.arch.real else data.astype(np.int8), True)

    def _vector(self, data: np.ndarray, normalized: bool) -> Vector:
        return (VECTORS if normalized else UNNORMALIZED)[self.kind](self, data)

    def __repr__(self) -> str:
        return f"VSA(architecture={self.architecture()})"


class BinarySpatterCode(VSA):
    kind = A.BSC


class MultiplyAddPermute(VSA):
    kind = A.MAP


class HolographicReducedRepresentation(VSA):
    kind = A.HRR


class VectorDerivedTransformationBinding(VSA):
    kind = A.VTB


class _Base:
    normalized = True

    def __init__(self, vsa: VSA, data: np.ndarray) -> None:
        self.vsa, self.data = vsa, data

    def architecture(self) -> str:
        return self.vsa.architecture()

    def size(self) -> int:
        return len(self.data)

    def equals(self, other: object) -> bool:
        return isinstance(other, _Base) and self.normalized == other.normalized and np.array_equal(self.data, other.data)

    def __eq__(self, other: object) -> bool:
        return self.equals(other)

    def __hash__(self) -> int:
        return hash(self.data.tobytes())

    def __len__(self) -> int:
        return len(self.data)

    def __iter__(self):
        return iter(self.data.tolist())

    def __getitem__(self, at: int):
        return self.data[at].item()

    def __repr__(self) -> str:
        return f"{type(self).__name__}(size={self.size()})"

    def to_list(self) -> list[float]:
        """Elements as numbers; normalized MAP vectors as 1 and 0."""
        data = (self.data > 0) if self.vsa.kind == A.MAP and self.normalized else self.data
        return data.astype(np.float64).tolist()

    def _other(self, other: _Base) -> _Base:
        if not isinstance(other, _Base) or other.vsa.kind != self.vsa.kind:
            raise ValueError("the vectors are of different architectures")
        if other.size() != self.size():
            raise ValueError(f"the vectors differ in size: {self.size()} and {other.size()}")
        return other

    def _bound(self, other: _Base) -> _Base:
        """An accumulator always stands left."""
        self._other(other)
        if not self.normalized and not other.normalized:
            raise ValueError("two unnormalized vectors cannot be bound")
        left, right = (other, self) if self.normalized and not other.normalized else (self, other)
        return self.vsa._vector(kernels.bind(self.vsa.kind, left.data, right.data), left.normalized)

    def _bundled(self, other: _Base) -> UnnormalizedVector:
        self._other(other)
        if not self.normalized and not other.normalized:
            raise ValueError("two unnormalized vectors cannot be bundled: see bundle_accumulators")
        left, right = (other, self) if self.normalized and not other.normalized else (self, other)
        algebra = VectorAlgebra(self.vsa.arch, self.size(), self.vsa._steps.__next__)
        return self.vsa._vector(algebra.bundle(kernels.denormalize(self.vsa.kind, left.data), right.data), False)

    def __mul__(self, other: _Base):
        return self._bound(other)

    def bind(self, other: _Base):
        return self._bound(other)


class Vector(_Base):
    """A normalized vector."""

    def similarity(self, other: Vector) -> float:
        if not self._other(other).normalized:
            raise ValueError("normalize the vector first")
        return float(kernels.similarity(self.vsa.kind, self.data, other.data))

    def permute(self, shifts: int) -> Vector:
        return self.vsa._vector(kernels.permute(self.data, shifts), True)

    def bundle(self, other: _Base) -> Vector:
        return self._bundled(other).normalize()

    def bundle_unnormalized(self, other: _Base) -> UnnormalizedVector:
        return self._bundled(other)

    def denormalize(self) -> UnnormalizedVector:
        return self.vsa._vector(kernels.denormalize(self.vsa.kind, self.data), False)

    def __add__(self, other: _Base) -> Vector:
        return self.bundle(other)


class UnnormalizedVector(_Base):
    """An accumulator."""

    normalized = False

    def normalize(self) -> Vector:
        return self.vsa._vector(kernels.normalize(self.vsa.kind, self.data), True)

    def bundle(self, other: Vector) -> UnnormalizedVector:
        return self._bundled(other)

    def bundle_accumulators(self, other: UnnormalizedVector) -> UnnormalizedVector:
        """The sum of two accumulators, as partial aggregates need it."""
        self._other(other)
        algebra = VectorAlgebra(self.vsa.arch, self.size(), self.vsa._steps.__next__)
        return self.vsa._vector(algebra.bundle(self.data, other.data), False)

    def __add__(self, other: Vector) -> UnnormalizedVector:
        return self._bundled(other)


class _Invertible:
    def inverse(self):
        return self.vsa._vector(kernels.inverse(self.vsa.kind, self.data), True)

    def __neg__(self):
        return self.inverse()


class BscVector(Vector): ...


class MapVector(Vector): ...


class HrrVector(_Invertible, Vector): ...


class VtbVector(_Invertible, Vector): ...


class BscUnnormalizedVector(UnnormalizedVector): ...


class MapUnnormalizedVector(UnnormalizedVector): ...


class HrrUnnormalizedVector(UnnormalizedVector): ...


class VtbUnnormalizedVector(UnnormalizedVector): ...


class Storage:
    """Named vectors of one architecture and size."""

    def __init__(self, architecture: VSA, size: int) -> None:
        self.vsa = architecture
        self.codebook = Codebook.empty(_session(), architecture.arch, size)

    @classmethod
    def from_dataframe(cls, architecture: VSA, size: int, df: Any, *, enums: dict[str, list[str]] | None = None) -> Storage:
        """A storage of all columns of ``df`` and their values."""
        kind = STORAGES[architecture.kind]
        out = kind.__new__(kind)
        out.vsa, out.codebook = architecture, Codebook.from_dataframe(architecture.arch, size, _frame(df), enums=enums)
        return out

    def architecture(self) -> str:
        return self.vsa.architecture()

    def size(self) -> int:
        return self.codebook.size

    def push(self, name: str) -> Vector:
        self.codebook = self.codebook.push(name)
        return self.vsa._vector(kernels.symbol(self.vsa.arch, name, self.size()), True)

    def extend(self, names: Iterable[str]) -> None:
        self.codebook = self.codebook.extend(names)

    def columns(self) -> list[str]:
        return list(self.codebook.columns)

    def values(self) -> list[str]:
        """All names, on the driver; ``codebook.names`` is the table."""
        return [r["name"] for r in self.codebook.names.orderBy("idx").toLocalIterator()]

    def get(self, name: str) -> Vector | None:
        return self._one(name)

    def get_column_value(self, column: str, value: str) -> Vector | None:
        return self._one(Cell(column, value))

    def get_column(self, column: str) -> Vector | None:
        return self._one(ColumnKey(column))

    def _one(self, key: Any) -> Vector | None:
        found = self.codebook.get(key).first()
        return None if found is None else self._made(found["vec"], True)

    def _made(self, elements: Any, normalized: bool) -> Any:
        kind = np.float64 if self.vsa.arch.real else np.int8 if normalized or self.vsa.kind == A.BSC else np.int64
        return self.vsa._vector(np.array(elements, kind), normalized)

    def execute(self, expression: str) -> Vector:
        try:
            return self.vsa._vector(self.codebook.execute(expression), True)
        except UnknownValueError as e:
            raise ValueError(str(e)) from e

    def find(self, vector: Vector) -> Vector | None:
        """The vector of the most similar symbol."""
        name = self.find_name(vector)
        return None if name is None else self.vsa._vector(kernels.symbol(self.vsa.arch, name, self.size()), True)

    def find_name(self, vector: Vector) -> str | None:
        found = self.codebook.find(vector.data).first()
        return None if found is None else found["name"]

    def similarities(self, vector: Vector) -> dict[str, float]:
        """Of all symbols, on the driver; see ``similarity_table`` for large storages."""
        return {r["name"]: r["similarity"] for r in self.similarity_table(vector).orderBy("pos").toLocalIterator()}

    def similarity_table(self, vector: Vector) -> DataFrame:
        """``pos, idx, name, similarity`` of all symbols, as a Spark table."""
        return self.codebook.similarities(vector.data)

    def subset(self, df: Any, *, order_by: str | None = None, enums: dict[str, list[str]] | None = None) -> Subset:
        """``df`` against this storage as it is now; nothing is read or checked before the first fold."""
        return SUBSETS[self.vsa.kind](self, _frame(df), order_by, enums)

    def __repr__(self) -> str:
        return f"{type(self).__name__}(size={self.size()}, columns={len(self.codebook.columns)}, values={self.codebook.names.count()})"


class BscStorage(Storage): ...


class MapStorage(Storage): ...


class HrrStorage(Storage): ...


class VtbStorage(Storage): ...


class Subset:
    """Folds that give vectors. Without ``order_by``, rows are in the order that Spark reads them."""

    def __init__(self, storage: Storage, df: DataFrame, order_by: str | None, enums: dict[str, list[str]] | None) -> None:
        if order_by is None:
            order_by = "_order"
            while order_by in df.columns:
                order_by = "_" + order_by
            df = df.withColumn(order_by, F.monotonically_increasing_id())
        self._storage, self._order = storage, order_by
        own = [f.name for f in df.schema if "enum" in (f.metadata or {})]
        known = {c: list(v) for c, v in storage.codebook.columns.items() if v is not None and c in df.columns and c not in own}
        self._folds = Folds(storage.codebook, df, order_by, (), enums if enums is not None else known)

    def _checked(self) -> Folds:
        self._folds.validate()
        return self._folds

    def rows(self, fold: str, *, encoding: str = "column", normalized: bool = True, ways: int = 1) -> DataFrame:
        """The table with ``vector``: each row's "bundle", "bind" or "combinations". Nothing is collected."""
        folds = self._checked()
        if fold == "bundle":
            return folds.bundle_rows(encoding=encoding, normalized=normalized)
        if fold == "bind":
            return folds.bind_rows(encoding=encoding)
        if fold == "combinations":
            return folds.bundle_rows_combinatorial(ways)
        raise ValueError(f"unknown fold {fold!r}: one of bundle, bind, combinations")

    def _rows(self, rows: DataFrame, normalized: bool) -> list[Any]:
        """Vectors in the order of rows: a list for small tables, read partition by partition; ``rows`` gives the table."""
        found = rows.orderBy(self._order).select("vector").toLocalIterator()
        return [None if r["vector"] is None else self._storage._made(r["vector"], normalized) for r in found]

    def _whole(self, folded: DataFrame, normalized: bool) -> Any:
        found = folded.orderBy("dim").collect()
        return self._storage._made([r["value"] for r in found], normalized) if found else None

    def bundle_rows(self, encoding: str = "column") -> list[Any]:
        return self._rows(self.rows("bundle", encoding=encoding), True)

    def bundle_rows_unnormalized(self, encoding: str = "column") -> list[Any]:
        return self._rows(self.rows("bundle", encoding=encoding, normalized=False), False)

    def bundle_rows_combinatorial(self, ways: int) -> list[Any]:
        return self._rows(self.rows("combinations", ways=ways), False)

    def bind_rows(self, encoding: str = "column") -> list[Any]:
        return self._rows(self.rows("bind", encoding=encoding), True)

    def bundle_dataset(self) -> Any:
        return self._whole(self._checked().bundle_dataset(), True)

    def bundle_dataset_unnormalized(self) -> Any:
        return self._whole(self._checked().bundle_dataset(rows_normalized=False, normalized=False), False)

    def bundle_dataset_combinatorial(self, ways: int) -> Any:
        return self._whole(self._checked().bundle_dataset_combinatorial(ways), False)

    def bundle_dataset_with_binding(self, encoding: str = "column", normalized: bool = True) -> Any:
        return self._whole(self._checked().bundle_dataset_with_binding(encoding=encoding, normalized=normalized), normalized)

    def bundle_dataset_temporal(self) -> Any:
        return self.bundle_dataset_with_binding("position")

    def bundle_dataset_temporal_unnormalized(self) -> Any:
        return self.bundle_dataset_with_binding("position", False)

    def bind_dataset(self, encoding: str = "column") -> Any:
        return self._whole(self._checked().bind_dataset(encoding=encoding), True)

    def bind_entire_dataset(self, encoding: str = "column") -> Any:
        return self._whole(self._checked().bind_entire_dataset(encoding=encoding), True)


class BscSubset(Subset): ...


class MapSubset(Subset): ...


class HrrSubset(Subset): ...


class VtbSubset(Subset): ...


VECTORS = {A.BSC: BscVector, A.MAP: MapVector, A.HRR: HrrVector, A.VTB: VtbVector}
UNNORMALIZED = {A.BSC: BscUnnormalizedVector, A.MAP: MapUnnormalizedVector, A.HRR: HrrUnnormalizedVector, A.VTB: VtbUnnormalizedVector}
STORAGES = {A.BSC: BscStorage, A.MAP: MapStorage, A.HRR: HrrStorage, A.VTB: VtbStorage}
SUBSETS = {A.BSC: BscSubset, A.MAP: MapSubset, A.HRR: HrrSubset, A.VTB: VtbSubset}
