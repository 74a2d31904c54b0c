"""The most similar vectors for a table of queries: exact, by blocked matrix products.

Queries are cut into blocks of bounded bytes. Every task multiplies a block with the candidates that
it reads and keeps the best ``k`` of each query; the tasks' best are merged. So what is sent are
``k`` rows for each query and task, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.architectures import BSC, Architecture
from hyperloom.functions import kernels
from hyperloom.plans.tables import numbered, written

#: Bytes of queries that travel with the tasks of one scan of the candidates.
BLOCK_BYTES = 32 << 20
#: Similarities that a task holds at once, and elements of vectors that are compared one by one.
PRODUCT = 1 << 22
#: How far a product of real vectors may be from the similarity that counts. BSC and MAP products are exact.
SLACK = 1e-9
FOUND = "_row long, _id long, _similarity double"


@dataclass
class Best:
    """The ``k`` best candidates of each query so far: of ties the larger id."""

    arch: Architecture
    queries: np.ndarray
    k: int

    def __post_init__(self) -> None:
        self.unit = self._unit(self.queries)
        self.row, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.least = np.full(len(self.queries), -np.inf)

    def _unit(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors whose products are similarities, or for BSC and MAP similarities times the size."""
        if self.arch.real:
            return kernels.normalize(self.arch.kind, vectors)
        return (2 * vectors - 1 if self.arch.kind == BSC else vectors).astype(np.float32)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, PRODUCT // max(len(self.queries), 1))
        for at in range(0, len(ids), step):
            self._add(ids[at : at + step], vectors[at : at + step])

    def _add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        products = self.unit @ self._unit(vectors).T
        if not self.arch.real:
            products = products.astype(np.float64) / vectors.shape[1]
        n = products.shape[1]
        least = np.maximum(self.least, np.partition(products, n - self.k, axis=1)[:, n - self.k]) if n > self.k else self.least
        i, j = np.nonzero(products >= least[:, None] - (SLACK if self.arch.real else 0))
        score = products[i, j]
        if self.arch.real:
            # A similarity must not depend on where in a product it stands: equal vectors have to tie.
            size = max(1, PRODUCT // vectors.shape[1])
            score = np.concatenate([kernels.similarity(self.arch.kind, self.queries[i[a : a + size]], vectors[j[a : a + size]]) for a in range(0, len(i), size)] or [score])
        row, found, score = np.concatenate([self.row, i]), np.concatenate([self.id, ids[j]]), np.concatenate([self.score, score])
        order = np.lexsort((-found, -score, row))
        row, found, score = row[order], found[order], score[order]
        first = np.searchsorted(row, np.arange(len(self.queries)))
        rank = np.arange(len(row)) - first[row]
        kept = rank < self.k
        self.row, self.id, self.score = row[kept], found[kept], score[kept]
        last = rank == self.k - 1
        self.least[row[last]] = score[last]


def _matrix(column: pa.Array, arch: Architecture, size: int) -> np.ndarray:
    lengths = np.asarray(column.value_lengths())
    if (lengths != size).any():
        raise ValueError(f"all vectors must have {size} elements")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64 if arch.real else np.int8).reshape(-1, size)


def most_similar(
    queries: DataFrame,
    candidates: DataFrame,
    arch: Architecture,
    *,
    k: int = 1,
    query_col: str = "id",
    id_col: str = "id",
    vector_col: str = "vec",
    vectors: Callable[[pa.RecordBatch], np.ndarray] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``query, rank, id, similarity``: for each row of ``queries`` the ``k`` most similar candidates.

    Both tables have an id and a vector of one length (candidates a ``long`` id); ``vectors`` may make those
    of a batch of candidates instead, within its task. Candidates are read once for each block of
    queries. Similarities are those of ``arch``; of ties the larger id comes first.

    Defined cases: rows of null vectors are left out; repeated queries and candidates count each; fewer
    candidates than ``k`` give fewer rows; no queries or candidates give none.
    """
    spark = queries.sparkSession
    rows = queries.where(F.col(vector_col).isNotNull()).select(F.col(query_col).alias("query"), F.col(vector_col).alias("_vec"))
    rows = written(numbered(rows, ["query"], "_row"), "queries")
    n, size = rows.agg(F.count(F.lit(1)), F.max(F.size("_vec"))).first()
    if not n:
        return rows.select("query", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("similarity"))
    block = max(1, block_bytes // (8 * size))
    there = candidates.where(F.col(id_col).isNotNull())
    there = there.select(id_col, vector_col).where(F.col(vector_col).isNotNull()) if vectors is None else there

    def scan(first: int) -> DataFrame:
        part = rows.where(F.col("_row").between(first, first + block - 1)).orderBy("_row").select("_vec").toArrow()
        shared = spark.sparkContext.broadcast(_matrix(part.column(0).combine_chunks(), arch, size))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(arch, shared.value, k)
            for batch in batches:
                at = batch.schema.get_field_index(id_col)
                made = vectors(batch) if vectors else _matrix(batch.column(batch.schema.get_field_index(vector_col)), arch, size)
                best.add(batch.column(at).cast(pa.int64()).to_numpy(zero_copy_only=False), made)
            yield pa.RecordBatch.from_arrays([pa.array(best.row + first), pa.array(best.id), pa.array(best.score)], ["_row", "_id", "_similarity"])

        return there.mapInArrow(run, FOUND)

    found = None
    for b in range(math.ceil(n / block)):
        # A block's best are written, so no scan's queries outlive it.
        more = written(scan(b * block), "best")
        found = more if found is None else found.union(more)
    window = Window.partitionBy("_row").orderBy(F.desc("_similarity"), F.desc("_id"))
    best = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return best.join(rows.select("_row", "query"), "_row").select("query", "rank", F.col("_id").alias("id"), F.col("_similarity").alias("similarity"))
