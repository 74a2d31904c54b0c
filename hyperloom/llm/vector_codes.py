"""Vector codes: product quantisation in integers, nearest entries found behind lower bounds of segment means."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.common import join_counted, written

#: Components become floor(SCALE * x).
SCALE = 256
#: Integer components of a vector of n may be as large as ROOM // n: all sums of squares then fit 62 bits.
ROOM = 1 << 30
#: What rounding may add to a bound, as a share of the squared norms it was made from: some
#: thousands of times the rounding of the products.
SLACK = 1e-12


@dataclass(frozen=True)
class Codebooks:
    """``entries``: integers by part, entry and position within the part."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _blocks(rows: np.ndarray, blocks: int) -> np.ndarray:
    """Rows of one part as coordinates: for each block its mean times the root of its length, and the
    norm of what is left around the mean. The squared distance of two rows' coordinates is never
    above that of the rows, and their norms are equal."""
    starts = np.arange(blocks) * rows.shape[1] // blocks
    lengths = np.diff(np.append(starts, rows.shape[1]))
    sums = np.add.reduceat(rows, starts, axis=1)
    # In integers up to here, so that what is left around a large mean keeps all its digits.
    left = lengths * np.add.reduceat(rows**2, starts, axis=1) - sums**2
    return np.concatenate([sums, np.sqrt(left)], axis=1) / np.sqrt(np.tile(lengths, 2))


def nearest(rows: np.ndarray, entries: np.ndarray, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row its nearest entry (squared distance, ties to the lower index), the distance, and
    how many exact distances were taken.

    One block over the whole part bounds each row's distance to each entry from below. The entry of the
    least bound is measured; entries whose bound is above that distance can't win and go. What is
    left is bounded again by two blocks, then four and so on, with the limit drawn tighter by the
    best entry of each level, and what survives all is measured exactly in integers. Bounds give way
    by more than their rounding, so neither a nearest entry nor a tie is ever lost.
    """
    levels = [1 << k for k in range(max(1, (rows.shape[1] - 1).bit_length()))]
    known = [_blocks(entries, b) for b in levels]
    found = [_nearest(rows[k : k + chunk], entries, levels, known) for k in range(0, len(rows), chunk)]
    index, distance, taken = zip(*found, strict=True) if found else ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [0])
    return np.concatenate(index), np.concatenate(distance), sum(taken)


def _nearest(rows: np.ndarray, entries: np.ndarray, levels: list[int], known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    n = len(rows)
    norms = (entries**2).sum(axis=1)[None, :] + (rows**2).sum(axis=1)[:, None].astype(np.float64)
    to = lambda best: ((rows - entries[best]) ** 2).sum(axis=1) * (1 + SLACK)
    # A bound is what the norms leave after twice the product of the coordinates.
    low = norms * (1 - SLACK) - 2 * (_blocks(rows, 1) @ known[0].T)
    limit, taken = to(low.argmin(axis=1)), n
    i, j = np.nonzero(low <= limit[:, None])
    for b, coordinates in zip(levels[1:], known[1:], strict=True):
        bound = norms[i, j] * (1 - SLACK) - 2 * np.einsum("ij,ij->i", _blocks(rows, b)[i], coordinates[j])
        starts = np.searchsorted(i, np.arange(n))
        best = np.flatnonzero(bound == np.minimum.reduceat(bound, starts)[i])
        limit, taken = np.minimum(limit, to(j[best[np.searchsorted(i[best], np.arange(n))]])), taken + n
        left = bound <= limit[i]
        i, j = i[left], j[left]
    exact = ((rows[i] - entries[j]) ** 2).sum(axis=1)
    least = np.minimum.reduceat(exact, np.searchsorted(i, np.arange(n)))
    hit = np.flatnonzero(exact == least[i])
    return j[hit[np.searchsorted(i[hit], np.arange(n))]], least, taken + len(exact)


def kept(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``vectors`` without rows whose vector is null or holds a null or a component that is not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(F.col(vector_col).isNotNull()).where(~F.exists(F.col(vector_col).cast("array<double>"), bad))


def integers(column: pa.Array, parts: int, size: int | None = None) -> np.ndarray:
    """Rows of integer components by part; raises if lengths differ or can't be cut, or components are too large."""
    lengths = np.asarray(column.value_lengths())
    size = int(lengths[0]) if size is None and len(lengths) else size or 0
    if size == 0 or size % parts or (lengths != size).any():
        raise ValueError(f"vectors must share a length that is a multiple of {parts}")
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if (np.abs(values) > ROOM // size).any():
        raise ValueError(f"components beyond {ROOM // size // SCALE} are not supported in vectors of {size}")
    return values.astype(np.int64).reshape(len(lengths), parts, size // parts)


def assigned(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every part of every row, and its squared distance."""
    codes, errors = np.empty(rows.shape[:2], np.int64), np.empty(rows.shape[:2], np.int64)
    for p in range(rows.shape[1]):
        codes[:, p], errors[:, p], _ = nearest(rows[:, p], books[p])
    return codes, errors


def _sums(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Count and componentwise sum of the parts that each entry gets, once for a whole task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = integers(batch.column(0), books.shape[0], books.shape[0] * books.shape[2])
                codes, _ = assigned(rows, books)
                for p in range(books.shape[0]):
                    counts[p] += np.bincount(codes[:, p], minlength=books.shape[1])
                    np.add.at(sums[p], codes[:, p], rows[:, p])
        part, entry = np.nonzero(counts)
        data = (part, entry, counts[part, entry], *sums[part, entry].T)
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()) for d in data], ["part", "entry", "n", *(f"s{i}" for i in range(books.shape[2]))])

    return run


def fit(vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks | None:
    """Codebooks after ``rounds`` over all rows of ``kept``; None if there are none.

    A part's codebook starts as that part of the rows of the least ids. A round assigns all parts and
    replaces each entry by the floor of the mean of what it got; entries that got nothing stay. Each
    task sends one sum for each entry; the driver gets one row for each entry of each part.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries, for two hex digits each")
    rows = kept(vectors, vector_col)
    first = rows.orderBy(F.col(id_col).asc_nulls_last(), vector_col).limit(entries).select(vector_col).toArrow()
    if not first.num_rows:
        return None
    books = integers(first.column(0).combine_chunks(), parts).transpose(1, 0, 2).copy()
    width = books.shape[2]
    schema = "part long, entry long, n long" + "".join(f", s{i} long" for i in range(width))
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    for _ in range(rounds):
        sums = rows.select(vector_col).mapInArrow(_sums(books), schema)
        for row in sums.groupBy("part", "entry").agg(whole("n"), *[whole(f"s{i}") for i in range(width)]).collect():
            books[row["part"], row["entry"]] = [int(row[f"s{i}"]) // int(row["n"]) for i in range(width)]
    return Codebooks(books)


def encode(vectors: DataFrame, books: Codebooks, *, vector_col: str = "embedding") -> DataFrame:
    """All columns of the rows of ``kept`` but the vector, with ``code`` (two hex digits for each part) and ``error``."""
    parts, _, width = books.entries.shape
    rest = [c for c in vectors.columns if c not in (vector_col, "code", "error")]
    rows = kept(vectors, vector_col).select(*rest, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            codes, errors = assigned(integers(batch.column(len(rest)), parts, parts * width), books.entries) if n else (np.empty((0, parts)), np.empty((0, parts)))
            digits = codes.astype(np.uint8).tobytes().hex()
            code = pa.array([digits[2 * parts * k : 2 * parts * (k + 1)] for k in range(n)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], code, pa.array(errors.sum(axis=1).astype(np.int64))], [*rest, "code", "error"])

    return rows.mapInArrow(run, rows.drop(vector_col).schema.add("code", "string").add("error", "long"))


def decode(code: Column, books: Codebooks) -> Column:
    """The vector that a code stands for, in the scale of the input."""

    @F.arrow_udf("array<double>")
    def vector(codes: pa.Array) -> pa.Array:
        parts = np.arange(books.entries.shape[0])
        found = [None if c is None else (books.entries[parts, list(bytes.fromhex(c))] / SCALE).ravel().tolist() for c in codes.to_pylist()]
        return pa.array(found, pa.list_(pa.float64()))

    return vector(code)


def vector_codes(
    vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every row of ``kept``.

    ``error`` is the squared distance to the decoded integers, ``label_error`` its sum over the rows
    of the same label. Codes are written once and summed within tasks; the sums go back by broadcast,
    or, where there are too many labels, by a join that deals hot labels apart.

    Defined cases: rows with null vectors, null or non-finite components are dropped; null labels are
    one label; null ids come last; of repeated ids the first rows by vector start a codebook; fewer
    rows than ``entries`` make smaller codebooks; an empty table gives an empty result; vectors of
    other lengths than the first, lengths that ``parts`` does not divide and components beyond
    2^22 / length (65,536 for vectors of 64) raise an error. Other columns are ignored.
    """
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    books = fit(named, parts=parts, entries=entries, rounds=rounds)
    if books is None:
        return named.where("false").select("vec_id", *[F.lit(None).cast(k).alias(c) for c, k in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    coded = written(encode(named, books), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    found = join_counted(coded, written(sums, "label-errors"), "label", "_rows")
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
