"""Folds over windows of a stream. Map tasks fold the rows that they have; state is a row for each window and dimension.

The folds of a batch are made of aggregates that merge (sums, parities, the last order value that
agrees), so Spark's own streaming aggregation keeps the state, and the watermark removes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.architectures import BSC, HRR, MAP, VTB
from hyperloom.functions import kernels
from hyperloom.operators.codebook import Codebook
from hyperloom.operators.rows import Encoding
from hyperloom.operators.subset import Subset

#: Folds by their names in ``Subset``: how a row's cells are joined, and how rows are.
FOLDS = {
    "bundle_dataset": ("bundle", "bundle"),
    "bundle_dataset_with_binding": ("bind", "bundle"),
    "bind_dataset": ("bundle", "bind"),
    "bind_entire_dataset": ("bind", "bind"),
}


def windowed_fold(
    codebook: Codebook,
    stream: DataFrame,
    columns: list[str],
    time_col: str,
    fold: str,
    *,
    window: str,
    late: str,
    order_by: str | None = None,
    encoding: str | Encoding = "column",
    normalized: bool = False,
) -> DataFrame:
    """``window_start, dim, value`` of a stream: the fold of ``FOLDS`` of the rows in each window.

    Equal to the same fold of a batch with ``group_by`` the window's start. A row's bundle is
    normalized, as by default there. ``normalized`` is for bundles of MAP; those of real vectors come as sums.
    Rows without a time or without cells are in no window. A row is late, and dropped, if the watermark (the
    largest time seen, less ``late``) had passed its window's end before the batch that has it; rows of a window
    that is still open count, however late. Products of real vectors need all rows at once or their order: HRR's follow from
    ``tuple_counts``; VTB's are for batches.
    """
    arch, size = codebook.arch, codebook.size
    op, over = FOLDS[fold]
    if over == "bind" and arch.real:
        raise ValueError("products of real vectors are folded in batches; of a stream, take tuple_counts")
    if normalized and arch.kind in (HRR, VTB):
        raise ValueError("the length of a real vector is known when its window is whole: normalize the sums then")
    draws = arch.kind == BSC and (op == "bundle" or over == "bundle")
    if draws and order_by is None:
        raise ValueError("this fold depends on the order of rows: name a column in order_by")
    cells = [F.col(f"`{c}`") for c in columns]
    own = stream.select(*cells, *[F.col(f"`{order_by}`")] * (order_by is not None))
    subset = Subset(codebook, own, order_by)
    kernel, n = subset._kernel(op, encoding, True), len(columns)
    time = F.col(f"`{time_col}`").cast("timestamp")
    rows = stream.where(subset._there).select(
        F.unix_micros(F.window(time, window)["start"]).alias("_w"),
        F.unix_micros(time).alias("_us"),
        *[c.alias(f"_c{k}") for k, c in enumerate(cells)],
        (F.col(f"`{order_by}`") if order_by else F.lit("")).alias("_o"),
    )
    rows = rows.withColumn("_text", F.col("_o").cast("string"))
    base = T.StructType().add("_us", "long").add("dim", "integer").add("value", "double" if arch.real else "long")

    def vectors(part: pa.Table) -> np.ndarray:
        return kernel([part[f"_c{i}"].to_pylist() for i in range(n)], part["_text"].to_pylist())[0]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        """The rows of each window of a batch, and the largest time among them."""
        for batch in batches:
            table, starts = pa.Table.from_batches([batch]), batch.column(0).to_numpy()
            order = np.argsort(starts, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(starts[order])) + 1) if len(order) else ():
                part = table.take(pa.array(at))
                yield int(part["_us"].to_numpy().max()), part

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for us, part in windows(batches):
            total = np.zeros(size, np.float64 if arch.real else np.int64)
            for start in range(0, part.num_rows, kernel.step):
                acc = vectors(part.slice(start, kernel.step))
                total += (acc if over == "bundle" or arch.kind == BSC else acc < 0).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, us)), pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], base.names)

    ordered = T.StructType([*base.fields, rows.schema["_o"], T.StructField("_key", T.StringType()), T.StructField("_agrees", T.BooleanType())])
    step = min(kernel.step, 64)

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each dimension the last row whose tie bit is its own bit, or, if none is, the first row."""
        for us, part in windows(batches):
            part = part.sort_by([("_o", "descending"), ("_key", "descending")])
            open_, at, value = np.ones(size, bool), np.full(size, part.num_rows - 1), np.zeros(size, np.int64)
            for start in range(0, part.num_rows, step):
                chunk = part.slice(start, step)
                acc = vectors(chunk)
                drawn = kernels.ties(arch, size, [("row", t) for t in chunk["_text"].to_pylist()])
                for i, agrees in enumerate(acc == drawn):
                    takes = open_ & agrees
                    at[takes], value[takes], open_ = start + i, acc[i][takes], open_ & ~takes
                if not open_.any():
                    break
            else:
                value[open_] = vectors(part.slice(part.num_rows - 1))[0][open_]
            taken = pa.array(at)
            order = part["_o"].take(taken).combine_chunks()
            # Cells decide only among first rows.
            keys = pa.array([part["_key"][part.num_rows - 1].as_py() if o else None for o in open_], pa.string())
            made = [pa.array(np.full(size, us)), pa.array(np.arange(size, dtype=np.int32)), pa.array(value), order, keys, pa.array(~open_)]
            yield pa.RecordBatch.from_arrays(made, ordered.names)

    last_wins = arch.kind == BSC and over == "bundle"
    if last_wins:
        rows = rows.withColumn("_key", F.to_json(F.struct(*[f"_c{k}" for k in range(n)])))
        partial = rows.mapInArrow(agreeing, ordered)
        yes = F.col("_agrees")
        last = F.max_by(F.when(yes, F.col("value")), F.when(yes, F.struct("_o")))
        first = F.min_by(F.when(~yes, F.col("value")), F.when(~yes, F.struct("_o", "_key")))
        total = F.coalesce(last, first)
    else:
        partial = rows.mapInArrow(sums, base)
        total = F.sum("value")
    # The largest time of a task's rows stands for them all: it moves the watermark as they would.
    partial = partial.withColumn("_ts", F.timestamp_micros("_us")).withWatermark("_ts", late)
    found = partial.groupBy(F.window("_ts", window).alias("_window"), "dim").agg(total.alias("value"))
    value = F.col("value")
    if over == "bind":
        value = value % 2 if arch.kind == BSC else 1 - 2 * (value % 2)
    elif normalized and arch.kind == MAP:
        value = F.when(value >= 0, 1).otherwise(-1).cast("long")
    return found.select(F.col("_window.start").alias("window_start"), "dim", value.alias("value"))
