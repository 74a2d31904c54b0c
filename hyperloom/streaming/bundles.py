"""Bundles over streams: an unnormalized bundle is a mergeable sum, so a windowed count is enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.operators.codebook import Codebook
from hyperloom.operators.subset import Subset
from hyperloom.plans.tables import scratch_path


def cell_counts(stream: DataFrame, columns: list[str], time_col: str, *, window: str, late: str) -> DataFrame:
    """``window_start, column, value, n`` of a stream: how often each cell occurs in each window.

    Rows later than ``late`` are dropped by the watermark, and state is kept per (window, cell), so
    its size follows the distinct cells and not the rows. Null cells are skipped.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])
    rows = stream.select(F.col(time_col).cast("timestamp").alias("_ts"), F.explode(cells).alias("c")).where("c.value IS NOT NULL")
    counted = rows.withWatermark("_ts", late).groupBy(F.window("_ts", window), F.col("c.column").alias("column"), F.col("c.value").alias("value"))
    return counted.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "column", "value", "n")


def bundle_counts(codebook: Codebook, counts: DataFrame, *, normalized: bool = False) -> DataFrame:
    """``window_start, dim, value``: the bundle of each window, from the counts of its cells.

    For a batch of counts, such as ``foreachBatch`` gives or a sink of ``cell_counts`` holds. BSC
    bundles depend on the order of rows and cannot be made from counts.
    """
    if not codebook.arch.additive:
        raise ValueError("counts don't determine a BSC bundle")
    columns = sorted(r["column"] for r in counts.select("column").distinct().collect())
    folds = Subset(codebook, counts.select("window_start", *[_only(c) for c in columns]), group_by=("window_start",))
    kernel = folds._kernel("bundle", "column", False)
    at: Column = F.lit(None).cast("int")
    for k, c in enumerate(columns):
        at = F.when(F.col("column") == c, k).otherwise(at)
    rows = counts.groupBy("window_start", at.alias("_k"), F.col("value").alias("_v")).agg(F.sum("n").alias("_n"))
    return folds._finish(folds._sums(rows, folds._cell_vector(kernel), 2, kernel), normalized)


def _only(column: str) -> Column:
    return F.when(F.col("column") == column, F.col("value")).alias(column)


def tuple_counts(stream: DataFrame, columns: list[str], time_col: str, *, window: str, late: str) -> DataFrame:
    """``window_start, columns..., n`` of a stream: how often each row of cells occurs in each window.

    All folds that don't depend on the order of rows follow from these counts, as ``Subset(...,
    group_by=("window_start",), weight="n")``. State is kept per (window, distinct row); rows without any
    cell are skipped, and rows of windows that the watermark has passed are dropped.
    """
    there = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in columns]).isNotNull()
    rows = stream.where(there).select(F.col(f"`{time_col}`").cast("timestamp").alias("_ts"), *[F.col(f"`{c}`") for c in columns])
    counted = rows.withWatermark("_ts", late).groupBy(F.window("_ts", window).alias("_window"), *[F.col(f"`{c}`") for c in columns])
    return counted.agg(F.count(F.lit(1)).alias("n")).select(F.col("_window.start").alias("window_start"), *[F.col(f"`{c}`") for c in columns], "n")


def stream_of(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A parquet table as a stream; ``options`` are those of Spark's file source."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    # A stream reads folders; a table that is one file is found by its name.
    folder, _, name = path.rstrip("/").rpartition("/")
    if _is_folder(spark, path):
        return reader.option("pathGlobFilter", "*.parquet").parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)


def drained(result: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each of ``keys`` of a streaming aggregation, once all that is there now has been read.

    The query runs with ``availableNow`` into a table of the shared folder. In update mode each batch
    writes the rows that it changed, so state goes once the watermark has passed a window; a batch
    that is run again overwrites its own rows. A stream without rows gives none.
    """
    spark = result.sparkSession
    out = scratch_path(spark, "stream")
    spark.createDataFrame([], result.schema).write.parquet(f"{out}/rows/batch=-1")
    query = (
        result.writeStream.outputMode("update")
        .option("checkpointLocation", f"{out}/checkpoint")
        .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    found = spark.read.schema(T.StructType([*result.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{out}/rows")
    others = [F.max_by(F.struct(F.col(f"`{c}`")), "batch")[c].alias(c) for c in result.columns if c not in keys]
    return found.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*others)


def stream_counts(spark: SparkSession, path: str, columns: list[str], time_col: str, *, window: str, late: str) -> DataFrame:
    """``cell_counts`` of a parquet table that is read as a stream until all of it has been counted."""
    counts = cell_counts(stream_of(spark, path), columns, time_col, window=window, late=late)
    return drained(counts, ["window_start", "column", "value"])


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
