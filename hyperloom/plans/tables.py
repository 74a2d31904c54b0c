"""Tables in the folder that driver and executors share, and row numbers without one big sort task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark's own setting: shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What the setting was before each write that runs now; the first entry is the session's own.
_WRITES: list[str] = []
_LOCK = Lock()
#: Measured bytes of a table up to which it may be broadcast.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may leave it unset; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="hyperloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/hyperloom-{name}-{uuid.uuid4().hex}"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """``CLEANUP`` is on while any write of the session runs; the last to end puts it back."""
    with _LOCK:
        _WRITES.append(spark.conf.get(CLEANUP, "false"))
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            before = _WRITES.pop()
            if not _WRITES:
                spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder: lineage ends there, lost executors don't matter.

    Spark removes the job's shuffle files when the write ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def size_in_bytes(df: DataFrame) -> int:
    """What the rows of ``df`` take in memory, measured over all of them; nested values count by their elements."""

    def width(field: T.StructField) -> Column:
        at, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return 16 + F.octet_length(at)
        if isinstance(kind, T.ArrayType):
            inner = F.octet_length(F.array_join(at, "")) if isinstance(kind.elementType, T.StringType) else F.lit(0)
            return 24 + 16 * F.size(at) + inner
        return F.lit(16)

    row = sum((F.coalesce(width(f), F.lit(16)).cast("long") for f in df.schema), F.lit(32).cast("long"))
    return df.agg(F.sum(row)).first()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is at most ``limit`` bytes, else as it is."""
    return F.broadcast(df) if size_in_bytes(df) <= (BROADCAST_BYTES if limit is None else limit) else df


def numbered(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ``order``.

    Rows are sorted by range; only one count per range partition meets in one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each range partition.
    offsets = counts.select("_part", (before - F.col("_first")).alias("_shift"))
    return ranged.join(F.broadcast(offsets), "_part").select((F.col("_row") + F.col("_shift")).alias(name), *df.columns)
