"""A codebook as a versioned table: names are only added, and every version stays readable.

Under its path, ``about`` holds the architecture, and ``version=0``, ``version=1``, ... the names that
each version added. A symbol keeps its ``idx`` for ever. A version counts once Spark has marked its
write as done, so a write that fails half way leaves the versions before it as they were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.architectures import Architecture
from hyperloom.operators.codebook import SCHEMA, Codebook
from hyperloom.plans.tables import numbered, written

ABOUT = "kind string, seed long, stream string, size int, columns array<struct<name:string,categories:array<string>>>"


@dataclass(frozen=True)
class StoredCodebook:
    """The codebook at ``path``. Objects hold no state but their path: others may extend it meanwhile."""

    spark: SparkSession
    path: str

    @staticmethod
    def create(path: str, book: Codebook) -> StoredCodebook:
        """Store ``book`` as version 0; ``path`` must not exist."""
        spark = book.names.sparkSession
        columns = [(name, None if c is None else list(c)) for name, c in book.columns.items()]
        about = spark.createDataFrame([(book.arch.kind, book.arch.seed, book.arch.stream, book.size, columns)], ABOUT)
        about.coalesce(1).write.parquet(f"{path}/about")
        book.names.select("idx", "name").write.parquet(f"{path}/version=0")
        return StoredCodebook(spark, path)

    def versions(self) -> list[int]:
        """The versions whose writes are done, in order."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = hadoop(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = []
        for status in files.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("version=") and files.exists(hadoop(status.getPath(), "_SUCCESS")):
                found.append(int(name.removeprefix("version=")))
        found.sort()
        return [v for i, v in enumerate(found) if v == i]

    def names(self, version: int | None = None) -> DataFrame:
        """``idx, name, version``: the names up to a version (the last one if None), and when each came."""
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"there is no version {version}; the last one is {known[-1]}")
        paths = [f"{self.path}/version={v}" for v in known if version is None or v <= version]
        schema = T.StructType.fromDDL(SCHEMA).add("version", "integer")
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths)

    def read(self, version: int | None = None) -> Codebook:
        """The codebook as it was at a version."""
        about = self.spark.read.schema(ABOUT).parquet(f"{self.path}/about").first()
        columns = {c["name"]: None if c["categories"] is None else tuple(c["categories"]) for c in about["columns"]}
        names = self.names(version).select("idx", "name")
        return Codebook(Architecture(about["kind"], about["seed"], about["stream"]), about["size"], names, columns)

    def extend(self, names: DataFrame, *, name_col: str = "name", order_by: str | None = None) -> int:
        """Add a table of names; returns the new version.

        Names that are there already, nulls and repeats add nothing: one anti-join of the distinct new
        names, which are numbered behind the old ones by the least ``order_by`` of each, else by name.
        Names are numbered by range, so no task gets them all. Where another writer has taken the
        same version, the write raises and nothing is changed.
        """
        versions = self.versions()
        known = self.names(versions[-1])
        order = F.col(order_by) if order_by else F.lit(0)
        rows = names.select(F.col(name_col).alias("name"), order.alias("_order")).where("name IS NOT NULL")
        rows = rows.groupBy("name").agg(F.min("_order").alias("_order")).join(known.select("name"), "name", "left_anti")
        top = known.agg(F.max("idx")).first()[0]
        start, version = 0 if top is None else top + 1, versions[-1] + 1
        placed = numbered(written(rows, "new-names"), ["_order", "name"], "_place")
        placed.select((F.col("_place") + start).alias("idx"), "name").write.parquet(f"{self.path}/version={version}")
        return version
