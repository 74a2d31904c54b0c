"""Codebooks as versioned tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hyperloom.architectures import Architecture
from hyperloom.operators.codebook import Codebook, ColumnKey
from hyperloom.operators.stored import StoredCodebook


def pairs(df) -> list[tuple]:
    return [(r["idx"], r["name"]) for r in df.orderBy("idx").collect()]


def test_versions(spark, tmp_path):
    """Old indices stay, every version stays readable, and names that are known or null add nothing."""
    df = spark.createDataFrame([("red", "circle"), ("blue", None)], "color string, shape string")
    book = Codebook.from_dataframe(Architecture("map", 7, "s"), 32, df, enums={"shape": ["circle", "square"]})
    stored = StoredCodebook.create(str(tmp_path / "book"), book)
    first = pairs(book.names)
    assert stored.versions() == [0] and pairs(stored.read().names) == first
    more = spark.createDataFrame([("red", 1), ("zinc", 3), (None, 0), ("amber", 5), ("zinc", 9), ("circle", 2)], "name string, k int")
    assert stored.extend(more, order_by="k") == 1
    assert pairs(stored.read().names) == [*first, (6, "zinc"), (7, "amber")]
    assert stored.extend(more) == 2 and stored.extend(spark.createDataFrame([("a",), ("0",)], "t string"), name_col="t") == 3
    again = StoredCodebook(spark, str(tmp_path / "book"))
    assert pairs(again.read(0).names) == first and pairs(again.read(2).names) == pairs(again.read(1).names)
    assert pairs(again.read().names)[-2:] == [(8, "0"), (9, "a")]
    assert {(r["name"], r["version"]) for r in again.names().where("version > 0").collect()} == {("zinc", 1), ("amber", 1), ("a", 3), ("0", 3)}
    back = again.read(1)
    assert back.arch == book.arch and back.size == 32 and back.columns == book.columns
    assert [r["name"] for r in back.select(ColumnKey("shape")).orderBy("pos").collect()] == ["circle", "square"]
    assert back.get("zinc").first()["vec"] == Codebook.empty(spark, book.arch, 32).push("zinc").get("zinc").first()["vec"]
    with pytest.raises(ValueError, match="no version 9"):
        again.read(9)


def test_half_a_write_is_no_version(spark, tmp_path):
    path = str(tmp_path / "book")
    stored = StoredCodebook.create(path, Codebook.empty(spark, Architecture("bsc"), 8))
    assert pairs(stored.read().names) == [] and stored.extend(spark.createDataFrame([("x",)], "name string")) == 1
    spark.createDataFrame([(1, "lost")], "idx long, name string").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/version=2")
    assert stored.versions() == [0, 1] and pairs(stored.read().names) == [(0, "x")]
    with pytest.raises(Exception, match="already exists"):
        stored.extend(spark.createDataFrame([("y",)], "name string"))


def test_a_million_names(spark, tmp_path):
    """A large table of names, half of them known."""
    stored = StoredCodebook.create(str(tmp_path / "book"), Codebook.empty(spark, Architecture("map"), 8))
    names = lambda n: spark.range(n).select(F.format_string("n%07d", "id").alias("name"))
    stored.extend(names(500_000))
    assert stored.extend(names(1_000_000)) == 2
    found = stored.read().names
    assert found.count() == 1_000_000 and found.where(F.format_string("n%07d", "idx") != F.col("name")).count() == 0
    assert stored.read(1).names.count() == 500_000
