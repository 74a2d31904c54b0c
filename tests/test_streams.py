"""Folds of streams against the same folds of batches, and what late rows do."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from hyperloom.architectures import BSC, HRR, MAP, VTB, Architecture
from hyperloom.operators.codebook import Codebook
from hyperloom.operators.subset import Subset
from hyperloom.streaming.bundles import drained, stream_of, tuple_counts
from hyperloom.streaming.folds import windowed_fold

START = dt.datetime(2024, 3, 1)
SCHEMA = "k long, ts timestamp, a string, b string"
KEYS = ["window_start", "dim"]


def rows_of(n: int, hours: float = 0.5) -> list[tuple]:
    """Rows over some days; nulls, and equal rows, among them."""
    return [(i, START + dt.timedelta(hours=hours * (i * 7 % n)), None if i % 5 == 0 else f"v{i % 3}", None if i % 10 == 0 else f"w{i % 4}") for i in range(n)]


def folder(spark, tmp_path, files: list[list[tuple]]) -> str:
    """A folder of one file for each list, read in that order."""
    out = tmp_path / "rows"
    out.mkdir()
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).toPandas().astype({"ts": "datetime64[us]"}).to_parquet(out / f"{i}.parquet")
        os.utime(out / f"{i}.parquet", (1_700_000_000 + 10 * i,) * 2)
    return str(out)


def days(df):
    return df.where("ts IS NOT NULL").withColumn("window_start", F.window(F.col("ts").cast("timestamp"), "1 day")["start"])


def by_key(df):
    return {(str(r["window_start"]), r["dim"]): r["value"] for r in df.collect()}


CASES = [
    (BSC, "bundle_dataset"),
    (BSC, "bundle_dataset_with_binding"),
    (BSC, "bind_dataset"),
    (BSC, "bind_entire_dataset"),
    (MAP, "bundle_dataset"),
    (MAP, "bind_dataset"),
    (HRR, "bundle_dataset_with_binding"),
]


@pytest.mark.parametrize(("kind", "fold"), CASES)
def test_same_as_batch(spark, tmp_path, kind, fold):
    rows = [*rows_of(120), (500, None, "v1", "w1"), (501, START, None, None)]
    path = folder(spark, tmp_path, [rows[::3], rows[1::3], rows[2::3]])
    book = Codebook(Architecture(kind, 3), 32, spark.createDataFrame([], "idx long, name string"), {"a": None, "b": None})
    stream = stream_of(spark, path, maxFilesPerTrigger="1")
    found = by_key(drained(windowed_fold(book, stream, ["a", "b"], "ts", fold, window="1 day", late="30 days", order_by="k"), KEYS))
    batch = days(spark.read.parquet(path)).select("window_start", "k", "a", "b")
    options = {"normalized": False} if "bundle" in fold and kind != BSC else {}
    wanted = by_key(getattr(Subset(book, batch, "k", ("window_start",)), fold)(**options))
    assert found.keys() == wanted.keys()
    assert all(found[k] == pytest.approx(wanted[k], abs=1e-9) for k in wanted)
    assert len(found) >= 3 * 32


@pytest.mark.parametrize("kind", [BSC, MAP, HRR])
def test_counts_of_rows_make_products(spark, tmp_path, kind):
    rows = rows_of(90)
    path = folder(spark, tmp_path, [rows[:40], rows[40:]])
    book = Codebook(Architecture(kind, 3), 32, spark.createDataFrame([], "idx long, name string"), {"a": None, "b": None})
    counts = drained(tuple_counts(stream_of(spark, path, maxFilesPerTrigger="1"), ["a", "b"], "ts", window="1 day", late="30 days"), ["window_start", "a", "b"])
    found = by_key(Subset(book, counts, group_by=("window_start",), weight="n").bind_entire_dataset())
    wanted = by_key(Subset(book, days(spark.read.parquet(path)).select("window_start", "a", "b"), group_by=("window_start",)).bind_entire_dataset())
    assert found.keys() == wanted.keys()
    assert all(found[k] == pytest.approx(wanted[k], rel=1e-6, abs=1e-9) for k in wanted)


def test_shared_orders_and_no_agreement(spark, tmp_path):
    """All rows share one order value: dimensions stay open, and the first row by its cells fills them."""
    rows = [(7, START + dt.timedelta(hours=i), f"v{i % 3}", f"w{i % 2}") for i in range(12)]
    path = folder(spark, tmp_path, [rows[:5], rows[5:]])
    book = Codebook(Architecture(BSC, 3), 64, spark.createDataFrame([], "idx long, name string"), {"a": None, "b": None})
    stream = stream_of(spark, path, maxFilesPerTrigger="1")
    found = by_key(drained(windowed_fold(book, stream, ["a", "b"], "ts", "bundle_dataset_with_binding", window="1 day", late="1 day", order_by="k"), KEYS))
    batch = days(spark.read.parquet(path)).select("window_start", "k", "a", "b")
    assert found == by_key(Subset(book, batch, "k", ("window_start",)).bundle_dataset_with_binding())


def test_late_rows_are_dropped(spark, tmp_path):
    on_time = [(1, START, "v1", "w1"), (2, START + dt.timedelta(days=5), "v2", "w1")]
    late = [(3, START + dt.timedelta(hours=3), "v3", "w1"), (4, START + dt.timedelta(days=5, hours=-1), "v1", "w2")]
    path = folder(spark, tmp_path, [on_time, [(5, START + dt.timedelta(days=5, hours=1), "v2", "w2")], late])
    book = Codebook(Architecture(MAP, 3), 16, spark.createDataFrame([], "idx long, name string"), {"a": None, "b": None})
    stream = stream_of(spark, path, maxFilesPerTrigger="1")
    found = by_key(drained(windowed_fold(book, stream, ["a", "b"], "ts", "bundle_dataset_with_binding", window="1 day", late="1 day"), KEYS))
    kept = days(spark.read.parquet(path)).where("k <> 3").select("window_start", "a", "b")
    assert found == by_key(Subset(book, kept, group_by=("window_start",)).bundle_dataset_with_binding(normalized=False))


def test_no_rows(spark, tmp_path):
    path = folder(spark, tmp_path, [[]])
    book = Codebook(Architecture(MAP, 3), 16, spark.createDataFrame([], "idx long, name string"), {"a": None, "b": None})
    assert drained(windowed_fold(book, stream_of(spark, path), ["a", "b"], "ts", "bind_dataset", window="1 day", late="1 day"), KEYS).count() == 0


def test_weights(spark):
    book = Codebook(Architecture(MAP, 3), 16, spark.createDataFrame([], "idx long, name string"), {"a": None})
    once = spark.createDataFrame([("x", 3), ("y", 2), ("z", 0), ("z", -1), ("z", None)], "a string, n long")
    often = spark.createDataFrame([("x",)] * 3 + [("y",)] * 2, "a string")
    for fold in ("bundle_dataset", "bind_dataset"):
        get = lambda s: {r["dim"]: r["value"] for r in getattr(s, fold)().collect()}  # noqa: B023, E731
        assert get(Subset(book, once, weight="n")) == get(Subset(book, often))


def test_refused(spark, tmp_path):
    stream = stream_of(spark, folder(spark, tmp_path, [rows_of(3)]))
    for kind, fold, more in ((VTB, "bind_dataset", {}), (HRR, "bundle_dataset", {"normalized": True}), (BSC, "bundle_dataset", {})):
        book = Codebook(Architecture(kind, 3), 16, spark.createDataFrame([], "idx long, name string"), {"a": None, "b": None})
        with pytest.raises(ValueError, match=r"vector|order_by"):
            windowed_fold(book, stream, ["a", "b"], "ts", fold, window="1 day", late="1 day", **more)
