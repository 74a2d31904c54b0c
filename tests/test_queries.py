"""Every registered query of the core against its SQL, or a fold in NumPy where SQL has none."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as entry
from hyperloom import queries
from hyperloom.functions import kernels
from oracle import connect, same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() == queries.SIZE


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())


def test_validated_subset_takes_every_row(spark, tmp_path, monkeypatch):
    """Rows of small, null and other values all count, and all types of event are checked against the codebook."""
    events = [("view", 0.5), ("view", 1.0), ("click", None), ("click", -3.0), ("click", 7.0), ("error", 0.0), (None, 2.0)]
    spark.createDataFrame(events, "event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    checked = []
    validate = queries.Subset.validate
    monkeypatch.setattr(queries.Subset, "validate", lambda self: checked.append((self, validate(self))))
    found = queries.QUERIES["validated_subset_map"](spark, str(tmp_path)).orderBy("dim").collect()
    arch = queries.arch("map")
    symbol = lambda name: kernels.symbol(arch, name, queries.SIZE)
    wanted = sum(kernels.bind("map", symbol("event_type"), symbol(t)) for t, _ in events if t)
    np.testing.assert_array_equal([r["value"] for r in found], wanted)
    subset = checked[0][0]
    assert subset.df.count() == len(events) and not subset.codebook.source.sameSemantics(subset.df)


@pytest.mark.parametrize("kind", ["hrr", "vtb"])
@pytest.mark.parametrize("name", ["bind_dataset", "bind_entire_dataset"])
def test_products_of_real_vectors(spark, sf_dir, kind, name):
    rows = sorted(
        (r["n_nationkey"], r["n_name"], r["r_name"])
        for r in spark.read.parquet(f"{sf_dir}/nation.parquet")
        .join(spark.read.parquet(f"{sf_dir}/region.parquet").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
        .collect()
    )
    arch, size = queries.arch(kind), queries.SIZE
    cell = lambda c, v: kernels.bind(kind, kernels.symbol(arch, c, size), kernels.symbol(arch, v, size))
    acc = None
    for _, nation, region in rows:
        a, b = cell("n_name", nation), cell("r_name", region)
        row = kernels.normalize(kind, a + b) if name == "bind_dataset" else kernels.bind(kind, a, b)
        acc = row if acc is None else kernels.bind(kind, acc, row)
    found = queries.QUERIES[f"{name}_{kind}"](spark, sf_dir).orderBy("dim").collect()
    np.testing.assert_allclose([r["value"] for r in found], acc / np.linalg.norm(acc), rtol=1e-5, atol=2e-6)


def test_rows_of_real_vectors(spark, sf_dir):
    arch, size = queries.arch("hrr"), queries.SIZE
    first = spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy("o_orderkey").first()
    cells = [kernels.bind("hrr", kernels.symbol(arch, c, size), kernels.symbol(arch, first[c], size)) for c in queries.ORDERS]
    found = queries.QUERIES["bind_rows_hrr"](spark, sf_dir).where(f"o_orderkey = {first['o_orderkey']}").orderBy("dim").collect()
    np.testing.assert_allclose([r["value"] for r in found], kernels.bind("hrr", *cells), atol=1e-6)
