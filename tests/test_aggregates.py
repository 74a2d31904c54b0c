"""Vectors of groups against folds in NumPy."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hyperloom.architectures import BSC, HRR, MAP, VTB, Architecture
from hyperloom.functions import kernels, vectors
from hyperloom.operators.aggregates import bind_groups, bind_sql, bundle_groups, bundle_sql


def made(spark, arch: Architecture, size: int):
    """Groups of several rows, one of one row, one of nulls only, and the null group; orders that repeat."""
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else "b", i // 2, kernels.symbol(arch, f"s{i}", size).tolist()) for i in range(40)]
    rows += [("one", 5, kernels.symbol(arch, "x", size).tolist()), ("none", 1, None), ("none", 2, None), ("b", 99, None)]
    df = spark.createDataFrame(rows, f"g string, o long, v array<{arch.element()}>")
    groups: dict = {}
    for g, o, v in rows:
        groups.setdefault(g, [])
        if v is not None:
            groups[g].append((o, np.array(v)))
    return df, groups


def last_agreeing(arch: Architecture, size: int, rows: list) -> list[int]:
    first = min(o for o, _ in rows)
    out = np.min([v for o, v in rows if o == first], axis=0)
    for o, v in sorted(rows, key=lambda r: r[0]):
        out = np.where(kernels.tie(arch, size, "row", o) == v, v, out)
    return out.tolist()


@pytest.mark.parametrize("size", [36, 64, 144])
@pytest.mark.parametrize("kind", [BSC, MAP, HRR, VTB])
def test_bundles(spark, kind, size):
    arch = Architecture(kind, 5)
    df, groups = made(spark, arch, size)
    found = {r["g"]: r["v"] for r in bundle_groups(df, ["g"], "v", arch, size, order_by="o" if kind == BSC else None).collect()}
    assert found.keys() == groups.keys()
    for g, rows in groups.items():
        if not rows:
            assert found[g] is None
        elif kind == BSC:
            assert found[g] == last_agreeing(arch, size, rows)
        else:
            np.testing.assert_allclose(found[g], np.sum([v for _, v in rows], axis=0, dtype=float), atol=1e-12)


@pytest.mark.parametrize("size", [36, 64, 144])
@pytest.mark.parametrize("kind", [BSC, MAP, HRR])
def test_products(spark, kind, size):
    arch = Architecture(kind, 5)
    df, groups = made(spark, arch, size)
    found = {r["g"]: r["v"] for r in bind_groups(df, ["g"], "v", arch, size).collect()}
    assert found.keys() == groups.keys()
    for g, rows in groups.items():
        if not rows:
            assert found[g] is None
        else:
            np.testing.assert_allclose(found[g], reduce(lambda a, b: kernels.bind(kind, a, b), [v for _, v in rows]), rtol=1e-5, atol=1e-9)


def test_products_out_of_range(spark):
    """Spectra far above and below one: the product has unit length. A zero vector makes a zero product."""
    arch = Architecture(HRR, 5)
    big, zero = [1e200] + [0.0] * 15, [0.0] * 16
    df = spark.createDataFrame([("big", big), ("big", big), ("zero", zero), ("zero", big)], "g string, v array<double>")
    found = {r["g"]: r["v"] for r in bind_groups(df, ["g"], "v", arch, 16).collect()}
    np.testing.assert_allclose(found["big"], [1.0] + [0.0] * 15, atol=1e-9)
    assert found["zero"] == zero


def test_in_sql(spark):
    """Beside other aggregates of one SELECT, and within ROLLUP."""
    arch = Architecture(MAP, 5)
    df, groups = made(spark, arch, 16)
    df.createOrReplaceTempView("agg_rows")
    found = spark.sql(f"SELECT g, grouping(g) AS whole, count(*) AS n, {bundle_sql(arch, 'v', 16)} AS s, {bind_sql(arch, 'v', 16)} AS p FROM agg_rows GROUP BY ROLLUP (g)").collect()
    total = next(r for r in found if r["whole"])
    every = [v for rows in groups.values() for _, v in rows]
    assert total["n"] == 44
    assert total["s"] == np.sum(every, axis=0, dtype=int).tolist()
    assert total["p"] == np.prod(every, axis=0).tolist()
    assert next(r for r in found if r["g"] == "one")["s"] == kernels.symbol(arch, "x", 16).tolist()


def test_bsc_in_sql(spark):
    arch = Architecture(BSC, 5)
    df, groups = made(spark, arch, 16)
    df.withColumn("t", vectors.tie_bits(arch, 16, F.lit("row"), F.col("o"))).createOrReplaceTempView("agg_bits")
    found = spark.sql(f"SELECT g, {bundle_sql(arch, 'v', 16, tie='t', order='o')} AS s FROM agg_bits GROUP BY g").collect()
    assert {r["g"]: r["s"] for r in found if r["g"] != "none"} == {g: last_agreeing(arch, 16, rows) for g, rows in groups.items() if rows}


def test_combines_within_tasks(spark):
    """A third of all rows in one group: tasks send sums, not rows. Clashing column names are kept."""
    arch = Architecture(MAP, 5)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("_b"), F.array(*[F.lit(1)] * 16).alias("_v"))
    out = bundle_groups(df, ["_b"], "_v", arch, 16)
    assert out.columns == ["_b", "_v"]
    assert out.where("`_b` = 0").first()["_v"] == [1000] * 16
    assert "partial_sum" in out._jdf.queryExecution().executedPlan().toString()


def test_normalized_empty_and_refused(spark):
    arch = Architecture(HRR, 5)
    df = spark.createDataFrame([("a", [3.0, 4.0])], "g string, v array<double>")
    assert bundle_groups(df, ["g"], "v", arch, 2, normalized=True).first()["v"] == [0.6, 0.8]
    assert bundle_groups(df.limit(0), ["g"], "v", arch, 2).count() == 0
    with pytest.raises(PySparkException, match="has not 3 elements but 2"):
        bundle_groups(df, ["g"], "v", arch, 3).collect()
    for f in (lambda: bind_groups(df, ["g"], "v", Architecture(VTB, 5), 4), lambda: bundle_groups(df, ["g"], "v", Architecture(BSC, 5), 2), lambda: bind_sql(arch, "v", 2)):
        with pytest.raises(ValueError, match=r"order|sums"):
            f()


@pytest.mark.parametrize("order", ["int", "string", "double"])
def test_bsc_orders(spark, order):
    """Null is the first of all orders, and rows of it count like others; whatever type orders have."""
    arch, size = Architecture(BSC, 5), 130
    rows = [("all" if i % 2 else "nulls", None if i % 2 == 0 or i % 5 == 0 else i % 4, kernels.symbol(arch, f"s{i}", size).tolist()) for i in range(24)]
    df = spark.createDataFrame(rows, "g string, o int, v array<tinyint>").withColumn("o", F.col("o").cast(order))
    found = {r["g"]: r["v"] for r in bundle_groups(df, ["g"], "v", arch, size, order_by="o").collect()}
    names = {r["o"]: "None" if r["o"] is None else r["name"] for r in df.select("o", F.col("o").cast("string").alias("name")).collect()}
    for g in ("all", "nulls"):
        last: list[int | None] = [None] * size
        mine = sorted(((o, v) for k, o, v in rows if k == g), key=lambda r: -1 if r[0] is None else r[0])
        for o, v in mine:
            tie = kernels.tie(arch, size, "row", names[o if o is None or order == "int" else str(o) if order == "string" else float(o)])
            last = [int(x) if x == t else was for x, t, was in zip(v, tie, last, strict=True)]
        assert found[g] == [mine[0][1][i] if x is None else x for i, x in enumerate(last)]
