"""Combinations by recurrence, ordered products of groups and ties, dictionary codes, and the size of what is broadcast."""

from __future__ import annotations

import time
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hyperloom import api
from hyperloom.architectures import Architecture, ColumnTypeMismatchError, InvalidDataTypeError, ValueNotFoundError
from hyperloom.functions import kernels
from hyperloom.operators import subset as subset_module
from hyperloom.operators.codebook import Codebook, as_codes
from hyperloom.operators.rows import RowKernel, encoding_of
from hyperloom.operators.subset import Subset


def kernel(kind: str, size: int, columns: int, ways: int) -> RowKernel:
    return RowKernel(Architecture(kind), size, [f"c{k}" for k in range(columns)], encoding_of("column"), "combos", normalized=False, ways=ways)


def cells_of(columns: int, rows: int, seed: int = 3) -> list[list[str | None]]:
    rng = np.random.default_rng(seed)
    return [[None if rng.random() < 0.2 else f"v{rng.integers(4)}" for _ in range(rows)] for _ in range(columns)]


@pytest.mark.parametrize("ways", [0, 1, 2, 3, 6])
@pytest.mark.parametrize("kind", ["map", "hrr", "vtb"])
def test_combinations_are_enumerated(kind, ways):
    """The recurrence and the shared prefixes give what every combination on its own gives, nulls left out."""
    made = kernel(kind, 64, 6, ways)
    columns = cells_of(6, 40)
    columns = [[*c, None] for c in columns]
    acc, valid = made(columns, [""] * 41)
    for i in range(41):
        there = [made.cell(k, columns[k][i]) for k in range(6) if columns[k][i] is not None]
        total = np.zeros(64)
        for n in range(1, ways + 1):
            for chosen in combinations(there, n):
                term = chosen[0]
                for more in chosen[1:]:
                    term = kernels.bind(kind, term, more)
                total += term
        assert valid[i] == (bool(there) and ways > 0)
        np.testing.assert_allclose(acc[i], total, atol=1e-9)


@pytest.mark.parametrize("kind", ["map", "hrr"])
def test_wide_rows_take_columns_times_ways(kind):
    """Three times the columns cost about three times as much; the combinations would be eighty times as many."""

    def seconds(columns: int) -> float:
        made, cells = kernel(kind, 1024, columns, 4), cells_of(columns, 50)
        made(cells, [""] * 50)
        began = time.perf_counter()
        for _ in range(5):
            made(cells, [""] * 50)
        return time.perf_counter() - began

    assert seconds(30) < 9 * seconds(10) + 0.05


def test_wide_tables(spark):
    """Thirty columns, and the same from the whole table at once as from its rows."""
    names = [f"c{k}" for k in range(30)]
    cells = cells_of(30, 60)
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(zip(*cells, strict=True))], "i int, " + ", ".join(f"{c} string" for c in names))
    book = Codebook.from_dataframe(Architecture("map"), 32, df.drop("i"))
    folds = Subset(book, df, order_by="i")
    rows = [r["vector"] for r in folds.bundle_rows_combinatorial(4).orderBy("i").collect()]
    want, _ = RowKernel(book.arch, 32, names, encoding_of("column"), "combos", normalized=False, ways=4)(cells, [""] * 60)
    assert rows == want.tolist()
    found = folds.bundle_dataset_combinatorial(4).orderBy("dim").collect()
    assert [r["value"] for r in found] == want.sum(axis=0).tolist()


PLANTS = [("oak", "tree"), ("fern", None), ("moss", "low"), (None, "tree")]


def product(arch, size, rows) -> np.ndarray:
    """The left fold over rows of cells, kept at unit length."""
    acc = None
    for row in rows:
        vectors = [kernels.bind("vtb", kernels.symbol(arch, c, size), kernels.symbol(arch, v, size)) for c, v in zip(("plant", "form"), row, strict=True) if v is not None]
        vec = vectors[0] if len(vectors) == 1 else kernels.bind("vtb", *vectors)
        acc = vec if acc is None else kernels.bind("vtb", acc, vec)
        acc = acc / np.linalg.norm(acc)
    return acc


@pytest.mark.parametrize("partitions", [1, 3, 40])
@pytest.mark.parametrize("grouped", [False, True])
def test_products_have_one_order(spark, grouped, partitions):
    """Rows that share their order value are in the order of their cells, nulls first, in every group and
    however the input is dealt; one order value and one group hold most rows."""
    arch, size = Architecture("vtb"), 64
    rng = np.random.default_rng(partitions)
    rows = [("g1" if rng.random() < 0.7 else f"g{rng.integers(30)}" if rng.random() < 0.9 else None, int(rng.integers(5)) if rng.random() < 0.3 else 2, *PLANTS[rng.integers(4)]) for _ in range(900)]
    schema = "`my.g` string, day int, plant string, form string"
    book = Codebook.from_dataframe(arch, size, spark.createDataFrame(rows, schema).select("plant", "form"))
    key = lambda r: (r[1], *[(v is not None, v or "") for v in r[2:]])
    wanted = {}
    for g in {r[0] for r in rows} if grouped else {"all"}:
        wanted[g] = product(arch, size, [r[2:] for r in sorted((r for r in rows if not grouped or r[0] == g), key=key)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for shuffled in (rows, rows[::-1], [rows[i] for i in rng.permutation(len(rows))]):
            df = spark.createDataFrame(shuffled, schema).repartition(5)
            df = df if grouped else df.drop("my.g")
            found = Subset(book, df, order_by="day", group_by=("my.g",) if grouped else ()).bind_entire_dataset().collect()
            made = {}
            for r in found:
                made.setdefault(r["my.g"] if grouped else "all", np.zeros(size))[r["dim"]] = r["value"]
            assert set(made) == set(wanted)
            for g, vec in made.items():
                np.testing.assert_allclose(vec / np.linalg.norm(vec), wanted[g], atol=1e-7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_hot_order_value_is_split(spark):
    """Rows of one order value with many cells go to several segments."""
    arch = Architecture("vtb")
    df = spark.range(400).select(F.lit(1).alias("day"), F.format_string("v%d", "id").alias("plant"))
    book = Codebook.from_dataframe(arch, 16, df.select("plant"))
    found = []
    original = subset_module.written
    try:
        subset_module.written = lambda d, name: found.append(original(d, name)) or found[-1]
        result = Subset(book, df, order_by="day").bind_entire_dataset()
    finally:
        subset_module.written = original
    assert found[-1].count() > 1
    names = sorted(r["plant"] for r in df.collect())
    vec = np.array([r["value"] for r in result.orderBy("dim").collect()])
    np.testing.assert_allclose(vec / np.linalg.norm(vec), product(arch, 16, [(v, None) for v in names]), atol=1e-6)


def test_pandas_categories(spark):
    """Categories keep their order, and the unused one is there."""
    df = pd.DataFrame({"x": pd.Categorical(["b", None, "a", "b"], ["z", "b", "a"]), "y": ["b", "q", None, "q"]})
    vsa = api.MultiplyAddPermute(42)
    s = api.Storage.from_dataframe(vsa, 64, df)
    assert s.codebook.columns == {"x": ("z", "b", "a"), "y": None}
    assert s.values()[:4] == ["x", "z", "b", "a"] and s.get_column_value("x", "z") is not None and s.get_column_value("x", "q") is None
    plain = api.Storage.from_dataframe(vsa, 64, df.astype(object).where(df.notna(), None), enums={"x": ["z", "b", "a"]})
    for fold in ("bundle_dataset", "bundle_dataset_unnormalized", "bind_dataset", "bind_entire_dataset"):
        text = plain.subset(df.astype(object).where(df.notna(), None))
        assert getattr(s.subset(df), fold)().equals(getattr(text, fold)()) and getattr(plain.subset(df), fold)().equals(getattr(text, fold)())
    assert [None if v is None else v.to_list() for v in s.subset(df).bundle_rows()] == [None if v is None else v.to_list() for v in text.bundle_rows()]
    for other in (["b", "z", "a"], ["z", "b", "a", "n"]):
        with pytest.raises(ColumnTypeMismatchError):
            s.subset(df.assign(x=pd.Categorical(df["x"], other))).bundle_dataset()
    with pytest.raises(InvalidDataTypeError):
        api.Storage.from_dataframe(vsa, 64, pd.DataFrame({"x": pd.Categorical([3, 4])}))


def test_arrow_dictionaries(spark):
    """Also where chunks have dictionaries of their own."""
    column = pa.chunked_array([pa.array(["a", "b", None]).dictionary_encode(), pa.array(["c", "a", "c"]).dictionary_encode()])
    s = api.Storage.from_dataframe(api.MultiplyAddPermute(1), 32, pa.table({"x": column}))
    assert s.codebook.columns == {"x": ("a", "b", "c")}
    text = api.Storage.from_dataframe(api.MultiplyAddPermute(1), 32, pa.table({"x": column.cast(pa.string())}))
    found = s.subset(pa.table({"x": column})).bundle_dataset_unnormalized()
    assert found.equals(text.subset(pa.table({"x": column.cast(pa.string())})).bundle_dataset_unnormalized())
    empty = api.Storage.from_dataframe(api.MultiplyAddPermute(1), 32, pa.table({"x": column.slice(0, 0)}))
    assert list(empty.codebook.columns) == ["x"]


def test_codes(spark):
    """Codes are counted as integers, also for BSC and in groups; unknown values and codes are errors."""
    df = spark.createDataFrame([(i, f"g{i % 2}", "bca"[i % 3] if i % 4 else None, "xy"[i % 2]) for i in range(30)], "i int, g string, a string, b string")
    enums = {"a": ["c", "b", "a"], "b": ["x", "y", "none"]}
    coded = as_codes(df, enums)
    assert [f.dataType.simpleString() for f in coded.schema] == ["int", "string", "int", "int"]
    for kind in ("map", "bsc", "hrr", "vtb"):
        book = Codebook.from_dataframe(Architecture(kind), 64, df.select("a", "b"), enums=enums)
        one, two = Subset(book, df, "i", ("g",), enums), Subset(book, coded, "i", ("g",))
        two.validate()
        for fold in ("bundle_dataset", "bind_dataset", "bundle_dataset_with_binding"):
            pick = lambda d: sorted((r["g"], r["dim"], round(r["value"], 7)) for r in d.collect())
            assert pick(getattr(one, fold)()) == pick(getattr(two, fold)())
    with pytest.raises(ValueNotFoundError, match="code 3"):
        Subset(book, coded.withColumn("b", (F.col("b") + 2).alias("b", metadata={"enum": enums["b"]})), "i", ("g",)).validate()
    with pytest.raises(Exception, match="value 'a' not found in column 'a'"):
        as_codes(df, {"a": ["c", "b"]}).collect()


def test_long_cells_are_not_broadcast(spark, monkeypatch):
    """Few distinct tuples of long texts: their bytes count, and rows then make their own vectors."""
    df = spark.range(40).select(F.col("id"), F.concat(F.lit("x" * 5000), (F.col("id") % 20).cast("string")).alias("t"))
    book = Codebook.from_dataframe(Architecture("map"), 16, df.select("t"))
    folds = Subset(book, df, order_by="id")
    want = sorted((r["id"], r["vector"]) for r in folds.bundle_rows().collect())
    assert "BroadcastExchange" in folds.bundle_rows()._jdf.queryExecution().toString()
    monkeypatch.setattr(subset_module, "BROADCAST_BYTES", 50_000)
    assert folds._few_tuples() is None
    assert "BroadcastExchange" not in folds.bundle_rows()._jdf.queryExecution().toString()
    assert sorted((r["id"], r["vector"]) for r in folds.bundle_rows().collect()) == want
