"""Codebooks, lookups, selectors, checks of tables, and the folds as expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hyperloom import api
from hyperloom.architectures import (
    Architecture,
    ColumnNotFoundError,
    ColumnTypeMismatchError,
    InvalidDataTypeError,
    ValueNotFoundError,
)
from hyperloom.functions import kernels
from hyperloom.operators.codebook import Cell, Codebook, ColumnKey, Index
from hyperloom.operators.subset import Subset
from hyperloom.plans.expression import UnknownValueError

ENUMS = {"metal": ["iron", "copper", "tin"], "ore": ["hematite", "malachite", "cassiterite"], "use": ["rails", "wire", "solder", "roofs"]}
ROWS = [("iron", "hematite", "rails"), ("copper", "malachite", "wire"), ("copper", "malachite", "roofs")]
KINDS = {"bsc": api.BinarySpatterCode, "map": api.MultiplyAddPermute, "hrr": api.HolographicReducedRepresentation, "vtb": api.VectorDerivedTransformationBinding}


@pytest.fixture(scope="module")
def shapes(spark):
    df = spark.createDataFrame([("red", "circle"), ("green", "square"), ("blue", "circle")], "color string, shape string")
    return Codebook.from_dataframe(Architecture("map"), 16, df, enums={"shape": ["circle", "square", "triangle"]})


def test_catalogue(shapes):
    names = [r["name"] for r in shapes.names.orderBy("idx").collect()]
    assert names == ["blue", "green", "red", "color", "shape", "circle", "square", "triangle"]
    assert list(shapes.columns) == ["color", "shape"]


def test_first_appearance(spark):
    df = spark.createDataFrame([(2, "a"), (1, "c"), (3, None), (0, "b"), (4, "c")], "k int, v string")
    book = Codebook.from_dataframe(Architecture("bsc"), 8, df, order_by="k")
    assert [r["name"] for r in book.names.orderBy("idx").collect()] == ["b", "c", "a", "v"]


@pytest.mark.parametrize(
    ("key", "name"),
    [
        ("triangle", "triangle"),
        (Index(2), "red"),
        (Index(99), None),
        ("none", None),
        (ColumnKey("color"), "color"),
        (ColumnKey("red"), None),
        (Cell("color", "circle"), "circle"),
        (Cell("shape", "red"), None),
        (Cell("shape", "triangle"), "triangle"),
        (Cell("size", "red"), None),
    ],
)
def test_lookup(shapes, key, name):
    found = shapes.get(key).first()
    assert (found and found["name"]) == name
    if name is None:
        with pytest.raises(KeyError):
            shapes[key]


def test_selectors(shapes):
    names = lambda s: [r["name"] for r in shapes.select(s).orderBy("pos").collect()]
    assert names(["red", "none", "circle", "red", Index(0)]) == ["red", "circle", "red", "blue"]
    assert names(ColumnKey("shape")) == ["circle", "square", "triangle"]
    assert len(names(ColumnKey("color"))) == len(names(None)) == 8
    assert names(ColumnKey("none")) == []


def test_find_takes_the_last_of_ties(shapes):
    assert shapes.find(shapes["red"], ["red", "blue", "red"]).first()["pos"] == 2
    assert shapes.find(shapes["red"], []).first() is None
    assert [r["name"] for r in shapes.find(shapes["red"], k=3).collect()][0] == "red"
    with pytest.raises(ValueError, match="elements"):
        shapes.find(np.ones(3))


def test_execute(shapes):
    np.testing.assert_array_equal(shapes.execute("red * green"), shapes["red"] * shapes["green"])
    with pytest.raises(UnknownValueError, match="x"):
        shapes.execute("red + x + y")


def test_wrong_tables(spark, shapes):
    with pytest.raises(InvalidDataTypeError, match="invalid data type for column 'n'"):
        Codebook.from_dataframe(Architecture("map"), 16, spark.range(1).select(F.col("id").alias("n")))
    frame = lambda *rows, schema="color string": spark.createDataFrame(rows, schema)
    Subset(shapes, frame(("red",), ("circle",), (None,))).validate()
    with pytest.raises(ColumnNotFoundError, match="column 'size' not found"):
        Subset(shapes, frame(("red",), schema="size string")).validate()
    with pytest.raises(ColumnTypeMismatchError, match="incompatible"):
        Subset(shapes, frame(("circle",), schema="shape string")).validate()
    with pytest.raises(ValueNotFoundError, match="value 'pink' not found in column 'color'"):
        Subset(shapes, frame(("pink",))).validate()
    with pytest.raises(ValueNotFoundError):
        Subset(shapes, frame(("red",), schema="shape string"), enums={"shape": ["circle", "square", "triangle"]}).validate()
    with pytest.raises(ValueError, match="without columns"):
        Subset(shapes, frame(("red",)).drop("color")).validate()


def storage(kind: str, size: int) -> tuple[api.Storage, pd.DataFrame]:
    df = pd.DataFrame(ROWS, columns=list(ENUMS))
    return api.Storage.from_dataframe(KINDS[kind](42), size, df, enums=ENUMS), df


def text_of(row: tuple, how: str) -> str:
    """A row as an expression: its cells, bundled or bound."""
    cells = [f"({c} * {v})" for c, v in zip(ENUMS, row, strict=True)]
    return "(" + (" + " if how == "bundle" else " * ").join(cells) + ")"


SUMS, PRODUCTS = ([text_of(r, how) for r in ROWS] for how in ("bundle", "bind"))


@pytest.mark.parametrize("kind", ["map", "hrr", "vtb"])
def test_folds_are_expressions(spark, kind):
    s, df = storage(kind, 1024)
    subset = s.subset(df)
    close = lambda vec, text: np.testing.assert_allclose(vec.data, s.execute(text).data, atol=1e-9)
    close(subset.bundle_dataset(), " + ".join(SUMS))
    close(subset.bind_dataset(), " * ".join(SUMS))
    close(subset.bundle_dataset_with_binding(), " + ".join(PRODUCTS))
    if kind == "vtb":
        one, two, three = subset.bind_rows()
        np.testing.assert_allclose(subset.bind_entire_dataset().data, (one * two * three).data, atol=1e-9)
    else:
        close(subset.bind_entire_dataset(), " * ".join(PRODUCTS))
    close(subset.bundle_dataset_temporal(), " + ".join(f"{a} * ({b} ^ 1) * ({c} ^ 2)" for a, b, c in ROWS))
    for row, text in zip(subset.bundle_rows(), SUMS, strict=True):
        close(row, text)
    np.testing.assert_allclose(subset.bundle_dataset_unnormalized().data, sum(r.data for r in subset.bundle_rows_unnormalized()), atol=1e-9)
    np.testing.assert_allclose(subset.bundle_dataset_combinatorial(2).data, sum(r.data for r in subset.bundle_rows_combinatorial(2)), atol=1e-9)
    np.testing.assert_allclose(
        subset.bundle_dataset_temporal_unnormalized().data, sum(r.data for r in subset.bind_rows("position")), atol=1e-9
    )


def test_bsc_folds(spark):
    s, df = storage("bsc", 1000)
    subset = s.subset(df)
    rows = subset.bundle_rows()
    assert subset.bind_dataset().equals(rows[0] * rows[1] * rows[2])
    agree = (rows[0].data == rows[1].data) & (rows[1].data == rows[2].data)
    np.testing.assert_array_equal(subset.bundle_dataset().data[agree], rows[0].data[agree])
    last = [s.execute(f"{c} * {v}") for c, v in zip(ENUMS, ROWS[0], strict=True)]
    assert rows[0].similarity(last[2]) > rows[0].similarity(last[0])


def test_nulls_and_empty_tables(spark):
    s, _ = storage("map", 64)
    df = spark.createDataFrame([("tin", None, "solder"), (None, None, None)], ", ".join(f"{c} string" for c in ENUMS))
    rows = s.subset(df).bundle_rows()
    assert rows[0].equals(s.execute("metal*tin + use*solder")) and rows[1] is None
    assert s.subset(df).bundle_dataset().equals(rows[0])
    assert s.subset(df).bundle_dataset_combinatorial(0) is None
    for none in (df.where("false"), df.where("metal IS NULL")):
        subset = s.subset(none)
        assert subset.bundle_dataset() is None and subset.bind_dataset() is None and subset.bind_entire_dataset() is None
    for kind in ("bsc", "hrr", "vtb"):
        subset = storage(kind, 64)[0].subset(df.where("false"))
        assert subset.bundle_dataset() is None and subset.bind_dataset() is None and subset.bundle_rows() == []


def test_bsc_needs_an_order(spark):
    s, _ = storage("bsc", 64)
    df = spark.createDataFrame(ROWS, ", ".join(f"{c} string" for c in ENUMS))
    with pytest.raises(ValueError, match="order_by"):
        Subset(s.codebook, df).bundle_dataset()


def test_groups(spark):
    s, _ = storage("map", 32)
    df = spark.createDataFrame([(k % 2, *ROWS[k % 2]) for k in range(10)], "g int, metal string, ore string, use string")
    for fold in ("bundle_dataset", "bind_dataset", "bind_entire_dataset"):
        found = getattr(Subset(s.codebook, df, group_by=("g",)), fold)()
        for g in (0, 1):
            alone = getattr(Subset(s.codebook, df.where(F.col("g") == g).drop("g")), fold)()
            pick = lambda d: [r["value"] for r in d.orderBy("dim").collect()]
            assert pick(found.where(F.col("g") == g)) == pick(alone)


def shared_order(spark, values: list[str]):
    """Many rows, few cells, and the given order values in turn."""
    rows = [(values[k % len(values)], *ROWS[k % 3]) for k in range(1200)]
    return spark.createDataFrame(rows, "day string, metal string, ore string, use string").repartition(5)


@pytest.mark.parametrize("days", [["d1"], ["d1", "d2"], ["d1", "d2", "d3"]])
@pytest.mark.parametrize("grouped", [False, True])
def test_bsc_rows_that_share_their_order(spark, days, grouped):
    """As many rows as one likes under one order value: the last that agrees with the tie bits counts, else the first row."""
    size, arch = 200, Architecture("bsc")
    book = Codebook.from_dataframe(arch, size, spark.createDataFrame(ROWS, ", ".join(f"{c} string" for c in ENUMS)))
    df = shared_order(spark, days)
    df = df.withColumn("g", F.lit(None).cast("string")) if grouped else df
    found = Subset(book, df, order_by="day", group_by=("g",) if grouped else ()).bundle_dataset_with_binding()
    cell = lambda c, v: kernels.symbol(arch, c, size) ^ kernels.symbol(arch, v, size)
    vectors = {r: cell("metal", r[0]) ^ cell("ore", r[1]) ^ cell("use", r[2]) for r in ROWS}
    pairs = {(r["day"], (r["metal"], r["ore"], r["use"])) for r in df.select("day", *ENUMS).distinct().collect()}
    wanted = np.full(size, -1)
    for day in sorted(days, reverse=True):
        tie = kernels.tie(arch, size, "row", day)
        for d, row in pairs:
            takes = (wanted < 0) & (vectors[row] == tie) & (d == day)
            wanted[takes] = tie[takes]
    first = vectors[min(r for d, r in pairs if d == min(days))]
    wanted = np.where(wanted < 0, first, wanted)
    assert [r["value"] for r in found.orderBy("dim").collect()] == wanted.tolist()


@pytest.mark.parametrize("kind", ["hrr", "vtb"])
def test_long_products_stay_in_range(spark, kind):
    """A product of thousands of rows that leaves the range of doubles has unit length."""
    size, arch = 64, Architecture(kind)
    book = Codebook.from_dataframe(arch, size, spark.createDataFrame(ROWS, ", ".join(f"{c} string" for c in ENUMS)))
    rows = [(k, *ROWS[k * k % 3]) for k in range(4000)]
    df = spark.createDataFrame(rows, "k int, metal string, ore string, use string").repartition(6)
    found = [r["value"] for r in Subset(book, df, order_by="k").bind_entire_dataset().orderBy("dim").collect()]
    cell = lambda c, v: kernels.bind(kind, kernels.symbol(arch, c, size), kernels.symbol(arch, v, size))
    vectors = {r: kernels.bind(kind, kernels.bind(kind, cell("metal", r[0]), cell("ore", r[1])), cell("use", r[2])) for r in ROWS}
    acc = None
    for _, *row in rows:
        acc = vectors[tuple(row)] if acc is None else kernels.bind(kind, acc, vectors[tuple(row)])
        acc = acc / np.linalg.norm(acc)
    np.testing.assert_allclose(np.array(found) / np.linalg.norm(found), acc, atol=1e-6)
    assert np.isfinite(found).all() and np.linalg.norm(found) > 0


@pytest.mark.parametrize("kind", KINDS)
def test_expressions_as_columns(spark, kind):
    """The same vector from Column expressions over the codebook as from NumPy on the driver."""
    book = Codebook.empty(spark, Architecture(kind), 16).extend(["a", "b", "c"])
    for text in ("a", "a * b ^ 2 + c", "(a + b + c) * b + a ^ 3"):
        (row,) = book.evaluate(text).collect()
        np.testing.assert_allclose(row["vec"], book.execute(text), atol=1e-9)
    with pytest.raises(UnknownValueError, match="x"):
        book.evaluate("a + x")


def test_many_pushes(spark):
    """The plan of the names stays short however often a codebook is extended."""
    book = Codebook.empty(spark, Architecture("map"), 8)
    for i in range(20):
        book = book.push(f"n{i}")
    assert [r["name"] for r in book.names.orderBy("idx").collect()] == [f"n{i}" for i in range(20)]
    assert book.names._jdf.queryExecution().analyzed().toString().count("Union") <= 16


def test_column_scope(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "a"), (None, "d")], "x string, y string")
    book = Codebook.from_dataframe(Architecture("map"), 8, df)
    names = lambda **how: {r["name"] for r in book.select(ColumnKey("x"), **how).collect()}
    assert names() == {"a", "b", "c", "d", "x", "y"} and names(scope="column") == {"a", "c"}
    with pytest.raises(ValueError, match="scope"):
        names(scope="other")
    with pytest.raises(ValueError, match="no table"):
        Codebook.empty(spark, Architecture("map"), 8).select(ColumnKey("x"), scope="column")
