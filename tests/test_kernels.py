"""Golden vectors, and the array columns against the NumPy kernels."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hyperloom.architectures import Architecture, InvalidSizeError
from hyperloom.functions import kernels, symbols, vectors
from hyperloom.functions.sql import register

# Two vectors of each algebra and what operations make of them.
GOLDEN = {
    "bsc": {
        "v1": [0, 1, 0, 0, 1], "v2": [1, 1, 0, 1, 0], "bound": [1, 0, 0, 1, 1], "permuted": [0, 0, 1, 0, 1],
        "similarity": -0.2,
    },
    "map": {
        "v1": [-1, 1, -1, -1, 1], "v2": [1, 1, -1, 1, -1], "bound": [-1, 1, 1, -1, -1], "permuted": [-1, -1, 1, -1, 1],
        "bundled": [0, 2, -2, 0, 0], "similarity": -0.2,
    },
    "hrr": {
        "v1": [0.2, -0.4, 0.1, 0.6, -0.3], "v2": [-0.5, 0.7, 0.2, -0.1, 0.4], "bound": [-0.36, 0.26, -0.02, -0.45, 0.71],
        "inverse": [0.2, -0.3, 0.6, 0.1, -0.4], "permuted": [0.1, 0.6, -0.3, 0.2, -0.4], "bundled": [-0.3, 0.3, 0.3, 0.5, 0.1],
        "similarity": -0.6819617073816743,
    },
    "vtb": {
        "v1": [0.2, -0.1, 0.3, 0.4, -0.5, 0.6, -0.7, 0.8, -0.9], "v2": [-0.3, 0.5, -0.2, 0.7, -0.6, 0.1, 0.4, -0.8, 0.9],
        "bound": [-0.29444863728670917, 0.3983716857408417, 0.7447818472546173, -0.8487048957087499, 1.1085125168440815, 1.905255888325765, 1.368320137979413, -1.8359738560230099, -2.9964478970941575],
        "inverse": [0.2, 0.4, -0.7, -0.1, -0.5, 0.8, 0.3, 0.6, -0.9], "permuted": [-0.7, 0.8, -0.9, 0.2, -0.1, 0.3, 0.4, -0.5, 0.6],
        "bundled": [-0.1, 0.4, 0.1, 1.1, -1.1, 0.7, -0.3, 0.0, 0.0], "similarity": -0.4421052631578948,
    },
}
KINDS = list(GOLDEN)


def data(kind: str, values: list[float]) -> np.ndarray:
    return np.array(values, np.float64 if kind in ("hrr", "vtb") else np.int8)


@pytest.mark.parametrize("kind", KINDS)
def test_golden_kernels(kind):
    g = GOLDEN[kind]
    a, b = data(kind, g["v1"]), data(kind, g["v2"])
    np.testing.assert_allclose(kernels.bind(kind, a, b), g["bound"], atol=1e-6)
    np.testing.assert_allclose(kernels.permute(a, 3), g["permuted"])
    assert kernels.similarity(kind, a, b) == pytest.approx(g["similarity"], abs=1e-6)
    if "bundled" in g:
        np.testing.assert_allclose(kernels.denormalize(kind, a) + b, g["bundled"], atol=1e-6)
    if "inverse" in g:
        np.testing.assert_allclose(kernels.inverse(kind, a), g["inverse"])
    else:
        with pytest.raises(TypeError):
            kernels.inverse(kind, a)


@pytest.mark.parametrize("kind", KINDS)
def test_golden_columns(spark, kind):
    g, arch = GOLDEN[kind], Architecture(kind)
    row = spark.createDataFrame([(g["v1"], g["v2"])], f"a array<{arch.element()}>, b array<{arch.element()}>")
    a, b = F.col("a"), F.col("b")
    asked = {"bound": vectors.bind(arch, a, b), "permuted": vectors.permute(a, 3), "similarity": vectors.similarity(arch, a, b)}
    if "bundled" in g:
        asked["bundled"] = vectors.bundle(arch, vectors.denormalize(arch, a), b)
    if "inverse" in g:
        asked["inverse"] = vectors.inverse(arch, a)
    found = row.select(*[c.alias(k) for k, c in asked.items()]).first()
    for k in asked:
        np.testing.assert_allclose(found[k], g[k], atol=1e-6)


@pytest.mark.parametrize("kind", KINDS)
def test_symbols_agree(spark, kind):
    arch = Architecture(kind, 7, "s")
    names = ["a", "Größe", "with blank", "", "3-MEDIUM"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", symbols.symbol(arch, F.col("n"), 289).alias("v")).collect()
    for r in rows:
        np.testing.assert_allclose(r["v"], kernels.symbol(arch, r["n"], 289), rtol=1e-12)


def test_rotation_examples(spark):
    row = spark.createDataFrame([([1, 0, 1, 0, 1], [])], "a array<int>, e array<int>")
    found = row.select(*[vectors.permute(F.col("a"), s).alias(f"p{s}") for s in (0, 2, 5, 7)], vectors.permute(F.col("e"), 3).alias("e")).first()
    assert (found["p0"], found["p2"], found["p5"], found["p7"], found["e"]) == ([1, 0, 1, 0, 1], [0, 1, 1, 0, 1], [1, 0, 1, 0, 1], [0, 1, 1, 0, 1], [])


def test_zero_vectors(spark):
    arch = Architecture("hrr")
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "z array<double>, a array<double>")
    found = row.select(vectors.similarity(arch, F.col("z"), F.col("a")).alias("s"), vectors.normalize(arch, F.col("z")).alias("n")).first()
    assert found["s"] == 0.0 and found["n"] == [0.0, 0.0]
    assert kernels.similarity("hrr", np.zeros(2), np.ones(2)) == 0.0


def test_parse_sizes(spark):
    row = spark.createDataFrame([([0.5, 0.4, 1.0, -1.0],)], "a array<double>")
    a = F.col("a")
    found = row.select(
        vectors.parse(Architecture("bsc"), a).alias("bsc"),
        vectors.parse(Architecture("map"), a, 4).alias("map"),
        vectors.parse(Architecture("map"), a, 5).alias("wrong"),
        vectors.parse(Architecture("vtb"), F.slice(a, 1, 3)).alias("vtb"),
    ).first()
    assert (found["bsc"], found["map"], found["wrong"], found["vtb"]) == ([1, 0, 1, 0], [1, 1, 1, -1], None, None)


def test_valid_sizes():
    assert [Architecture("vtb").valid_size(n) for n in (0, 1, 9, 128)] == [False, True, True, False]
    with pytest.raises(InvalidSizeError, match="invalid vector size"):
        Architecture("vtb").check_size(128)
    with pytest.raises(ValueError, match="size must be > 0"):
        Architecture("map").check_size(0)
    with pytest.raises(ValueError, match="unknown architecture"):
        Architecture("none")
    with pytest.raises(ValueError, match="square"):
        kernels.bind("vtb", np.ones(8), np.ones(8))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(0, 2**32 - 1))
def test_vtb_bind_is_a_matrix_product(d, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, d * d))
    wanted = [np.sqrt(d) * sum(b[r * d + c] * a[k * d + c] for c in range(d)) for k in range(d) for r in range(d)]
    np.testing.assert_allclose(kernels.bind("vtb", a, b), wanted, atol=1e-9)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 33), st.integers(0, 2**32 - 1))
def test_hrr_bind_is_a_convolution(n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, n))
    wanted = [sum(a[i] * b[(k - i) % n] for i in range(n)) for k in range(n)]
    np.testing.assert_allclose(kernels.bind("hrr", a, b), wanted, atol=1e-9)


@pytest.mark.parametrize("kind", KINDS)
def test_sql_functions(spark, kind):
    arch = Architecture(kind)
    names = register(spark, arch, prefix="t_")
    assert ("t_inverse" in names) == (not arch.self_inverse) and ("t_bundle" in names) == arch.additive
    found = spark.sql("SELECT t_bind(t_symbol('a', 16), t_symbol('b', 16)) AS v, t_similarity(t_symbol('a', 16), t_permute(t_symbol('a', 16), 16)) AS s").first()
    a, b = kernels.symbol(arch, "a", 16), kernels.symbol(arch, "b", 16)
    np.testing.assert_allclose(found["v"], kernels.bind(kind, a, b), atol=1e-12)
    assert found["s"] == pytest.approx(1.0)
