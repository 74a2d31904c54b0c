"""Packed words against arrays, and bit-sliced counts against sums."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hyperloom.architectures import Architecture
from hyperloom.functions import kernels
from hyperloom.operators import packed


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 5), st.integers(0, 2**32), st.integers(1, 300))
def test_counts(n, width, seed, cut):
    """However rows are dealt to counters, the majority is that of the sums; ties are 1."""
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 2**64, (n, width), np.uint64) & rng.integers(0, 2**64, (n, width), np.uint64) | rng.integers(0, 2**64, (1, width), np.uint64)
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.int64)
    one, two = packed.Counts(), packed.Counts()
    for part, into in ((words[:cut], one), (words[cut : 2 * cut], two), (words[2 * cut :], one)):
        if len(part):
            into.add(part)
    one.merge(two)
    assert one.n == n
    counted = sum((1 << k) * np.unpackbits(p.view(np.uint8), bitorder="little").astype(np.int64) for k, p in enumerate(one.planes))
    assert (counted == bits.sum(axis=0)).all()
    found = np.unpackbits(one.majority().view(np.uint8), bitorder="little")
    assert (found == (2 * bits.sum(axis=0) >= n)).all()


@pytest.mark.parametrize("kind", ["bsc", "map"])
@pytest.mark.parametrize("size", [1, 20, 63, 64, 65, 128, 200])
def test_words_are_arrays(spark, kind, size):
    """Bind and permute on words are those on arrays, at any size and shift."""
    arch = Architecture(kind)
    a, b = (kernels.symbol(arch, n, size) for n in "ab")
    df = spark.createDataFrame([(a.tolist(), b.tolist()), (None, b.tolist())], "a array<tinyint>, b array<tinyint>")
    words = df.select(packed.pack(F.col("a")).alias("a"), packed.pack(F.col("b")).alias("b"))
    shifts = sorted({0, 1, size - 1, size + 3, 63, 64, 65, 130})
    made = [packed.unpack(arch, packed.bind(arch, F.col("a"), F.col("b"), size), size), *[packed.unpack(arch, packed.permute(F.col("a"), s, size), size) for s in shifts]]
    one, none = words.select(*[c.alias(f"c{i}") for i, c in enumerate(made)]).collect()
    assert one["c0"] == kernels.bind(kind, a, b).tolist()
    for i, s in enumerate(shifts, 1):
        assert one[f"c{i}"] == kernels.permute(a, s).tolist()
    assert set(none) == {None}


@pytest.mark.parametrize("held", [1 << 22, 1])
def test_majority(spark, monkeypatch, held):
    """Groups, one of them null and one with most rows; null vectors have no vote."""
    monkeypatch.setattr(packed, "HELD_WORDS", held)
    size, rng = 100, np.random.default_rng(2)
    rows = [("hot" if rng.random() < 0.7 else None if rng.random() < 0.3 else f"g{rng.integers(5)}", rng.integers(0, 2, size).tolist() if rng.random() < 0.9 else None) for _ in range(400)]
    df = spark.createDataFrame([*rows, ("nulls", None)], "`a.g` string, v array<tinyint>").repartition(7).withColumn("w", packed.pack(F.col("v")))
    found = packed.majority(df, "w", size, group_by=("a.g",)).withColumn("v", packed.unpack(Architecture("bsc"), F.col("words"), size)).collect()
    groups = {g for g, v in rows if v is not None}
    assert {r["a.g"] for r in found} == groups and len(found) == len(groups)
    for r in found:
        votes = np.array([v for g, v in rows if g == r["a.g"] and v is not None])
        assert r["n"] == len(votes) and r["v"] == (2 * votes.sum(axis=0) >= len(votes)).astype(int).tolist()
    whole = packed.majority(df, "w", size).first()
    assert whole["n"] == sum(v is not None for _, v in rows) and packed.majority(df.where("false"), "w", size).collect() == []
    with pytest.raises(Exception, match="words"):
        packed.majority(df, "w", 300).collect()
