"""Exact top-k of many queries against plain NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.architectures import Architecture
from hyperloom.functions import kernels
from hyperloom.operators import search
from hyperloom.operators.codebook import Codebook, ColumnKey
from hyperloom.operators.search import most_similar


def frame(spark, vectors: np.ndarray, kind: str, ids: list[int]):
    rows = [(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, f"id long, vec array<{'double' if kind in ('hrr', 'vtb') else 'tinyint'}>")


@pytest.mark.parametrize("kind", ["bsc", "map", "hrr", "vtb"])
@pytest.mark.parametrize(("block", "product"), [(1 << 20, 1 << 22), (700, 60)])
def test_most_similar(spark, monkeypatch, kind, block, product):
    """Copies that tie, ids that repeat, zero vectors, nulls; one block of queries or many."""
    monkeypatch.setattr(search, "PRODUCT", product)
    arch, rng = Architecture(kind), np.random.default_rng(4)
    made = {"bsc": lambda n: rng.integers(0, 2, (n, 25)), "map": lambda n: 2 * rng.integers(0, 2, (n, 25)) - 1}.get(kind, lambda n: rng.normal(size=(n, 25)))
    candidates = made(60)
    candidates[20:40] = candidates[5]
    queries = np.concatenate([made(9), candidates[[5, 6]]])
    if arch.real:
        queries[0] = candidates[1] = 0
    c_ids = [*rng.permutation(60).tolist()]
    q_ids = [*range(9), 3, 50]
    c = frame(spark, candidates, kind, c_ids).union(spark.createDataFrame([(99, None)], f"id long, vec array<{'double' if arch.real else 'tinyint'}>")).repartition(4)
    q = frame(spark, queries, kind, q_ids).union(c.where("vec IS NULL"))
    wanted = []
    for i, v in zip(q_ids, queries, strict=True):
        scores = [(float(kernels.similarity(kind, v, x)), j) for x, j in zip(candidates, c_ids, strict=True)]
        wanted += [(i, r + 1, j, round(s, 9)) for r, (s, j) in enumerate(sorted(scores, reverse=True)[:7])]
    found = most_similar(q, c, arch, k=7, block_bytes=block)
    assert sorted((r["query"], r["rank"], r["id"], round(r["similarity"], 9)) for r in found.collect()) == sorted(wanted)
    assert most_similar(q.where("false"), c, arch, k=2).collect() == [] and most_similar(q, c.where("false"), arch, k=2).collect() == []
    assert most_similar(q, c, arch, k=100).count() == 11 * 60


def test_find_all_is_find(spark):
    """The same symbols as one search for each query, also among the selected ones."""
    df = spark.createDataFrame([(f"a{i}", f"b{i % 5}") for i in range(40)], "x string, y string")
    book = Codebook.from_dataframe(Architecture("map"), 64, df, enums={"y": [f"b{i}" for i in range(6)]})
    texts = ["a1 + a2 + x", "a3 * y", "b1 + b2 + b3", "y"]
    queries = spark.createDataFrame([(i, book.execute(t).tolist()) for i, t in enumerate(texts)], "id long, vec array<tinyint>")
    for selector in (None, ColumnKey("y"), ["a1", "a3", "a1"]):
        found = book.find_all(queries, selector, k=3).collect()
        for i, t in enumerate(texts):
            wanted = [(r["pos"], r["name"], r["similarity"]) for r in book.find(book.execute(t), selector, k=3).collect()]
            assert [(r["pos"], r["name"], r["similarity"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query"] == i] == wanted


def test_rows_sent_follow_queries_and_k(spark, monkeypatch):
    """Each task sends k rows for each query at most, however many candidates there are."""
    sent = []
    keep = search.written
    monkeypatch.setattr(search, "written", lambda df, name: sent.append((name, keep(df, name))) or sent[-1][1])
    c = spark.range(5000).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: F.sin(F.col("id") * j)).alias("vec")).repartition(6)
    most_similar(c.where("id < 30"), c, Architecture("hrr"), k=4).collect()
    assert [d.count() <= 6 * 30 * 4 for name, d in sent if name == "best"] == [True]
