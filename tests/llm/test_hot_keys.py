"""Keys that hold most rows, with adaptive execution off: results stay whole and the keys are dealt apart."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from fixtures import rows_of
from pyspark.sql import functions as F

from hyperloom.llm import common, components, mixing
from hyperloom.llm.common import meeting, written
from hyperloom.llm.decontaminate import contamination
from hyperloom.plans import tables

ADAPTIVE = "spark.sql.adaptive.enabled"


@pytest.fixture
def rigid(spark):
    before = spark.conf.get(ADAPTIVE)
    spark.conf.set(ADAPTIVE, "false")
    yield spark
    spark.conf.set(ADAPTIVE, before)


def test_a_star_of_a_million_links(rigid):
    """One node with a million neighbours, chained to a second star."""
    hub, n = 2_000_000, 1_000_000
    links = rigid.range(n).select(F.lit(hub).alias("u"), F.col("id").alias("v"))
    other = rigid.range(1000).select(F.lit(hub + 1).alias("u"), (F.col("id") + hub + 10).alias("v"))
    found = components.connected_components(links.union(other).union(rigid.createDataFrame([(n - 1, n), (hub + 5, hub + 6)], "u long, v long")))
    counts = {r["component"]: r["n"] for r in found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {0: n + 2, hub + 1: 1001, hub + 5: 2}


@pytest.mark.parametrize("limit", [None, 0])
def test_random_links_with_hubs(rigid, monkeypatch, limit):
    """Against a union-find, where every node of several links counts as hot, broadcast or salted."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "SALTS", 4)
    if limit is not None:
        monkeypatch.setattr(tables, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(7, k) for k in range(200, 230)]
    root = list(range(300))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    found = components.connected_components(rigid.createDataFrame(pairs, "u long, v long"))
    assert rows_of(found) == sorted([(x, find(x)) for x in nodes], key=str)


def test_ten_thousand_sources_by_three_topics(rigid):
    """Marginals of 30,000 cells, three values of one dimension among them, against the same rounds in NumPy."""
    topics = ["a", "b", "c"]
    rows = rigid.range(30_000).select(
        F.format_string("s%d", F.floor(F.col("id") / 3)).alias("source"),
        F.when(F.col("id") % 7 == 0, "x").otherwise("y").alias("lang"),
        F.element_at(F.array(*map(F.lit, topics)), (F.col("id") % 3 + 1).cast("int")).alias("topic"),
        (F.col("id") * F.col("id") % 1013 + 1).alias("n_tokens"),
    )
    found = mixing.calibrate(written(rows, "t-cells"), rounds=2, tolerance=1.0)
    assert found.n_cells == 30_000
    cells = rows.collect()
    w = np.array([float(r["n_tokens"]) for r in cells])
    tokens = w.copy()
    codes = {d: np.unique([r[d] for r in cells], return_inverse=True)[1] for d in mixing.DIMENSIONS}
    goals = {d: np.sqrt(np.bincount(codes[d], tokens)) for d in mixing.DIMENSIONS}
    for _ in range(2):
        for d in mixing.DIMENSIONS:
            w = w * (goals[d] / goals[d].sum() / np.bincount(codes[d], w))[codes[d]]
    want = {(r["source"], r["lang"], r["topic"]): p for r, p in zip(cells, w / tokens / (w / tokens).max(), strict=True)}
    made = found.cells.collect()
    np.testing.assert_allclose([r["probability"] for r in made], [want[r["source"], r["lang"], r["topic"]] for r in made], rtol=1e-9)


@pytest.mark.parametrize("limit", [tables.BROADCAST_BYTES, 300, 0])
def test_meeting(rigid, monkeypatch, limit):
    monkeypatch.setattr(tables, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = written(rigid.range(200).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.format_string("k%d", "id")).alias("key")), "t-rows")
    known = written(rigid.createDataFrame([("hot",), ("k3",), ("none",), *[(f"z{i}",) for i in range(50)]], "key string"), "t-known")
    assert {r["id"] for r in meeting(rows, known, "key").collect()} == {*range(0, 200, 2), 3}


def test_a_common_gram(rigid, monkeypatch):
    """A passage that nearly all documents hold, where the benchmark is too large to broadcast."""
    passage = " ".join(f"p{k}" for k in range(15))
    docs = rigid.createDataFrame([(i, f"a{i} b{i} {passage} c{i}" if i % 10 else f"clean text {i}") for i in range(120)], "doc_id long, text string")
    items = rigid.createDataFrame([(1, passage), (2, "p3 p4"), (3, "nothing of this kind")], "item_id long, text string")
    want = rows_of(contamination(docs, items))
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
    assert rows_of(contamination(docs, items)) == want
    by = defaultdict(int)
    for r in want:
        by[r[5]] += 1
    assert by == {True: 108, False: 12}
