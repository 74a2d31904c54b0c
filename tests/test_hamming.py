"""The index of parts against all distances in NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException

from hyperloom.operators import hamming
from hyperloom.operators.hamming import Parts, nearest
from hyperloom.plans import tables


def words(bits: np.ndarray) -> list[int]:
    filled = np.pad(bits.astype(np.uint8), (0, -len(bits) % 64))
    return np.packbits(filled, bitorder="little").view(np.int64).tolist()


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, words array<bigint>")


def wanted(queries, candidates, k):
    out = []
    for q, a in queries:
        ranked = sorted((int((a != b).sum()), -i) for i, b in candidates)[:k]
        out += [(q, r + 1, -i, d) for r, (d, i) in enumerate(ranked)]
    return sorted(out)


def found(df):
    return sorted((r["query"], r["rank"], r["id"], r["distance"]) for r in df.collect())


@pytest.mark.parametrize("size", [50, 64, 130])
@pytest.mark.parametrize("broadcast", [True, False])
def test_nearest(spark, monkeypatch, size, broadcast):
    """Near and far queries, copies that tie, ids that repeat, nulls; hot values; by index and by blocks."""
    if not broadcast:
        monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(hamming, "HOT_ROWS", 3)
    monkeypatch.setattr(hamming, "CHEAPER", 1.0)
    rng = np.random.default_rng(size)
    centres = rng.integers(0, 2, (8, size))
    near = [np.where(rng.random(size) < rng.choice([0, 0.03, 0.1]), 1 - centres[i % 8], centres[i % 8]) for i in range(80)]
    candidates = [(int(i), v) for i, v in zip(rng.permutation(120), [*near, *rng.integers(0, 2, (40, size))], strict=True)]
    candidates += [candidates[3], (500, candidates[3][1]), (501, candidates[3][1])]
    queries = [(i, v) for i, v in enumerate([*centres, *rng.integers(0, 2, (4, size)), candidates[3][1]])] + [(2, centres[2])]
    c = frame(spark, [*[(i, words(v)) for i, v in candidates], (900, None), (None, words(centres[0]))]).repartition(4)
    q = frame(spark, [*[(i, words(v)) for i, v in queries], (77, None)])
    assert found(nearest(q, c, size, k=5, direct=0)) == wanted(queries, candidates, 5)
    if broadcast and size == 50:
        assert found(nearest(q, c, size, k=200, direct=0)) == wanted(queries, candidates, 200)
        assert found(nearest(q, c, size, k=5)) == wanted(queries, candidates, 5)
        assert nearest(q.where("false"), c, size).collect() == [] and nearest(q, c.where("false"), size).collect() == []


def test_near_queries_need_no_scan(spark, monkeypatch):
    """Queries whose neighbours are near are all answered by the index."""
    asked = []
    keep = hamming.most_similar
    monkeypatch.setattr(hamming, "most_similar", lambda q, *a, **o: asked.append(q.count()) or keep(q, *a, **o))
    rng = np.random.default_rng(1)
    many = rng.integers(0, 2, (2000, 128))
    near = many[:30].copy()
    near[:, :9] ^= 1
    rows = nearest(frame(spark, [(i, words(v)) for i, v in enumerate(near)]), frame(spark, [(i, words(v)) for i, v in enumerate(many)]), 128, direct=0)
    assert [(r["query"], r["id"], r["distance"]) for r in rows.orderBy("query").collect()] == [(i, i, 9) for i in range(30)]
    assert asked == [0]


def test_parts():
    assert Parts.of(64, 1 << 20).spans == [(0, 16), (16, 16), (32, 16), (48, 16)]
    assert Parts(10, 3).spans == [(0, 4), (4, 3), (7, 3)]
    assert Parts.of(3, 1000).spans == [(0, 3)]


def test_other_sizes_raise(spark):
    with pytest.raises(PySparkException, match="have 2 words"):
        nearest(frame(spark, [(1, [1, 2])]), frame(spark, [(1, [1])]), 100).collect()
