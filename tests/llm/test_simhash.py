from __future__ import annotations

import numpy as np
import pytest
import xxhash
from fixtures import documents, empty
from pyspark.sql import functions as F

from hyperloom.llm import common, simhash
from hyperloom.llm.components import connected_components


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values: list[int], most: int) -> dict[int, int]:
    """Each value's least reachable value, by comparing all pairs."""
    parent = {v: v for v in values}

    def find(v: int) -> int:
        while parent[v] != v:
            v = parent[v]
        return v

    x = np.array(sorted(parent), np.uint64)
    for i, row in enumerate(x):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ row) <= most) + i + 1:
            a, b = sorted((find(int(row)), find(int(x[j]))))
            parent[b] = a
    return {v: find(v) for v in parent}


def check(found: list, texts: dict, most: int = 4) -> None:
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    part = components(list(fps.values()), most)
    least: dict[int, int] = {}
    for i, f in fps.items():
        if i is not None:
            least[part[f]] = min(i, least.get(part[f], i))
    assert len(found) >= len(texts)
    for r in found:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
        assert r["component_id"] == least[part[fps[r["doc_id"]]]]


def test_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(simhash.simhash_components(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


@pytest.mark.parametrize("hot", [100_000, 1])
def test_awkward_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(simhash, "NAMED_BYTES", 4 << 20 if hot > 1 else 0)
    docs = documents(spark)
    found = simhash.simhash_components(docs).collect()
    assert len(found) == docs.count()
    check(found, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert simhash.simhash_components(empty(spark)).collect() == []
    kept = simhash.keep_one_per_component(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in found}


def test_shared_ids_decide_nothing(spark):
    """A component of null ids stays, but no null id beside an ordinary one, and no id that is least elsewhere."""
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue white black grey")
    rows = [(None, a), (7, b), (None, b), (3, c), (5, c), (5, "quite another text of its own here"), (3, b), (2, b)]
    kept = simhash.keep_one_per_component(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in kept), key=str) == sorted([(None, a), (3, c), (5, rows[5][1]), (2, b)], key=str)


def test_slabs_make_no_difference(monkeypatch):
    text = " ".join(f"Word{i % 50}" for i in range(500)).encode()
    whole = simhash.fingerprint(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(simhash, "SLAB_BYTES", size)
        assert simhash.fingerprint(text) == whole == brute_fingerprint(text.decode())


def _values(kind: str) -> np.ndarray:
    rng = np.random.default_rng(5)
    if kind == "dense":  # a ball: all within a few bits of one another
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(700)], np.uint64)
        return np.unique(np.uint64(0x0123456789ABCDEF) ^ flips)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:200] ^ np.array([sum(1 << int(b) for b in rng.choice(64, k % 7, replace=False)) for k in range(200)], np.uint64)
    return np.unique(np.concatenate([base, near]))


@pytest.mark.parametrize("kind", ["dense", "sparse"])
@pytest.mark.parametrize("thresholds", [None, [3, 0], [-1, 2, 1], [0, 0, 0, 0, 0]])
def test_links(spark, monkeypatch, kind, thresholds):
    """Whatever the allocation, with buckets that are dealt anew, and with sets that are sorted by bits."""
    monkeypatch.setattr(simhash, "SMALL", 8)
    monkeypatch.setattr(simhash, "DIRECT", 500)
    values = _values(kind)
    if thresholds is not None:
        m = len(thresholds)
        parts = [(list(range(64))[k::m], t) for k, t in enumerate(thresholds) if t >= 0]
        assert sum(thresholds) == 4 - m + 1
        monkeypatch.setattr(simhash, "plan", lambda n, both, most: parts)
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    links = simhash.near_links(fps, max_distance=4, large=300)
    # A spanning forest of each bucket, so no more links than signatures.
    assert links.count() < 64 * 64 * len(values)
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    wanted = components([int(v) for v in values], 4)
    same = {}
    for v in values:
        own = found.get(int(v.view(np.int64)), int(v.view(np.int64)))
        assert same.setdefault(own, wanted[int(v)]) == wanted[int(v)]
    assert len(same) == len(set(wanted.values()))


def test_plan_covers():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (500, 64)).astype(float)
    x[:, 1] = x[:, 0]
    for n in (10, 10**5, 10**10):
        parts = simhash.plan(n, x.T @ x * n / 500, 4)
        bits = [b for group, _ in parts for b in group]
        assert len(bits) == len(set(bits))
        # Thresholds of unused partitions are -1: m - used of them.
        assert any(sum(t for _, t in parts) - (m - len(parts)) == 4 - m + 1 for m in range(2, 6))
    assert simhash.plan(0, np.zeros((64, 64)), 4)
    same = next(g for g, _ in simhash.plan(10**5, x.T @ x * 200, 4) if 0 in g)
    assert 1 in same


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)] + [(200, 201 + i) for i in range(40)]
    links = spark.createDataFrame(chain, "u long, v long")
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert found == {i: 0 for i in range(51)} | {100: 100, 101: 100} | {200 + i: 200 for i in range(41)}
    assert connected_components(links.where(F.lit(False))).collect() == []


@pytest.mark.parametrize("direct", [1 << 22, 1000, 0])
def test_within_bucket(monkeypatch, direct):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    for kind in ("dense", "sparse"):
        fp = _values(kind)
        wanted = components([int(v) for v in fp], 4)
        label = simhash.within_bucket(fp, 4)
        assert [int(fp[k]) for k in label] == [wanted[int(v)] for v in fp]
    assert len(simhash.within_bucket(fp[:0], 4)) == 0


def test_large_bucket_of_near_copies(spark):
    """Rows sent for a bucket grow in proportion to it, and its components are those of all pairs."""
    rng = np.random.default_rng(11)

    def ball(n: int) -> np.ndarray:
        flips = np.zeros(n, np.uint64)
        for _ in range(6):
            flips ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        return np.unique(np.uint64(0x0123456789ABCDEF) ^ flips)

    def sent(fp: np.ndarray) -> int:
        fps = spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp long")
        parts = simhash.plan(*simhash.bit_counts(fps), 4)
        return simhash.respread(simhash.signatures(fps, parts), 4, 1000)[0].count()

    small, large = ball(4_000), ball(16_000)
    assert sent(large) / len(large) < 4 * sent(small) / len(small)
    found = ball(100_000)
    label = simhash.within_bucket(found, 4)
    few = found[:3000]
    wanted = components([int(v) for v in few], 4)
    part: dict[int, int] = {}
    for v, k in zip(few, label, strict=False):
        assert part.setdefault(wanted[int(v)], int(k)) == int(k)
    alone = np.flatnonzero(np.bincount(label, minlength=len(found)) == 1)
    for i in alone[:50]:
        assert (np.bitwise_count(found ^ found[i]) <= 4).sum() == 1


def near_copies(pairs: int, words: int, share: float, seed: int) -> tuple[list[tuple], float]:
    """Texts under even ids, copies with replaced words under odd ones, and their mean Jaccard similarity of 4-word shingles."""
    rng = np.random.default_rng(seed)
    rows, found = [], []
    for k in range(pairs):
        text = [f"w{x}" for x in rng.integers(0, 20_000, words)]
        copy = list(text)
        for at in rng.choice(words, max(1, round(words * share)), replace=False):
            copy[at] = f"new{rng.integers(10**6)}"
        one, two = ({tuple(t[i : i + 4]) for i in range(words - 3)} for t in (text, copy))
        found.append(len(one & two) / len(one | two))
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
    return rows, float(np.mean(found))


def test_recall_of_near_copies(spark):
    """Measured, for the README: how many planted near copies four bits catch. They catch no other pairs."""
    measured = {}
    for share, low, high in ((0.0275, 0.0, 0.15), (0.0125, 0.05, 0.45), (0.006, 0.3, 0.8)):
        rows, jaccard = near_copies(300, 400, share, 11)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        parts = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs).collect()}
        assert all(c // 2 == i // 2 for i, c in parts.items())
        caught = sum(parts[2 * k] == parts[2 * k + 1] for k in range(300)) / 300
        measured[round(jaccard, 3)] = round(caught, 3)
        assert low <= caught <= high
    print("recall by mean Jaccard similarity:", measured)
