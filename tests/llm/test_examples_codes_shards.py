"""Fill-in-the-middle examples, vector codes and shards against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, empty, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hyperloom.llm import common, sharding, vector_codes
from hyperloom.llm.common import join_counted
from hyperloom.llm.fill_in_middle import fill_in_middle, rearranged, restore, restored
from hyperloom.llm.rope import build, join, split_chars, split_units

SENTINELS = ("<P>", "<S>", "<M>")


def heights(rope) -> int:
    """The height, where no node's children differ by more than one."""
    if rope.left is None:
        return 0
    a, b = heights(rope.left), heights(rope.right)
    assert abs(a - b) <= 1 and rope.height == max(a, b) + 1
    return rope.height


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\nß🙂", max_size=60), st.integers(1, 7), st.data())
def test_ropes(text, leaf, data):
    rope = build(text, leaf)
    assert str(rope or "") == text
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    if rope:
        heights(rope)
        assert (rope.chars, rope.units) == (len(text), len(lines))
    k = data.draw(st.integers(0, len(text) + 1))
    assert tuple(str(x or "") for x in split_chars(rope, k)) == (text[:k], text[k:])
    k = data.draw(st.integers(0, len(lines) + 1))
    a, b = split_units(rope, k)
    assert (str(a or ""), str(b or "")) == ("".join(lines[:k]), "".join(lines[k:]))
    back = join(b, a)
    if back:
        heights(back)
        assert str(back) == str(b or "") + str(a or "")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<PSM>\nx", max_size=40), st.integers(0, 99), st.integers(0, 99), st.sampled_from(["psm", "spm"]))
def test_examples_come_back(text, first, second, form):
    """Also from texts that are full of parts of sentinels."""
    if not text or any(s in text for s in SENTINELS):
        form = "plain"
    *_, output = rearranged(text, form, first, second)
    assert restored(output, form) == text


def example(ident, text, seed=7, rate=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return ident, len(lines), "plain", None, None, text, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return ident, len(lines), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", text


@pytest.mark.parametrize(("seed", "rate", "spm"), [(7, 100, 50), (1, 40, 100), (2, 0, 0)])
def test_fill_in_middle(spark, seed, rate, spm):
    lines = [(200 + k, "\n".join(f"line {i} {'ü🙂' * (i % 3)}" for i in range(k)) + "\n" * (k % 3)) for k in range(40)]
    lines += [(300, "a <P> b\nc"), (301, "<S>"), (302, "x\n<M>\ny"), (303, "<\nP>"), (304, "\n" * 9000), (305, "long" * 5000)]
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame(lines, "doc_id long, text string"))
    docs = docs.withColumns({c: F.lit("clash") for c in ("n", "form", "output", "_form", "_h1", "_cut", "other")})
    found = restore(fill_in_middle(docs, seed=seed, rate=rate, spm=spm))
    wanted = [example(r["doc_id"], r["text"], seed, rate, spm) for r in docs.collect()]
    assert rows_of(found, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored") == sorted(wanted, key=str)
    assert {tuple(r) for r in found.select("_form", "_h1", "_cut", "other").collect()} == {("clash",) * 4}
    assert restore(fill_in_middle(empty(spark))).collect() == []


def nearest(x, entries):
    return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(entries))


def codes(rows, parts, entries, rounds):
    """Codebooks and assignments in plain integers; rows are (id, vector, label) of finite vectors."""
    whole = [(i, [math.floor(256 * float(x)) for x in v], lab) for i, v, lab in rows]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(whole[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in whole[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in whole:
                members[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, got in members.items():
                books[p][k] = [sum(c) // len(got) for c in zip(*got, strict=True)]
    found, labels = [], Counter()
    for i, v, lab in whole:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        labels[lab] += error
        found.append((i, lab, "".join(f"{k:02x}" for _, k in best), error))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, code, error, labels[lab], digest) for i, lab, code, error in found], key=str)


@pytest.mark.parametrize(("n", "size", "parts", "entries", "rounds"), [(300, 24, 3, 16, 2), (40, 16, 16, 64, 2), (120, 20, 4, 256, 1), (50, 8, 1, 1, 3)])
def test_vector_codes(spark, n, size, parts, entries, rounds):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=size) * rng.choice([0.01, 0.3, 20])], int(rng.integers(3)) or None) for i in rng.permutation(n)]
    rows += [(7, rows[0][1], 9), (None, rows[1][1], None), rows[2], (n + 1, [0.0] * size, 1), (n + 2, [-0.001] * size, 1)]
    bad = [(1, None, 1), (2, [float("nan")] + [1.0] * (size - 1), 1), (3, [None] + [1.0] * (size - 1), 1), (4, [float("-inf")] * size, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").repartition(3).withColumns({"code": F.lit("clash"), "error": F.lit(1)})
    found = vector_codes.vector_codes(df, parts=parts, entries=entries, rounds=rounds)
    assert rows_of(found) == codes(rows, parts, entries, rounds)
    nothing = vector_codes.vector_codes(df.where("vec_id in (2, 3, 4) and error = 0"), parts=parts)
    assert nothing.columns == found.columns and nothing.collect() == []


def test_codes_decode(spark):
    df = spark.createDataFrame([(i, [i / 256, -i / 256, 1.0, 0.5], 0) for i in range(20)], "vec_id long, embedding array<double>, label int")
    books = vector_codes.fit(df, parts=2, entries=32)
    coded = vector_codes.encode(df, books)
    assert coded.agg(F.sum("error")).first()[0] == 0
    assert rows_of(coded.select("vec_id", vector_codes.decode(F.col("code"), books).alias("v"))) == rows_of(df, "vec_id", "embedding")
    for odd in ([1.0] * 3, [2.0**21] * 4):
        with pytest.raises(Exception, match="multiple|beyond"):
            vector_codes.vector_codes(df.union(spark.createDataFrame([(99, odd, 0)], df.schema)), parts=2).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 9), st.sampled_from([2, 200, 1 << 20, vector_codes.ROOM // 9]))
def test_bounds_lose_no_nearest_entry(seed, width, spread):
    """Ties, entries that repeat and components of any size."""
    rng = np.random.default_rng(seed)
    rows, entries = rng.integers(-spread, spread + 1, (50, width)), rng.integers(-spread, spread + 1, (20, width))
    entries[5] = entries[3]
    rows[:4] = entries[5]
    rows[4:8] = spread - 1 + rng.integers(0, 2, (4, width))
    entries[7:12] = spread - 1 + rng.integers(0, 2, (5, width))
    found, distance, _ = vector_codes.nearest(rows, entries)
    whole = ((rows[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert found.tolist() == whole.argmin(axis=1).tolist() and distance.tolist() == whole.min(axis=1).tolist()


def test_bounds_spare_most_distances(spark, sf_dir):
    kept = vector_codes.kept(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("embedding").toArrow()
    rows = vector_codes.integers(kept.column(0).combine_chunks(), 4)
    taken = sum(vector_codes.nearest(rows[:, p], rows[:64, p])[2] for p in range(4))
    assert taken < 0.4 * 4 * 64 * len(rows)


def placed(key, weights, seed=42):
    """Shards in the order of a key's ranking."""
    draw = lambda i: int(hashlib.md5(f"{seed}|{i}|{'' if key is None else key}".encode()).hexdigest()[:13], 16)
    scores = [(-math.log((draw(i) + 0.5) / 2**52) / w, i) for i, w in enumerate(weights) if w]
    return min(scores)[1], draw


@pytest.mark.parametrize(("weights", "added"), [((1.0,) * 16, (1.0,)), ((2.0, 0.0, 1.0, 0.5), (3.0, 1.0)), ((1.0,), ())])
def test_shards(spark, weights, added):
    docs = documents(spark).withColumns({c: F.lit("clash") for c in ("shard", "slot", "size", "law")})
    docs = docs.union(docs.where("doc_id = 5").crossJoin(spark.range(30)).drop("id")).repartition(5)
    rows = []
    for r in docs.collect():
        text = (r["text"] or "").encode()
        shard, draw = placed(r["doc_id"], weights)
        rows.append((shard, draw(shard), (r["doc_id"] is not None, r["doc_id"] or 0), len(text) + 1, zlib.crc32(text), r["doc_id"]))
    wanted, counts = [], Counter()
    for shard, _, _, size, crc, ident in sorted(rows, key=lambda r: r[:5]):
        wanted.append((ident, size, crc, "key", shard, counts[shard], placed(ident, [*weights, *added])[0]))
        counts[shard] += 1
    assert rows_of(sharding.slots(docs, weights=weights, added=added)) == sorted(wanted, key=str)
    assert sharding.slots(empty(spark)).collect() == []


def test_shares_and_moves(spark):
    """Shards get their weights' shares; a new one only takes, a heavier one only takes, a removed one only gives."""
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    old = (1.0, 2.0, 1.0, 4.0)
    named = {"old": old, "more": (*old, 2.0), "heavier": (1.0, 3.0, 1.0, 4.0), "without": (1.0, 2.0, 0.0, 4.0)}
    rows = keys.select(*[sharding.shard_of(F.col("doc_id"), w).alias(n) for n, w in named.items()]).collect()
    counts = Counter(r["old"] for r in rows)
    for shard, weight in enumerate(old):
        assert abs(counts[shard] / len(rows) - weight / 8) < 0.02
    assert {r["more"] for r in rows if r["more"] != r["old"]} == {4}
    assert abs(sum(r["more"] == 4 for r in rows) / len(rows) - 0.2) < 0.02
    assert {r["heavier"] for r in rows if r["heavier"] != r["old"]} == {1}
    assert {r["old"] for r in rows if r["without"] != r["old"]} == {2}
    with pytest.raises(ValueError, match="weights"):
        sharding.shard_of(F.col("doc_id"), (0.0, 0.0))


def test_written_shards(spark, tmp_path):
    docs = documents(spark, clashes=False).withColumn("_own", F.lit(1))
    sharding.write_shards(docs, str(tmp_path / "out"), weights=(1.0, 2.0, 3.0))
    back = spark.read.parquet(str(tmp_path / "out"))
    want = sharding.assign(docs, weights=(1.0, 2.0, 3.0))
    assert want.columns == [*docs.columns, "shard"]
    assert rows_of(back, *want.columns) == rows_of(want)


@pytest.mark.parametrize(("hot", "limit"), [(100_000, None), (100_000, 0), (3, 200), (3, 0)])
def test_join_counted(spark, monkeypatch, hot, limit):
    """Broadcast, shuffled, hot keys broadcast, hot keys salted: the same rows."""
    monkeypatch.setattr(common, "SALTS", 3)
    rows = common.written(spark.createDataFrame([(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i}") for i in range(60)], "i long, k string").repartition(4), "t-rows")
    found = common.written(rows.groupBy("k").agg(F.sum("i").alias("s"), F.count(F.lit(1)).alias("n")), "t-found")
    joined = join_counted(rows, found, "k", "n", hot=hot, limit=limit)
    sums = {r["k"]: r["s"] for r in found.collect()}
    assert rows_of(joined) == sorted([(r["i"], r["k"], sums[r["k"]]) for r in rows.collect()], key=str)
