"""Repeated windows, benchmark windows and license statements against plain loops."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
from fixtures import LONG, PASSAGE, documents, empty, rows_of

from pyspark.sql import functions as F

from hyperloom.llm import substring_dedup
from hyperloom.llm.decontaminate import contamination, drop_contaminated
from hyperloom.llm.license_scan import BASE, STATEMENTS, STRIDE, Template, scan, template_table
from hyperloom.llm.license_texts import TEXTS
from hyperloom.llm.substring_dedup import WordHashes, drop_repeats, pack, rolling
from hyperloom.plans import tables

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def brute_repeats(docs: list[tuple], window: int) -> list[tuple]:
    split = [(i, (t or "").encode().split()) for i, t in docs]
    counts = Counter(tuple(w[p : p + window]) for _, w in split for p in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = {q for p in range(len(w) - window + 1) if counts[tuple(w[p : p + window])] > 1 for q in range(p, p + window)}
        out.append((i, b" ".join(x for q, x in enumerate(w) if q not in gone).decode(), len(w), len(gone)))
    return out


@pytest.mark.parametrize("window", [35, 8, 5, 2, 1])
@pytest.mark.parametrize(("slab", "chunk", "direct"), [(1_000_000, 1 << 20, 4096), (50, 1 << 20, 4096), (70, 150, 3)])
def test_repeats(spark, monkeypatch, window, slab, chunk, direct):
    """Also where documents are cut into chunks and slabs, and where windows and places take two hops."""
    for name, value in (("SLAB", slab), ("CHUNK", chunk), ("DIRECT", direct)):
        monkeypatch.setattr(substring_dedup, name, value)
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    found = drop_repeats(documents(spark), window=window)
    assert rows_of(found, "doc_id", "text", "n_words", "n_removed") == sorted(brute_repeats(docs, window), key=str)
    assert "lang" in found.columns


def test_repeats_of_nothing(spark):
    assert drop_repeats(empty(spark)).collect() == []


def test_repeats_at_any_alignment(spark):
    """Two places of one passage, at all offsets that blocks can have."""
    rows = []
    for k in range(40):
        rows.append((2 * k, " ".join([*(f"a{k}_{i}" for i in range(k)), *(f"s{k}_{i}" for i in range(35)), "x"])))
        rows.append((2 * k + 1, " ".join([*(f"b{k}_{i}" for i in range(3 * k % 17)), *(f"s{k}_{i}" for i in range(35))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r["n_removed"] for r in drop_repeats(docs).collect()} == {35}


@pytest.mark.parametrize("partitions", [4, 211])
def test_replies_follow_the_places_not_the_partitions(spark, monkeypatch, partitions):
    made = {}
    keep = substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda df, name: made.setdefault(name, keep(df, name)))
    monkeypatch.setattr(substring_dedup, "discard", lambda *tables: None)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [(i, " ".join([*(f"a{i}_{k}" for k in range(30)), *(f"s{k}" for k in range(60))])) for i in range(400)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
        assert {r["n_removed"] for r in drop_repeats(docs).collect()} == {60}
        for name in ("anchor-hits", "repeats"):
            places = made[f"{name}-places"]
            assert 0 < places.count() <= substring_dedup.LEAST_BUCKETS
            dealt = places.mapInArrow(substring_dedup.deal(1 + (name == "repeats"), substring_dedup.LEAST_BUCKETS), f"bucket int, {substring_dedup.PLACES}")
            assert dealt.count() <= substring_dedup.LEAST_BUCKETS**2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_known_places_of_equal_beginnings_spread():
    """Slabs of documents that all begin alike send their known places to different buckets."""
    rng = np.random.default_rng(7)
    head = [b"h%d" % k for k in range(60)]
    into = set()
    for slab in range(40):
        hashes = WordHashes()
        words = [hashes.of(head + [b"w%d_%d_%d" % (slab, d, k) for k in range(20)]) for d in range(5)]
        keys = rng.integers(-(2**62), 2**62, (5, 1))
        counts = np.full(5, 80 - 18 + 1)
        doc, pos = np.repeat(np.arange(5), counts), np.tile(np.arange(63), 5)
        lane = rolling(np.concatenate(words), doc * 80 + pos, 18)
        packed = list(pack(keys, doc, pos, [lane], pos % 18 == 0, 422, [4]))
        into |= {r["bucket"] for r in packed if r["known"]}
    assert len(into) > 30


def windows_of(rng, n: int, docs: int = 300) -> tuple:
    """Places of ``n`` windows of random documents."""
    counts = np.full(docs, n // docs)
    return rng.integers(-(2**62), 2**62, (docs, 1)), np.repeat(np.arange(docs), counts), np.tile(np.arange(n // docs), docs)


def test_packing_stays_cheap_as_buckets_grow():
    """At 6.25 million buckets both packings together take a few millionths of a second for each window."""
    buckets, rng = 6_250_000, np.random.default_rng(1)
    coarse = substring_dedup.coarse_of(buckets)
    keys, doc, pos = windows_of(rng, 900_000)
    lanes = [rng.integers(0, 2**64, len(doc), np.uint64)]
    began = time.perf_counter()
    rows = list(pack(keys, doc, pos, lanes, pos % 18 == 0, buckets, [4], coarse))
    first = (time.perf_counter() - began) / len(doc)
    assert len(rows) <= coarse and {r["bucket"] for r in rows} <= set(range(coarse))

    # What a task gets of one coarse bucket: rows of many slabs.
    slabs = []
    for _ in range(1500):
        keys, doc, pos = windows_of(rng, 300, 50)
        lane = rng.integers(0, 2**40, len(doc), np.uint64) * np.uint64(buckets) + rng.integers(0, buckets // coarse, len(doc), np.uint64) * np.uint64(coarse) + np.uint64(7)
        slabs += pack(keys, doc, pos, [lane], pos % 18 == 0, buckets, [4], coarse)
    began = time.perf_counter()
    found = [r for b in substring_dedup.repack([4], 1, buckets, coarse)(iter([substring_dedup._batch(slabs)])) for r in b.to_pylist()]
    second = (time.perf_counter() - began) / 450_000
    assert {r["bucket"] % coarse for r in found} == {7} and len(found) <= buckets // coarse + 1
    assert first + second < 5e-6


@pytest.mark.parametrize("buckets", [40, 5000])
def test_both_packings_send_the_same(monkeypatch, buckets):
    """Windows, tags and flags arrive at the same buckets by one packing or by two."""
    monkeypatch.setattr(substring_dedup, "DIRECT", 30)
    coarse, rng = substring_dedup.coarse_of(buckets), np.random.default_rng(buckets)
    keys, doc, pos = windows_of(rng, 3000)
    lanes = [rng.integers(0, 2**64, 700, np.uint64)[rng.integers(0, 700, len(doc))] for _ in range(1)]
    lanes.append(lanes[0] * np.uint64(3))

    def sent(rows) -> list[tuple]:
        out = []
        for r in rows:
            key, d, p = substring_dedup._decode(r, 1)
            flags = np.zeros(len(p), int) if r["known"] else substring_dedup._flags(r["flags"], len(p))
            tags = np.zeros((2, len(p)), np.uint64) if r["known"] else [substring_dedup._values(r["tags"][w * 8 * len(p) : (w + 1) * 8 * len(p)], 8) for w in (0, 1)]
            out += [(None if r["known"] else r["bucket"], r["known"], *map(int, (key[d[i], 0], p[i], tags[0][i], tags[1][i], flags[i]))) for i in range(len(p))]
        return sorted(out, key=str)

    aligned = pos % 4 == 0
    one = list(pack(keys, doc, pos, lanes, aligned, buckets, [8, 8]))
    two = substring_dedup._batch(list(pack(keys, doc, pos, lanes, aligned, buckets, [8, 8], coarse)))
    twice = [r for b in substring_dedup.repack([8, 8], 1, buckets, coarse)(iter([two])) for r in b.to_pylist()]
    assert sent(one) == sent(twice) and max(r["bucket"] for r in twice) < buckets


def test_lanes_have_word_hashes_of_their_own():
    """Words that agree in one hash still differ in the other, and so do their windows."""
    hashes = np.array([[1, 1], [2, 2], [1, 3], [2, 4]], np.uint64)
    one, other = (rolling(hashes, np.array([0, 2]), 2, lane) for lane in (0, 1))
    assert one[0] == one[1] and other[0] != other[1]


ITEMS = [
    (1, " ".join(PASSAGE.split()[:13])),
    (2, " ".join(PASSAGE.split()[5:40])),
    (3, "quick brown fox"),
    (4, "Two, WORDS"),
    (5, None),
    (6, ""),
    (7, "lazy"),
    (None, "emoji"),
    (8, "nothing like this is anywhere in the documents that we have got here today"),
    (8, "quick brown fox"),
]


def brute_contamination(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = words_of(t)
        n = min(13, len(w))
        for p in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[p : p + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w = words_of(t)
        hit, met = set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    met |= windows[k]
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(met), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination(spark):
    docs = documents(spark)
    benchmark = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, n_words string")
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted = brute_contamination(plain, ITEMS)
    assert rows_of(contamination(docs, benchmark).drop("_k1", "_k2")) == sorted(wanted, key=str)
    kept = drop_contaminated(docs, benchmark)
    clean = [i for (i, *_, bad) in wanted if not bad]
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, clean))


def test_contamination_of_a_long_document(spark):
    """A document that is an item as a whole, every word of it hit; work is linear in its words."""
    text = " ".join(f"w{i * 7919 % 60_013}" for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(1, text), (2, "of it"), (3, "w0 w7919 w15838")], "item_id long, text string")
    found = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in contamination(docs, items).collect()}
    assert found == {1: (60_000, 2, True), 2: (2, 1, True)}


def test_broadcasts_are_measured(spark, monkeypatch):
    """Nothing is broadcast by hint where no byte may be, and results stay the same."""
    docs, items = documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    wanted = rows_of(contamination(docs, items))
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(F, "broadcast", lambda df: pytest.fail("broadcast"))
    assert rows_of(contamination(docs, items)) == wanted


def test_contamination_of_nothing(spark):
    docs, benchmark = documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(empty(spark), benchmark).collect() == []
    clean = contamination(docs, benchmark.where("false"))
    assert clean.count() == docs.count() and clean.where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0


def brute_scan(docs: list[tuple], templates: tuple[Template, ...] = BASE + STATEMENTS, stride: int = STRIDE) -> list[tuple]:
    out = []
    for i, text in docs:
        w = words_of(text)
        places = [(p, t.label) for t in templates if t.consecutive for p in range(len(w)) if w[p : p + len(t.words)] == t.words]
        labels, score = {label for _, label in places}, 1.0 if places else 0.0
        for t in templates:
            whole, step = set(t.words), t.stride(stride)
            for b in range(0, 0 if t.consecutive else len(w), step):
                n = len(whole & set(w[b : b + step + len(t.words) - 1]))
                if n >= t.needed:
                    labels.add(t.label)
                    score = max(score, n / len(whole))
        starts = [p for p, _ in places]
        out.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score))
    return out


def licensed(spark):
    filler = " ".join(f"f{i}" for i in range(29))
    text = dict(TEXTS)
    more = [
        (200, f"{filler} under the MIT license {filler} under the mit license"),
        (201, f"{filler} x under the apache license, version 2.0"),
        (202, "work licensed under GNU general license version 3"),
        (203, "Permission is granted, free of charge, to any person obtaining a copy of this software"),
        (204, "cc by nc cc by nc"),
        (205, "rights all reserved, license mit the under"),
        (206, f"{filler} {text['mit']} {filler}"),
        (207, f"{filler} {filler} {text['bsd']}".replace("holder", "owner").replace("disclaimer", "notice")),
        (208, f"{LONG} {text['zlib']} {LONG} {text['gpl-3']}"),
        (209, " ".join(text["isc"].split()[:60])),
    ]
    docs = documents(spark).select("doc_id", "text", "labels", "n_words", "score", "b", "w")
    return docs.union(spark.createDataFrame([(i, t, *"abcde") for i, t in more], docs.schema))


@pytest.mark.parametrize("literals", [5_000, 0])
def test_licenses(spark, literals):
    """The same whether prefix words are literals or a table that is joined."""
    docs = licensed(spark)
    wanted = sorted(brute_scan([(r["doc_id"], r["text"]) for r in docs.collect()]), key=str)
    assert rows_of(scan(docs, literals=literals)) == wanted
    found = {r[0]: r[6].split(",") for r in wanted}
    assert "mit" in found[206] and "bsd" in found[207] and {"zlib", "gpl-3"} <= set(found[208]) and "isc" not in found[209]
    assert scan(empty(spark), literals=literals).collect() == []


@pytest.mark.parametrize("literals", [5_000, 100])
def test_templates_of_any_length_and_number(spark, literals):
    """A template of 500 words is found, and thousands of distinct template words are no limit."""
    many = tuple(Template(f"t{k:03}", " ".join(f"v{k}x{i}" for i in range(20))) for k in range(200))
    long = Template("long", " ".join(f"w{i}" for i in range(500)))
    templates = (*many, long, Template("phrase", " ".join(f"q{i}" for i in range(40)), 1.0, True), Template("nothing", " - "))
    rows = [
        (1, " ".join([*(f"x{i}" for i in range(77)), *(f"w{i}" for i in range(500) if i % 6)])),
        (2, " ".join(f"v7x{i}" for i in range(18))),
        (3, " ".join(f"v7x{i}" for i in range(15))),
        (4, " ".join(["a", *(f"q{i}" for i in range(40)), "b", *(f"q{i}" for i in range(40))])),
        (5, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = sorted(brute_scan(rows, templates[:-1], 8), key=str)
    assert rows_of(scan(docs, templates, stride=8, literals=literals)) == wanted
    assert {r[0]: r[6] for r in wanted} == {1: "long", 2: "t007", 3: "", 4: "phrase", 5: ""}
    none = scan(docs, template_table(spark, templates).where("false")).collect()
    assert len(none) == 5 and {r["labels"] for r in none} == {""}


@pytest.mark.parametrize("literals", [5_000, 0])
def test_other_templates_change_nothing(spark, literals):
    """What a template finds, and its score, are the same alone and beside any others."""
    spread = ["x"] * 44
    spread[0], spread[20], spread[43] = "all", "rights", "reserved"
    near = ["y", "all", "z", "rights", "reserved"]
    rows = [(1, " ".join(spread)), (2, " ".join(near)), (3, "reserved all rights " + " ".join(spread)), (4, " ".join(["n"] * 31 + ["all", "rights", "reserved"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = Template("A", "all rights reserved", 1.0)
    others = (Template("B", " ".join(f"b{k}" for k in range(33))), Template("C", "b1 b2 all of b3"), Template("D", "x y", 1.0, True))
    alone = rows_of(scan(docs, (one,), literals=literals), "doc_id", "labels", "score")
    assert alone == [(1, "", 0.0), (2, "A", 1.0), (3, "A", 1.0), (4, "A", 1.0)]
    for more in (others[:1], others[1:], others):
        assert rows_of(scan(docs, (one, *more), literals=literals), "doc_id", "labels", "score") == alone
    if literals:
        licenses = licensed(spark)
        every = {(r["doc_id"], label) for r in scan(licenses).collect() for label in r["labels"].split(",") if label}
        for t in (BASE[0], STATEMENTS[-1]):
            assert {(r["doc_id"], t.label) for r in scan(licenses, (t,)).where("labels <> ''").collect()} <= every
