from __future__ import annotations

import hashlib
import time
from collections import Counter

import pytest
from fixtures import documents, empty, rows_of
from pyspark.sql import functions as F

from hyperloom.llm import exact_dedup
from hyperloom.llm.exact_dedup import exact_groups
from hyperloom.llm.line_dedup import drop_common_lines

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
BLANKS = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("salts", [1, 4])
def test_exact_groups(spark, salts):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    norm = [(i, (t or "").translate(UPPER)) for i, t in docs]
    ids = {}
    for i, t in norm:
        ids.setdefault(t, []).append(i)
    keep = {t: max((i for i in group if i is not None), default=None) for t, group in ids.items()}
    wanted = [(i, keep[t], len(ids[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm]
    assert rows_of(exact_groups(documents(spark), salts=salts)) == sorted(wanted, key=str)
    assert exact_groups(empty(spark)).collect() == []


@pytest.mark.parametrize("few", [1, 2])
def test_texts_of_one_digest(spark, monkeypatch, few):
    """Texts whose digests collide are still told apart by their content."""
    docs = documents(spark)
    wanted = rows_of(exact_groups(docs), "doc_id", "keep_id", "group_size", "kept")
    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 1).cast("binary") if few == 2 else F.lit(b"x"))
    assert rows_of(exact_groups(docs), "doc_id", "keep_id", "group_size", "kept") == wanted


@pytest.mark.parametrize(("min_docs", "min_chars"), [(2, 1), (1, 1), (2, 6), (3, 0), (99, 1)])
def test_lines(spark, min_docs, min_chars):
    docs = [(r["doc_id"], r["text"] or "") for r in documents(spark).collect()]
    key = lambda line: line.strip(BLANKS).translate(UPPER)
    counts = Counter(k for _, t in docs for k in {key(line) for line in t.split("\n")} if len(k) >= min_chars)
    gone = {k for k, n in counts.items() if n >= min_docs}
    wanted = []
    for i, t in docs:
        kept = [line for line in t.split("\n") if key(line) not in gone]
        n = len(t.split("\n"))
        wanted.append((i, "\n".join(kept), n, n - len(kept)))
    found = drop_common_lines(documents(spark), min_docs=min_docs, min_chars=min_chars)
    assert rows_of(found, "doc_id", "text", "n_lines", "n_dropped") == sorted(wanted, key=str)
    assert {"lang", "kept", "fp"} <= set(found.columns) and found.where("kept <> 'clash'").count() == 0
    assert drop_common_lines(empty(spark)).collect() == []


def test_rows_of_one_id_are_one_document(spark):
    """Lines that stand under one id only stay, however many rows have it; ten ids or null ids count."""
    rows = [(1, f"once\nold {k}\nmany") for k in range(12)] + [(k, "many\nten") for k in range(2, 11)] + [(99, "ten")]
    rows += [(None, f"none\nnull {k}") for k in range(10)]
    found = drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10, min_chars=1)
    wanted = [(1, f"once\nold {k}") for k in range(12)] + [(k, "") for k in range(2, 11)] + [(99, "")] + [(None, f"null {k}") for k in range(10)]
    assert rows_of(found, "doc_id", "text") == sorted(wanted, key=str)


def test_many_lines_in_one_document(spark):
    """Four times the lines of a document take about four times as long, not sixteen."""

    def seconds(n: int) -> float:
        rows = [(i, "\n".join([*(f"line {i} {k}" for k in range(n)), "shared"])) for i in range(2)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        began = time.perf_counter()
        found = {(r["n_lines"], r["n_dropped"]) for r in drop_common_lines(docs, min_docs=2).select("n_lines", "n_dropped").collect()}
        assert found == {(n + 1, 1)}
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 5 * seconds(10_000) + 2
