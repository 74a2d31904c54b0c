"""Tables of expressions against one at a time."""

from __future__ import annotations

import numpy as np
import pytest

from hyperloom.architectures import BSC, HRR, MAP, VTB, Architecture
from hyperloom.operators import expressions
from hyperloom.operators.codebook import Codebook
from hyperloom.operators.expressions import Keys, canonical, evaluate_all, value_of
from hyperloom.plans import tables
from hyperloom.plans.expression import Expression

TEXTS = [
    "a",
    "a * b",
    "b * a",
    "a * b + c",
    "c + b * a",
    "(a * b + c) ^ 3 * d",
    "((a * b + c) ^ 3 * d + a) ^ 2 + (a * b)",
    "((a * b + c) ^ 3 * d + a) ^ 2 + (a * b)",
    "a + b + c + d",
    "d + (a * b) ^ 66",
    "d + (a * b) ^ 2",
]
BAD = [None, "", "a +", "(a", "a * nobody + noone", "(" * 5000 + "a" + ")" * 5000]


@pytest.fixture(params=["broadcast", "salted"])
def ways(request, monkeypatch):
    if request.param == "salted":
        monkeypatch.setattr(expressions, "HOT_ROWS", 2)
        monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)


def book_of(spark, kind: str, size: int = 64) -> Codebook:
    return Codebook.empty(spark, Architecture(kind, 4), size).extend("abcd")


@pytest.mark.parametrize("kind", [BSC, MAP, HRR, VTB])
def test_same_as_one_at_a_time(spark, kind, ways):
    book = book_of(spark, kind)
    table = spark.createDataFrame(list(enumerate([*TEXTS, *BAD])), "key long, text string")
    found = evaluate_all(book, table)
    assert found.columns == ["key", "text", "vec", "error"]
    rows = {r["key"]: r for r in found.collect()}
    assert len(rows) == len(TEXTS) + len(BAD)
    for i, text in enumerate(TEXTS):
        wanted = value_of(Expression.parse(text), Keys(book.arch, 64), {}) if kind == BSC else book.execute(text)
        np.testing.assert_allclose(rows[i]["vec"], wanted, atol=1e-12)
        assert rows[i]["error"] is None
    bad = [rows[len(TEXTS) + i] for i in range(len(BAD))]
    assert all(r["vec"] is None for r in bad)
    assert [r["error"] for r in bad] == ["Invalid expression"] * 3 + ["Mismatched parentheses", "Unknown value: nobody", "Expression is nested too deeply"]


def test_keys_commute_where_the_algebra_does():
    def key(kind, text):
        return Keys(Architecture(kind, 1), 16)[Expression.parse(text)]

    for kind in (BSC, MAP, HRR, VTB):
        assert (key(kind, "a * b") == key(kind, "b * a")) == (kind != VTB)
        assert (key(kind, "a + b") == key(kind, "b + a")) == (kind != BSC)
        assert key(kind, "a ^ 17") == key(kind, "a ^ 1") != key(kind, "a")
        assert key(kind, "a + b + c") != key(kind, "a + (b + c)")


def test_shared_parts_are_evaluated_once(spark, monkeypatch, tmp_path):
    """Every unit that a task evaluates leaves a file; so does none twice."""
    folder = str(tmp_path)
    plain = expressions.value_of

    def noted(whole, keys, known):
        import uuid
        from pathlib import Path

        Path(folder, f"{keys[whole]}-{uuid.uuid4().hex}").write_text(f"{whole} {len(known)}")
        return plain(whole, keys, known)

    monkeypatch.setattr(expressions, "value_of", noted)
    texts = [f"(a * b + c) ^ 2 * {x}" for x in "abcd"] + ["c + b * a", "a * b"]
    evaluate_all(book_of(spark, MAP), spark.createDataFrame([(t,) for t in texts * 3], "text string")).collect()
    seen = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    # Four products, (a * b + c) ^ 2, a * b + c and a * b.
    assert len(seen) == len(set(seen)) == 7
    given = sorted(int(f.read_text().split()[-1]) for f in tmp_path.iterdir())
    assert given == [0, 1, 1, 1, 1, 1, 1]


def test_none_and_clashing_names(spark):
    book = book_of(spark, MAP)
    assert evaluate_all(book, spark.createDataFrame([], "text string")).count() == 0
    assert evaluate_all(book, spark.createDataFrame([(None,), ("a a",)], "text string")).where("vec IS NULL").count() == 1
    with pytest.raises(ValueError, match="of its own"):
        evaluate_all(book, spark.createDataFrame([], "text string, error string"))


def test_canonical(spark):
    """Equal keys where operands commute, no key for what is no expression."""
    texts = ["a * b + c", "c + (b * a)", "c + b * (a ^ 1)", "a *", None, "a + a", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r["id"]: r for r in canonical(Architecture("map"), 16, df).collect()}
    assert [found[i]["shown"] for i in range(7)] == ["((a * b) + c)", "(c + (b * a))", "(c + (b * (a ^ 1)))", None, None, "(a + a)", "a"]
    keys = [found[i]["key"] for i in range(7)]
    assert keys[0] == keys[1] and keys[3] is keys[4] is None and len({*keys} - {None}) == 4
    ordered = {r["id"]: r["key"] for r in canonical(Architecture("vtb"), 16, df).collect()}
    assert ordered[0] != ordered[1]
