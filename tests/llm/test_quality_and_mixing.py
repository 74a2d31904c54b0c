from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
from fixtures import documents, empty
from pyspark.sql import functions as F

import corpus_pipeline
from hyperloom.llm import mixing, quality


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    assert 0 < len(model.rules) < 100
    scored = quality.classify(docs, model)
    assert scored.count() == docs.count()
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    good = np.array([r["quality"] for r in rows])
    predicted = np.array([r["predicted"] for r in rows])
    assert (predicted == good).mean() > 0.98 and predicted[good == 1].mean() > 0.99


def test_scores_ignore_other_columns(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels, max_rows=500)
    docs = docs.where("doc_id < 50")
    moved = docs.withColumns({"doc_id": F.col("doc_id") + 7, "lang": F.lit("xx"), "source": F.lit("yy"), "score": F.lit("clash")})
    pick = lambda d: [r["score"] for r in quality.classify(d, model).orderBy("doc_id").collect()]
    assert pick(docs) == pick(moved)


def test_rules_as_columns(spark):
    model = quality.RuleModel((quality.Rule((("n_words", True, 1.0), ("upper_share", False, 0.5)), 2.0), quality.Rule((("n_words", False, 3.0),), -1.0)), 0.25)
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "A B C D")], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in quality.classify(docs, model).collect()}
    wanted = {1: 0.25 + 2 - 1, 2: 0.25 - 1, 3: 0.25}
    assert found == {k: pytest.approx(1 / (1 + math.exp(-v))) for k, v in wanted.items()}


def plain_statistics(text: str) -> dict[str, float]:
    """The statistics once more, one by one from the characters of the bytes."""
    data = text.encode()
    chars = [chr(b) for b in data]
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", "".join(chars)) if w]
    lines, n, k = "".join(chars).split("\n"), len(chars) or 1, len(words) or 1
    share = lambda test: sum(map(test, chars)) / n
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    entropy = 0.0
    for c in set(chars):
        p = chars.count(c) / len(chars)
        entropy -= p * math.log2(p)
    return {
        "n_bytes": len(data),
        "n_words": len(words),
        "mean_word": len("".join(words)) / k,
        "upper_share": share(lambda c: "A" <= c <= "Z"),
        "digit_share": share(lambda c: "0" <= c <= "9"),
        "symbol_share": share(lambda c: c in "#$%&*<>{}[]\\^_~=+@"),
        "bang_share": share(lambda c: c in "!?"),
        "bar_share": share(lambda c: c == "|"),
        "stop_share": share(lambda c: c in ".,;:"),
        "newline_share": share(lambda c: c == "\n"),
        "high_share": share(lambda c: ord(c) > 127),
        "byte_entropy": entropy,
        "unique_words": len(set(words)) / k,
        "top_word": max((words.count(w) for w in set(words)), default=0) / k,
        "same_next": sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / k,
        "repeated_threes": (len(threes) - len(set(threes))) / len(threes) if threes else 0.0,
        "odd_ends": sum(w[-1] in "#$%&*!|" for w in words) / k,
        "short_words": sum(len(w) <= 3 for w in words) / k,
        "repeated_lines": (len(lines) - len(set(lines))) / len(lines),
    }


def test_statistics_and_scores_once_more(spark, tables):
    """Statistics and the fitted score of whole texts, from Spark and from plain Python."""
    real, labels = tables
    model = quality.fit(real, labels, max_rows=1000)
    docs = documents(spark).select("doc_id", "text").union(real.where("doc_id < 40").select("doc_id", "text"))
    found = quality.with_statistics(docs.withColumn("_copy", F.col("text")), text_col="_copy").withColumn("_score", model.score)
    for row in found.collect():
        wanted = plain_statistics(row["text"] or "")
        assert {s: row[f"_s_{s}"] for s in quality.STATISTICS} == {s: pytest.approx(v, abs=1e-9) for s, v in wanted.items()}
        held = lambda rule: all((row[f"_s_{s}"] > t) == above for s, above, t in rule.conditions)  # noqa: B023, E731
        total = model.intercept + sum(r.weight for r in model.rules if held(r))
        assert row["_score"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_few_labels(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, none) == quality.RuleModel((), 0.0)
    one = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 0), (3, None)], "doc_id long, quality int")
    assert quality.fit(docs, one).rules == ()
    both = spark.createDataFrame([(i, i % 2) for i in range(16)], "doc_id long, quality int")
    model = quality.fit(docs, both)
    found = quality.classify(docs, model)
    assert found.count() == docs.count() and found.where("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL").count() == 0
    assert quality.classify(empty(spark), model).collect() == []
    kept = quality.drop_rejected(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_marginals(spark, tables):
    """Expected tokens have the target shares: exactly for the dimension fitted last, nearly for the others."""
    docs, _ = tables
    targets = {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}}
    mixed = mixing.mix(docs, topic=mixing.by_length(F.col("text")), targets=targets, rounds=20)
    assert mixed.count() == docs.count() and mixed.agg(F.max("probability")).first()[0] == 1.0
    expected = mixed.groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("t")).collect()
    total = sum(r["t"] for r in expected)
    for r in expected:
        assert r["t"] / total == pytest.approx(targets["lang"][r["lang"]], abs=2e-3)
    drawn = {r["lang"]: r["t"] for r in mixed.where("sampled").groupBy("lang").agg(F.sum("n_tokens").alias("t")).collect()}
    for lang, share in targets["lang"].items():
        assert drawn[lang] / sum(drawn.values()) == pytest.approx(share, abs=0.08)
    taken = mixing.sample(docs, topic=mixing.by_length(F.col("text")), targets=targets, rounds=20)
    assert {r[0] for r in taken.select("doc_id").collect()} == {r[0] for r in mixed.where("sampled").select("doc_id").collect()}


@pytest.mark.parametrize("few", [10_000, 0])
def test_mixing_awkward_rows(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_CELLS", few)
    docs = documents(spark)
    topic = F.when(F.col("doc_id") > 3, "a")
    mixed = mixing.mix(docs, topic=topic)
    assert mixed.count() == docs.count()
    assert mixed.where("probability IS NULL OR probability < 0 OR probability > 1 OR n_tokens < 1").count() == 0
    assert mixing.mix(empty(spark), topic=topic).collect() == []
    assert mixing.sample(docs, topic=topic).columns == docs.columns
    never = mixing.mix(docs, topic=topic, targets={"source": {"src1": 1.0}})
    assert {r["source"] for r in never.where("sampled OR probability > 0").collect()} <= {"src1"}
    assert mixing.mix(docs, topic=topic, targets={"source": {"nowhere": 1.0}}).where("sampled").count() == 0


def test_a_rare_cell_does_not_shrink_the_sample(spark):
    """One odd row beside 1,000 documents; the stage spends its budget and takes that row whole."""
    text = F.repeat(F.lit("word "), 100)
    many = spark.range(1000).select(
        F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 4 == 0, "de").otherwise("en").alias("lang"), F.lit("web").alias("source")
    )
    odd = spark.createDataFrame([(5000, "word " * 20, None, "web")], "doc_id long, text string, lang string, source string")
    kept = {r[0] for r in corpus_pipeline.mixed(spark, many.union(odd), "").select("doc_id").collect()}
    assert 5000 in kept and len(kept) == pytest.approx(500, abs=75)


def test_tiny_probabilities_keep_their_chance(spark):
    """A cell that is to get 1e-12 of what the rarest gets has this probability, not zero, and a draw can be as small."""
    tokens = [("hot", 10**15), ("cold", 1000)]
    rows = spark.createDataFrame([(s, "", "", n) for s, n in tokens], "source string, lang string, topic string, n_tokens long")
    found = {r["source"]: r["probability"] for r in mixing.calibrate(rows, targets={"source": {"hot": 0.5, "cold": 0.5}}).cells.collect()}
    assert found["cold"] == 1.0 and found["hot"] == pytest.approx(1e-12, rel=1e-6)
    draws = spark.range(20_000).select(mixing.draw(F.col("id"), 1).alias("d"))
    assert draws.where("d * pow(2D, 32) <> floor(d * pow(2D, 32))").count() > 19_000
    assert draws.where("d < 0 OR d >= 1").count() == 0 and draws.agg(F.avg("d")).first()[0] == pytest.approx(0.5, abs=0.02)


@pytest.mark.parametrize("budget", [0.01, 0.3, 0.9, 1.0])
def test_budget(spark, tables, budget):
    """Expected tokens are the budget, and unsaturated cells keep the ratios of the fit."""
    docs, _ = tables
    rows = mixing.mix(docs, topic=mixing.by_length(F.col("text"))).drop("probability")
    free = {tuple(r[d] for d in mixing.DIMENSIONS): r for r in mixing.calibrate(rows).cells.collect()}
    found = mixing.calibrate(rows, budget=budget)
    cells = {tuple(r[d] for d in mixing.DIMENSIONS): r for r in found.cells.collect()}
    total = sum(r["tokens"] for r in cells.values())
    assert sum(r["tokens"] * r["probability"] for r in cells.values()) == pytest.approx(budget * total, rel=1e-6)
    assert found.n_saturated == sum(r["saturated"] for r in cells.values())
    c = max((r["probability"] / free[k]["probability"] for k, r in cells.items() if not r["saturated"]), default=math.inf)
    for k, r in cells.items():
        assert r["probability"] == pytest.approx(min(1, c * free[k]["probability"]), rel=1e-5)
    assert {r["probability"] for r in cells.values() if r["saturated"]} <= {1.0}


def test_rounds_go_on_to_the_tolerance(spark):
    tokens = [("a", "en", 100_000), ("a", "de", 10), ("b", "en", 10), ("b", "de", 100_000)]
    rows = spark.createDataFrame([(s, x, "", n) for s, x, n in tokens], "source string, lang string, topic string, n_tokens long")
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}}
    with pytest.warns(RuntimeWarning, match="after 2 rounds"):
        short = mixing.calibrate(rows, targets=targets, rounds=2)
    whole = mixing.calibrate(rows, targets=targets, rounds=2, max_rounds=200)
    assert (short.rounds, short.error > 1e-4) == (2, True) and 2 < whole.rounds < 200 and whole.error <= 1e-4
    never = rows.where("n_tokens > 10")
    with pytest.warns(RuntimeWarning, match="from its target"):
        assert mixing.calibrate(never, targets=targets, max_rounds=20).error > 0.1
