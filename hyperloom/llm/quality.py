"""Quality classifier: a sparse ensemble of rules, compiled into Column expressions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.common import passes_columns, written

#: Labelled rows that a fit uses at most, those with the least hash of their id.
MAX_TRAINING_ROWS = 20_000
FOLDS = 5

STATISTICS = (
    "n_bytes",
    "n_words",
    "mean_word",
    "upper_share",
    "digit_share",
    "symbol_share",
    "bang_share",
    "bar_share",
    "stop_share",
    "newline_share",
    "high_share",
    "byte_entropy",
    "unique_words",
    "top_word",
    "same_next",
    "repeated_threes",
    "odd_ends",
    "short_words",
    "repeated_lines",
)


def _statistics(data: bytes) -> list[float]:
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(len(data), 1)
    share = lambda chars: float(counts[list(chars)].sum()) / n
    words = data.split()
    k = max(len(words), 1)
    p = counts[counts > 0] / n
    lines = data.split(b"\n")
    threes = list(zip(words, words[1:], words[2:], strict=False))
    return [
        float(len(data)),
        float(len(words)),
        sum(map(len, words)) / k,
        share(range(65, 91)),
        share(range(48, 58)),
        share(b"#$%&*<>{}[]\\^_~=+@"),
        share(b"!?"),
        share(b"|"),
        share(b".,;:"),
        share(b"\n"),
        float(counts[128:].sum()) / n,
        float(-(p * np.log2(p)).sum()) if len(data) else 0.0,
        len(set(words)) / k,
        max(Counter(words).values(), default=0) / k,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
        1 - len(set(threes)) / len(threes) if threes else 0.0,
        sum(w[-1:] in b"#$%&*!|" for w in words) / k,
        sum(len(w) < 4 for w in words) / k,
        1 - len(set(lines)) / len(lines),
    ]


def with_statistics(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col``, plus the statistics of whole texts as ``_s_<name>`` doubles; null counts as empty."""
    others = [c for c in docs.columns if c != text_col]
    names = [f"_s_{s}" for s in STATISTICS]
    schema = docs.select(*others).schema
    for name in names:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([_statistics(t.as_py() or b"") for t in batch.column(len(others))]).reshape(-1, len(names))
            columns = [pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*list(batch.columns)[: len(others)], *columns], [*others, *names])

    return docs.select(*others, F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions (statistic, above, threshold) with the weight that the lasso left it."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    @property
    def column(self) -> Column:
        tests = [F.col(f"_s_{s}") > F.lit(t) if above else F.col(f"_s_{s}") <= F.lit(t) for s, above, t in self.conditions]
        return reduce(and_, tests)


@dataclass(frozen=True)
class RuleModel:
    """Rules with weights other than zero, and the intercept."""

    rules: tuple[Rule, ...]
    intercept: float

    @property
    def score(self) -> Column:
        """The probability of label 1, as an expression over statistics."""
        total = reduce(lambda a, b: a + b, [F.when(r.column, F.lit(r.weight)).otherwise(0.0) for r in self.rules], F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-total))


def held_out(ident: Column) -> Column:
    """Whether a row is of the fold that no label is learned from; a null id is not."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, *, label: str, id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """``_label`` and statistics of labelled documents outside the held-out fold, ``max_rows`` at most."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.select(F.col(id_col).alias("_id"), (F.col(label) > 0).cast("double").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_rows)
    # At most max_rows rows of 16 bytes.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id")
    return with_statistics(rows).orderBy("_id", "_label", *[f"_s_{s}" for s in STATISTICS]).limit(max_rows)


def _paths(tree) -> list[tuple[tuple[int, bool, float], ...]]:
    """Conditions from the root to every other node of a fitted tree."""
    found, todo = [], [(tree._call_java("rootNode"), ())]
    while todo:
        node, path = todo.pop()
        if path:
            found.append(path)
        if node.subtreeDepth() > 0:
            split = node.split()
            at, limit = split.featureIndex(), split.threshold()
            todo += [(node.leftChild(), (*path, (at, False, limit))), (node.rightChild(), (*path, (at, True, limit)))]
    return found


def _tight(path: tuple[tuple[int, bool, float], ...]) -> tuple[tuple[str, bool, float], ...]:
    """One condition per statistic and side: the strictest."""
    bounds: dict[tuple[int, bool], float] = {}
    for at, above, limit in path:
        old = bounds.get((at, above), limit)
        bounds[at, above] = max(old, limit) if above else min(old, limit)
    return tuple((STATISTICS[at], above, limit) for (at, above), limit in sorted(bounds.items()))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_TRAINING_ROWS,
    trees: int = 12,
    depth: int = 3,
    penalty: float = 0.0005,
    seed: int = 42,
) -> RuleModel:
    """Learn a rule ensemble: forest paths become rules, a lasso logistic regression weighs them.

    Only statistics of texts are inputs. Rows come from ``training_rows``, a documented bound that
    keeps fitting the same size whatever the corpus. Without labelled rows the score is 0.5, with
    one class only it is that class's smoothed share.
    """
    rows = written(training_rows(docs, labels, label=label, id_col=id_col, text_col=text_col, max_rows=max_rows).coalesce(1), "training")
    counts = rows.agg(F.count(F.lit(1)), F.sum("_label")).first()
    n, ones = counts[0], counts[1] or 0
    if not 0 < ones < n:
        return RuleModel((), float(np.log((ones + 1) / (n - ones + 1))))
    assembled = VectorAssembler(inputCols=[f"_s_{s}" for s in STATISTICS], outputCol="_features").transform(rows)
    forest = RandomForestClassifier(labelCol="_label", featuresCol="_features", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=seed)
    paths = {_tight(p) for tree in forest.fit(assembled).trees for p in _paths(tree)}
    rules = [Rule(p) for p in sorted(paths)]
    if not rules:
        return RuleModel((), float(np.log(ones / (n - ones))))
    held = F.array(*[r.column.cast("double") for r in rules])
    matrix = rows.select("_label", array_to_vector(held).alias("_rules"))
    lasso = LogisticRegression(labelCol="_label", featuresCol="_rules", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=True)
    fitted = lasso.fit(matrix)
    weighed = [Rule(r.conditions, float(w)) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if abs(w) > 1e-9]
    return RuleModel(tuple(weighed), float(fitted.intercept))


def classify(docs: DataFrame, model: RuleModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Statistics are taken of whole texts; rules and score are Column expressions over them. Defined
    cases: null and empty texts have statistics of zero and a score like any other; a null id is not
    held out; rows that repeat get a row each; an empty table gives an empty result; other columns
    are ignored.
    """
    rows = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


@passes_columns
def drop_rejected(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options: object) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay as they are."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    scored = with_statistics(docs.withColumn("_copy", F.col(text_col)), text_col="_copy")
    return scored.where(model.score >= threshold).select(*docs.columns)
