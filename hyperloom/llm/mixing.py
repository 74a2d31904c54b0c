"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import logging
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.llm.common import broadcast_if_small, join_counted, written

DIMENSIONS = ("source", "lang", "topic")
LOG = logging.getLogger(__name__)
#: Cells that may be fitted in one partition; more are fitted by shuffles.
FEW_CELLS = 10_000
#: Fitting rounds between two written tables.
ROUNDS_A_TABLE = 5


def by_length(text: Column) -> Column:
    """A stand-in for a topic where a table has none: the form of a text, by its words."""
    n = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return F.when(n < 100, "note").when(n < 600, "article").otherwise("long")


@dataclass(frozen=True)
class Mixture:
    """What ``calibrate`` found. ``cells`` has the columns ``source, lang, topic, tokens, probability,
    saturated``; a saturated cell would need its documents more than once and has probability 1.

    ``error`` is the largest distance of a fitted share from its target over all values of all
    dimensions; ``gap`` is the same for the shares of the tokens that the sample is expected to
    have, so it holds what saturated cells lack as well.
    """

    cells: DataFrame
    n_cells: int
    n_saturated: int
    rounds: int
    error: float
    gap: float


def mix(
    docs: DataFrame,
    *,
    topic: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    seed: int = 42,
    **fitting: object,
) -> DataFrame:
    """One row per row of ``docs`` with its calibrated sampling probability and whether it is sampled.

    Tokens (words, one at least) are summed by source, language and topic in one pass; what follows
    works on those cells, with the options of ``calibrate``. No document is repeated. The draw of a
    document is a hash of ``seed`` and its id, in steps of 2^-52; probabilities are not rounded, so a
    cell of any small probability still has its chance.

    Columns: ``doc_id, source, lang, topic, n_tokens, probability, sampled``. Defined cases: null
    source, language or topic count as ''; null and empty texts count one token; rows with one id
    share their draw; values with target 0 are never sampled; if no cell has weight, nothing is; an
    empty table gives an empty result; other columns are ignored.
    """
    tokens = F.greatest(F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(1)).cast("long")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        _name(F.col(source_col)).alias("source"),
        _name(F.col(lang_col)).alias("lang"),
        _name(topic).alias("topic"),
        tokens.alias("n_tokens"),
    )
    rows = written(rows, "tokens")
    found = calibrate(rows, **fitting)
    cells = broadcast_if_small(found.cells.select(*DIMENSIONS, "probability"))
    return rows.join(cells, list(DIMENSIONS)).select(
        "doc_id", *DIMENSIONS, "n_tokens", "probability", (draw(F.col("doc_id"), seed) < F.col("probability")).alias("sampled")
    )


def calibrate(
    rows: DataFrame,
    *,
    temper: float = 0.5,
    targets: dict[str, dict[str, float]] | None = None,
    rounds: int = 10,
    max_rounds: int | None = None,
    tolerance: float = 1e-4,
    budget: float | None = None,
) -> Mixture:
    """Sampling probabilities of the cells of ``rows`` (``source, lang, topic, n_tokens``).

    Each round scales the cells' weights to the target share of each source, then language, then
    topic. A target is given in ``targets[dimension][value]`` or else is the value's share of tokens
    to the power ``temper``; targets are normalised over the values present. After ``rounds`` rounds
    more follow, ``max_rounds`` in all at most (none more by default), until no share is further than
    ``tolerance`` from its target. If some still is, as with targets that the cells can't meet, that
    is warned of.

    A cell's documents are sampled with probability proportional to weight over tokens. ``budget`` is
    the share of all tokens that the sample is expected to have: probabilities are
    ``min(1, c * weight / tokens)`` with the ``c`` that spends it, or all 1 if the cells with weight
    have fewer tokens. So a tiny cell is taken whole and others don't shrink for it. Without a budget
    the largest probability is 1 and no cell is cut: the largest sample with just the fitted shares,
    which one rare cell can make as small as it likes.
    """
    if budget is not None and not 0 < budget <= 1:
        raise ValueError("budget is a share of all tokens: more than 0, 1 at most")
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    n_cells = cells.count()
    few = n_cells <= FEW_CELLS
    cells = cells.coalesce(1) if few else cells
    for d in DIMENSIONS:
        cells, own = _with_sum(cells, d, "tokens", few)
        if targets and d in targets:
            pairs = [x for k, v in targets[d].items() for x in (F.lit(k), F.lit(float(v)))]
            share = F.coalesce(F.element_at(F.create_map(*pairs), F.col(d)), F.lit(0.0))
        else:
            share = F.pow(own.cast("double"), F.lit(temper))
        cells = cells.withColumn(f"_{d}", share).drop("_sum")
        cells = cells if few else written(cells, "shares")
    cells = written(cells.withColumn("w", F.col("tokens").cast("double")), "targets")
    sums = {d: cells.select(d, f"_{d}").distinct().agg(F.sum(f"_{d}")).first()[0] or 1.0 for d in DIMENSIONS}
    done, upto = 0, rounds
    while True:
        for k in range(done, upto):
            cells = cells.coalesce(1) if few else cells
            for d in DIMENSIONS:
                cells, now = _with_sum(cells, d, "w", few)
                cells = cells.withColumn("w", F.when(now > 0, F.col("w") * (F.col(f"_{d}") / F.lit(sums[d])) / now).otherwise(0.0)).drop("_sum")
                cells = cells if few else written(cells, "scaled")
            if k % ROUNDS_A_TABLE == ROUNDS_A_TABLE - 1 or k == upto - 1:
                cells = written(cells, "fitted")
        done, error = upto, off_target(cells, F.col("w"), sums)
        upto = min(done + ROUNDS_A_TABLE, max_rounds or 0)
        if error <= tolerance or upto <= done:
            break
    if error > tolerance:
        warnings.warn(f"after {done} rounds a share is {error:.3g} from its target; the tolerance is {tolerance:g}", RuntimeWarning, stacklevel=2)
    if budget is None:
        scale = None
        top = cells.agg(F.max(F.col("w") / F.col("tokens"))).first()[0] or 1.0
        probability, over = F.col("w") / F.col("tokens") / F.lit(top), F.lit(False)
    else:
        scale = spend(cells, budget)
        over = F.col("w") * F.lit(scale) > F.col("tokens")
        probability = F.when(over, 1.0).otherwise(F.col("w") / F.col("tokens") * F.lit(scale))
    cells = cells.withColumn("probability", probability).withColumn("saturated", over)
    gap = error if scale is None else off_target(cells, F.col("tokens") * F.col("probability"), sums)
    n_saturated = 0 if scale is None else cells.where("saturated").count()
    if n_saturated:
        LOG.info("%d of %d cells are taken whole; the expected shares are up to %.3g from their targets", n_saturated, n_cells, gap)
    return Mixture(cells.select(*DIMENSIONS, "tokens", "probability", "saturated"), n_cells, n_saturated, done, error, gap)


def _with_sum(cells: DataFrame, d: str, of: str, few: bool) -> tuple[DataFrame, Column]:
    """``cells`` with the sum of a column over each value of ``d``, and that sum.

    Few cells are in one task, where a window does it. Many are summed within tasks, and the sums
    are joined back: a value with a third of all cells stays spread.
    """
    if few:
        return cells, F.sum(of).over(Window.partitionBy(d))
    sums = written(cells.groupBy(d).agg(F.sum(of).alias("_sum"), F.count(F.lit(1)).alias("_cells")), "sums")
    return join_counted(cells, sums, d, "_cells"), F.col("_sum")


def off_target(cells: DataFrame, weight: Column, sums: dict[str, float]) -> float:
    """The largest distance of a value's share of ``weight`` from its target, over all dimensions."""
    whole = cells.agg(F.sum(weight)).first()[0] or 1.0
    gaps = []
    for d in DIMENSIONS:
        away = F.abs(F.col("_now") / F.lit(whole) - F.col(f"_{d}") / F.lit(sums[d]))
        gaps.append(cells.groupBy(d, f"_{d}").agg(F.sum(weight).alias("_now")).agg(F.max(away)).first()[0] or 0.0)
    return max(gaps)


def spend(cells: DataFrame, budget: float) -> float:
    """The ``c`` for which ``min(tokens, c * w)`` sums to the share ``budget`` of all tokens.

    The sum is concave in ``c`` and made of straight pieces, so Newton steps from below never pass
    the solution and end on its piece.
    """
    tokens, weight = cells.agg(F.sum("tokens"), F.sum("w")).first()
    if not weight:
        return 0.0
    goal = budget * tokens
    c = goal / weight
    while True:
        over = F.col("w") * F.lit(c) > F.col("tokens")
        whole, rest = cells.agg(F.sum(F.when(over, F.col("tokens")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("w")))).first()
        if not rest:
            return c
        better = (goal - whole) / rest
        if better <= c * (1 + 1e-12):
            return c
        c = better


def _name(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def draw(ident: Column, seed: int) -> Column:
    """A multiple of 2^-52 in [0, 1) from a hash of ``seed`` and ``ident``."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def sample(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples; all columns stay as they are."""
    id_col = str(options.get("id_col", "doc_id"))
    names = {"source": str(options.get("source_col", "source")), "lang": str(options.get("lang_col", "lang"))}
    mixed = mix(docs, **options)
    cells = written(mixed.groupBy(*DIMENSIONS).agg(F.max("probability").alias("_p")), "probabilities")
    cells = cells.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "_p")
    topic = options["topic"]
    at = (_name(docs[names["source"]]) == cells["_source"]) & (_name(docs[names["lang"]]) == cells["_lang"]) & (_name(topic) == cells["_topic"])
    cells = broadcast_if_small(cells)
    seed = int(options.get("seed", 42))
    return docs.join(cells, at).where(draw(docs[id_col], seed) < cells["_p"]).select(*[docs[c] for c in docs.columns])
