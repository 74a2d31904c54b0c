"""Connected components of a graph given by its links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm import common
from hyperloom.llm.common import discard, join_counted, written


def _with_least(links: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    """Links with ``_m`` of their ``u``. Where there are ``many``, a ``u`` may have more than a task should get."""
    return join_counted(links, written(least, "least"), "u", "_n") if many else links.join(least.drop("_n"), "u")


def connected_components(links: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links`` (``u, v``): the least node of its component.

    Each round links every node's larger neighbours, then its smaller ones, to the least of its
    neighbourhood; a logarithmic number of rounds leaves stars. A round ends in a written table, so
    its plan stays short and lost executors cost one round at most. Neighbourhoods are never
    gathered: they are a minimum by node joined back, and the links of a node that has very many are
    joined apart from the rest. Loops are ignored.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before, many = state, state[0] > common.HOT_ROWS
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "_m").alias("_m"), "_n")
        large = _with_least(both, least, many).where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        large = written(large, "large-star")
        discard(edges)
        least = large.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n"))
        small = _with_least(large, least, many).select(F.explode(F.array("u", "v")).alias("u"), F.col("_m").alias("v")).where("u <> v").distinct()
        edges = written(small, "small-star")
        discard(large)
    raise RuntimeError(f"links have not settled after {max_rounds} rounds")
