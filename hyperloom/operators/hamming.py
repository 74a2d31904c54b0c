"""The nearest packed vectors for a table of queries: exact, by an index of several parts of the bits.

Vectors are cut into ``m`` parts of about log2(candidates) bits, and looked up by the value of each part.
Of two vectors whose distance is below m * (t + 1), some part differs in at most t bits. So the queries probe
all values that differ from their own in 0 bits, then in 1, ..., until their k-th best is within what has been
covered; few candidates are compared. Queries that stay open, or whose probes would
meet too many candidates, are compared with all of them in blocks (``most_similar``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.architectures import BSC, Architecture
from hyperloom.operators.packed import unpack
from hyperloom.operators.search import most_similar
from hyperloom.plans.tables import broadcast_if_small, discard, numbered, written

#: Bits of a part at least and at most; in how many bits a probed value may differ.
NARROWEST, WIDEST, MOST_BITS = 4, 40, 2
#: The share of all comparisons up to which probing is taken for cheaper than comparing with all in blocks.
CHEAPER = 1 / 16
#: Bits compared, queries times candidates times size, up to which no index is made: all are compared in blocks.
DIRECT = 1 << 37
#: Candidates of one value from which they are joined in several tasks, one for each so many.
HOT_ROWS = 100_000


@dataclass(frozen=True)
class Parts:
    """Equal parts of the bits of a vector, but for one bit more in the first ones."""

    size: int
    count: int

    @staticmethod
    def of(size: int, candidates: int) -> Parts:
        width = min(max(round(math.log2(max(candidates, 2))), NARROWEST), WIDEST)
        return Parts(size, max(1, -(-size // width)))

    @property
    def spans(self) -> list[tuple[int, int]]:
        """Where each part starts, and how many bits it has."""
        short, longer = divmod(self.size, self.count)
        return [(p * short + min(p, longer), short + (p < longer)) for p in range(self.count)]

    def value(self, words: Column, start: int, width: int) -> Column:
        word, inside = divmod(start, 64)
        out = F.call_function("shiftrightunsigned", F.get(words, F.lit(word)), F.lit(inside))
        if inside + width > 64:
            out = out.bitwiseOR(F.call_function("shiftleft", F.get(words, F.lit(word + 1)), F.lit(64 - inside)))
        return out.bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))

    def values(self, words: Column) -> Column:
        """``part, value`` of all parts."""
        return F.array(*[F.struct(F.lit(p).alias("part"), self.value(words, *span).alias("value")) for p, span in enumerate(self.spans)])

    def probes(self, words: Column, bits: int) -> Column:
        """``part, value`` of all values that differ in ``bits`` bits from a part of ``words``."""

        def around(p: int, start: int, width: int) -> Column:
            masks = F.array(*[F.lit(sum(1 << i for i in chosen)).cast("bigint") for chosen in combinations(range(width), bits)])
            return F.transform(masks, lambda m: F.struct(F.lit(p).alias("part"), self.value(words, start, width).bitwiseXOR(m).alias("value")))

        return F.concat(*[around(p, *span) for p, span in enumerate(self.spans) if span[1] >= bits])

    def differing(self, a: Column, b: Column) -> Column:
        """In how many bits each part differs."""
        return F.array(*[F.bit_count(self.value(a, *span).bitwiseXOR(self.value(b, *span))).cast("int") for span in self.spans])


def nearest(
    queries: DataFrame, candidates: DataFrame, size: int, *, k: int = 1, query_col: str = "id", id_col: str = "id", words_col: str = "words", direct: int | None = None
) -> DataFrame:
    """``query, rank, id, distance``: for each row of ``queries`` the ``k`` candidates that differ in the fewest bits.

    Both tables have an id (candidates a ``long`` one) and the words of ``packed.pack``, bits beyond ``size`` zero. Of ties
    the larger id comes first. What is sent are the probes, which follow the queries, unless they are small
    enough to be broadcast the parts of the candidates, and ``k`` rows for each query and task. Up to ``direct``
    (``DIRECT`` if None) compared bits there is no index.

    Defined cases: rows of null ids (candidates) or null words are left out; repeated queries and candidates count each; of
    candidates with equal words only the ``k`` largest ids are indexed; fewer candidates than ``k`` give fewer rows;
    no queries or candidates give none; words of another number raise an error.
    """
    width = -(-size // 64)

    def rows_of(df: DataFrame, name: str, column: str) -> DataFrame:
        words = F.col(f"`{words_col}`")
        wrong = F.raise_error(F.lit(f"packed vectors of {size} elements have {width} words"))
        return df.where(words.isNotNull()).select(F.col(f"`{name}`").alias(column), F.when(F.size(words) == width, words).otherwise(wrong).alias("_words"))

    asked = written(numbered(rows_of(queries, query_col, "query"), ["query"], "_row"), "queries")
    there = rows_of(candidates, id_col, "_id").where("_id IS NOT NULL").withColumn("_id", F.col("_id").cast("long"))
    copies = Window.partitionBy("_words").orderBy(F.desc("_id"))
    there = written(there.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy"), "candidates")
    n = there.count()
    parts = Parts.of(size, n)
    indexed = asked.count() * n * size > (DIRECT if direct is None else direct)
    index = there.select("_id", "_words", F.explode(parts.values(F.col("_words"))).alias("_p")).select("_id", "_words", "_p.*")
    counts = written(index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")), "part-counts") if indexed else None
    best = Window.partitionBy("_row").orderBy("distance", F.desc("_id"))
    left, known, finished = asked, None, []
    for bits in range(MOST_BITS + 1 if indexed else 0):
        probes = left.select("_row", F.col("_words").alias("_query"), F.explode(parts.probes(F.col("_words"), bits)).alias("_p")).select("_row", "_query", "_p.*")
        waiting = left.count()
        met = probes.groupBy("part", "value").agg(F.count(F.lit(1)).alias("asked")).join(counts, ["part", "value"]).agg(F.sum(F.col("asked") * F.col("n"))).first()[0] or 0
        if not waiting or met > CHEAPER * waiting * n:
            break
        differing = parts.differing(F.col("_words"), F.col("_query"))
        # A pair is taken where it is met first: in the first of its parts that differ least.
        first = (F.array_min(differing) == bits) & (F.array_position(differing, bits) == F.col("part") + 1)
        distance = F.aggregate(differing, F.lit(0), lambda a, x: a + x).alias("distance")
        found = _met(index, probes, counts).where(first).select("_row", "_id", distance)
        found = found if known is None else found.union(known)
        found = written(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "nearest")
        # All candidates of less than this distance have been met.
        covered = parts.count * (bits + 1)
        sure = written(found.groupBy("_row").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).where((F.col("n") == k) & (F.col("d") < covered)).select("_row"), "sure")
        finished.append(found.join(sure, "_row", "left_semi"))
        left = written(left.join(sure, "_row", "left_anti"), "open-queries")
        known = found.join(sure, "_row", "left_anti").select("_row", "_id", "distance")
    if indexed:
        discard(counts)
    arch = Architecture(BSC)
    vectors = [df.select(name, unpack(arch, F.col("_words"), size).alias("vec")) for df, name in ((left, "_row"), (there, "_id"))]
    rest = most_similar(*vectors, arch, k=k, query_col="_row", id_col="_id")
    rest = rest.select(F.col("query").alias("_row"), F.col("id").alias("_id"), F.round((1 - F.col("similarity")) * size / 2).cast("int").alias("distance"), "rank")
    for done in finished:
        rest = rest.unionByName(done)
    return rest.join(asked.select("_row", "query"), "_row").select("query", "rank", F.col("_id").alias("id"), "distance")


def _met(index: DataFrame, probes: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates and probes of equal parts. Probes are broadcast if they are small; else candidates of frequent values are dealt to several tasks."""
    small = broadcast_if_small(probes)
    if small is not probes:
        return index.join(small, ["part", "value"])
    hot = counts.where(F.col("n") > HOT_ROWS).select("part", "value", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("_salts"))
    hot = broadcast_if_small(hot)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = index.join(hot, ["part", "value"], "left").withColumn("_salt", F.pmod(F.xxhash64("_id"), salts).cast("int")).drop("_salts")
    spread = probes.join(hot, ["part", "value"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(spread, ["part", "value", "_salt"]).drop("_salt")


__all__ = ["Parts", "nearest"]
