"""License scans: exact set-similarity join of text blocks with license wordings."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm.common import broadcast_if_small, discard, row_key, written
from hyperloom.llm.decontaminate import words_of
from hyperloom.llm.license_texts import PHRASES, SENTENCES, TEXTS
from hyperloom.plans.tables import numbered

#: Words from one block to the next for the shortest templates; twice as many for those of up to twice the words, and so on.
STRIDE = 4
#: Template words that are looked for as literals, within the rows of documents. More are joined.
LITERALS = 5_000


@dataclass(frozen=True)
class Template:
    """``phrase`` stands for ``label`` where a block holds the share ``least`` of its distinct words.
    The template's own length says how wide its blocks are, whatever other templates there are.

    A ``consecutive`` template counts only where all its words stand in a row, and each such place
    counts.
    """

    label: str
    phrase: str
    least: float = 0.8
    consecutive: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall("[a-z0-9]+", self.phrase.lower())

    @property
    def needed(self) -> int:
        return math.ceil(self.least * len(set(self.words)) - 1e-9)

    def stride(self, least: int = STRIDE) -> int:
        """Words from one block to the next: ``least``, doubled until a block can hold the whole template."""
        while len(self.words) > least + 1:
            least *= 2
        return least

    def width(self, least: int = STRIDE) -> int:
        """Words of a block: as few as hold every place that begins before the next block."""
        return self.stride(least) + len(self.words) - 1


BASE = tuple(Template(label, phrase, 1.0, True) for label, phrase in PHRASES)
STATEMENTS = (
    *(Template(label, phrase) for label, phrase in SENTENCES),
    Template("all-rights-reserved", "all rights reserved", 1.0),
    *(Template(label, text) for label, text in TEXTS),
)


def template_table(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """``templates`` as the table that ``scan`` takes."""
    return spark.createDataFrame([(t.label, t.phrase, t.least, t.consecutive) for t in templates], "label string, phrase string, least double, consecutive boolean")


def _prepared(templates: DataFrame, stride: int) -> DataFrame:
    """``tid, label, consecutive, phrase`` (words), ``needed``, ``stride``; templates without words are left out."""
    words = words_of(F.col("phrase"))
    rows = templates.select("label", F.coalesce("consecutive", F.lit(False)).alias("consecutive"), "least", words.alias("phrase")).where(F.size("phrase") > 0)
    beyond = F.floor((F.size("phrase") - 2) / stride).cast("int")
    doubled = F.when(beyond > 0, F.length(F.bin(beyond))).otherwise(0)
    needed = F.greatest(F.ceil(F.col("least") * F.size(F.array_distinct("phrase")) - 1e-9).cast("int"), F.lit(1))
    rows = rows.withColumn("needed", needed).withColumn("stride", (stride * F.pow(F.lit(2), doubled)).cast("int"))
    return rows.drop("least").withColumn("tid", F.monotonically_increasing_id())


def _blocks_at(at: Column, stride: int) -> Column:
    """The numbers of the blocks of ``2 * stride`` words that hold the positions ``at``."""
    number = lambda i: (i / stride).cast("int")
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.when(i >= stride, F.array(number(i) - 1, number(i))).otherwise(F.array(number(i))))))


def _of_words(words: list[str], hit: Column) -> Column:
    return hit["w"].isin(words)


def _of_stride(stride: int, hit: Column) -> Column:
    return hit["stride"] == stride


def _at(keep: Callable[[Column], Column]) -> Column:
    """The positions of the hits of one stride."""
    return F.transform(F.filter("_hits", lambda hit: keep(hit)), lambda hit: hit["i"])


def _block(stride: int):
    return lambda b: F.struct(F.lit(stride).alias("stride"), b.alias("b"), F.slice("_words", b * stride + 1, 2 * stride).alias("w"))


def scan(
    docs: DataFrame,
    templates: DataFrame | tuple[Template, ...] = BASE + STATEMENTS,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    stride: int = STRIDE,
    literals: int = LITERALS,
) -> DataFrame:
    """One row per row of ``docs`` with the license statements that its whole text holds.

    ``templates`` is a table (``label, phrase, least, consecutive``) of any size with phrases of any
    length, or a tuple that becomes one. Template words are ordered by how often they occur in all
    documents, rarest first. A block that holds ``needed`` of a template's distinct words holds one of
    its first ``size - needed + 1``: only blocks around such a prefix word are built. Templates of up to
    ``stride + 1`` words have blocks every ``stride`` words, longer ones every twice as many, and so on; a
    template of n words looks at ``stride + n - 1`` words of each of its blocks, so it lies in one of
    them whole, and which other templates there are changes nothing for it. Blocks meet templates
    over prefix words (prefix filter), pass if they have enough template words (length filter) and
    if enough can follow the common word in both orders (positional filter), all on blocks of the
    longest template that their stride allows, and are then counted exactly on the template's own
    words, once, at their first common word.

    Up to ``literals`` template words are found within the documents' own rows. More are joined with the
    words of the documents, and positions come back to the texts, which are shuffled once for that.
    Templates, ranks and prefix words are broadcast only if their measured bytes are few.

    Columns: ``doc_id, n_words, n_base`` (places of consecutive templates), ``first_word,
    last_word`` (their smallest and largest start from 0, else null), ``base_labels`` and ``labels``
    (distinct, sorted, comma-joined; ``labels`` has those of statements too) and ``score`` (the
    largest share of a template that was found, 0 if none).

    Defined cases: null and empty texts have no words, no labels ('') and score 0; each of rows that
    repeat has its row; templates without words are never found; no templates or an empty table give
    rows without labels or none; other columns are ignored.
    """
    spark = docs.sparkSession
    table = templates if isinstance(templates, DataFrame) else template_table(spark, templates)
    table = written(_prepared(table, stride), "templates")
    classes = sorted(r["stride"] for r in table.select("stride").distinct().collect())
    words = words_of(F.col(text_col))

    vocabulary = written(table.select(F.explode("phrase").alias("w")).distinct(), "vocabulary")
    few = vocabulary.count() <= literals
    if few:
        known = [r["w"] for r in vocabulary.collect()]
        seen = docs.select(F.explode(F.filter(words, lambda w: w.isin(known))).alias("w"))
    else:
        seen = docs.select(F.explode(words).alias("w")).join(broadcast_if_small(vocabulary), "w", "left_semi")
    counts = seen.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counted = vocabulary.join(counts, "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n"))
    ranked_words = written(numbered(counted, ["n", "w"], "rank").select("rank", "w"), "ranks")
    ranks = broadcast_if_small(ranked_words)
    ordered = table.select("tid", F.explode(F.array_distinct("phrase")).alias("w")).join(ranks, "w")
    ordered = table.join(ordered.groupBy("tid").agg(F.array_sort(F.collect_list("rank")).alias("ranks")), "tid")
    ordered = written(ordered, "ordered")
    index = ordered.select("tid", "stride", "needed", F.size("ranks").alias("whole"), F.posexplode(F.slice("ranks", 1, F.size("ranks") - F.col("needed") + 1)).alias("p", "rank"))
    prefix = written(index.select("stride", "rank").distinct().join(ranks, "rank").select("stride", "w"), "prefix")

    rows = docs.select(F.col(id_col).alias("doc_id"), *row_key(F.col(id_col), F.col(text_col)), words.alias("_words"))
    if few:
        chosen: dict[int, list[str]] = {s: [] for s in classes}
        for r in prefix.collect():
            chosen[r["stride"]].append(r["w"])
        every = sorted(set().union(*chosen.values()))
        rows = rows.withColumn("_hits", F.array_compact(F.transform("_words", lambda w, i: F.when(w.isin(every), F.struct(i.alias("i"), w.alias("w"))))))
        at = {s: _at(partial(_of_words, of)) for s, of in chosen.items()}
    else:
        hits = rows.select("_k1", "_k2", F.posexplode("_words").alias("_i", "w")).join(broadcast_if_small(prefix), "w")
        hits = hits.groupBy("_k1", "_k2").agg(F.collect_set(F.struct(F.col("_i").alias("i"), "stride")).alias("_hits"))
        rows = rows.join(hits, ["_k1", "_k2"], "left").withColumn("_hits", F.coalesce("_hits", F.array().cast("array<struct<i:int,stride:int>>")))
        at = {s: _at(partial(_of_stride, s)) for s in classes}
    parts = [F.array().cast("array<struct<stride:int,b:int,w:array<string>>>")]
    for s in classes:
        parts.append(F.transform(_blocks_at(at[s], s), _block(s)))
    base = written(rows.select("doc_id", "_k1", "_k2", F.size("_words").cast("long").alias("n_words"), F.concat(*parts).alias("_blocks")), "blocks")

    key = ["_k1", "_k2", "stride", "b"]
    blocks = base.select("_k1", "_k2", F.explode("_blocks").alias("_block")).select("_k1", "_k2", "_block.stride", "_block.b", "_block.w").dropDuplicates(key)
    blocks = written(blocks, "distinct-blocks")
    ranked = blocks.select(*key, F.posexplode("w").alias("i", "w")).join(ranks, "w")
    ranked = ranked.groupBy(*key).agg(F.collect_list(F.struct("i", "rank")).alias("_placed"))
    ranked = ranked.withColumn("_ranks", F.array_sort(F.array_distinct(F.col("_placed.rank"))))
    met = ranked.select(*key, "_placed", "_ranks", F.posexplode("_ranks").alias("q", "rank")).join(broadcast_if_small(index), ["rank", "stride"])
    size, whole = F.size("_ranks"), F.col("whole")
    met = met.where(size >= F.col("needed")).where(F.least("p", "q") + F.least(whole - F.col("p"), size - F.col("q")) >= F.col("needed"))
    met = met.join(broadcast_if_small(ordered.select("tid", "label", "consecutive", "phrase", "ranks")), "tid")
    width = F.col("stride") + F.size("phrase") - 1
    met = met.withColumn("_own", F.filter("_placed", lambda x: x["i"] < width)).withColumn("_common", F.array_intersect(F.col("_own.rank"), "ranks"))
    met = met.where((F.size("_common") >= F.col("needed")) & (F.array_min("_common") == F.col("rank")))
    met = written(met.select(*key, "label", "consecutive", "phrase", (F.size("_common") / whole).alias("share")), "met")
    n = F.size("phrase")
    # A place belongs to the block that its first word opens, which holds all of it.
    last = F.least(F.size("w") - n, F.col("stride") - 1)
    places = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice("w", i + 1, n) == F.col("phrase"))
    rowwise = met.where("consecutive").join(blocks, key).withColumn("_places", places).where(F.size("_places") > 0)
    start = F.col("b") * F.col("stride")
    rowwise = rowwise.select("_k1", "_k2", "label", "share", F.size("_places").alias("n"), (start + F.array_min("_places")).alias("low"), (start + F.array_max("_places")).alias("high"))
    nothing = F.lit(None).cast("int")
    loose = met.where("NOT consecutive").select("_k1", "_k2", "label", "share", nothing.alias("n"), nothing.alias("low"), nothing.alias("high"))
    found = rowwise.union(loose).groupBy("_k1", "_k2").agg(
        F.sum("n").alias("n_base"),
        F.min("low").cast("long").alias("first_word"),
        F.max("high").cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("n").isNotNull(), F.col("label"))).alias("_base"),
        F.collect_set("label").alias("_all"),
        F.max("share").alias("score"),
    )
    found = written(found, "licenses")
    discard(table, vocabulary, ranked_words, ordered, prefix, blocks, met)
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return base.drop("_blocks").join(found, ["_k1", "_k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        joined("_base").alias("base_labels"),
        joined("_all").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
