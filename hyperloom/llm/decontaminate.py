"""Benchmark passages in documents: winnowed fingerprints, joined and extended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.common import NON_WORD, broadcast_if_small, discard, lower_ascii, meeting, passes_columns, row_key, written


def words_of(text: Column) -> Column:
    """Alphanumeric words, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NON_WORD, -1), "")


def _grams(words: str, size: int, value) -> Column:
    """``value(slice)`` for each run of ``size`` of the array column ``words``, in order."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - (size - 1))
    return F.when(n >= size, F.transform(starts, lambda i: value(F.slice(words, i, size))))


def _around(n: Column, length: int, reach: int):
    """For a gram of ``reach`` words: where windows of ``length`` words that hold it start."""
    low, high = F.lit(0), n - length
    return lambda p: F.sequence(F.least(F.greatest(p - (length - reach), low), high), F.greatest(F.least(p, high), low))


def _hashed(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _lesser(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _paired(rows: DataFrame, left: str, right: str, ahead: int, combine, out: str) -> DataFrame:
    """``rows`` with ``out``: each element of the array ``left`` combined with that of ``right`` so many places ahead."""
    n = F.greatest(F.least(F.size(left), F.size(right) - ahead), F.lit(0))
    return rows.withColumn(out, F.zip_with(F.slice(left, 1, n), F.slice(right, ahead + 1, n), combine))


def with_grams(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` (with ``_words``) plus ``_gram<n>`` for each n: hashes of all runs of n words, in order.

    The hash of a run is made of those of its parts of 1, 2, 4, ... words, which overlapping runs share.
    Explode these columns with an outer function: for others Spark adds a filter on their size, into
    which it copies the chain of columns over and over.
    """
    rows = rows.withColumn("_gram1", F.transform("_words", lambda w: F.xxhash64(w)))
    made = {1}
    for size in sorted(sizes):
        done = 0
        for bit in (1 << k for k in range(size.bit_length())):
            if bit not in made:
                half = bit // 2
                rows = _paired(rows, f"_gram{half}", f"_gram{half}", half, _hashed, f"_gram{bit}")
                made.add(bit)
            if size & bit:
                if done and done + bit not in made:
                    rows = _paired(rows, f"_gram{done}", f"_gram{bit}", done, _hashed, f"_gram{done + bit}")
                    made.add(done + bit)
                done += bit
    return rows.drop(*[f"_gram{n}" for n in made if n not in sizes])


def _sliding_least(rows: DataFrame, column: str, span: int) -> DataFrame:
    """``rows`` with ``column`` replaced by the least of each ``span`` consecutive elements."""
    width = 1
    while width < span:
        ahead = min(width, span - width)
        rows = _paired(rows, column, column, ahead, _lesser, "_least").drop(column).withColumnRenamed("_least", column)
        width += ahead
    return rows


def _of_length(length: int):
    """A gram's hash as the mark of a short item of ``length`` words."""
    return lambda gram: F.xxhash64(F.lit(length), gram)


def with_fingerprints(rows: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    """``rows`` (with ``_words``) plus ``_marks``: distinct winnowed fingerprints and short-item grams.

    The least gram hash of each ``window - gram + 1`` consecutive grams is taken, so two texts that
    share ``window`` words share a fingerprint. Each of the lengths ``short`` adds all grams of that
    length, hashed together with it.
    """
    marked = with_grams(rows, [gram, *short])
    if gram in short:
        marked = marked.withColumn("_chosen", F.col(f"_gram{gram}"))
    else:
        marked = marked.withColumnRenamed(f"_gram{gram}", "_chosen")
    marked = _sliding_least(marked, "_chosen", window - gram + 1)
    marks = F.array_distinct("_chosen")
    for length in short:
        marks = F.array_union(marks, F.transform(f"_gram{length}", _of_length(length)))
    return marked.withColumn("_marks", marks).drop("_chosen", *[f"_gram{n}" for n in short])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = 13,
    gram: int = 5,
    share: int = 20,
) -> DataFrame:
    """One row per row of ``docs``: which of its words stand in benchmark windows.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is
    one window. Columns: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the
    row's key ``_k1, _k2``; contaminated means n_hit > 0 and ``share * n_hit >= n_words``.

    Documents are winnowed in their own rows and their fingerprints meet those of the benchmark. Only
    documents with a hit are read again; their words are written once. Their grams, with positions,
    meet the benchmark's fingerprints in a join, and the windows that hold such a gram are compared
    by their words. So documents are read twice whatever lengths the items have, and work is linear
    in the words of a document. The benchmark's side of a join is broadcast while its measured bytes
    stay in bounds, and shuffled beyond.

    Defined cases: null and empty texts have no words and are clean; items without words are
    ignored; items of null id count as ''; of rows that repeat each gets its row; with an empty
    benchmark all is clean; an empty table gives an empty result; other columns are ignored.
    """
    stored = written(
        benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("_item"), words_of(F.col(text_col)).alias("_words")), "items"
    )
    items = stored.where(F.size("_words") > 0)
    short = sorted(r[0] for r in items.select(F.size("_words").alias("n")).where(F.col("n") < window).distinct().collect())
    pieces = F.when(F.size("_words") < window, F.array(F.array_join("_words", " "))).otherwise(
        _grams("_words", window, lambda w: F.array_join(w, " "))
    )
    windows = written(items.select("_item", F.size("_words").alias("_n"), F.explode(F.array_distinct(pieces)).alias("_window")), "windows")
    sized = items.withColumn("_n", F.size("_words"))
    marks = with_fingerprints(sized.where(F.col("_n") >= window), window, gram, []).select(F.lit(window).alias("_length"), F.explode_outer("_marks").alias("_mark"))
    # A short item is found by its own length alone, not by the shorter grams within it.
    for length in short:
        own = with_grams(sized.where(F.col("_n") == length), [length]).select(F.lit(length), F.explode_outer(F.transform(f"_gram{length}", _of_length(length))))
        marks = marks.union(own)
    marks = written(marks.distinct().where("_mark IS NOT NULL"), "marks")
    known = written(marks.select("_mark").distinct(), "known-marks")

    key = row_key(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), *key, words_of(F.col(text_col)).alias("_words"))
    base = with_fingerprints(rows, window, gram, short)
    base = written(base.select("doc_id", "_k1", "_k2", F.size("_words").cast("long").alias("n_words"), "_marks"), "fingerprints")
    hits = meeting(base.select("_k1", "_k2", F.explode("_marks").alias("_mark")), known, "_mark")
    hits = written(hits.select("_k1", "_k2").distinct(), "hits")
    again = docs.select(*key, F.col(text_col).alias("_text")).join(broadcast_if_small(hits), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    again = written(again.select("_k1", "_k2", words_of(F.col("_text")).alias("_words")), "hit-words")

    starts = None
    for length in [*short, window]:
        reach = gram if length == window else length
        grams = F.col(f"_gram{reach}") if length == window else F.transform(f"_gram{reach}", _of_length(length))
        there = with_grams(again, [reach]).select("_k1", "_k2", F.size("_words").alias("_n"), F.posexplode_outer(grams).alias("_at", "_mark"))
        met = meeting(there, marks.where(F.col("_length") == length).select("_mark"), "_mark").where(F.col("_n") >= length)
        met = met.select("_k1", "_k2", F.explode(_around(F.col("_n"), length, reach)(F.col("_at"))).alias("_start"))
        met = met.groupBy("_k1", "_k2").agg(F.collect_set("_start").alias("_starts")).withColumn("_length", F.lit(length))
        starts = met if starts is None else starts.union(met)
    texts = again.join(starts, ["_k1", "_k2"]).select("_k1", "_k2", "_words", "_length", F.explode("_starts").alias("_start"))
    candidates = texts.select("_k1", "_k2", "_start", "_length", F.array_join(F.slice("_words", F.col("_start") + 1, F.col("_length")), " ").alias("_window"))
    distinct = written(windows.select("_window").distinct(), "distinct-windows")
    places = written(meeting(candidates, distinct, "_window"), "places")
    discard(again, hits, known, distinct, marks, stored)

    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("_start", (F.col("_start") + F.col("_length")).alias("end")))),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["upto"], s["end"]).alias("upto"),
            (acc["n"] + F.greatest(s["end"] - F.greatest(acc["upto"], s["_start"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    covered = places.groupBy("_k1", "_k2").agg(fold.alias("n_hit"))
    met = places.select("_k1", "_k2", "_window").distinct().join(windows.select("_window", "_item"), "_window")
    named = met.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("_item")).alias("_items"))
    found = written(covered.join(named, ["_k1", "_k2"]), "contamination")
    discard(places, windows)
    found = broadcast_if_small(found)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return base.join(found, ["_k1", "_k2"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.when(F.col("_items").isNull(), 0).otherwise(F.size("_items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        "_k1",
        "_k2",
    )


@passes_columns
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """``docs`` without its contaminated rows; all columns stay as they are."""
    id_col, text_col = str(options.get("id_col", "doc_id")), str(options.get("text_col", "text"))
    bad = written(contamination(docs, benchmark, **options).where("contaminated").select("_k1", "_k2").distinct(), "contaminated")
    bad = broadcast_if_small(bad)
    keyed = docs.select("*", *row_key(F.col(id_col), F.col(text_col)))
    return keyed.join(bad, ["_k1", "_k2"], "left_anti").select(*docs.columns)
