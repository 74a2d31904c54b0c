"""Fill-in-the-middle examples: texts cut at two line ranks and put together anew, on ropes."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.common import passes_columns
from hyperloom.llm.rope import Rope, build, join, split_chars, split_units

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Rows of a batch that are Python objects at a time.
SLICE = 128
CUT = "struct<n:bigint,prefix_chars:bigint,middle_chars:bigint,output:string>"


def draws(ident: Column, seed: int) -> list[Column]:
    """Four unsigned integers: the first groups of eight digits of the SHA-256 of ``seed:ident``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def rearranged(text: str, form: str, first: int, second: int) -> tuple[int, int | None, int | None, str]:
    """Lines of ``text``, code points of its prefix and middle, and the example."""
    whole = build(text)
    n = whole.units if whole else 0
    if form == "plain":
        return n, None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    head, suffix = split_units(whole, high)
    prefix, middle = split_units(head, low)
    p, s, m = map(build, (PREFIX, SUFFIX, MIDDLE))
    parts = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    return n, _chars(prefix), _chars(middle), str(join(*parts))


def _chars(rope: Rope | None) -> int:
    return rope.chars if rope else 0


def restored(output: str, form: str) -> str:
    """The text of an example. No text that is cut holds a sentinel, so each stands there once; the
    tree is split at their ranks and the pieces are joined in their old order."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    b = output.index(second, len(first))
    c = output.index(MIDDLE, b)
    rest, pieces = build(output), []
    for cut in (c + len(MIDDLE), c, b + len(second), b, len(first)):
        rest, piece = split_chars(rest, cut)
        pieces.append(piece)
    middle, _, later, _, earlier = pieces
    prefix, suffix = (earlier, later) if form == "psm" else (later, earlier)
    return str(join(prefix, middle, suffix) or "")


def _form(text: Column, chance: Column, kind: Column, rate: int, spm: int) -> Column:
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    return F.when((text == "") | marked | (chance % 100 >= rate), "plain").when(kind % 100 < spm, "spm").otherwise("psm")


@passes_columns
def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """``docs`` with ``n`` (lines), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    A line is a run up to and with its line feed; the last one may lack it. Hashes of the id choose
    two line ranks, whether the text is cut (``rate`` of 100) and how (``spm`` of 100). The prefix
    ends at the smaller rank, the middle at the larger. ``psm`` is ``<P>prefix<S>suffix<M>middle``,
    ``spm`` is ``<S>suffix<P>prefix<M>middle``.

    Each text is a rope whose nodes know their lines and code points: two splits by line rank, and
    joins with the sentinels, copy no more than the leaves that are cut. Hashes and forms are Spark
    expressions; one row at a time is in Python.

    Defined cases: null counts as empty; empty texts and such as contain a sentinel are plain, with
    null counts of code points; a null id hashes as the empty string; rows of one id are cut at the
    same draws; ties of the ranks leave an empty middle; an empty table gives an empty result.
    Columns named like the added ones are replaced, others pass through.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    text = F.coalesce(F.col(text_col), F.lit(""))

    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, forms: pa.Array, firsts: pa.Array, seconds: pa.Array) -> pa.Array:
        names, kind = ("n", "prefix_chars", "middle_chars", "output"), _arrow(CUT)
        return _sliced(lambda *row: dict(zip(names, rearranged(*row), strict=True)), kind, texts, forms, firsts, seconds)

    kept = [c for c in docs.columns if c in (id_col, text_col) or c not in added]
    rows = docs.select(*kept, _form(text, h3, h4, rate, spm).alias("_form"), h1.alias("_h1"), h2.alias("_h2"))
    rows = rows.withColumn("_cut", cut(text, "_form", "_h1", "_h2"))
    return rows.select(*kept, "_cut.n", F.col("_form").alias("form"), "_cut.prefix_chars", "_cut.middle_chars", "_cut.output")


def _sliced(of: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``of`` for each row, with few rows as Python objects at a time."""
    slices = [pa.array([of(*row) for row in zip(*[c.slice(k, SLICE).to_pylist() for c in columns], strict=True)], kind) for k in range(0, len(columns[0]), SLICE)]
    return pa.concat_arrays(slices) if slices else pa.array([], kind)


def _arrow(kind: str) -> pa.StructType:
    fields = (f.split(":") for f in kind.removeprefix("struct<").removesuffix(">").split(","))
    return pa.struct([(name, pa.int64() if what == "bigint" else pa.string()) for name, what in fields])


def restore(examples: DataFrame, *, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``examples`` with ``restored``: the exact text, from nothing but the output and its form.

    Null outputs or forms give null; an empty table gives an empty result.
    """

    @F.arrow_udf("string")
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return _sliced(lambda o, f: None if o is None or f is None else restored(o, f), pa.string(), outputs, forms)

    return examples.withColumn("restored", back(output_col, form_col))
