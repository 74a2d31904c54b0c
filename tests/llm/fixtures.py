"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = [f"w{i % 97}x{i % 13}" for i in range(4000)]
LONG = " ".join(WORDS)
PASSAGE = " ".join(f"p{i}" for i in range(60))
MIXED = "Über Ärger İ ẞ x y ΑΒΓ"
TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "Two words",
    "The quick brown fox jumps over the lazy dog",
    "the QUICK brown fox jumps over the lazy dog",
    f"start {PASSAGE} end",
    f"other start here {PASSAGE} and another end",
    f"{PASSAGE} {PASSAGE}",
    MIXED,
    MIXED.replace("x", "X"),
    LONG,
    LONG + " tail",
    "line\n  Line \nother\r\nline\n\n",
    "🙂 emoji 🙂 and\nline",
    "Released under the MIT License. Apache License, Version 2.0 and CC BY-NC 4.0, under the mit license",
]

CLASHES = ("keep_id", "n_words", "kept", "n_lines", "n_dropped", "fp", "component_id", "score", "h1", "b", "w", "n", "u", "v", "key", "labels", "n_removed")


def documents(spark: SparkSession, *, clashes: bool = True) -> DataFrame:
    """Texts under ids 0.., one row twice, one text under a null id."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, TEXTS[5], "en", "src1", 1), (100, TEXTS[8], "de", "src0", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clashes else df


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark).where("false")


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    """Rows as sortable tuples."""
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)
