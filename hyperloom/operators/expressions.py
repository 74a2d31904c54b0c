"""Tables of expressions: parts that several of them share are evaluated once.

A part has a key made of its operator and the keys of its operands, which are sorted where the algebra
commutes, so equal parts have equal keys wherever they stand. Symbols' vectors are functions of their
names and are made where they are needed; only vectors of shared parts are sent between tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.architectures import VTB, Architecture
from hyperloom.functions import kernels
from hyperloom.functions.algebra import VectorAlgebra
from hyperloom.operators.codebook import Codebook
from hyperloom.plans.expression import Expression, Mul, ParseError, Plus, Pow, UnknownValueError, Value
from hyperloom.plans.tables import broadcast_if_small, discard, written

#: Rows of one key from which it is joined in several tasks, one for each so many.
HOT_ROWS = 100_000
#: Who uses a part that is a whole expression.
ROOT = "root"


class Keys:
    """Keys of the parts of one expression."""

    def __init__(self, arch: Architecture, size: int) -> None:
        self.arch, self.size = arch, size
        self.known: dict[int, str] = {}

    def __getitem__(self, part: Expression) -> str:
        if id(part) not in self.known:
            if isinstance(part, Value):
                words = ["name", part.name]
            elif isinstance(part, Pow):
                words = ["^", self[part.base], str(part.exponent % self.size)]
            else:
                inner = [self[p] for p in operands(part)]
                commutes = self.arch.additive if isinstance(part, Plus) else self.arch.kind != VTB
                words = ["+" if isinstance(part, Plus) else "*", *(sorted(inner) if commutes else inner)]
            self.known[id(part)] = hashlib.sha256("\x00".join(words).encode()).hexdigest()[:32]
        return self.known[id(part)]


def operands(part: Expression) -> tuple[Expression, ...]:
    if isinstance(part, Plus):
        return part.terms
    if isinstance(part, Mul):
        return (part.left, part.right)
    return (part.base,) if isinstance(part, Pow) else ()


def parts_of(whole: Expression) -> Iterator[Expression]:
    """The expression and its parts that are no names."""
    left = [whole]
    while left:
        part = left.pop()
        if not isinstance(part, Value):
            yield part
            left += operands(part)


def value_of(whole: Expression, keys: Keys, known: Mapping[str, np.ndarray]) -> np.ndarray:
    """The vector of an expression, given vectors of some parts by their keys. No part is evaluated twice."""
    arch, size = keys.arch, keys.size
    found = dict(known)

    def value(part: Expression) -> np.ndarray:
        key = keys[part]
        if key not in found:
            steps = count()
            algebra = VectorAlgebra(arch, size, lambda: f"{key}|{next(steps)}")
            if isinstance(part, Value):
                found[key] = kernels.symbol(arch, part.name, size)
            elif isinstance(part, Pow):
                found[key] = algebra.power(value(part.base), part.exponent)
            elif isinstance(part, Mul):
                found[key] = algebra.multiply(value(part.left), value(part.right))
            else:
                found[key] = algebra.add_many([value(t) for t in part.terms])
        return found[key]

    return value(whole)


def evaluate_all(codebook: Codebook, table: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``table`` with ``vec``, the vector of the expression in ``text_col``, and ``error``.

    A text that is no expression, or null, or nested too deeply for Python, or that has a name which the codebook
    lacks (the first one is told), has a null ``vec`` and says why in ``error``. Vectors are those of
    ``Codebook.execute`` (sums of real vectors but for rounding, as their terms are not in the order of the text), except that a BSC sum draws its tie bits by its own key instead of by its place in
    the text: equal parts are equal everywhere. Each distinct part that more than one other part uses
    is evaluated once, those within others first; equal texts, and texts that differ only by
    commuting, are one. Where results are too many to be broadcast, rows of one frequent text are dealt
    by their other columns.
    """
    if {"vec", "error"} & set(table.columns):
        raise ValueError("the table has a column vec or error of its own")
    arch, size = codebook.arch, codebook.size
    text = F.col(f"`{text_col}`")
    texts = table.where(text.isNotNull()).groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    edge = "array<struct<user:string,part:string>>"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for line, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = {"text": line, "n": n, "root": None, "error": None, "names": [], "edges": []}
                try:
                    whole, keys = Expression.parse(line), Keys(arch, size)
                    row["root"], row["names"] = keys[whole], list(dict.fromkeys(whole.names()))
                    uses = {(ROOT, keys[whole])} if not isinstance(whole, Value) else set()
                    uses |= {(keys[p], keys[o]) for p in parts_of(whole) for o in operands(p) if not isinstance(o, Value)}
                    row["edges"] = [{"user": u, "part": p} for u, p in sorted(uses)]
                except ParseError as e:
                    row["error"] = str(e)
                except RecursionError:
                    row["error"] = "Expression is nested too deeply"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, parsed_arrow)

    parsed_arrow = pa.schema(
        [("text", pa.string()), ("n", pa.int64()), ("root", pa.string()), ("error", pa.string()), ("names", pa.list_(pa.string()))]
        + [("edges", pa.list_(pa.struct([("user", pa.string()), ("part", pa.string())])))]
    )
    parsed = written(texts.mapInArrow(parse, f"text string, n long, root string, error string, names array<string>, edges {edge}"), "expressions")
    named = parsed.select("text", F.posexplode("names").alias("pos", "name"))
    unknown = written(named.select("name").distinct().join(codebook.names, "name", "left_anti"), "unknown-names")
    missing = _joined(named, unknown, "name").groupBy("text").agg(F.min_by("name", "pos").alias("unknown"))
    told = parsed.join(missing, "text", "left")
    told = told.withColumn("error", F.coalesce("error", F.concat(F.lit(str(UnknownValueError(""))), "unknown"))).drop("unknown", "names")
    told = written(told, "checked-expressions")
    discard(parsed, unknown)
    fit = told.where("error IS NULL")

    # Which parts more than one other part uses, and in which texts they stand.
    shared = fit.select(F.explode("edges").alias("e")).select("e.*").distinct().groupBy("part").count().where("count > 1").select(F.col("part").alias("key"))
    shared = written(shared, "shared-parts")
    inside = fit.select("text", F.explode(F.array_distinct(F.transform("edges", lambda e: e["part"]))).alias("key"))
    cuts = _joined(inside, shared, "key").groupBy("text").agg(F.collect_set("key").alias("cuts"))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sent = [], set()
            for line, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole, keys, cut = Expression.parse(line), Keys(arch, size), set(found or ())
                levels: dict[str, tuple[int, set[str]]] = {}

                def level(part: Expression, keys: Keys = keys, cut: set[str] = cut, levels: dict = levels) -> tuple[int, set[str]]:
                    """How many shared parts stand within each other below this one, and the topmost of them."""
                    key = keys[part]
                    if key not in levels:
                        depth, top = 0, set()
                        for o in operands(part):
                            if isinstance(o, Value):
                                continue
                            below, within = level(o)
                            below, within = (below + 1, {keys[o]}) if keys[o] in cut else (below, within)
                            depth, top = max(depth, below), top | within
                        levels[key] = (depth, top)
                    return levels[key]

                for part in (whole, *(p for p in parts_of(whole) if keys[p] in cut)):
                    if keys[part] not in sent:
                        sent.add(keys[part])
                        depth, top = level(part)
                        rows.append({"key": keys[part], "level": depth, "text": str(part), "cuts": sorted(top)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("cuts", pa.list_(pa.string()))]))

    made = fit.select("text").join(cuts, "text", "left").mapInArrow(units, "key string, level int, text string, cuts array<string>")
    made = written(made.groupBy("key").agg(F.min(F.struct("level", "text", "cuts")).alias("u")).select("key", "u.*"), "parts")
    vector = T.ArrayType(T.DoubleType() if arch.real else T.ByteType())
    arrow = pa.list_(pa.float64() if arch.real else pa.int8())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 22) // size)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                out = []
                for line, given in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    known = {g["cut"]: np.array(g["vec"], np.float64 if arch.real else np.int8) for g in given or ()}
                    out.append(value_of(Expression.parse(line), Keys(arch, size), known))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, arrow)], ["key", "vec"])

    schema = T.StructType().add("key", "string").add("vec", vector)
    given = T.ArrayType(T.StructType().add("cut", "string").add("vec", vector))
    done: DataFrame | None = None
    # As many turns as shared parts stand within each other.
    for turn in range((made.agg(F.max("level")).first()[0] or 0) + 1):
        now = made.where(F.col("level") == turn)
        if done is None:
            rows = now.select("key", "text", F.lit(None).cast(given).alias("given"))
        else:
            wanted = now.select("key", F.explode("cuts").alias("cut"))
            vectors = _joined(wanted, done.withColumnRenamed("key", "cut"), "cut", salt=F.col("key"))
            rows = now.join(vectors.groupBy("key").agg(F.collect_list(F.struct("cut", "vec")).alias("given")), "key").select("key", "text", "given")
        found = written(rows.mapInArrow(run, schema), "part-vectors")
        done = found if done is None else done.union(found)
    discard(shared, made)
    by_text = _joined(told.select("text", "n", F.col("root").alias("key"), "error"), done, "key", how="left").select(F.col("text").alias("_text"), "error", "vec")
    # Salts follow from the rows themselves, so a task that is run again deals them as before.
    plain = [f.name for f in table.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    out = _joined(table.withColumn("_text", text), by_text, "_text", salt=F.struct(*[F.col(f"`{c}`") for c in plain]), how="left")
    error = F.when(text.isNull(), F.lit("Invalid expression")).otherwise(F.col("error"))
    return out.select(*[F.col(f"`{c}`") for c in table.columns], "vec", error.alias("error"))


def canonical(arch: Architecture, size: int, table: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``table`` with ``shown``, the expression in ``text_col`` with all its parentheses, and ``key``.

    Keys are equal exactly where expressions are but for the order of operands that commute in ``arch``. Both are
    null where ``evaluate_all`` would tell an error of the text itself; names need not be known.
    """
    if {"shown", "key"} & set(table.columns):
        raise ValueError("the table has a column shown or key of its own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str | None, str | None]] = []
            for line in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                try:
                    whole = None if line is None else Expression.parse(line)
                    rows.append((None, None) if whole is None else (str(whole), Keys(arch, size)[whole]))
                except (ParseError, RecursionError):
                    rows.append((None, None))
            made = [pa.array([r[i] for r in rows], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "shown", "key"])

    return table.mapInArrow(run, T.StructType([*table.schema.fields]).add("shown", "string").add("key", "string"))


def _joined(rows: DataFrame, one: DataFrame, key: str, *, salt: Column | None = None, how: str = "inner") -> DataFrame:
    """``rows`` with ``one``, which has each ``key`` once: broadcast if it is small, else with hot keys in several tasks."""
    small = broadcast_if_small(one)
    if small is not one:
        return rows.join(small, key, how)
    hot = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / HOT_ROWS).cast("int").alias("_salts")).where(F.col(key).isNotNull() & (F.col("_salts") > 1))
    hot = broadcast_if_small(written(hot, "hot-keys"))
    spread = F.coalesce("_salts", F.lit(1))
    by = F.xxhash64(salt if salt is not None else F.col("text"))
    rows = rows.join(hot, key, "left").withColumn("_salt", F.pmod(by, spread).cast("int")).drop("_salts")
    one = one.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), spread - 1))).drop("_salts")
    return rows.join(one, [key, "_salt"], how).drop("_salt")


__all__ = ["Keys", "canonical", "evaluate_all", "value_of"]
