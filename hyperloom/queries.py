"""Registered queries of the algebra, the codebook and the folds, each with its DuckDB SQL.

Results are in long form: one row per dimension, real numbers rounded to six places. Symbols use
seed 42; ``SIZE`` elements keep the SQL, which spells every vector out, within reach.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperloom import api
from hyperloom.architectures import BSC, HRR, MAP, VTB, Architecture
from hyperloom.functions import colors, kernels, symbols, vectors
from hyperloom.functions.algebra import ColumnVectorAlgebra
from hyperloom.operators import packed
from hyperloom.operators.aggregates import bind_groups, bundle_groups, bundle_sql
from hyperloom.operators.codebook import Cell, Codebook, ColumnKey, Index, as_codes
from hyperloom.operators.expressions import canonical, evaluate_all
from hyperloom.operators.hamming import nearest
from hyperloom.operators.search import most_similar
from hyperloom.operators.stored import StoredCodebook
from hyperloom.operators.subset import Subset
from hyperloom.plans.expression import ColumnNumberAlgebra, Expression
from hyperloom.plans.tables import broadcast_if_small, scratch_path, written
from hyperloom.sources import table

SIZE = 64
ORDERS = ("o_orderstatus", "o_orderpriority")
ITEMS = ("l_returnflag", "l_linestatus")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def arch(kind: str) -> Architecture:
    return Architecture(kind, 42)


# SQL for symbols. Dimensions are called j.


def _bit(name: str, j: str = "j") -> str:
    digit = f"substr(md5('42|' || {name} || '|' || ({j} // 128)), ({j} % 128) // 4 + 1, 1)"
    return f"((instr('0123456789abcdef', {digit}) - 1) // (2 ** ({j} % 4))::int) % 2"


def _sign(name: str, j: str = "j") -> str:
    return f"(2 * ({_bit(name, j)}) - 1)"


def _tie(key: str, j: str = "j") -> str:
    return _bit(f"'tie|' || {key}", j)


def _real(name: str, j: str = "j") -> str:
    return f"(('0x' || substr(md5('42|' || {name} || '|' || ({j} // 4)), ({j} % 4) * 8 + 1, 8))::bigint / 2147483648.0 - 1.0)"


DIMS = f"j AS (SELECT unnest(generate_series(0, {SIZE - 1})) AS j)"


def _real_symbols(names: str) -> str:
    """Common table expressions: ``sym(name, j, x)``, of unit length, for the names of a query."""
    return f"""{DIMS}, nm AS (SELECT DISTINCT name FROM ({names})),
        raw AS MATERIALIZED (SELECT name, j, {_real('name')} AS x FROM nm, j),
        sym AS MATERIALIZED (SELECT name, j, x / sqrt(sum(x * x) OVER (PARTITION BY name)) AS x FROM raw)"""


def rounded(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def exploded(df: DataFrame, *keys: str, vec: str = "vec", real: bool = False) -> DataFrame:
    """Keys, ``dim`` and ``value`` of an array column."""
    out = df.select(*keys, F.posexplode(vec).alias("dim", "value"))
    return out.withColumn("value", rounded(F.col("value"))) if real else out.withColumn("value", F.col("value").cast("long"))


def orders(spark: SparkSession, sf_dir: str, *, nulls: bool = False, key: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    status = F.nullif(F.col("o_orderstatus"), F.lit("P")) if nulls else F.col("o_orderstatus")
    priority = F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")) if nulls else F.col("o_orderpriority")
    return rows.select(*["o_orderkey"] * key, status.alias("o_orderstatus"), priority.alias("o_orderpriority"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*ITEMS)


def folds(df: DataFrame, kind: str, size: int = SIZE, **options: object) -> Subset:
    """A table against the codebook of its own columns and values, and checked against it."""
    hidden = [str(options[o]) for o in ("order_by",) if o in options] + list(options.get("group_by", ()))
    plain = [c for c in df.columns if c not in hidden]
    book = Codebook.from_dataframe(arch(kind), size, df.select(*plain), enums=options.get("enums"))
    subset = Subset(book, df, **options)
    subset.validate()
    return subset


def whole(df: DataFrame) -> DataFrame:
    return df.withColumn("value", rounded(F.col("value")) if df.schema["value"].dataType.simpleString() == "double" else F.col("value").cast("long"))


# Symbols


@register("codebook_map", f"WITH {DIMS} SELECT r_name AS name, j::int AS dim, {_sign('r_name')}::bigint AS value FROM region, j")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    return exploded(names.select("name", symbols.symbol(arch(MAP), F.col("name"), SIZE).alias("vec")), "name")


@register("codebook_bsc", f"WITH {DIMS} SELECT n_name AS name, j::int AS dim, ({_bit('n_name')})::bigint AS value FROM nation, j")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select("n_name")
    book = Codebook.from_dataframe(arch(BSC), SIZE, names)
    return exploded(book.vectors().where(F.col("name") != "n_name"), "name")


@register(
    "codebook_hrr",
    f"WITH {_real_symbols('SELECT r_name AS name FROM region')} SELECT name, j::int AS dim, round(x, 6) + 0.0 AS value FROM sym",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "region").select("r_name")
    book = Codebook.from_dataframe(arch(HRR), SIZE, names)
    return exploded(book.vectors().where(F.col("name") != "r_name"), "name", real=True)


# Algebra on array columns


def _pairs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Each nation with the vectors of its name (a) and its region's name (b)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("other"))
    return rows.select("name", *[symbols.symbol(arch(kind), F.col(c), SIZE).alias(v) for c, v in (("name", "a"), ("other", "b"))])


def _pair_sql(value: str, cast: str = "bigint") -> str:
    return f"""WITH {DIMS} SELECT n_name AS name, j::int AS dim, ({value})::{cast} AS value
        FROM nation JOIN region ON n_regionkey = r_regionkey, j"""


_A, _B = _sign("n_name"), _sign("r_name")


def _algebra(name: str, kind: str, sql: str, make: Callable[[Architecture, Column, Column], Column]) -> None:
    @register(name, sql)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = make(arch(kind), F.col("a"), F.col("b"))
        return exploded(_pairs(spark, sf_dir, kind).select("name", made.alias("vec")), "name")


_algebra("bind_map", MAP, _pair_sql(f"{_A} * {_B}"), vectors.bind)
_algebra("bind_bsc", BSC, _pair_sql(f"({_bit('n_name')} + {_bit('r_name')}) % 2"), vectors.bind)
_algebra("unbind_map", MAP, _pair_sql(_B), lambda k, a, b: vectors.bind(k, a, vectors.bind(k, a, b)))
_algebra("permute_map", MAP, _pair_sql(_sign("n_name", f"((j + {SIZE} - 3) % {SIZE})")), lambda k, a, b: vectors.permute(a, 3))
_algebra("permute_wraps_map", MAP, _pair_sql(_sign("n_name", f"((j + {SIZE} - 5) % {SIZE})")), lambda k, a, b: vectors.permute(a, SIZE + 5))
_algebra("bundle_pair_map", MAP, _pair_sql(f"{_A} + {_B}"), lambda k, a, b: vectors.bundle(k, vectors.denormalize(k, a), b))
_algebra(
    "bundle_pair_norm_map",
    MAP,
    _pair_sql(f"CASE WHEN {_A} + {_B} >= 0 THEN 1 ELSE -1 END"),
    lambda k, a, b: vectors.normalize(k, vectors.bundle(k, vectors.denormalize(k, a), b)),
)
_algebra(
    "bind_accumulator_map",
    MAP,
    _pair_sql(f"({_A} + {_B}) * {_B}"),
    lambda k, a, b: vectors.bind_accumulator(k, vectors.bundle(k, vectors.denormalize(k, a), b), b),
)
_algebra(
    "bundle_accumulators_map",
    MAP,
    _pair_sql(f"2 * {_A} + 2 * {_B}"),
    lambda k, a, b: vectors.bundle(k, vectors.bundle(k, vectors.denormalize(k, a), b), vectors.bundle(k, vectors.denormalize(k, a), b)),
)
_algebra("serialize_map", MAP, _pair_sql(_bit("n_name")), lambda k, a, b: vectors.serialize(k, a))
_algebra("parse_map", MAP, _pair_sql(f"CASE WHEN {_A} + {_B} * 0.5 >= 0 THEN 1 ELSE -1 END"), lambda k, a, b: vectors.parse(k, F.zip_with(a, b, lambda x, y: x + y * 0.5), SIZE))
_algebra("parse_bsc", BSC, _pair_sql(f"CASE WHEN {_bit('n_name')} * 0.25 + {_bit('r_name')} * 0.25 >= 0.5 THEN 1 ELSE 0 END"), lambda k, a, b: vectors.parse(k, F.zip_with(a, b, lambda x, y: x * 0.25 + y * 0.25), SIZE))
_algebra(
    "bundle_pair_bsc",
    BSC,
    _pair_sql(f"CASE WHEN {_bit('n_name')} = {_bit('r_name')} THEN {_bit('n_name')} ELSE {_tie('n_name')} END"),
    lambda k, a, b: vectors.bundle(k, a, b, vectors.tie_bits(k, SIZE, F.col("name"))),
)


def _similarity_sql(value: str) -> str:
    return f"""WITH {DIMS} SELECT n_name AS name, round(sum({value}) / {SIZE}.0, 6) + 0.0 AS similarity
        FROM nation JOIN region ON n_regionkey = r_regionkey, j GROUP BY n_name"""


@register("similarity_map", _similarity_sql(f"{_A} * {_B}"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, MAP).select("name", rounded(vectors.similarity(arch(MAP), F.col("a"), F.col("b"))).alias("similarity"))


@register("similarity_bsc", _similarity_sql(f"CASE WHEN {_bit('n_name')} = {_bit('r_name')} THEN 1 ELSE -1 END"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, BSC).select("name", rounded(vectors.similarity(arch(BSC), F.col("a"), F.col("b"))).alias("similarity"))


@register("similarity_packed_bsc", _similarity_sql(f"CASE WHEN {_bit('n_name')} = {_bit('r_name')} THEN 1 ELSE -1 END"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _pairs(spark, sf_dir, BSC).select("name", vectors.pack(F.col("a")).alias("a"), vectors.pack(F.col("b")).alias("b"))
    return packed.select("name", rounded(vectors.packed_similarity(F.col("a"), F.col("b"), SIZE)).alias("similarity"))


@register("equality_map", "SELECT n_name AS name, n_name = r_name AS same FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, MAP).select("name", vectors.equal(F.col("a"), F.col("b")).alias("same"))


# Algebra of real vectors, on the embeddings of neighbouring ids


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), "label")
    two = one.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return one.join(two, "vec_id")


_E = "e AS MATERIALIZED (SELECT vec_id, label, unnest(generate_series(0, 63)) AS j, unnest(embedding)::double AS x FROM embeddings)"


def _neighbour_query(name: str, kind: str, sql: str, make: Callable[[Architecture, Column, Column], Column]) -> None:
    @register(name, f"WITH {_E} {sql}")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _neighbours(spark, sf_dir)
        return exploded(rows.select("vec_id", make(arch(kind), F.col("a"), F.col("b")).alias("vec")), "vec_id", real=True)


_JOIN = "FROM e a JOIN e b ON b.vec_id = a.vec_id + 1"
_neighbour_query("hrr_bind", HRR, f"SELECT a.vec_id, ((a.j + b.j) % 64)::int AS dim, round(sum(a.x * b.x), 6) + 0.0 AS value {_JOIN} GROUP BY ALL", vectors.bind)
_neighbour_query(
    "vtb_bind",
    VTB,
    f"SELECT a.vec_id, ((a.j // 8) * 8 + b.j // 8)::int AS dim, round(sqrt(8.0) * sum(a.x * b.x), 6) + 0.0 AS value {_JOIN} AND a.j % 8 = b.j % 8 GROUP BY ALL",
    vectors.bind,
)
_neighbour_query("hrr_inverse", HRR, f"SELECT a.vec_id, ((64 - a.j) % 64)::int AS dim, round(a.x, 6) + 0.0 AS value {_JOIN} AND a.j = b.j", lambda k, a, b: vectors.inverse(k, a))
_neighbour_query("vtb_inverse", VTB, f"SELECT a.vec_id, ((a.j % 8) * 8 + a.j // 8)::int AS dim, round(a.x, 6) + 0.0 AS value {_JOIN} AND a.j = b.j", lambda k, a, b: vectors.inverse(k, a))
_neighbour_query("hrr_permute", HRR, f"SELECT a.vec_id, ((a.j + 7) % 64)::int AS dim, round(a.x, 6) + 0.0 AS value {_JOIN} AND a.j = b.j", lambda k, a, b: vectors.permute(a, 7))
_neighbour_query("hrr_bundle", HRR, f"SELECT a.vec_id, a.j::int AS dim, round(a.x + b.x, 6) + 0.0 AS value {_JOIN} AND a.j = b.j", lambda k, a, b: vectors.bundle(k, a, b))
_neighbour_query(
    "hrr_normalize",
    HRR,
    f"SELECT a.vec_id, a.j::int AS dim, round(a.x / sqrt(sum(a.x * a.x) OVER (PARTITION BY a.vec_id)), 6) + 0.0 AS value {_JOIN} AND a.j = b.j",
    lambda k, a, b: vectors.normalize(k, a),
)

_COSINE = f"WITH {_E} SELECT a.vec_id, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) + 0.0 AS similarity {_JOIN} AND a.j = b.j GROUP BY ALL"


@register("hrr_similarity", _COSINE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("vec_id", rounded(vectors.similarity(arch(HRR), F.col("a"), F.col("b"))).alias("similarity"))


@register("vtb_similarity", _COSINE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("vec_id", rounded(vectors.similarity(arch(VTB), F.col("a"), F.col("b"))).alias("similarity"))


@register("hrr_bundle_by_label", f"WITH {_E} SELECT label, j::int AS dim, round(sum(x), 6) + 0.0 AS value FROM e GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", "dim").agg(rounded(F.sum(F.col("x").cast("double"))).alias("value"))


# Codebooks


_BOOK = """b AS (SELECT c_mktsegment AS name FROM customer UNION SELECT 'c_mktsegment'
    UNION SELECT o_orderstatus FROM orders UNION SELECT 'o_orderstatus')"""


def _book(spark: SparkSession, sf_dir: str, kind: str = MAP) -> Codebook:
    """Symbols of segments and order states."""
    customer, order = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    both = customer.select("c_mktsegment").unionByName(order.select("o_orderstatus"), allowMissingColumns=True)
    return Codebook.from_dataframe(arch(kind), SIZE, both)


@register("values", f"WITH {_BOOK} SELECT name FROM b")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(spark, sf_dir).values()


@register("columns", "SELECT column_name AS name FROM (DESCRIBE SELECT c_mktsegment, o_orderstatus FROM customer, orders)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in _book(spark, sf_dir).columns], "name string")


@register(
    "symbol_order",
    """WITH v AS (SELECT 0 AS p, 1 AS k, c_mktsegment AS name FROM customer UNION SELECT 0, 2, 'c_mktsegment'
        UNION SELECT 1, 1, o_orderstatus FROM orders UNION SELECT 1, 2, 'o_orderstatus')
    SELECT row_number() OVER (ORDER BY p, k, name) - 1 AS idx, name FROM v""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(spark, sf_dir).names


@register(
    "extend_push",
    f"WITH {_BOOK} SELECT name FROM b UNION SELECT unnest(['new', 'newer'])",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(spark, sf_dir).push("new").extend(["F", "newer", "new"]).values()


@register("lookup_column_value", f"WITH {DIMS} SELECT j::int AS dim, {_sign(chr(39) + 'F' + chr(39))}::bigint AS value FROM j")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(_book(spark, sf_dir).get(Cell("o_orderstatus", "F")))


@register(
    "lookup_missing",
    f"""WITH {DIMS}, c AS (SELECT column_name AS name FROM (DESCRIBE SELECT c_mktsegment, o_orderstatus FROM customer, orders))
        SELECT j::int AS dim, {_sign('name')}::bigint AS value FROM c, j WHERE name = 'F'""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(_book(spark, sf_dir).get(ColumnKey("F")))


@register("lookup_index", f"WITH {DIMS} SELECT 'AUTOMOBILE' AS name, j::int AS dim, {_sign(chr(39) + 'AUTOMOBILE' + chr(39))}::bigint AS value FROM j")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(_book(spark, sf_dir).get(Index(0)), "name")


@register(
    "get_multiple",
    f"WITH {DIMS}, k AS (SELECT unnest([0, 2, 3]) AS pos, unnest(['F', 'O', 'F']) AS name) SELECT pos::bigint AS pos, name, j::int AS dim, {_sign('name')}::bigint AS value FROM k, j",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(_book(spark, sf_dir).get_multiple(["F", "no such name", "O", "F"]), "pos", "name")


@register(
    "select_column_enum",
    """SELECT c.pos::bigint AS pos, c.name, count(o_orderkey) AS orders FROM (SELECT unnest([0, 1, 2, 3]) AS pos, unnest(['O', 'F', 'P', 'never']) AS name) c
        LEFT JOIN orders ON o_orderstatus = c.name GROUP BY ALL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared categories in their order, and how many orders have each."""
    states = table(spark, sf_dir, "orders").select("o_orderstatus")
    book = Codebook.from_dataframe(arch(MAP), SIZE, states, enums={"o_orderstatus": ["O", "F", "P", "never"]})
    counts = states.groupBy(F.col("o_orderstatus").alias("name")).agg(F.count(F.lit(1)).alias("orders"))
    return book.select(ColumnKey("o_orderstatus")).join(counts, "name", "left").select("pos", "name", F.coalesce("orders", F.lit(0)).alias("orders"))


@register("select_column_string", f"WITH {_BOOK} SELECT name FROM b")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(spark, sf_dir).select(ColumnKey("o_orderstatus")).select("name")


@register("select_column_scope", "SELECT DISTINCT o_orderstatus AS name FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the values that stand in the column itself."""
    return _book(spark, sf_dir).select(ColumnKey("o_orderstatus"), scope="column").select("name")


def _against(kind: str, query: str) -> str:
    same = f"CASE WHEN {_bit('name')} = ({query}) THEN 1 ELSE -1 END"
    del kind
    return f"WITH {DIMS}, {_BOOK} SELECT name, round(sum({same}) / {SIZE}.0, 6) + 0.0 AS similarity FROM b, j GROUP BY name"


_QUERY = f"({_bit(chr(39) + 'F' + chr(39))} + {_bit(chr(39) + 'o_orderstatus' + chr(39))}) % 2"


@register("similarities_bsc", _against(BSC, _QUERY))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir, BSC)
    return book.similarities(book.execute("F * o_orderstatus")).select("name", rounded(F.col("similarity")).alias("similarity"))


@register("find_bsc", f"{_against(BSC, _QUERY)} ORDER BY similarity DESC, CASE WHEN name IN ('c_mktsegment', 'o_orderstatus') THEN 1 ELSE 0 END LIMIT 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir, BSC)
    return book.find(book.execute("F * o_orderstatus")).select("name", rounded(F.col("similarity")).alias("similarity"))


@register(
    "find_map",
    f"""WITH {DIMS}, {_BOOK} SELECT name, round(sum({_sign('name')} * {_sign("'F'")} * ({_sign("'F'")} * {_sign("'O'")})) / {SIZE}.0, 6) + 0.0 AS similarity
        FROM b, j GROUP BY name ORDER BY similarity DESC, name LIMIT 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    return book.find(book.execute("F * (F * O)")).select("name", rounded(F.col("similarity")).alias("similarity"))


@register(
    "similarities_of_names",
    f"""WITH {DIMS}, k AS (SELECT unnest([0, 1, 2]) AS pos, unnest(['F', 'O', 'no such name']) AS name),
        s AS (SELECT name, round(sum({_sign('name')} * {_sign(chr(39) + 'O' + chr(39))}) / {SIZE}.0, 6) + 0.0 AS similarity FROM k, j WHERE pos < 2 GROUP BY name)
    SELECT pos::bigint AS pos, name, similarity FROM k LEFT JOIN s USING (name)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _book(spark, sf_dir).similarities_of(["F", "O", "no such name"], "O")
    return found.select("pos", "name", rounded(F.col("similarity")).alias("similarity"))


def _badge_sql() -> str:
    """Badges and tiles of the similarity of each nation's name and its region's; nations of Asia have none."""
    stops = [[s[c] for s in colors.STOPS] for c in range(3)]
    mixed = ", ".join(f"round({list(v)}[p + 1] * (1 - f) + {list(v)}[p + 2] * f)::int AS {c}" for c, v in zip("rgb", stops, strict=True))
    light = lambda c: f"(CASE WHEN {c} / 255 <= 0.04045 THEN {c} / 255 / 12.92 ELSE (({c} / 255 + 0.055) / 1.055) ** 2.4 END)"
    bright = f"0.2126 * {light('r')} + 0.7152 * {light('g')} + 0.0722 * {light('b')}"
    shaded = lambda share: ", ' ', ".join(f"round({c} * {share})::int" for c in "rgb")
    return f"""WITH {DIMS}, s AS (SELECT n_name AS name, CASE WHEN r_name <> 'ASIA' THEN sum({_A} * {_B}) / {SIZE}.0::double END AS s
            FROM nation JOIN region ON n_regionkey = r_regionkey, j GROUP BY n_name, r_name),
        q AS (SELECT *, CASE WHEN s IS NOT NULL THEN least(greatest((s + 1) * 5, 0), 10) END AS q FROM s), p AS (SELECT *, CASE WHEN q < 9 THEN floor(q)::int WHEN q IS NOT NULL THEN 9 END AS p, q - CASE WHEN q < 9 THEN floor(q) ELSE 9 END AS f FROM q),
        m AS (SELECT name, s, {mixed} FROM p)
        SELECT name, CASE WHEN s IS NULL THEN 'sim = -' ELSE format('sim = {{:.3f}}', s) END AS label, coalesce(r, 241) AS r, coalesce(g, 245) AS g, coalesce(b, 249) AS b,
               coalesce(round(r * 0.78)::int, 203) AS border_r, CASE WHEN s IS NULL THEN 51 WHEN {bright} > 0.45 THEN 15 ELSE 248 END AS text_r,
               CASE WHEN s IS NULL THEN 'border-color: rgb(226 232 240); background-color: rgb(255 255 255);'
                    ELSE concat('border-color: rgb(', {shaded(0.75)}, '); background-color: color-mix(in oklab, rgb(', r, ' ', g, ' ', b, ') 18%, white);') END AS tile FROM m"""


@register("similarity_badges", _badge_sql())
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    similar = vectors.similarity(arch(MAP), F.col("a"), F.col("b"))
    asia = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = _pairs(spark, sf_dir, MAP).join(asia.select(F.col("n_name").alias("name"), F.lit(True).alias("none")), "name", "left")
    rows = rows.select("name", F.when(F.col("none").isNull(), similar).alias("s"))
    made = rows.select("name", colors.badge(F.col("s")).alias("x"), colors.tile(F.col("s")).alias("tile"))
    return made.select("name", "tile", "x.label", "x.fill.r", "x.fill.g", "x.fill.b", F.col("x.border.r").alias("border_r"), F.col("x.text.r").alias("text_r"))


@register(
    "most_similar_embeddings",
    """WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS x
        FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
    SELECT query, row_number() OVER (PARTITION BY query ORDER BY x DESC, id DESC)::int AS rank, id, round(x, 6) + 0.0 AS similarity
    FROM s QUALIFY rank <= 5""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors for every hundredth."""
    rows = table(spark, sf_dir, "embeddings")
    found = most_similar(rows.where("vec_id % 100 = 0"), rows, arch(HRR), k=5, query_col="vec_id", id_col="vec_id", vector_col="embedding")
    return found.withColumn("similarity", rounded(F.col("similarity")))


@register(
    "nearest_bits_embeddings",
    """WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1.0 ELSE -1.0 END)::double[] AS s FROM embeddings),
        d AS (SELECT a.vec_id AS query, b.vec_id AS id, ((64 - list_dot_product(a.s, b.s)) / 2)::int AS distance FROM e a, e b WHERE a.vec_id % 100 = 0)
    SELECT query, row_number() OVER (PARTITION BY query ORDER BY distance, id DESC)::int AS rank, id, distance FROM d QUALIFY rank <= 5""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors whose signs are nearest, for every hundredth; by the index at every scale."""
    signs = vectors.parse(arch(BSC), F.transform("embedding", lambda x: F.when(x >= 0, 1.0).otherwise(0.0)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.pack(signs).alias("words"))
    return nearest(rows.where("vec_id % 100 = 0"), rows, 64, k=5, query_col="vec_id", id_col="vec_id", direct=0)


# Expressions


def _q(name: str) -> str:
    return f"'{name}'"


_S = {n: _sign(_q(n)) for n in ("F", "O", "P", "o_orderstatus", "BUILDING")}


def _norm(value: str) -> str:
    return f"(CASE WHEN {value} >= 0 THEN 1 ELSE -1 END)"


def _expression_query(name: str, text: str, value: str) -> None:
    @register(name, f"WITH {DIMS} SELECT j::int AS dim, ({value})::bigint AS value FROM j")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return exploded(_book(spark, sf_dir).evaluate(text))


_expression_query("expr_execute_map", "F * o_orderstatus + O + P", _norm(f"{_S['F']} * {_S['o_orderstatus']} + {_S['O']} + {_S['P']}"))
_expression_query("expr_nested_plus", "(F + O) + P", _norm(f"{_norm(_S['F'] + ' + ' + _S['O'])} + {_S['P']}"))
_expression_query("expr_trailing_ignored", "((F + O) * P) )", f"{_norm(_S['F'] + ' + ' + _S['O'])} * {_S['P']}")
_expression_query("expr_permute", "F * BUILDING ^ 2", f"{_S['F']} * {_sign(_q('BUILDING'), f'((j + {SIZE} - 2) % {SIZE})')}")


@register(
    "expr_column_map",
    _pair_sql(f"{_norm(f'{_A} + {_B} + {_A} * {_B}')} * {_sign('n_name', f'((j + {SIZE} - 1) % {SIZE})')}"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Expression.parse("(x + y + x * y) * x ^ 1").column({"x": F.col("a"), "y": F.col("b")}, ColumnVectorAlgebra(arch(MAP), SIZE))
    return exploded(_pairs(spark, sf_dir, MAP).select("name", made.alias("vec")), "name")


@register("expr_numbers", "SELECT n_nationkey, ((n_nationkey + n_regionkey) ** 3 * 2 + n_regionkey)::bigint AS value FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"x": F.col("n_nationkey").cast("long"), "y": F.col("n_regionkey").cast("long"), "two": F.lit(2).cast("long")}
    made = Expression.parse("(x + y) ^ 3 * two + y").column(columns, ColumnNumberAlgebra())
    return table(spark, sf_dir, "nation").select("n_nationkey", made.alias("value"))


@register(
    "expr_number_kinds",
    """SELECT n_nationkey, ((n_nationkey + n_regionkey) * n_regionkey)::tinyint AS b, ((n_nationkey + n_regionkey) * n_regionkey)::smallint AS s,
       ((n_nationkey + n_regionkey) * n_regionkey)::int AS i, ((n_nationkey + n_regionkey) * n_regionkey)::bigint AS l,
       ((n_nationkey + n_regionkey) * n_regionkey)::decimal(20, 0)::varchar AS u FROM nation""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of integers that Spark has; an unsigned 64-bit one is a decimal of 20 digits."""
    text = Expression.parse("(x + y) * y")
    kinds = {"b": "tinyint", "s": "smallint", "i": "int", "l": "bigint", "u": "decimal(20,0)"}
    made = {k: text.column({"x": F.col("n_nationkey").cast(t), "y": F.col("n_regionkey").cast(t)}, ColumnNumberAlgebra(t)) for k, t in kinds.items()}
    made["u"] = made["u"].cast("string")
    return table(spark, sf_dir, "nation").select("n_nationkey", *[c.alias(k) for k, c in made.items()])


# Rows as vectors: orders with a key

_NULLS = "(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s, nullif(o_orderpriority, '1-URGENT') AS p FROM orders)"
_CS = f"({_sign(_q('o_orderstatus'))} * {_sign('s')})"
_CP = f"({_sign(_q('o_orderpriority'))} * {_sign('p')})"


def _rows_sql(value: str) -> str:
    """Vectors depend on the two cells alone, so they are made for distinct pairs and joined back."""
    return f"""WITH {DIMS}, o AS {_NULLS}, t AS (SELECT DISTINCT s, p FROM o WHERE s IS NOT NULL OR p IS NOT NULL),
        v AS (SELECT s, p, j::int AS dim, ({value})::bigint AS value FROM t, j)
        SELECT o_orderkey, dim, value FROM o JOIN v ON o.s IS NOT DISTINCT FROM v.s AND o.p IS NOT DISTINCT FROM v.p"""


_SUM = f"coalesce({_CS}, 0) + coalesce({_CP}, 0)"
_PRODUCT = f"coalesce({_CS}, 1) * coalesce({_CP}, 1)"
_MOVED = f"coalesce({_sign('s')}, 0) + coalesce({_sign('p', f'((j + {SIZE} - 1) % {SIZE})')}, 0)"
_COMBOS = f"{_SUM} + coalesce({_CS} * {_CP}, 0)"


def _rows_query(name: str, value: str, make: Callable[[Subset], DataFrame]) -> None:
    @register(name, _rows_sql(value))
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = make(folds(orders(spark, sf_dir, nulls=True, key=True), MAP, order_by="o_orderkey"))
        return exploded(rows, "o_orderkey", vec="vector")


_rows_query("bundle_rows_map_norm", _norm(_SUM), lambda s: s.bundle_rows())
_rows_query("bundle_rows_map_unnorm", _SUM, lambda s: s.bundle_rows(normalized=False))
_rows_query("bundle_rows_position_map", _norm(_MOVED), lambda s: s.bundle_rows(encoding="position"))
_rows_query("bind_rows_map", _PRODUCT, lambda s: s.bind_rows())
_rows_query("bundle_rows_combinatorial_2", _COMBOS, lambda s: s.bundle_rows_combinatorial(2))

_BS, _BP = f"(({_bit(_q('o_orderstatus'))} + {_bit('s')}) % 2)", f"(({_bit(_q('o_orderpriority'))} + {_bit('p')}) % 2)"
_ROW_BSC = f"CASE WHEN s IS NULL THEN {_BP} WHEN p IS NULL OR {_BS} = {_BP} THEN {_BS} ELSE {_tie("'cell|' || o_orderkey || '|1'")} END"


@register(
    "find_symbols_of_rows_map",
    f"""WITH {DIMS}, o AS {_NULLS}, t AS (SELECT DISTINCT s, p FROM o WHERE s IS NOT NULL OR p IS NOT NULL),
        v AS (SELECT s, p, j, {_norm(f"coalesce({_sign('s')}, 0) + coalesce({_sign('p', f'((j + {SIZE} - 1) % {SIZE})')}, 0)")} AS x FROM t, j),
        n AS (SELECT DISTINCT 0 AS c, 1 AS k, s AS name FROM o WHERE s IS NOT NULL UNION SELECT 0, 2, 'o_orderstatus'
            UNION SELECT DISTINCT 1, 1, p FROM o WHERE p IS NOT NULL UNION SELECT 1, 2, 'o_orderpriority'),
        b AS (SELECT name, row_number() OVER (ORDER BY c, k, name) - 1 AS idx FROM n),
        m AS (SELECT s, p, name, idx, sum(x * {_sign('name')}) / {SIZE}.0 AS y FROM v, b WHERE v.j IS NOT NULL GROUP BY ALL),
        r AS (SELECT s, p, name, y, row_number() OVER (PARTITION BY s, p ORDER BY y DESC, idx DESC)::int AS rank FROM m QUALIFY rank <= 2)
        SELECT o_orderkey AS query, rank, name, round(y, 6) + 0.0 AS similarity FROM o JOIN r ON o.s IS NOT DISTINCT FROM r.s AND o.p IS NOT DISTINCT FROM r.p""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a vector, and the two symbols that it is most like."""
    subset = folds(orders(spark, sf_dir, nulls=True, key=True), MAP, order_by="o_orderkey")
    found = subset.codebook.find_all(subset.bundle_rows(encoding="position"), k=2, query_col="o_orderkey", vector_col="vector")
    return found.select("query", "rank", "name", rounded(F.col("similarity")).alias("similarity"))


@register(
    "bundle_rows_bsc",
    f"WITH {DIMS}, o AS {_NULLS} SELECT o_orderkey, j::int AS dim, ({_ROW_BSC})::bigint AS value FROM o, j WHERE s IS NOT NULL OR p IS NOT NULL",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(folds(orders(spark, sf_dir, nulls=True, key=True), BSC, order_by="o_orderkey").bundle_rows(), "o_orderkey", vec="vector")


def _conv(a: str, b: str, join: str, keys: str) -> str:
    """Circular convolution of two tables (..., j, x)."""
    return f"SELECT {keys}, (({a}.j + {b}.j) % {SIZE})::int AS j, sum({a}.x * {b}.x) AS x FROM {join} GROUP BY ALL"


@register(
    "bind_rows_hrr",
    f"""WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders), t AS (SELECT DISTINCT s, p FROM o),
        {_real_symbols("SELECT s AS name FROM t UNION SELECT p FROM t UNION SELECT unnest(['o_orderstatus', 'o_orderpriority'])")},
        cs AS MATERIALIZED ({_conv('c', 'v', "sym c JOIN sym v ON c.name = 'o_orderstatus' AND v.name IN (SELECT s FROM t)", 'v.name AS s')}),
        cp AS MATERIALIZED ({_conv('c', 'v', "sym c JOIN sym v ON c.name = 'o_orderpriority' AND v.name IN (SELECT p FROM t)", 'v.name AS p')}),
        r AS MATERIALIZED ({_conv('cs', 'cp', 't JOIN cs USING (s) JOIN cp USING (p)', 's, p')})
        SELECT o_orderkey, j AS dim, round(x, 6) + 0.0 AS value FROM o JOIN r USING (s, p)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(folds(orders(spark, sf_dir, key=True), HRR, order_by="o_orderkey").bind_rows(), "o_orderkey", vec="vector", real=True)


# Whole tables as vectors


def _tuples_sql(value: str, aggregate: str) -> str:
    return f"""WITH {DIMS}, o AS {_NULLS}, t AS (SELECT s, p, count(*) AS n FROM o WHERE s IS NOT NULL OR p IS NOT NULL GROUP BY ALL),
        v AS (SELECT j, n, ({value}) AS x FROM t, j) SELECT j::int AS dim, ({aggregate})::bigint AS value FROM v GROUP BY j"""


def _fold_query(name: str, sql: str | None, make: Callable[[Subset], DataFrame], kind: str = MAP, size: int = SIZE) -> None:
    @register(name, sql)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        ordered = kind in (BSC, VTB)
        rows = orders(spark, sf_dir, nulls=True, key=ordered)
        return whole(make(folds(rows, kind, size, **{"order_by": "o_orderkey"} if ordered else {})))


_ODD = "CASE WHEN sum(CASE WHEN x < 0 THEN n ELSE 0 END) % 2 = 1 THEN -1 ELSE 1 END"
_fold_query("bundle_dataset_map_nn", _tuples_sql(_norm(_SUM), _norm("sum(n * x)")), lambda s: s.bundle_dataset())
_fold_query("bundle_dataset_map_nu", _tuples_sql(_norm(_SUM), "sum(n * x)"), lambda s: s.bundle_dataset(normalized=False))
_fold_query("bundle_dataset_map_un", _tuples_sql(_SUM, _norm("sum(n * x)")), lambda s: s.bundle_dataset(rows_normalized=False))
_fold_query("bundle_dataset_position_map", _tuples_sql(_norm(_MOVED), _norm("sum(n * x)")), lambda s: s.bundle_dataset(encoding="position"))
_fold_query("null_skip_map", _tuples_sql(_SUM, "sum(n * x)"), lambda s: s.bundle_dataset(rows_normalized=False, normalized=False))
_fold_query("bundle_dataset_combinatorial_1", _tuples_sql(_SUM, "sum(n * x)"), lambda s: s.bundle_dataset_combinatorial(1))
_fold_query("bundle_dataset_combinatorial_2", _tuples_sql(_COMBOS, "sum(n * x)"), lambda s: s.bundle_dataset_combinatorial(2))
_fold_query("bundle_dataset_with_binding_map", _tuples_sql(_PRODUCT, _norm("sum(n * x)")), lambda s: s.bundle_dataset_with_binding())
_fold_query(
    "bundle_dataset_temporal_map",
    _tuples_sql(f"coalesce({_sign('s')}, 1) * coalesce({_sign('p', f'((j + {SIZE} - 1) % {SIZE})')}, 1)", _norm("sum(n * x)")),
    lambda s: s.bundle_dataset_with_binding(encoding="position"),
)
_fold_query(
    "bundle_dataset_temporal_unnormalized_map",
    _tuples_sql(f"coalesce({_sign('s')}, 1) * coalesce({_sign('p', f'((j + {SIZE} - 1) % {SIZE})')}, 1)", "sum(n * x)"),
    lambda s: s.bundle_dataset_with_binding(encoding="position", normalized=False),
)
_fold_query("bind_dataset_map", _tuples_sql(_norm(_SUM), _ODD), lambda s: s.bind_dataset())
_fold_query("bind_entire_dataset_map", _tuples_sql(_PRODUCT, _ODD), lambda s: s.bind_entire_dataset())
_fold_query("bind_entire_dataset_bsc", _tuples_sql(f"(coalesce({_BS}, 0) + coalesce({_BP}, 0)) % 2", "sum(n * x) % 2"), lambda s: s.bind_entire_dataset(), BSC)
_fold_query(
    "bind_dataset_bsc",
    f"""WITH {DIMS}, o AS {_NULLS} SELECT j::int AS dim, (sum({_ROW_BSC}) % 2)::bigint AS value FROM o, j
        WHERE s IS NOT NULL OR p IS NOT NULL GROUP BY j""",
    lambda s: s.bind_dataset(),
    BSC,
)


def _last_writer_sql(row: str) -> str:
    """Every row counts here: the last whose tie bit is its own bit, or else the first."""
    return f"""WITH {DIMS}, o AS {_NULLS}, w AS (SELECT j, o_orderkey AS k, ({row}) AS x FROM o, j WHERE s IS NOT NULL OR p IS NOT NULL)
        SELECT j::int AS dim, coalesce(arg_max(x, k) FILTER (x = {_tie("'row|' || k")}), arg_min(x, k))::bigint AS value FROM w GROUP BY j"""


_fold_query("bundle_dataset_bsc", _last_writer_sql(_ROW_BSC), lambda s: s.bundle_dataset(), BSC)
_fold_query("bundle_dataset_with_binding_bsc", _last_writer_sql(f"(coalesce({_BS}, 0) + coalesce({_BP}, 0)) % 2"), lambda s: s.bundle_dataset_with_binding(), BSC)


def _times(kind: str, a: str, b: str) -> str:
    """The product of two lists of ``SIZE`` numbers, element by element."""
    of = lambda v, at: f"{v}[({at})::int + 1]"
    if kind == HRR:
        term, n, scale = f"{of(a, 'k')} * {of(b, f'(i - k + {SIZE}) % {SIZE}')}", SIZE, "1.0"
    else:
        term, n, scale = f"{of(a, '(i // 8) * 8 + k')} * {of(b, '(i % 8) * 8 + k')}", 8, "sqrt(8.0)"
    return f"list_transform(range({SIZE}), lambda i: {scale} * list_sum(list_transform(range({n}), lambda k: {term})))"


def _product_sql(kind: str, row: str) -> str:
    """The left fold over the nations, row by row; ``row`` makes a row of its cells a and b."""
    return f"""WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
        {_real_symbols("SELECT n_name AS name FROM n UNION SELECT r_name FROM n UNION SELECT unnest(['n_name', 'r_name'])")},
        l AS MATERIALIZED (SELECT name, list(x ORDER BY j) AS v FROM sym GROUP BY name),
        c AS MATERIALIZED (SELECT k, {_times(kind, 'nc.v', 'nv.v')} AS a, {_times(kind, 'rc.v', 'rv.v')} AS b FROM n JOIN l nc ON nc.name = 'n_name'
            JOIN l nv ON nv.name = n_name JOIN l rc ON rc.name = 'r_name' JOIN l rv ON rv.name = r_name),
        r AS MATERIALIZED (SELECT k, {row} AS v FROM c),
        f(k, v) AS (SELECT k, v FROM r WHERE k = 1 UNION ALL SELECT r.k, {_times(kind, 'f.v', 'r.v')} FROM f JOIN r ON r.k = f.k + 1)
        SELECT unnest(range({SIZE}))::int AS dim, round(unnest(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) + 0.0 AS value
        FROM f WHERE k = (SELECT max(k) FROM n)"""


_UNIT_SUM = "list_transform(list_zip(a, b), lambda p: (p[1] + p[2]) / sqrt(list_sum(list_transform(list_zip(a, b), lambda q: (q[1] + q[2]) * (q[1] + q[2])))))"


def _nations_query(name: str, kind: str, row: str, make: Callable[[Subset], DataFrame]) -> None:
    """Products of real vectors over the nations, given with unit length since their size runs away.

    SQL spells each step of the fold out, so it is short.
    """

    @register(name, _product_sql(kind, row))
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
        rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
        found = make(folds(rows, kind, order_by="n_nationkey"))
        # One vector: SIZE rows.
        norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy()))
        return whole(found.withColumn("value", F.col("value") / norm))


for _kind in (HRR, VTB):
    _nations_query(f"bind_dataset_{_kind}", _kind, _UNIT_SUM, lambda s: s.bind_dataset())
    _nations_query(f"bind_entire_dataset_{_kind}", _kind, _times(_kind, "a", "b"), lambda s: s.bind_entire_dataset())


_TIED = "SELECT c_nationkey AS g, floor(c_acctbal / 500) AS o, c_mktsegment AS s, (c_custkey % 3)::varchar AS t FROM customer"


@register(
    "bind_entire_dataset_vtb_groups",
    f"""WITH RECURSIVE n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o, s, t) AS k FROM ({_TIED})),
        {_real_symbols("SELECT s AS name FROM n UNION SELECT t FROM n UNION SELECT unnest(['c_mktsegment', 'third'])")},
        l AS MATERIALIZED (SELECT name, list(x ORDER BY j) AS v FROM sym GROUP BY name),
        c AS (SELECT s, t, {_times(VTB, 'sc.v', 'sv.v')} AS a, {_times(VTB, 'tc.v', 'tv.v')} AS b FROM (SELECT DISTINCT s, t FROM n) JOIN l sc ON sc.name = 'c_mktsegment'
            JOIN l sv ON sv.name = s JOIN l tc ON tc.name = 'third' JOIN l tv ON tv.name = t),
        p AS MATERIALIZED (SELECT s, t, {_times(VTB, 'a', 'b')} AS v FROM c),
        r AS MATERIALIZED (SELECT g, k, v FROM n JOIN p USING (s, t)),
        f(g, k, v) AS (SELECT g, k, v FROM r WHERE k = 1 UNION ALL SELECT r.g, r.k, {_times(VTB, 'f.v', 'r.v')} FROM f JOIN r ON r.g = f.g AND r.k = f.k + 1)
        SELECT g AS c_nationkey, unnest(range({SIZE}))::int AS dim, round(unnest(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) + 0.0 AS value
        FROM f JOIN (SELECT g, max(k) AS k FROM n GROUP BY g) USING (g, k)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product for each nation over its customers; many share their order value, some all of their cells."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_nationkey", "floor(c_acctbal / 500) AS wealth", "c_mktsegment", "string(c_custkey % 3) AS third")
    found = folds(rows, VTB, order_by="wealth", group_by=("c_nationkey",)).bind_entire_dataset()
    # One vector for each group: SIZE rows.
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("c_nationkey")))
    return whole(found.withColumn("value", F.col("value") / norm))


_ITEM_CELLS = """cells AS (SELECT 'l_returnflag' AS c, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL
    UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL)"""


@register("bundle_dataset_map_uu", f"WITH {DIMS}, {_ITEM_CELLS} SELECT j::int AS dim, sum(n * {_sign('c')} * {_sign('v')})::bigint AS value FROM cells, j GROUP BY j")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(folds(items(spark, sf_dir), MAP).bundle_dataset(rows_normalized=False, normalized=False))


@register(
    "bundle_dataset_native_map",
    f"WITH {DIMS}, {_ITEM_CELLS} SELECT j::int AS dim, sum(n * {_sign('c')} * {_sign('v')})::bigint AS value FROM cells, j GROUP BY j",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within Spark's own functions: counts first, then dimensions of distinct cells."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in ITEMS])
    counted = items(spark, sf_dir).select(F.explode(cells).alias("x")).groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n"))
    spread = counted.select("c", "v", "n", F.explode(symbols.dims(SIZE)).alias("dim"))
    a, b = (symbols.element(arch(MAP), F.col(k), F.col("dim")) for k in "cv")
    return spread.groupBy("dim").agg(F.sum(F.col("n") * a * b).cast("long").alias("value"))


_HRR_CELLS = f"""{_real_symbols("SELECT c AS name FROM cells UNION SELECT v FROM cells")}"""


@register(
    "bundle_dataset_hrr_uu",
    f"WITH {_ITEM_CELLS}, {_HRR_CELLS} SELECT ((a.j + b.j) % {SIZE})::int AS dim, round(sum(n * a.x * b.x), 6) + 0.0 AS value FROM cells JOIN sym a ON a.name = c JOIN sym b ON b.name = v GROUP BY ALL",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(folds(items(spark, sf_dir), HRR).bundle_dataset(rows_normalized=False, normalized=False))


@register(
    "bundle_dataset_vtb_uu",
    f"WITH {_ITEM_CELLS}, {_HRR_CELLS} SELECT ((a.j // 8) * 8 + b.j // 8)::int AS dim, round(sqrt(8.0) * sum(n * a.x * b.x), 6) + 0.0 AS value FROM cells JOIN sym a ON a.name = c JOIN sym b ON b.name = v AND a.j % 8 = b.j % 8 GROUP BY ALL",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(folds(items(spark, sf_dir), VTB).bundle_dataset(rows_normalized=False, normalized=False))


@register(
    "bundle_dataset_hrr_un",
    f"""WITH {_ITEM_CELLS}, {_HRR_CELLS}, s AS (SELECT ((a.j + b.j) % {SIZE})::int AS dim, sum(n * a.x * b.x) AS x
        FROM cells JOIN sym a ON a.name = c JOIN sym b ON b.name = v GROUP BY ALL)
    SELECT dim, round(x / sqrt(sum(x * x) OVER ()), 6) + 0.0 AS value FROM s""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(folds(items(spark, sf_dir), HRR).bundle_dataset(rows_normalized=False))


def _shared_value(terms: str) -> str:
    return f"WITH {DIMS}, t AS (SELECT quality::varchar AS q, toxic::varchar AS x, count(*) AS n FROM labels GROUP BY ALL) SELECT j::int AS dim, sum(n * ({terms}))::bigint AS value FROM t, j GROUP BY j"


@register("shared_namespace", _shared_value(f"{_sign(_q('quality'))} * {_sign('q')} + {_sign(_q('toxic'))} * {_sign('x')}"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'0' and '1' are values of both columns and one symbol each."""
    rows = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return whole(folds(rows, MAP).bundle_dataset(rows_normalized=False, normalized=False))


_PART3 = [f"({_sign(_q(c))} * {_sign(c)})" for c in ("p_brand", "p_type", "z")]
_THREE = " + ".join([*_PART3, f"{_PART3[0]} * {_PART3[1]}", f"{_PART3[0]} * {_PART3[2]}", f"{_PART3[1]} * {_PART3[2]}", " * ".join(_PART3)])


@register(
    "bundle_dataset_combinatorial_3",
    f"""WITH {DIMS}, t AS (SELECT p_brand, p_type, (p_size % 3)::varchar AS z, count(*) AS n FROM part GROUP BY ALL)
        SELECT j::int AS dim, sum(n * ({_THREE}))::bigint AS value FROM t, j GROUP BY j""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_type", (F.col("p_size") % 3).cast("string").alias("z"))
    return whole(folds(rows, MAP).bundle_dataset_combinatorial(3))


#: Columns of lineitem as text, some with nulls: the expressions in Spark's SQL and in DuckDB's.
WIDE = {
    "flag": ("l_returnflag", "l_returnflag"),
    "status": ("nullif(l_linestatus, 'F')", "nullif(l_linestatus, 'F')"),
    "number": ("string(l_linenumber)", "l_linenumber::varchar"),
    "tax": ("string(int(round(l_tax * 100)))", "round(l_tax * 100)::int::varchar"),
    "discount": ("string(nullif(int(round(l_discount * 100)), 4))", "nullif(round(l_discount * 100)::int, 4)::varchar"),
    "year": ("string(year(l_shipdate))", "year(l_shipdate)::varchar"),
    "month": ("string(nullif(month(l_shipdate), 1))", "nullif(month(l_shipdate), 1)::varchar"),
    "tens": ("string(int(floor(l_quantity / 10)))", "floor(l_quantity / 10)::int::varchar"),
}


@register(
    "bundle_dataset_combinatorial_wide",
    f"""WITH {DIMS}, t AS (SELECT *, row_number() OVER () AS k FROM (SELECT {", ".join(f"{sql} AS {c}" for c, (_, sql) in WIDE.items())}, count(*) AS n FROM lineitem GROUP BY ALL)),
        c AS ({" UNION ALL ".join(f"SELECT k, n, '{c}' AS c, {c} AS v FROM t WHERE {c} IS NOT NULL" for c in WIDE)}),
        x AS MATERIALIZED (SELECT c, v, j, {_sign('c')} * {_sign('v')} AS x FROM (SELECT DISTINCT c, v FROM c), j),
        p AS (SELECT k, n, j, sum(x)::bigint AS p, count(*) AS m FROM c JOIN x USING (c, v) GROUP BY ALL)
        SELECT j::int AS dim, sum(n * (p + (p * p - m) // 2 + (p * p * p - 3 * p * m + 2 * p) // 6))::bigint AS value FROM p GROUP BY j""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of up to three of eight columns; SQL takes them from sums of powers."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[f"{text} AS {c}" for c, (text, _) in WIDE.items()])
    return whole(folds(rows, MAP).bundle_dataset_combinatorial(3))


@register(
    "bundle_dataset_codes_map",
    f"""WITH {DIMS}, t AS (SELECT l_returnflag AS s, l_linestatus AS p, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT j::int AS dim, {_norm(f"sum(n * {_norm(f'{_sign(_q(ITEMS[0]))} * {_sign("s")} + {_sign(_q(ITEMS[1]))} * {_sign("p")}')})")}::bigint AS value FROM t, j GROUP BY j""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of integer codes with their categories, of which one never occurs."""
    return whole(folds(as_codes(items(spark, sf_dir), {"l_returnflag": ["R", "never", "A", "N"], "l_linestatus": ["F", "O"]}), MAP).bundle_dataset())


@register(
    "grouped_bundle_map",
    f"""WITH {DIMS}, t AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
        SELECT lang, j::int AS dim, sum(n * {_sign(_q('source'))} * {_sign('source')})::bigint AS value FROM t, j GROUP BY ALL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", "source")
    return whole(folds(rows, MAP, group_by=("lang",)).bundle_dataset(rows_normalized=False, normalized=False))


@register(
    "validated_subset_map",
    f"""WITH {DIMS}, t AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL)
        SELECT j::int AS dim, sum(n * {_sign(_q('event_type'))} * {_sign('event_type')})::bigint AS value FROM t, j GROUP BY j""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: a codebook from a table's distinct values, all of its rows checked against it, and the fold."""
    rows = table(spark, sf_dir, "events").select("event_type")
    subset = Subset(Codebook.from_dataframe(arch(MAP), SIZE, rows.distinct()), rows)
    subset.validate()
    return whole(subset.bundle_dataset(rows_normalized=False, normalized=False))


#: Records of two nations, and the question what is to the second as its region is to the first.
RECORDS = (("NATION_3", "AMERICA"), ("NATION_8", "EUROPE"))
RECORDS_QUERY = " * ".join(f"(n_name * {n} + r_name * {r} + n_nationkey * code)" for n, r in RECORDS) + f" * {RECORDS[0][1]}"
#: Regions in turn, each rotated by its place, and the place that is asked for.
JOURNEY = ("ASIA", "AFRICA", "EUROPE", "AMERICA")
LARGE, ASKED = 10_000, 2
_PLACES = "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT unnest(['n_name', 'r_name', 'n_nationkey', 'code'])"


def _nearest_sql(value: str) -> str:
    """The name of nation or region whose signs agree most with ``value`` over ``LARGE`` dimensions."""
    return f"""WITH j AS (SELECT unnest(generate_series(0, {LARGE - 1})) AS j), n AS ({_PLACES}),
        q AS MATERIALIZED (SELECT j, {value} AS x FROM j)
        SELECT name FROM n, q GROUP BY name ORDER BY sum(CASE WHEN {_sign('name')} = x THEN 1 ELSE -1 END) DESC, name LIMIT 1"""


def _majority(terms: list[str]) -> str:
    return _norm(" + ".join(terms))


def _replaced(terms: list[str], first_step: int) -> str:
    """A BSC bundle in signs: where the next term differs from what there is, the step's tie bit counts."""
    acc = terms[0]
    for k, term in enumerate(terms[1:]):
        acc = f"(CASE WHEN ({acc}) = ({term}) THEN {term} ELSE 2 * ({_tie(f"'step|{first_step + k}'")}) - 1 END)"
    return acc


def _records(bundle: Callable[[list[str], int], str], sign: int) -> str:
    """The query's value in signs. In these, a product of BSC bits is the negative product."""
    pair = lambda a, b: f"({sign} * {_sign(_q(a))} * {_sign(_q(b))})"
    one, two = (bundle([pair("n_name", n), pair("r_name", r), pair("n_nationkey", "code")], 2 * k) for k, (n, r) in enumerate(RECORDS))
    return f"({one}) * ({two}) * {_sign(_q(RECORDS[0][1]))}"


def _journey(bundle: Callable[[list[str], int], str]) -> str:
    """Rotated back by the place that is asked for."""
    return bundle([_sign(_q(name), f"((j + {ASKED} - {k} + {LARGE}) % {LARGE})") for k, name in enumerate(JOURNEY)], 0)


def _nearest_query(name: str, kind: str, text: str, sql: str) -> None:
    @register(name, sql)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        nation, region = table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name")
        book = Codebook.from_dataframe(arch(kind), LARGE, nation.unionByName(region, allowMissingColumns=True)).extend(["n_nationkey", "code"])
        return book.find(book.execute(text)).select("name")


_nearest_query("analogy_map", MAP, RECORDS_QUERY, _nearest_sql(_records(lambda t, k: _majority(t), 1)))
_nearest_query("analogy_bsc", BSC, RECORDS_QUERY, _nearest_sql(_records(_replaced, -1)))
_JOURNEY_TEXT = f"({' + '.join(f'{name} ^ {k}' for k, name in enumerate(JOURNEY))}) ^ {LARGE - ASKED}"
_nearest_query("sequence_recall_map", MAP, _JOURNEY_TEXT, _nearest_sql(_journey(lambda t, k: _majority(t))))


# More elements than one block of a symbol's digests holds


BLOCKS = 400
_WIDE = f"j AS (SELECT unnest(generate_series(0, {BLOCKS - 1})) AS j)"


@register("codebook_map_blocks", f"WITH {_WIDE} SELECT n_name AS name, j::int AS dim, {_sign('n_name')}::bigint AS value FROM nation, j")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select("n_name")
    return exploded(Codebook.from_dataframe(arch(MAP), BLOCKS, names).vectors().where("name <> 'n_name'"), "name")


@register("symbols_native_blocks", f"WITH {_WIDE} SELECT n_name AS name, j::int AS dim, ({_bit('n_name')})::bigint AS value FROM nation, j")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same digests by Spark's own functions."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return exploded(names.select("name", symbols.symbol(arch(BSC), F.col("name"), BLOCKS).alias("vec")), "name")


@register("bundle_dataset_map_blocks", f"WITH {_WIDE}, {_ITEM_CELLS} SELECT j::int AS dim, sum(n * {_sign('c')} * {_sign('v')})::bigint AS value FROM cells, j GROUP BY j")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(folds(items(spark, sf_dir), MAP, BLOCKS).bundle_dataset(rows_normalized=False, normalized=False))


@register("bundle_dataset_bsc_blocks", _last_writer_sql(_ROW_BSC).replace(DIMS, _WIDE))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(folds(orders(spark, sf_dir, nulls=True, key=True), BSC, BLOCKS, order_by="o_orderkey").bundle_dataset())


# Words of 64 bits


@register(
    "packed_bind_permute_map",
    f"""WITH {_WIDE} SELECT n_name AS name, j::int AS dim, ({_sign('n_name', f'((j + {BLOCKS} - 70) % {BLOCKS})')} * {_sign('r_name', f'((j + {BLOCKS} - 70) % {BLOCKS})')})::bigint AS value
        FROM nation JOIN region ON n_regionkey = r_regionkey, j""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound and rotated as words, over the ends of words and of the vector."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    a, b = (packed.pack(symbols.symbol(arch(MAP), F.col(c), BLOCKS)) for c in ("n_name", "r_name"))
    words = rows.select(F.col("n_name").alias("name"), packed.permute(packed.bind(arch(MAP), a, b, BLOCKS), 70, BLOCKS).alias("words"))
    return exploded(words.select("name", packed.unpack(arch(MAP), F.col("words"), BLOCKS).alias("vec")), "name")


@register(
    "packed_majority_map",
    f"""WITH {_WIDE}, t AS (SELECT l_returnflag AS g, l_shipdate::date::varchar AS v, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT g AS l_returnflag, sum(n)::bigint AS n, j::int AS dim, CASE WHEN sum(n * {_sign('v')}) >= 0 THEN 1 ELSE -1 END::bigint AS value FROM t, j GROUP BY g, j""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority of all items' days of shipping, for each return flag; every item votes."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("name"))
    book = Codebook.from_dataframe(arch(MAP), BLOCKS, rows.select("name"))
    words = written(book.vectors(book.names.select("name")).select("name", packed.pack(F.col("vec")).alias("words")), "words")
    found = packed.majority(rows.join(broadcast_if_small(words), "name"), "words", BLOCKS, group_by=("l_returnflag",))
    return exploded(found.select("l_returnflag", "n", packed.unpack(arch(MAP), F.col("words"), BLOCKS).alias("vec")), "l_returnflag", "n")


# A stored codebook


@register(
    "stored_codebook_versions",
    """WITH a AS (SELECT DISTINCT p_brand AS name FROM part), b AS (SELECT p_type AS name, min(p_partkey) AS k FROM part WHERE p_type NOT IN (FROM a) GROUP BY p_type),
        c AS (SELECT DISTINCT o_orderpriority AS name FROM orders WHERE o_orderpriority NOT IN (FROM a) AND o_orderpriority NOT IN (SELECT name FROM b))
    SELECT name, 0 AS version, row_number() OVER (ORDER BY name) - 1 AS idx FROM a
    UNION ALL SELECT name, 1, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY k, name) - 1 FROM b
    UNION ALL SELECT name, 2, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) + row_number() OVER (ORDER BY name) - 1 FROM c""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands, then types as parts first have them, then brands again with priorities: each name keeps its place."""
    part, order = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    stored = StoredCodebook.create(scratch_path(spark, "codebook"), Codebook.empty(spark, arch(MAP), SIZE))
    stored.extend(part, name_col="p_brand")
    stored.extend(part, name_col="p_type", order_by="p_partkey")
    stored.extend(part.select(F.col("p_brand").alias("name")).union(order.select("o_orderpriority")))
    return stored.names().select("name", (F.col("version") - 1).alias("version"), "idx")


# Through the interactive classes, with declared kinds of events


EVENT_KINDS = ["click", "error", "purchase", "signup", "view", "never"]


def _storage(spark: SparkSession, sf_dir: str) -> tuple[api.Storage, DataFrame]:
    """Events by kind, whose categories are declared, in the order of ids."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    vsa = api.MultiplyAddPermute(42)
    return api.Storage.from_dataframe(vsa, SIZE, rows.select("event_type"), enums={"event_type": EVENT_KINDS}), rows


_EVENT_CELLS = "t AS (SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL)"
_EVENT = f"({_sign(_q('event_type'))} * {_sign('event_type')})"


@register("api_bundle_dataset_enum", f"WITH {DIMS}, {_EVENT_CELLS} SELECT j::int AS dim, sum(n * {_EVENT})::bigint AS value FROM t, j GROUP BY j")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    storage, rows = _storage(spark, sf_dir)
    found = storage.subset(rows, order_by="event_id").bundle_dataset_unnormalized()
    return spark.createDataFrame(list(enumerate(found.data.tolist())), "dim int, value long")


@register(
    "api_bind_rows",
    f"WITH {DIMS}, {_EVENT_CELLS}, v AS (SELECT event_type, j::int AS dim, {_EVENT}::bigint AS value FROM t, j) SELECT event_id, dim, v.value FROM events JOIN v USING (event_type)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    storage, rows = _storage(spark, sf_dir)
    return exploded(storage.subset(rows, order_by="event_id").rows("bind"), "event_id", vec="vector")


@register(
    "api_similarities",
    f"""WITH {DIMS}, n AS (SELECT event_type AS name FROM events WHERE event_type IS NOT NULL UNION SELECT unnest(['event_type', 'never']))
        SELECT name, round(sum({_sign('name')} * {_sign(_q('never'))}) / {SIZE}.0, 6) + 0.0 AS similarity FROM n, j GROUP BY name""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    storage, _ = _storage(spark, sf_dir)
    vector = storage.get_column_value("event_type", "never")
    return storage.similarity_table(vector).select("name", rounded(F.col("similarity")).alias("similarity"))


# Accumulators of the other algebras

_neighbour_query(
    "bind_accumulator_vtb",
    VTB,
    f"""SELECT a.vec_id, ((a.j // 8) * 8 + b.j // 8)::int AS dim, round(sqrt(8.0) * sum((a.x + c.x) * b.x), 6) + 0.0 AS value
        {_JOIN} AND a.j % 8 = b.j % 8 JOIN e c ON c.vec_id = b.vec_id AND c.j = a.j GROUP BY ALL""",
    lambda k, a, b: vectors.bind_accumulator(k, vectors.bundle(k, vectors.denormalize(k, a), b), b),
)
_neighbour_query(
    "bind_accumulator_hrr",
    HRR,
    f"""SELECT a.vec_id, ((a.j + b.j) % 64)::int AS dim, round(sum((a.x + c.x) * b.x), 6) + 0.0 AS value
        {_JOIN} JOIN e c ON c.vec_id = b.vec_id AND c.j = a.j GROUP BY ALL""",
    lambda k, a, b: vectors.bind_accumulator(k, vectors.bundle(k, vectors.denormalize(k, a), b), b),
)
_neighbour_query(
    "bundle_accumulators_hrr",
    HRR,
    f"SELECT a.vec_id, a.j::int AS dim, round(2 * a.x + b.x, 6) + 0.0 AS value {_JOIN} AND a.j = b.j",
    lambda k, a, b: vectors.bundle(k, vectors.bundle(k, vectors.denormalize(k, a), b), vectors.denormalize(k, a)),
)


# Orders that rows share


@register(
    "bundle_dataset_bsc_shared_order",
    f"""WITH {DIMS}, t AS (SELECT DISTINCT o_orderdate::date::varchar AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders),
        w AS (SELECT j, k, ({_BS} + {_BP}) % 2 AS x, s, p FROM t, j)
        SELECT j::int AS dim, coalesce(arg_max(x, k) FILTER (x = {_tie("'row|' || k")}), arg_min(x, (k, s, p)))::bigint AS value FROM w GROUP BY j""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one day share their order, and with it their tie bits."""
    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), *ORDERS)
    return whole(folds(rows, BSC, order_by="day").bundle_dataset_with_binding())


@register(
    "bundle_dataset_bsc_one_order",
    f"""WITH {DIMS}, t AS (SELECT DISTINCT l_returnflag AS s, l_linestatus AS p FROM lineitem),
        w AS (SELECT j, s, p, ({_bit(_q('l_returnflag'))} + {_bit('s')} + {_bit(_q('l_linestatus'))} + {_bit('p')}) % 2 AS x FROM t, j)
        SELECT j::int AS dim, coalesce(max(x) FILTER (x = {_tie("'row|' || 'all'")}), arg_min(x, (s, p)))::bigint AS value FROM w GROUP BY j""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows share one order value: the last few leave dimensions open, and all rows decide."""
    rows = items(spark, sf_dir).withColumn("all", F.lit("all"))
    return whole(folds(rows, BSC, order_by="all").bundle_dataset_with_binding())


@register(
    "stream_bundle_map",
    f"""WITH {DIMS}, t AS (SELECT date_trunc('day', ts) AS w, event_type, count(*) AS n FROM events GROUP BY ALL)
        SELECT strftime(w, '%Y-%m-%d') AS day, j::int AS dim, sum(n * {_sign(_q('event_type'))} * {_sign('event_type')})::bigint AS value FROM t, j GROUP BY ALL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bundles over the events as a stream that is read to its end."""
    from hyperloom.streaming.bundles import bundle_counts, stream_counts

    counts = stream_counts(spark, f"{sf_dir}/events.parquet", ["event_type"], "ts", window="1 day", late="1 day")
    book = Codebook(arch(MAP), SIZE, spark.createDataFrame([], "idx long, name string"), {"event_type": None})
    found = bundle_counts(book, counts)
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "dim", F.col("value").cast("long").alias("value"))


_EVENT_BITS = f"({_bit(_q('event_type'))} + {_bit('event_type')} + {_bit(_q('size'))} + {_bit('size')}) % 2"
_EVENTS = "t AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id AS k, event_type, CASE WHEN value >= 100 THEN 'large' ELSE 'small' END AS size FROM events)"


def _event_stream(spark: SparkSession, sf_dir: str, kind: str, fold: str, **options: object) -> DataFrame:
    """A fold of each day of the events, read as a stream to its end."""
    from hyperloom.streaming.bundles import drained, stream_of
    from hyperloom.streaming.folds import windowed_fold

    size = F.when(F.col("value") >= 100, "large").otherwise("small")
    events = stream_of(spark, f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", size.alias("size"))
    book = Codebook(arch(kind), SIZE, spark.createDataFrame([], "idx long, name string"), {"event_type": None, "size": None})
    found = windowed_fold(book, events, ["event_type", "size"], "ts", fold, window="1 day", late="1 day", **options)
    return drained(found, ["window_start", "dim"]).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "dim", F.col("value").cast("long").alias("value"))


@register(
    "stream_bundle_bsc",
    f"""WITH {DIMS}, {_EVENTS}, w AS (SELECT day, j, k, {_EVENT_BITS} AS x FROM t, j)
        SELECT day, j::int AS dim, coalesce(arg_max(x, k) FILTER (x = {_tie("'row|' || k")}), arg_min(x, k))::bigint AS value FROM w GROUP BY day, j""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day and dimension the bit of the last event whose tie bit is its own bit."""
    return _event_stream(spark, sf_dir, BSC, "bundle_dataset_with_binding", order_by="event_id")


@register(
    "stream_bind_map",
    f"""WITH {DIMS}, {_EVENTS}, w AS (SELECT day, event_type, size, count(*) AS n FROM t GROUP BY ALL)
        SELECT day, j::int AS dim, (1 - 2 * (sum(n * ({_EVENT_BITS})) % 2))::bigint AS value FROM w, j GROUP BY day, j""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of all cells of each day's events; a sign is the parity of the negative ones."""
    return _event_stream(spark, sf_dir, MAP, "bind_entire_dataset")


# Vectors of groups as aggregates


@register(
    "sql_bundle_agg_map",
    f"""SELECT label, count(*) AS n, j::int AS dim, sum(CASE WHEN x >= 0 THEN 1 ELSE -1 END)::bigint AS value
        FROM (SELECT label, unnest(generate_series(0, 63)) AS j, unnest(embedding) AS x FROM embeddings) GROUP BY label, j""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings' signs, bundled by label in one SELECT beside a count."""
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.select("label", vectors.parse(arch(MAP), F.col("embedding").cast("array<double>")).alias("v"))
    found = spark.sql(f"SELECT label, count(*) AS n, {bundle_sql(arch(MAP), 'v', SIZE)} AS vec FROM {{rows}} GROUP BY label", rows=rows)
    return exploded(found, "label", "n")


@register(
    "bundle_groups_bsc",
    f"""WITH {DIMS}, o AS (SELECT o_orderpriority AS g, o_orderkey AS k, o_orderstatus || o_custkey AS name FROM orders),
        w AS (SELECT g, k, j, ({_bit('name')}) AS x FROM o, j)
        SELECT g AS o_orderpriority, j::int AS dim, coalesce(arg_max(x, k) FILTER (x = {_tie("'row|' || k")}), arg_min(x, k))::bigint AS value FROM w GROUP BY g, j""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("name", F.concat("o_orderstatus", F.col("o_custkey").cast("string")))
    book = Codebook(arch(BSC), SIZE, rows.select("o_orderpriority", "o_orderkey", "name"))
    return exploded(bundle_groups(book.vectors(), ["o_orderpriority"], "vec", arch(BSC), SIZE, order_by="o_orderkey"), "o_orderpriority")


@register(
    "bind_groups_map",
    f"""WITH {DIMS}, o AS (SELECT o_orderpriority AS g, o_orderstatus || o_custkey AS name, count(*) AS n FROM orders GROUP BY ALL)
        SELECT g AS o_orderpriority, j::int AS dim, (1 - 2 * (sum(n * (1 - ({_bit('name')}))) % 2))::bigint AS value FROM o, j GROUP BY g, j""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("name", F.concat("o_orderstatus", F.col("o_custkey").cast("string")))
    book = Codebook(arch(MAP), SIZE, rows.select("o_orderpriority", "name"))
    return exploded(bind_groups(book.vectors(), ["o_orderpriority"], "vec", arch(MAP), SIZE), "o_orderpriority")


# Tables of expressions

_TURNED = f"(j + {SIZE} - (k % 7)) % {SIZE}"


@register(
    "expressions_map",
    f"""WITH {DIMS}, o AS (SELECT o_orderkey, o_orderstatus AS s, o_custkey % 7 AS k FROM orders), t AS (SELECT DISTINCT s, k FROM o),
        v AS MATERIALIZED (SELECT s, k, j, {_norm(f"{_sign(_q('o_orderstatus'), f'({_TURNED})')} * {_sign('s', f'({_TURNED})')} + {_sign(_q('o_orderstatus'))} * {_sign('s')} + {_sign('s')}")} AS x FROM t, j)
        SELECT o_orderkey, j::int AS dim, x::bigint AS value FROM o JOIN v USING (s, k)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression for each order; all of one status share a product, which is evaluated once."""
    rows, pair = table(spark, sf_dir, "orders"), F.concat(F.lit("o_orderstatus * "), F.col("o_orderstatus"))
    text = F.concat(F.lit("("), pair, F.lit(") ^ "), (F.col("o_custkey") % 7).cast("string"), F.lit(" + "), pair, F.lit(" + "), F.col("o_orderstatus"))
    book = Codebook.from_dataframe(arch(MAP), SIZE, rows.select("o_orderstatus"))
    return exploded(evaluate_all(book, rows.select("o_orderkey", text.alias("text"))), "o_orderkey")


@register(
    "expressions_errors",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL ELSE 'Unknown value: ' || split_part(o_orderpriority, ' ', 1) END AS error
        FROM orders""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions of which the codebook knows some names only."""
    rows = table(spark, sf_dir, "orders")
    book = Codebook.from_dataframe(arch(MAP), SIZE, rows.where("o_orderpriority IN ('1-URGENT', '2-HIGH')").select("o_orderpriority"))
    text = F.concat(F.lit("o_orderpriority * "), F.col("o_orderpriority"))
    return evaluate_all(book, rows.select("o_orderkey", text.alias("text"))).select("o_orderkey", "error")


@register(
    "expressions_equal",
    """SELECT o_orderkey, '((' || o_orderstatus || ' * k' || (o_custkey % 5) || ') + (o ^ 2))' AS shown, true AS commuted, o_custkey % 5 = 0 AS base FROM orders""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order an expression as it is shown, whether it equals the same one written the other way round, and another one."""
    rows, k = table(spark, sf_dir, "orders"), F.concat(F.lit("k"), (F.col("o_custkey") % 5).cast("string"))
    ways = {
        "a": F.concat(F.col("o_orderstatus"), F.lit(" * "), k, F.lit(" + o ^ 2")),
        "b": F.concat(F.lit("(o ^ 2) + ("), k, F.lit(" * "), F.col("o_orderstatus"), F.lit(")")),
        "c": F.concat(F.lit("k0 * "), F.col("o_orderstatus"), F.lit(" + o ^ 2")),
    }
    found = rows.select("o_orderkey", *[c.alias(n) for n, c in ways.items()])
    for n in ways:
        found = canonical(arch(MAP), SIZE, found, text_col=n).withColumnsRenamed({"shown": f"shown_{n}", "key": f"key_{n}"})
    return found.select("o_orderkey", F.col("shown_a").alias("shown"), (F.col("key_a") == F.col("key_b")).alias("commuted"), (F.col("key_a") == F.col("key_c")).alias("base"))


# An encoding of one's own


class ByOddTurns:
    """The value's symbol, turned by 1, 3, 5, ... elements."""

    def cell(self, arch: Architecture, size: int, column: str, position: int, value: str) -> np.ndarray:
        return kernels.permute(kernels.symbol(arch, value, size), 2 * position + 1)


_TURNS = [_sign(c, f"((j + {SIZE} - {2 * i + 1}) % {SIZE})") for i, c in enumerate("sp")]
_fold_query(
    "bundle_dataset_own_encoding_map",
    _tuples_sql(f"coalesce({_TURNS[0]}, 0) + coalesce({_TURNS[1]}, 0)", "sum(n * x)"),
    lambda s: s.bundle_dataset(encoding=ByOddTurns(), rows_normalized=False, normalized=False),
)
