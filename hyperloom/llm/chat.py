"""Chat formatting: minimum-cost repair of roles, then rendering."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.common import broadcast_if_small, written

#: Other names of the roles.
ROLES = {
    "system": "system", "developer": "system",
    "user": "user", "human": "user", "customer": "user",
    "assistant": "assistant", "bot": "assistant", "ai": "assistant", "gpt": "assistant", "model": "assistant",
}
#: States of the automaton: nothing yet, then the role of the last turn.
STATES = ("", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
UNKNOWN = 0
#: Legal next turns of each state. A conversation ends after an assistant.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}

#: A wrong label costs more than an empty turn: words of one side are not put into the mouth of the other lightly.
MERGE, RELABEL, INSERT = 1.0, 5.0, 3.0
#: A turn of unknown role has no label to change.
NAME = 0.5
INF = float("inf")

#: What looks like the beginning of a marker within a text, however often it was escaped already.
MARKER = re.compile(r"<(\\*)\|")


def escaped(text: str) -> str:
    """``text`` with a backslash more after the ``<`` of every ``<|``, so that it holds no marker."""
    return MARKER.sub(r"<\\\1|", text)


def parsed(rendered: str) -> list[tuple[str, str]]:
    """The turns (role, text) that a rendered conversation holds: what ``render`` was given, unescaped."""
    turns = re.findall(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", rendered, re.DOTALL)
    return [(role, re.sub(r"<\\(\\*)\|", r"<\1|", text)) for role, text in turns]


def _step(state: int, role: int, to: int) -> tuple[float, tuple[int, ...]]:
    """Cost of taking a turn of ``role`` as ``to`` after ``state``, and the empty turns to insert first.

    A turn of the same role as the one before is merged with it.
    """
    cost = 0.0 if role == to else NAME if role == UNKNOWN else RELABEL
    if state == to and to != START:
        return cost + MERGE, ()
    if to in NEXT[state]:
        return cost, ()
    ways = [x for x in NEXT[state] if to in NEXT[x]]
    return (cost + INSERT, (ways[0],)) if ways and to != START else (INF, ())


STEPS = {(s, r, t): _step(s, r, t) for s in range(4) for r in range(4) for t in range(4)}
COSTS = np.array([[[STEPS[s, r, t][0] for t in range(4)] for s in range(4)] for r in range(4)])
#: What it takes to end in each state: an empty answer, or an empty question and answer.
ENDS = np.array([2 * INSERT, 2 * INSERT, INSERT, 0.0])
TAIL = {START: (USER, ASSISTANT), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def summary(roles: list[int]) -> np.ndarray:
    """Least costs from each state to each state over a run of turns: a min-plus product."""
    out = np.where(np.eye(4, dtype=bool), 0.0, INF)
    for r in roles:
        out = (out[:, :, None] + COSTS[r][None, :, :]).min(axis=1)
    return out


def route(roles: list[int], enter: int, leave: int) -> list[int]:
    """The states after each turn, on the cheapest way from ``enter`` to ``leave``; ties go to the later state's least predecessor."""
    cost, back = np.full(4, INF), []
    cost[enter] = 0
    for r in roles:
        ways = cost[:, None] + COSTS[r]
        back.append(ways.argmin(axis=0))
        cost = ways.min(axis=0)
    states = [leave]
    for choice in back[:0:-1]:
        states.append(int(choice[states[-1]]))
    return states[::-1] if roles else []


def role_number(role: Column) -> Column:
    names = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    out = F.lit(UNKNOWN)
    for k, state in enumerate(STATES[1:], 1):
        out = F.when(names.isin([n for n, r in ROLES.items() if r == state]), k).otherwise(out)
    return out


def repair(
    conversations: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    run_rows: int = 50_000,
) -> DataFrame:
    """One row per turn: the role it gets in the cheapest legal sequence, and its rendered piece.

    Legal is an optional system turn, then user and assistant in turns, ending with the assistant.
    A turn keeps its role or is relabelled; a turn of the same role as the one before is merged with
    it; empty turns are inserted before it or at the end. The costs are constants of this module.

    Turns are sorted by range over (conversation, turn), so a conversation of any size is spread over
    runs. A run's effect is a 4 x 4 matrix of costs; for conversations that span several runs (one
    at most for each boundary) the matrices are chained to find the states between runs. Then each
    run is decided by itself.

    Columns: ``conv_id, turn, seq`` (order within the conversation), ``role, new_role, action``
    (keep, relabel, merge, relabel+merge), ``inserted`` (roles put in before, comma-joined), ``tail``
    (roles put in after, on the last turn), ``cost`` (share of this turn, inserts and tail
    included) and ``rendered``. Pieces joined in order are the rendered conversation, from which
    ``parsed`` reads back the repaired turns: a ``<|`` within a text is rendered as ``<\\|`` (and
    ``<\\|`` as ``<\\\\|``), so no text can open or close a turn.

    Defined cases: turns are ordered by turn, role and text, nulls first; ties are alike; null
    conversation ids are one conversation; unknown or null roles may become anything at a small
    cost; null text is empty; an empty table gives an empty result; other columns are ignored.
    """
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = ["conv_id", "turn", "role", "text", "_tie"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_seq", F.monotonically_increasing_id()).withColumn("_run", F.spark_partition_id())
    ranged = ranged.withColumn("_run", F.col("_run") * F.lit(1 << 20) + F.floor(F.col("_seq") % (1 << 33) / run_rows))
    ranged = written(ranged.select("conv_id", "turn", "role", "text", "_seq", "_run", role_number(F.col("role")).alias("_r")), "runs")

    spanning = ranged.groupBy("conv_id").agg(F.min("_run").alias("_a"), F.max("_run").alias("_b")).where("_a <> _b")
    spanning = written(spanning.select(F.col("conv_id").alias("_c")), "spanning")
    spanning = broadcast_if_small(spanning)
    states = written(_between(ranged.join(spanning, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")), "states")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_run") == F.col("_r_run"))
    known = states.select(F.col("conv_id").alias("_c"), F.col("_run").alias("_r_run"), "_enter", "_leave", "_final")
    placed = ranged.join(known, same, "left").select("conv_id", "_run", "_seq", "turn", "role", "text", "_r", "_enter", "_leave", "_final")
    dealt = placed.repartition("conv_id", "_run").sortWithinPartitions("conv_id", "_run", "_seq")
    schema = dealt.select("conv_id", "turn").schema
    for name, kind in (("seq", "long"), ("role", "string"), ("new_role", "string"), ("action", "string"), ("inserted", "string"), ("tail", "string"), ("cost", "double"), ("rendered", "string")):
        schema = schema.add(name, kind)
    return dealt.mapInArrow(_decide, schema)


def _between(turns: DataFrame) -> DataFrame:
    """For each run of the given conversations: the states at its start and end, and whether it is the last."""

    def summaries(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["_seq"].to_pylist(), table["_r"].to_pylist(), strict=True))
        return pa.table({"conv_id": table["conv_id"][:1], "_run": table["_run"][:1], "_m": pa.array([summary([r for _, r in rows]).ravel().tolist()])})

    def chain(table: pa.Table) -> pa.Table:
        runs = sorted(zip(table["_run"].to_pylist(), table["_m"].to_pylist(), strict=True))
        cost, back = np.array([0.0, INF, INF, INF]), []
        for _, m in runs:
            ways = cost[:, None] + np.array(m).reshape(4, 4)
            back.append(ways.argmin(axis=0))
            cost = ways.min(axis=0)
        state, out = int((cost + ENDS).argmin()), []
        for (run, _), choice in zip(runs[::-1], back[::-1], strict=True):
            out.append((run, int(choice[state]), state))
            state = int(choice[state])
        out.reverse()
        n = len(out)
        conv = pa.chunked_array([pa.array([table["conv_id"][0].as_py()] * n, table["conv_id"].type)])
        return pa.table({"conv_id": conv, "_run": [o[0] for o in out], "_enter": [o[1] for o in out], "_leave": [o[2] for o in out], "_final": [i == n - 1 for i in range(n)]})

    kind = turns.schema["conv_id"].dataType.simpleString()
    found = turns.select("conv_id", "_run", "_seq", "_r").groupBy("conv_id", "_run").applyInArrow(summaries, f"conv_id {kind}, _run long, _m array<double>")
    return found.groupBy("conv_id").applyInArrow(chain, f"conv_id {kind}, _run long, _enter long, _leave long, _final boolean")


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation, run and place; a run that a batch cuts is carried over."""
    rest: list[dict] = []
    kinds: pa.Schema | None = None

    def out(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        done, begin = [], 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or (rows[k]["conv_id"], rows[k]["_run"]) != (rows[begin]["conv_id"], rows[begin]["_run"]):
                done += _run_rows(rows[begin:k])
                begin = k
        if done:
            yield pa.RecordBatch.from_pylist(done, kinds)

    for batch in batches:
        if kinds is None:
            text = [(c, pa.string()) for c in ("role", "new_role", "action", "inserted", "tail")]
            kinds = pa.schema([batch.schema.field("conv_id"), batch.schema.field("turn"), ("seq", pa.int64()), *text, ("cost", pa.float64()), ("rendered", pa.string())])
        rows = rest + batch.to_pylist()
        last = len(rows)
        while last and (rows[last - 1]["conv_id"], rows[last - 1]["_run"]) == (rows[-1]["conv_id"], rows[-1]["_run"]):
            last -= 1
        yield from out(rows[:last])
        rest = rows[last:]
    yield from out(rest)


def _run_rows(rows: list[dict]) -> list[dict]:
    roles = [r["_r"] for r in rows]
    enter, leave, final = rows[0]["_enter"], rows[0]["_leave"], rows[0]["_final"]
    if enter is None:
        enter, final = START, True
        leave = int((summary(roles)[START] + ENDS).argmin())
    done, state = [], enter
    for k, (row, to) in enumerate(zip(rows, route(roles, enter, leave), strict=True)):
        cost, before = STEPS[state, row["_r"], to]
        merged = state == to
        tail = TAIL[to] if final and k == len(rows) - 1 else ()
        action = "+".join([*["relabel"] * (row["_r"] != to), *["merge"] * merged]) or "keep"
        piece = ("" if state == START and not before else "\n") if merged else "".join(_head(s, state == START and i == 0) for i, s in enumerate([*before, to]))
        piece += escaped(row["text"]) + "".join(_head(s, False) for s in tail) + ("<|end|>\n" if final and k == len(rows) - 1 else "")
        done.append(
            {
                "conv_id": row["conv_id"],
                "turn": row["turn"],
                "seq": row["_seq"],
                "role": row["role"],
                "new_role": STATES[to],
                "action": action,
                "inserted": ",".join(STATES[s] for s in before),
                "tail": ",".join(STATES[s] for s in tail),
                "cost": cost + INSERT * len(tail),
                "rendered": piece,
            }
        )
        state = to
    return done


def _head(state: int, first: bool) -> str:
    return ("" if first else "<|end|>\n") + f"<|{STATES[state]}|>\n"


def render(repaired: DataFrame) -> DataFrame:
    """``conv_id, text``: the pieces of ``repair`` joined; a result row is one whole conversation."""
    pieces = F.array_sort(F.collect_list(F.struct("seq", "rendered")))
    return repaired.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda p: p["rendered"]), "").alias("text"))
