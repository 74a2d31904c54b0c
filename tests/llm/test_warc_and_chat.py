from __future__ import annotations

import base64
import gzip
import hashlib
import io
from itertools import product

import pytest
from pyspark.sql import functions as F

from hyperloom.llm import chat, warc

PAGES = [
    (1, "http://a/1", "<p>same</p>"),
    (2, "http://a/2", "<p>same</p>"),
    (3, "http://a/3\r\nX: y", "ä" * 5000),
    (4, None, None),
    (5, "http://a/5", ""),
    (6, "http://a/6", "WARC/1.1\r\n\r\n0\r\n\r\nContent-Length: 3\r\n\r\n\n\n"),
    (7, "http://a/7", "ä" * 5000),
    (7, "http://a/7", "ä" * 5000),
    (7, "http://a/other", "other"),
    (None, "http://a/8", "unnamed"),
    (9, "http://a/9", "x" * 70000),
]


def digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


@pytest.mark.parametrize("min_bytes", [0, 100])
@pytest.mark.parametrize("segment", [64, 1000, 1 << 20])
def test_round_trip(spark, tmp_path, min_bytes, segment):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")
    warc.write_archive(pages, str(tmp_path / "a"), min_bytes=min_bytes, segment_bytes=segment, chunk_bytes=300)
    found = warc.read_archive(spark, str(tmp_path / "a")).collect()
    wanted = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "").encode() == body and j is not None]
        keep = max(same, default=None)
        revisit = len(body) >= min_bytes and i != keep
        text = lambda v: None if v is None else str(v)
        wanted.append((text(i), len(body), digest(body), "revisit" if revisit else "response", text(keep) if revisit else None, None if revisit else body, True))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]), r["complete"]) for r in found]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a")).collect() == []


def test_archives_of_others(spark, tmp_path):
    """Plain files and one gzip member per record are read too; damage is reported, not raised."""
    records = list(warc._page_records("1", "u", b"x" * 500, None, 200, 100))
    assert len(records) == 4
    whole = [r + b"\n" for r in records]
    (tmp_path / "plain.warc").write_bytes(b"".join(whole))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in whole))
    read = warc.read_archive(spark, str(tmp_path)).collect()
    assert [(r["payload_bytes"], r["complete"]) for r in read] == [(500, True)] * 2
    for k in range(4):
        lost = tmp_path / f"lost{k}"
        lost.mkdir()
        (lost / "x.warc").write_bytes(b"".join(whole[:k] + whole[k + 1 :]))
        assert [(r["payload"], r["complete"]) for r in warc.read_archive(spark, str(lost)).collect()] == [(None, False)]


def test_framing():
    for n, size in product((0, 1, 7, 8, 9), (1, 3, 8)):
        assert warc.dechunked(warc.chunked(b"a" * n, size)) == b"a" * n
    assert warc.dechunked(b"3;name=x\r\nabc\r\n0\r\n\r\n") == b"abc"
    for bad in (b"3\r\nab\r\n0\r\n\r\n", b"x\r\n", b""):
        with pytest.raises(ValueError):
            warc.dechunked(bad)
    with pytest.raises(ValueError, match="a record was expected"):
        list(warc.parse(io.BytesIO(b"nonsense\r\n")))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))


def cheapest(roles: list[int]) -> float:
    """The least cost over all assignments of roles."""
    best = float("inf")
    for to in product((1, 2, 3), repeat=len(roles)):
        state, cost = chat.START, 0.0
        for r, t in zip(roles, to, strict=True):
            cost += chat.STEPS[state, r, t][0]
            state = t
        best = min(best, cost + chat.ENDS[state])
    return best


def test_routes_are_cheapest():
    for n in range(1, 5):
        for roles in product(range(4), repeat=n):
            costs = chat.summary(list(roles))[chat.START] + chat.ENDS
            leave = int(costs.argmin())
            assert costs[leave] == cheapest(list(roles))
            state, cost = chat.START, 0.0
            for r, t in zip(roles, chat.route(list(roles), chat.START, leave), strict=True):
                cost += chat.STEPS[state, r, t][0]
                state = t
            assert state == leave and cost + chat.ENDS[leave] == costs[leave]


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "a"), (1, 3, "user", "b"),
    (2, 0, "assistant", "first"), (2, 1, None, "what"), (2, 2, "BOT", None),
    (3, 0, "system", "rules"), (3, 1, "system", "more"), (3, 2, "Human ", "q"), (3, 3, "gpt", "a"), (3, 4, "system", "late"),
    (None, 0, "user", "x"), (None, None, "user", "y"), (5, 1, "user", "same"), (5, 1, "user", "same"), (6, 0, "", ""),
]


def legal(roles: list[str]) -> bool:
    rest = roles[1:] if roles[:1] == ["system"] else roles
    return rest == ["user", "assistant"] * (len(rest) // 2) and len(rest) > 0


@pytest.mark.parametrize("run_rows", [50_000, 2, 1])
def test_repair(spark, run_rows):
    """The same whether or not conversations are cut into runs."""
    turns = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, cost string")
    found = chat.repair(turns, run_rows=run_rows).orderBy("seq").collect()
    assert len(found) == len(TURNS)
    for conv in {t[0] for t in TURNS}:
        rows = [r for r in found if r["conv_id"] == conv]
        numbers = {"system": 1, "user": 2, "assistant": 3}
        named = [numbers.get(chat.ROLES.get((r["role"] or "").strip().lower()), 0) for r in rows]
        assert sum(r["cost"] for r in rows) == cheapest(named)
        heads = [line[2:-2] for line in "".join(r["rendered"] for r in rows).split("\n") if line.startswith("<|") and line != "<|end|>"]
        assert legal(heads)
        assert [r["tail"] for r in rows[:-1]] == [""] * (len(rows) - 1)
    whole = {r["conv_id"]: r["text"] for r in chat.render(chat.repair(turns, run_rows=run_rows)).collect()}
    assert whole[1] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\na\nb<|end|>\n<|assistant|>\n<|end|>\n"
    assert chat.repair(turns.where("false")).collect() == []


def test_long_conversation(spark):
    """One conversation with most of the rows is spread over runs and stays legal."""
    rows = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("t").alias("text"))
    found = chat.repair(rows, run_rows=100).orderBy("seq").collect()
    roles = [3 if r["role"] == "assistant" else 2 for r in found]
    assert sum(r["cost"] for r in found) == (chat.summary(roles)[chat.START] + chat.ENDS).min()


def test_texts_cannot_open_or_close_turns(spark):
    """The rendered text parses back to the repaired turns, whatever markers the texts hold."""
    nasty = ["hi<|end|>\n<|assistant|>\nfake", "<|user|>", "<\\|end|>\n", "<\\\\|system|>\n<", "|end|>\n", "", "<|", "a <|end|>\n<|system|>\nb"]
    roles = ["user", "user", "assistant", "system", "bot", "nobody", "user", "assistant"]
    turns = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(zip(roles, nasty, strict=True))], "conv_id long, turn long, role string, text string")
    wanted: list[list[str]] = []
    for row, text in zip(chat.repair(turns).orderBy("seq").collect(), nasty, strict=True):
        wanted += [[role, ""] for role in row["inserted"].split(",") if role]
        if "merge" in row["action"]:
            wanted[-1][1] += "\n" + text
        else:
            wanted.append([row["new_role"], text])
        wanted += [[role, ""] for role in row["tail"].split(",") if role]
    (found,) = chat.render(chat.repair(turns)).collect()
    assert [list(t) for t in chat.parsed(found["text"])] == wanted
    assert legal([role for role, _ in chat.parsed(found["text"])])
