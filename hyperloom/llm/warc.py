"""Web archives: writing records in segments, and reassembling them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm.common import broadcast_if_small, row_key, written

#: What every record says.
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 4 << 10
#: Bytes of records that one file of an archive gets at most.
FILE_BYTES = 256 << 20
HEAD_BYTES = 2 << 10
RAW = "record_id string, record_type string, origin string, segment int, total_length long, digest string, refers_to string, block binary"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record, without the last line feed: the line separator of the text writer supplies it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r"


def _page_records(page_id: str, url: str, payload: bytes, refers_to: str | None, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    digest = _digest(payload)
    name = lambda page: f"<urn:x-page:{page}:{digest}>"
    uri = re.sub(r"[\r\n]+", " ", url or "")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        head = f"{HTTP_HEAD}Content-Length: {len(payload)}\r\n\r\n".encode()
        headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", name(page_id)), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
        yield _record([*headers, ("Content-Type", "application/http;msgtype=response")], head)
        return
    block = f"{HTTP_HEAD}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload, chunk_bytes)
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for k, piece in enumerate(pieces, 1):
        if k == 1:
            headers = [("WARC-Type", "response"), ("WARC-Record-ID", name(page_id)), *common, ("Content-Type", "application/http;msgtype=response")]
        else:
            own = f"<urn:x-page:{page_id}:{digest}:{k}>"
            headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Segment-Origin-ID", name(page_id)), *common]
        if len(pieces) > 1:
            headers.append(("WARC-Segment-Number", k))
            if k == len(pieces):
                headers.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(headers, piece)


def write_archive(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    min_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> None:
    """Write gzip'd WARC files under ``path``, one record per row of ``pages`` (or one per segment).

    Of rows with equal bodies of ``min_bytes`` or more, that with the largest id is a response and
    the others revisit it; rows that repeat that id are responses too. Bodies are chunked, and
    blocks of over ``segment_bytes`` are split into continuation records. Equal bodies are found by
    SHA-256, combined within map tasks first; only (row, largest id) of revisits is joined back, and
    bodies are written from where they were read. A null body is empty, a null id the empty string.
    A record has ``segment_bytes`` and a head at most, so a number of records bounds a file to ``FILE_BYTES``.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    key = row_key(F.col(id_col), F.col(url_col), F.col(body_col))
    rows = pages.select(*key, F.col(id_col).alias("_id"), F.unhex(F.sha2(body, 256)).alias("_sha"), F.octet_length(body).alias("_n"))
    rows = rows.where(F.col("_n") >= min_bytes)
    groups = written(rows.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "equal-bodies")
    revisits = rows.join(groups, "_sha").where(~F.col("_id").eqNullSafe(F.col("_keep"))).select("_k1", "_k2", "_keep")
    revisits = written(revisits.dropDuplicates(["_k1", "_k2"]), "revisits")
    revisits = broadcast_if_small(revisits)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    marked = pages.select(*key, text(F.col(id_col)).alias("_id"), text(F.col(url_col)).alias("_url"), body.alias("_body"))
    marked = marked.join(revisits, ["_k1", "_k2"], "left").select("_id", "_url", "_body", F.col("_keep").cast("string").alias("_keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                ident, url, payload, keep = (x.as_py() for x in row)
                records = list(_page_records(ident, url, payload, keep, segment_bytes, chunk_bytes))
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["value"])

    records = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    most = max(1, FILE_BYTES // (segment_bytes + HEAD_BYTES))
    records.write.option("maxRecordsPerFile", most).option("compression", "gzip").option("lineSep", "\n").text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record was expected, not {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError("the stream ends within a record")
        yield headers, block


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the WARC files under ``path``, plain or gzip'd; segments are still apart.

    A file is read as one value and unpacked as a stream of records. Spark's limit for a value is 2 GB:
    a larger file stops the job with Spark's error, nothing of it is left out silently.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in ("record_id", "record_type", "origin")])
        schema = schema.append(pa.field("segment", pa.int32())).append(pa.field("total_length", pa.int64()))
        schema = schema.append(pa.field("digest", pa.string())).append(pa.field("refers_to", pa.string())).append(pa.field("block", pa.binary()))
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                stream = pa.BufferReader(data)
                plain = gzip.GzipFile(fileobj=stream) if data[:2].to_pybytes() == b"\x1f\x8b" else stream
                rows, size = [], 0
                for h, block in parse(io.BufferedReader(plain)):
                    number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
                    rows.append(
                        {
                            "record_id": h.get("warc-record-id"),
                            "record_type": h.get("warc-type"),
                            "origin": h.get("warc-segment-origin-id", h.get("warc-record-id")),
                            "segment": int(number) if number else None,
                            "total_length": int(total) if total else None,
                            "digest": h.get("warc-payload-digest", "").removeprefix("sha1:"),
                            "refers_to": h.get("warc-refers-to"),
                            "block": block,
                        }
                    )
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("content").mapInArrow(run, RAW)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: segments are grouped by origin, ordered by number and checked against the total length.

    Adds ``complete``: false where a number is missing, or the length is not what the last segment
    says; such a record has a null block. Equal segments of one number are copies of one record, and
    as many records come out. Only segmented records are shuffled, and a group is one record.
    """
    columns = ["record_id", "record_type", "digest", "refers_to", "block"]
    single = records.where("segment IS NULL").select(*columns, F.lit(True).alias("complete"))
    pieces = records.where("segment IS NOT NULL")
    one = pieces.groupBy("origin", "segment").agg(
        F.count(F.lit(1)).alias("copies"), F.max("total_length").alias("total"), F.first("digest").alias("digest"), F.first("block").alias("block")
    )
    whole = one.groupBy("origin").agg(
        F.max("digest").alias("digest"),
        F.max("total").alias("total"),
        F.max("copies").alias("copies"),
        F.count(F.lit(1)).alias("n"),
        F.min("segment").alias("first"),
        F.max("segment").alias("last"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    whole = whole.withColumn("block", block)
    complete = (F.col("first") == 1) & (F.col("last") == F.col("n")) & F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False))
    whole = whole.withColumn("complete", complete).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return single.union(
        whole.select(
            F.col("origin").alias("record_id"),
            F.lit("response").alias("record_type"),
            "digest",
            F.lit(None).cast("string").alias("refers_to"),
            F.when(F.col("complete"), F.col("block")).alias("block"),
            "complete",
        )
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the archive under ``path``: ``page_id`` (string), ``payload`` (binary, null for revisits
    and damaged records), ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``
    (string) and ``complete``.

    Chunked bodies are decoded; a body that isn't decodable or doesn't have its digest is not complete.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                block, payload, size, complete = r.pop("block"), None, None, r["complete"]
                if block is not None:
                    head, _, body = block.partition(b"\r\n\r\n")
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                    if r["record_type"] == "revisit":
                        size = int(fields.get(b"content-length", b"0"))
                    else:
                        try:
                            payload = dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                            size = len(payload)
                            complete = _digest(payload) == r["digest"]
                        except ValueError:
                            complete = False
                rows.append(r | {"payload": payload, "payload_bytes": size, "complete": complete})
            kinds = [("record_id", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("complete", pa.bool_())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*kinds, ("payload", pa.binary()), ("payload_bytes", pa.int64())]))

    schema = "record_id string, record_type string, digest string, refers_to string, complete boolean, payload binary, payload_bytes long"
    pages = reassembled(read_records(spark, path)).select("record_id", "record_type", "digest", "refers_to", "complete", "block").mapInArrow(run, schema)
    ident = lambda c: F.nullif(F.regexp_extract(c, "^<urn:x-page:(.*):[A-Z2-7]+>$", 1), F.lit(""))
    return pages.select(
        ident(F.col("record_id")).alias("page_id"),
        "payload",
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        ident(F.col("refers_to")).alias("refers_to"),
        "complete",
    )
