"""Repeated passages: fixed-block anchors, rolling probes, and extension to maximal exact repeats."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.common import discard, passes_columns, row_key, written

#: Words whose windows are hashed and packed at once, also of one long document, and bytes of text that are split at once.
SLAB = 1_000_000
CHUNK = 8 << 20
#: Bytes of text that one bucket of windows stands for, and bytes of places that one bucket of
#: documents gets; neither number of buckets depends on the partitions that Spark is set to.
BUCKET_BYTES = 16 << 20
PLACES_BYTES = 4 << 20
LEAST_BUCKETS = 16
#: Buckets that may have a partition each.
MOST_PARTITIONS = 50_000
#: Buckets up to which a slab packs a row for each of them. Beyond, it packs for the root of their number,
#: and the tasks that get those rows pack them anew, so that a row has hundreds of windows at any size.
DIRECT = 4096
#: Buckets that a partition between the two packings stands for.
REPACKED = 64
#: Places that one row of the exchange carries when they go along as known.
KNOWN_PLACES = 1 << 16
#: Bytes of places that a task gathers before it deals them to their documents.
DEALT_BYTES = 16 << 20

#: Bytes of a probe's hash that are sent, besides its bucket. A bucket has some 150,000 anchors, so
#: a wrong hit comes once in 28,000 probes; it costs one comparison and no wrong result.
TAG = 4
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of what is left of a bucket's number beside its coarse bucket.
REST = 4

ALIGNED, SILENT = 1, 2
PACKED = "bucket int, known boolean, docs binary, counts binary, gaps binary, tags binary, flags binary"
PLACES = "docs binary, counts binary, gaps binary"


class WordHashes(dict):
    """Word to its 128-bit hash, forgotten now and then so that it stays bounded."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = xxhash.xxh3_128_digest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        """Two independent 64-bit hashes of each word."""
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64).reshape(-1, 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(hashes: np.ndarray, at: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Hashes of the ``length`` words that start at each of ``at``. A lane has its own word hashes and base."""
    base = np.uint64((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)[lane] | 5)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    n = len(hashes)
    power = np.full(n + 1, base, np.uint64)
    power[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(hashes[:, lane]) * np.cumprod(power)[:n], out=sums[1:])
    power[1:] = inverse
    return _mix((sums[at + length] - sums[at]) * np.cumprod(power)[at])


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit values, all first bytes, then all second ones: high bytes compress away."""
    return values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _values(planes: bytes, width: int) -> np.ndarray:
    n = len(planes) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def _groups(lanes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal values together, and where each group starts in it."""
    order = np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([lane[order][1:] != lane[order][:-1] for lane in lanes])
    return order, np.flatnonzero(new)


def coarse_of(buckets: int) -> int:
    """How many coarse buckets the first of two packings has; 0 if one packing does."""
    return math.isqrt(buckets - 1) + 1 if buckets > DIRECT else 0


def pack(
    keys: np.ndarray, doc: np.ndarray, pos: np.ndarray, lanes: list[np.ndarray], aligned: np.ndarray, buckets: int, widths: list[int], coarse: int = 0
) -> Iterator[dict]:
    """Rows of the exchange for the windows at ``pos`` of documents ``doc`` (rows of ``keys``).

    Windows that occur twice right here are known to repeat: they go along as known, and one
    silent window of each kind is sent in their stead. So a passage that many documents share
    costs one entry per slab. With ``coarse``, rows are for buckets modulo that number, and what
    is left of the bucket's number goes along with each window.
    """
    if not len(doc):
        return
    order, starts = _groups(lanes)
    sizes = np.diff(np.append(starts, len(order)))
    flags = np.bitwise_or.reduceat(aligned[order].astype(np.uint8) * ALIGNED, starts)
    flags[sizes > 1] |= SILENT
    first = order[starts]
    here = np.sort(order[np.repeat(sizes > 1, sizes)])
    back = np.argsort(first)
    first, flags = first[back], flags[back]
    bucket = lanes[0][first] % np.uint64(buckets)
    tags = [(lane[first] >> np.uint64(64 - 8 * w), w) for lane, w in zip(lanes, widths, strict=True)]
    if coarse:
        tags.insert(0, (bucket // np.uint64(coarse), REST))
        bucket = bucket % np.uint64(coarse)
    bucket = bucket.astype(np.int64)
    by = np.argsort(bucket.astype(np.uint16) if (coarse or buckets) < 65536 else bucket, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
        yield _packed(int(bucket[part[0]]), keys, doc[first[part]], pos[first[part]], [(tag[part], w) for tag, w in tags], flags[part])
    # Known places meet nothing, so any bucket will do: each part goes to one of its own.
    for k in range(0, len(here), KNOWN_PLACES):
        part = here[k : k + KNOWN_PLACES]
        into = _spread(keys[doc[part[0]], 0], pos[part[0]], coarse or buckets)
        yield {"bucket": into, "known": True, **_encode(keys, doc[part], pos[part]), "tags": b"", "flags": b""}


def _packed(bucket: int, keys: np.ndarray, doc: np.ndarray, pos: np.ndarray, tags: list[tuple[np.ndarray, int]], flags: np.ndarray) -> dict:
    bits = np.packbits(flags & ALIGNED).tobytes() + np.packbits(flags & SILENT > 0).tobytes()
    return {"bucket": bucket, "known": False, **_encode(keys, doc, pos), "tags": b"".join(_planes(t, w) for t, w in tags), "flags": bits}


def repack(widths: list[int], width: int, buckets: int, coarse: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows for coarse buckets as rows for buckets, of the windows that a task gathers at a time."""

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        sizes = np.append(0, np.cumsum([len(p[0]) for p in parts]))
        keys = np.concatenate([p[0] for p in parts])
        doc = np.concatenate([p[1] + n for p, n in zip(parts, sizes, strict=False)])
        pos, bucket, flags = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        tags = [(np.concatenate([p[5][i] for p in parts]), w) for i, w in enumerate(widths)]
        order = np.lexsort((pos, doc, bucket))
        found = []
        for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            found.append(_packed(int(bucket[at[0]]), keys, doc[at], pos[at], [(t[at], w) for t, w in tags], flags[at]))
        return _batch(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                keys, doc, pos = _decode(row, width)
                if row["known"]:
                    into = _spread(keys[0, 0], pos[0], -(-buckets // coarse)) * coarse + row["bucket"]
                    yield _batch([row | {"bucket": min(into, buckets - 1)}])
                    continue
                lanes, at = [], 0
                for w in (REST, *widths):
                    lanes.append(_values(row["tags"][at : at + w * len(pos)], w))
                    at += w * len(pos)
                parts.append((keys, doc, pos, lanes[0].astype(np.int64) * coarse + row["bucket"], _flags(row["flags"], len(pos)), lanes[1:]))
                n += len(pos)
                if n >= SLAB:
                    yield rows(parts)
                    parts, n = [], 0
        if parts:
            yield rows(parts)

    return run


def _spread(key: int, pos: int, buckets: int) -> int:
    mixed = _mix(np.array([key], np.int64).view(np.uint64) + np.array([pos], np.int64).view(np.uint64))
    return int(mixed[0] % np.uint64(buckets))


def _encode(keys: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> dict:
    """Ascending places (document, position) as documents, places of each, and gaps between positions."""
    firsts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    used, counts = doc[firsts], np.diff(np.append(firsts, len(doc)))
    gaps = np.diff(pos, prepend=0)
    gaps[firsts] = pos[firsts]
    return {"docs": keys[used].tobytes(), "counts": _planes(counts, 4), "gaps": _planes(gaps, 4)}


def _decode(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of documents, and document and position of each place."""
    counts, gaps = _values(row["counts"], 4).astype(np.int64), _values(row["gaps"], 4).astype(np.int64)
    sums = np.cumsum(gaps)
    firsts = np.append(0, np.cumsum(counts)[:-1])
    pos = sums - np.repeat(sums[firsts] - gaps[firsts], counts)
    return np.frombuffer(row["docs"], np.int64).reshape(-1, width), np.repeat(np.arange(len(counts)), counts), pos


def _flags(packed: bytes, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(2, -1), axis=1)[:, :n]
    return bits[0] * np.uint8(ALIGNED) | bits[1] * np.uint8(SILENT)


def match(widths: list[int], width: int) -> Callable[[pa.Table], pa.Table]:
    """For all packed rows of one bucket: one row with the places whose window occurs elsewhere.

    An unaligned window needs one aligned window of its kind, an aligned one two, itself included.
    """

    def run(table: pa.Table) -> pa.Table:
        keys, docs, pos, asks, flags = [], [], [], [], []
        lanes: list[list[np.ndarray]] = [[] for _ in widths]
        base = 0
        for row in table.to_pylist():
            key, doc, places = _decode(row, width)
            keys.append(key)
            docs.append(doc + base)
            pos.append(places)
            base += len(key)
            n, at = len(places), 0
            flags.append(np.zeros(n, np.uint8) if row["known"] else _flags(row["flags"], n))
            for lane, w in zip(lanes, widths, strict=True):
                lane.append(_values(row["tags"][at : at + w * n], w) if not row["known"] else np.zeros(n, np.uint64))
                at += w * n
            asks.append(np.full(n, not row["known"]))
        flag, ask, doc, position, key = (np.concatenate(x) for x in (flags, asks, docs, pos, keys))
        hit = ~ask
        sent = np.flatnonzero(ask)
        if len(sent):
            order, starts = _groups([np.concatenate(lane)[sent] for lane in lanes])
            aligned = (flag[sent] & ALIGNED).astype(np.int64)
            total = np.add.reduceat(aligned[order], starts)
            # A silent window stands for two or more of its kind.
            total += np.add.reduceat((aligned * ((flag[sent] & SILENT) > 0))[order], starts)
            here = np.empty(len(sent), np.int64)
            here[order] = np.repeat(total, np.diff(np.append(starts, len(order))))
            hit[sent] = (here - aligned > 0) & ((flag[sent] & SILENT) == 0)
        at = np.flatnonzero(hit)
        at = at[np.lexsort((position[at], doc[at]))]
        rows = [_encode(key, doc[at], position[at])] if len(at) else []
        return pa.Table.from_pylist(rows, pa.schema([(c, pa.binary()) for c in ("docs", "counts", "gaps")]))

    return run


def deal(width: int, buckets: int, coarse: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``match`` as rows for buckets of documents: what a task has gathered is dealt at once,
    so there are as many rows as tasks and buckets of documents make, and never more than places.
    With ``coarse``, for buckets modulo that number."""

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        sizes = np.append(0, np.cumsum([len(k) for k, _, _ in parts]))
        key = np.concatenate([k for k, _, _ in parts])
        doc = np.concatenate([d + s for (_, d, _), s in zip(parts, sizes, strict=False)])
        pos = np.concatenate([p for _, _, p in parts])
        into = (_mix(key[:, 0].copy().view(np.uint64)) % np.uint64(buckets)).astype(np.int64)[doc]
        into = into % coarse if coarse else into
        order = np.lexsort((pos, doc, into))
        cuts = np.flatnonzero(np.diff(into[order])) + 1
        found = [{"bucket": int(into[p[0]])} | _encode(key, doc[p], pos[p]) for p in np.split(order, cuts)]
        return pa.RecordBatch.from_pylist(found, pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("docs", "counts", "gaps"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                parts.append(_decode(row, width))
                size += len(row["docs"]) + len(row["gaps"])
                if size > DEALT_BYTES:
                    yield rows(parts)
                    parts, size = [], 0
        if parts:
            yield rows(parts)

    return run


def gather(names: list[str]) -> Callable[[pa.Table], pa.Table]:
    """For all packed replies of one bucket of documents: one row per document with its places."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_decode(row, len(names)) for row in table.to_pylist()]
        sizes = np.append(0, np.cumsum([len(k) for k, _, _ in parts]))
        key = np.concatenate([k for k, _, _ in parts])
        key, same = np.unique(key, axis=0, return_inverse=True)
        doc = same.reshape(-1)[np.concatenate([d + s for (_, d, _), s in zip(parts, sizes, strict=False)])]
        pos = np.concatenate([p for _, _, p in parts])
        order = np.lexsort((pos, doc))
        ends = np.cumsum(np.bincount(doc, minlength=len(key)))
        spans = np.append(0, ends).astype(np.int32) * 4
        data = pos[order].astype(np.uint32).tobytes()
        found = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(spans.tobytes()), pa.py_buffer(data)])
        return pa.table({**{c: pa.array(key[:, i].copy()) for i, c in enumerate(names)}, "_hits": found})

    return run


def chunks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, for as many bytes at a time as ``CHUNK`` says; a word is never cut."""
    at = 0
    while len(text) - at > CHUNK:
        blank = BLANK.search(text, at + CHUNK)
        if blank is None:
            break
        yield text[at : blank.start()].split()
        at = blank.start()
    yield (text[at:] if at else text).split()


@dataclass(frozen=True)
class Slab:
    """Pieces of documents. Piece i has the words ``first[i]`` to ``first[i + 1]`` of ``words`` (as hashes),
    which start at word ``offsets[i]`` of the document of ``keys[i]``; ``last[i]`` says that the document ends
    there. Each window lies in one piece whole."""

    keys: np.ndarray
    words: np.ndarray
    first: np.ndarray
    offsets: np.ndarray
    last: np.ndarray
    extra: list


def _slabs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[Slab]:
    """Slabs of about ``SLAB`` words; a longer document is cut into pieces that share ``length - 1`` words."""
    hashes = WordHashes()
    pieces: list[tuple] = []
    n = 0

    def slab() -> Slab:
        keys, words, offsets, last, extra = zip(*pieces, strict=True)
        first = np.append(0, np.cumsum([len(w) for w in words]))
        return Slab(np.array(keys, np.int64).reshape(-1, 2), np.concatenate(words), first, np.array(offsets, np.int64), np.array(last, bool), list(extra))

    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        more = columns.get("_hits")
        for i, text in enumerate(columns["_text"]):
            key, extra = (columns["_k1"][i].as_py(), columns["_k2"][i].as_py()), more[i].as_py() if more is not None else None
            held, offset = np.empty((0, 2), np.uint64), 0
            parts = chunks(text.as_py() or b"")
            part = next(parts)
            while part is not None:
                held, part = np.concatenate([held, hashes.of(part)]), next(parts, None)
                while len(held) >= SLAB + length:
                    pieces.append((key, held[: SLAB + length - 1], offset, False, extra))
                    held, offset, n = held[SLAB:], offset + SLAB, n + SLAB
                    yield slab()
                    pieces, n = [], 0
            if len(held) < length:
                continue
            pieces.append((key, held, offset, True, extra))
            n += len(held)
            if n >= SLAB:
                yield slab()
                pieces, n = [], 0
    if n:
        yield slab()


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), *((c, pa.binary()) for c in ("docs", "counts", "gaps", "tags", "flags"))])
    return pa.RecordBatch.from_pylist(rows, kinds)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for counts[i] values, for each i in turn."""
    return np.repeat(starts - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(int(counts.sum()))


def _probe(block: int, window: int, buckets: int, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in _slabs(batches, window):
            # A block that starts in the last words of a piece stands in the next one too, and counts there.
            counts = np.diff(slab.first) - np.where(slab.last, block, window) + 1
            doc = np.repeat(np.arange(len(slab.keys)), counts)
            at = _ranges(slab.first[:-1], counts)
            pos = at - slab.first[doc] + slab.offsets[doc]
            # One half of the key is enough here: a collision only adds windows that are then compared.
            rows = pack(slab.keys[:, :1], doc, pos, [rolling(slab.words, at, block)], pos % block == 0, buckets, widths, coarse_of(buckets))
            yield _batch(list(rows))

    return run


def _extend(block: int, window: int, buckets: int, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in _slabs(batches, window):
            near, first = np.zeros(len(slab.words) + 1, np.int64), slab.first
            for d, found in enumerate(slab.extra):
                p, last, offset = np.frombuffer(found, np.uint32), first[d + 1] - first[d] - window, slab.offsets[d]
                p = p[np.searchsorted(p, offset) : len(p) if slab.last[d] else np.searchsorted(p, offset + last + window - block, side="right")].astype(np.int64) - offset
                low, high = np.maximum(p - (window - block), 0), np.minimum(p, last)
                low = np.minimum(low, last) if slab.last[d] else low
                here = low <= high
                np.add.at(near, first[d] + low[here], 1)
                np.add.at(near, first[d] + high[here] + 1, -1)
            at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            doc = np.searchsorted(first, at, side="right") - 1
            lanes = [rolling(slab.words, at, window, lane) for lane in (0, 1)]
            rows = pack(slab.keys, doc, at - first[doc] + slab.offsets[doc], lanes, np.ones(len(at), bool), buckets, widths, coarse_of(buckets))
            yield _batch(list(rows))

    return run


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with one partition for each bucket, so that tasks are even; hashed where these are too many."""
    return rows.repartitionById(buckets, F.col("bucket")) if buckets <= MOST_PARTITIONS else rows


def _tasks(buckets: int) -> int:
    """Partitions between two packings."""
    return min(MOST_PARTITIONS, max(LEAST_BUCKETS, buckets // REPACKED))


def _exchange(packed: DataFrame, buckets: int, widths: list[int], names: list[str], name: str) -> DataFrame:
    """``names, _hits``: for each document the places found, written out.

    Places are written as each bucket of windows finds them and then dealt to buckets of documents,
    whose number follows from the bytes of the places there are.
    """
    if coarse := coarse_of(buckets):
        # Rows of a coarse bucket may be in any of several tasks; each packs what it gets.
        tasks = _tasks(buckets)
        salt = F.pmod(F.xxhash64("docs", "gaps"), F.lit(max(1, tasks // coarse)))
        packed = packed.repartition(tasks, "bucket", salt).mapInArrow(repack(widths, len(names), buckets, coarse), PACKED)
    found = written(_dealt(packed, buckets).groupBy("bucket").applyInArrow(match(widths, len(names)), PLACES), f"{name}-places")
    size = found.agg(F.sum(F.octet_length("docs") + F.octet_length("gaps"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(size / PLACES_BYTES))
    dealt, coarse = found, coarse_of(buckets)
    if coarse:
        dealt = dealt.mapInArrow(deal(len(names), buckets, coarse), f"bucket int, {PLACES}").repartition(_tasks(buckets), "bucket")
    dealt = dealt.mapInArrow(deal(len(names), buckets), f"bucket int, {PLACES}")
    schema = ", ".join(f"{c} long" for c in names) + ", _hits binary"
    whole = written(_dealt(dealt, buckets).groupBy("bucket").applyInArrow(gather(names), schema), name)
    discard(found)
    return whole


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """``_k1, _k2, _hits``: where windows of ``window`` words start that also start anywhere else.

    Blocks of b = (window + 1) // 2 words that start at multiples of b in each document are the
    anchors. Every window of 2b - 1 or fewer words that occurs twice holds, at one of its places,
    an anchor that a rolling block of the other place meets. So rolling blocks of all documents are
    probed against the anchors (packed by hash bucket; documents and positions come back), and each
    hit is extended to all windows around it, which are compared by 128-bit hash with those around
    all other hits (two hashes of each word, each rolled over the window by itself). Neighbouring
    repeated windows together are the maximal exact repeats. Work is linear in words: occurrences
    are counted, never paired. Memory is bounded by ``SLAB`` words, also within one long document.
    """
    spark = docs.sparkSession
    block = (window + 1) // 2
    text = F.col(text_col).cast("binary")
    keyed = docs.select(*row_key(F.col(id_col), F.col(text_col)), text.alias("_text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES))
    probes = keyed.mapInArrow(_probe(block, window, buckets, [TAG]), PACKED)
    hits = _exchange(probes, buckets, [TAG], ["_k1"], "anchor-hits")
    around = keyed.join(hits, "_k1").mapInArrow(_extend(block, window, buckets, [8, 8]), PACKED)
    repeats = _exchange(around, buckets, [8, 8], ["_k1", "_k2"], "repeats")
    discard(hits)
    return repeats


def covered(starts: np.ndarray, window: int, begin: int, n: int) -> np.ndarray:
    """Which of the ``n`` words from ``begin`` on lie in a window that starts at one of ``starts``, which are in order."""
    near = starts[np.searchsorted(starts, begin - window, side="right") : np.searchsorted(starts, begin + n)] - begin
    edges = np.bincount(np.maximum(near, 0), minlength=n + 1)[: n + 1] - np.bincount(np.minimum(near + window, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edges[:n]) > 0


@passes_columns
def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """``docs`` with every word removed from ``text_col`` that a repeated window covers.

    A window is ``window`` consecutive words (runs of non-blank ASCII, unchanged) of one document;
    it is repeated if its words also start anywhere else, in the same document or another, judged
    on the input. Kept words are joined by one space. Adds ``n_words`` and ``n_removed``, replacing
    columns of these names.

    Defined cases: null, empty and blank texts become ``''`` with no words; documents shorter than
    a window keep all words; of rows that repeat, each counts as another place; an empty table gives
    an empty result. Other columns are passed through.
    """
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    repeats = repeated_windows(docs, id_col=id_col, text_col=text_col, window=window)
    joined = docs.select(*columns, *row_key(F.col(id_col), F.col(text_col))).join(repeats, ["_k1", "_k2"], "left")
    rows = joined.select(*[F.col(c).cast("binary") if c == text_col else F.col(c) for c in columns], "_hits")
    schema = rows.drop("_hits").schema.add("n_words", "long").add("n_removed", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, removed = [], [], []
            at = batch.schema.names.index(text_col)
            for text, hits in zip(batch.column(at), batch.column(len(columns)), strict=True):
                starts = np.frombuffer(hits.as_py() or b"", np.uint32).astype(np.int64)
                n, kept = 0, []
                for words in chunks(text.as_py() or b""):
                    gone = covered(starts, window, n, len(words))
                    n += len(words)
                    kept.append((b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words), len(words) - int(gone.sum())))
                totals.append(n)
                removed.append(n - sum(k for _, k in kept))
                texts.append(b" ".join([t for t, k in kept if k]))
            out = list(batch.columns)[: len(columns)]
            out[at] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([*out, pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], [*columns, "n_words", "n_removed"])

    return rows.mapInArrow(run, schema).withColumn(text_col, F.col(text_col).cast("string"))
