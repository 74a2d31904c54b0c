"""Near duplicates by SimHash, searched with a generalised pigeonhole."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.common import broadcast_if_small, discard, join_counted, passes_columns, row_key, written
from hyperloom.llm.components import connected_components

BITS = 64
SEED = 42
#: Words that are handled at once, so that a very long text needs no more memory than others.
SLAB_BYTES = 1 << 20
#: Rows of a bucket up to which all of its pairs are compared, together with those of other buckets.
SMALL = 64
#: Pairs of fingerprints that are compared one by one; a larger set is linked to so many leaders
#: and sorted by groups of its bits first.
DIRECT = 1 << 22
LEADERS = 4
#: Fingerprints of one bucket that one task takes; larger buckets are dealt anew by their other bits.
LARGE = 1 << 18
#: Bytes of components that are broadcast; more are shuffled, the hot ones apart.
NAMED_BYTES = 4 << 20
ALL = (1 << BITS) - 1
BUCKETED = "part long, key long, free long, fp long"


def _slabs(data: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, in lists that repeat the last ``overlap`` words of the one before."""
    if len(data) <= SLAB_BYTES:
        yield data.split()
        return
    at, carry = 0, []
    while at < len(data):
        end = at + SLAB_BYTES
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        words = carry + data[at:end].split()
        yield words
        carry, at = words[-overlap:] if overlap else [], end


def fingerprint(data: bytes, shingle: int = 4) -> int:
    """SimHash of a text: bit i is set if over half of the shingles' XXH64 have it set."""
    ones, total, words = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in _slabs(data.lower(), shingle - 1):
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends[:-1])]
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64)
        total += len(hashes)
        for k in range(0, len(hashes), 65536):
            ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    if not total:
        return digest(b" ".join(words), SEED) if words else 0
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, also: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp``: the SimHash of every whole text as a signed long, and the columns ``also`` between them.

    Words are runs of non-blank ASCII, A-Z lower-cased; fewer words than ``shingle`` make one
    shingle; a null, empty or blank text has fingerprint zero.
    """
    schema = docs.select(F.col(id_col).alias("doc_id"), *also).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or b"", shingle) for t in batch.column(batch.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], ["doc_id", *also, "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), *also, F.col(text_col).cast("binary")).mapInArrow(run, schema)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j both set: 64 x 64 counts over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = _bits(_unsigned(batch.column(0))).astype(np.float32)
            both += x.T @ x
            n += len(x)
        values = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "n"])

    rows = fps.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    values = np.zeros(BITS * BITS + 1)
    for r in rows:
        values[r["at"]] = r["n"]
    return int(values[-1]), values[:-1].reshape(BITS, BITS)


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def plan(n: int, both: np.ndarray, max_distance: int) -> list[tuple[list[int], int]]:
    """Partitions of the bits with a threshold each: whatever differs in ``max_distance`` bits or
    fewer differs, in at least one partition, in no more bits than its threshold.

    That holds if the thresholds sum to ``max_distance - m + 1`` over ``m`` partitions. Correlated
    bits are grouped, so that partitions are as independent as can be; the thresholds are those
    of least estimated cost, found by dynamic programming, for each m; the cheapest m is taken. The
    cost of a partition at a threshold is the rows that it sends and the pairs that it verifies.
    """
    total = max(n, 1)
    p = np.diag(both) / total
    joint = both / total
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((joint - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    # For two rows drawn at random: how likely they differ in a bit, and in both of two bits.
    differ = 2 * p * (1 - p)
    one, other, none = p[:, None] - joint, p[None, :] - joint, 1 - p[:, None] - p[None, :] + joint
    differ_both = 2 * (joint * none + one * other)
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in range(2, max_distance + 2):
        groups = _group(corr, m)
        costs = [_costs(g, n, differ, differ_both, max_distance - m + 1) for g in groups]
        cost, thresholds = _allocate(costs, max_distance - m + 1)
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0])
    return best[1]


def _group(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each grows by the free bit that correlates most with it."""
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, groups)) + m - k - 1) // (m - k)
        left = sorted(free)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        while len(group) < size:
            group.append(max(sorted(free - set(group)), key=lambda b: (corr[b, group].sum(), -b)))
        free -= set(group)
        groups.append(sorted(group))
    return groups


#: A row that is sent weighs as much as so many verified pairs.
ROW_COST = 100.0


def _costs(group: list[int], n: int, differ: np.ndarray, differ_both: np.ndarray, most: int) -> list[float]:
    """Estimated cost at thresholds 0..most. The bits of a random pair differ as a Markov chain along the group."""
    chance = np.zeros((2, most + 2))
    first = group[0]
    chance[0, 0], chance[1, 1] = 1 - differ[first], differ[first]
    for a, b in zip(group, group[1:], strict=False):
        after = np.zeros_like(chance)
        stay = min(1.0, differ_both[a, b] / max(differ[a], 1e-12))
        come = min(1.0, max(0.0, differ[b] - differ_both[a, b]) / max(1 - differ[a], 1e-12))
        after[0] = chance[0] * (1 - come) + chance[1] * (1 - stay)
        hit = chance[0] * come + chance[1] * stay
        after[1, 1:] = hit[:-1]
        chance = after
    within = np.cumsum(chance.sum(axis=0))
    rows = np.cumsum([math.comb(len(group), t) for t in range(most + 1)])
    return [ROW_COST * n * float(rows[t]) + n * n / 2 * float(within[t]) for t in range(most + 1)]


def _allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of -1 (partition not used) or more with the sum ``total`` and the least cost."""
    table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (so_far, chosen) in table.items():
            for t in range(-1, len(cost)):
                there = (so_far + (cost[t] if t >= 0 else 0.0), [*chosen, t])
                if spent + t not in after or there[0] < after[spent + t][0]:
                    after[spent + t] = there
        table = after
    return table[total]


def signatures(fps: DataFrame, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """``part, key, free, fp``: each fingerprint under its own bits of each partition and under all
    values within the partition's threshold; ``free`` are the bits of the other partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _unsigned(batch.column(0))
            for part, (bits, most) in enumerate(partitions):
                mask = sum(1 << b for b in bits)
                # Rows that meet by a changed bit may still differ in the partition's own bits.
                free = np.full(len(fp), ALL if most else ALL & ~mask, np.uint64).view(np.int64)
                for t in range(most + 1):
                    for flipped in combinations(bits, t):
                        key = (fp & np.uint64(mask)) ^ np.uint64(sum(1 << b for b in flipped))
                        columns = [np.full(len(fp), part, np.int64), key.view(np.int64), free, fp.view(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "key", "free", "fp"])

    return fps.select("fp").mapInArrow(run, BUCKETED)


def respread(rows: DataFrame, max_distance: int, large: int) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` (``part, key, free, probe, fp``) with buckets of over ``large`` rows dealt anew.

    What a bucket has in common leaves the bits ``free``; two of its rows within ``max_distance``
    agree in at least one of ``max_distance + 1`` groups of these. So each row goes on under one key
    for each group: a fixed number of copies, whatever the size of the bucket. That is repeated for
    what is still too large, with fewer free bits each time, until ``large`` rows can't differ in
    the bits left. Also returns the written tables that the rows are read from.
    """
    done: list[DataFrame] = []
    made: list[DataFrame] = []
    for level in range(BITS):
        rows = written(rows, f"buckets-{level}")
        sizes = rows.groupBy("part", "key", "free").agg(F.count(F.lit(1)).alias("_n"))
        over = written(sizes.where((F.col("_n") > large) & (F.bit_count("free") > 0)).select("part", "key", "free"), "large-buckets")
        made += [rows, over]
        if over.isEmpty():
            done.append(rows)
            break
        over = broadcast_if_small(over)
        done.append(rows.join(over, ["part", "key", "free"], "left_anti"))
        rows = rows.join(over, ["part", "key", "free"], "left_semi").mapInArrow(_subkeys(max_distance, level), BUCKETED)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out, made


def _subkeys(max_distance: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, key, free, fp = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            for mask in np.unique(free):
                at = np.flatnonzero(free == mask)
                for k, group in enumerate(_split(int(mask) & ALL, max_distance + 1)):
                    under = (key[at].view(np.uint64) ^ (fp[at].view(np.uint64) & np.uint64(group))) * np.uint64(0x9E3779B97F4A7C15)
                    under ^= under >> np.uint64(29)
                    left = np.full(len(at), (int(mask) & ALL) & ~group, np.uint64).view(np.int64)
                    columns = [part[at] * (max_distance + 2) + k + 1, under.view(np.int64), left, fp[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "key", "free", "fp"])

    return run


def _split(mask: int, groups: int) -> list[int]:
    """The bits of ``mask`` dealt to ``groups`` masks of nearly equal size; empty ones are left out."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    return [sum(1 << b for b in bits[k::groups]) for k in range(min(groups, len(bits)))]


class Forest:
    """Components of nodes 0..n-1 that grow by links; the least node stands for its component."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        root = self.parent[at]
        while (up := self.parent[root]).size and (up != root).any():
            root = up
        self.parent[at] = root
        return root

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(self.parent, high, low)


def within_bucket(fp: np.ndarray, max_distance: int) -> np.ndarray:
    """For distinct fingerprints: the least index of each one's component over links of ``max_distance`` bits or fewer.

    A set is first linked to a few leaders, which joins a dense group at once. Then only what is
    outside its largest component needs to be compared with all of it. Where that would be more than
    ``DIRECT`` pairs, the set is sorted by each of ``max_distance + 1`` groups of bits, in one of which
    any two within the distance agree; runs that agree are searched in the same way by the other bits.
    """
    forest = Forest(len(fp))

    def outside(at: np.ndarray) -> np.ndarray:
        roots = forest.roots(at)
        values, counts = np.unique(roots, return_counts=True)
        return at[roots != values[counts.argmax()]]

    def search(at: np.ndarray, free: int) -> None:
        rest = outside(at)
        for k in range(LEADERS):
            if len(rest) * len(at) <= DIRECT:
                break
            leader = rest[_central(fp[rest])] if k == 0 else rest[len(rest) // 2]
            close = at[np.bitwise_count(fp[at] ^ fp[leader]) <= max_distance]
            forest.link(np.full(len(close), leader), close)
            rest = outside(at)
        if len(rest) * len(at) <= DIRECT:
            step = max(1, (1 << 20) // len(at))
            for k in range(0, len(rest), step):
                i, j = np.nonzero(np.bitwise_count(fp[rest[k : k + step]][:, None] ^ fp[at][None, :]) <= max_distance)
                forest.link(rest[k + i], at[j])
            return
        for group in _split(free, max_distance + 1):
            masked = fp[at] & np.uint64(group)
            order = np.argsort(masked, kind="stable")
            starts = np.flatnonzero(np.append(True, masked[order][1:] != masked[order][:-1]))
            for s, e in zip(starts, np.append(starts[1:], len(at)), strict=True):
                if e - s > 1:
                    search(at[order[s:e]], free & ~group)

    if len(fp):
        search(np.arange(len(fp)), int(np.bitwise_or.reduce(fp ^ fp[0])))
    return forest.roots(np.arange(len(fp)))


def _central(fp: np.ndarray) -> int:
    """Which of the fingerprints is nearest to the bits that most of them have."""
    most = np.packbits(2 * _bits(fp).sum(axis=0, dtype=np.int64) > len(fp), bitorder="little").view(np.uint64)
    return int(np.bitwise_count(fp ^ most[0]).argmin())


def in_small_buckets(fp: np.ndarray, ends: np.ndarray, max_distance: int) -> np.ndarray:
    """The same for rows of many small buckets at once, one after the other: row i meets row i + k of its bucket, for each k."""
    forest = Forest(len(fp))
    last = np.repeat(ends, np.diff(ends, prepend=0))
    at, k = np.arange(len(fp)), 0
    while len(at):
        k += 1
        at = at[at + k < last[at]]
        near = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= max_distance]
        forest.link(near, near + k)
    return forest.roots(np.arange(len(fp)))


def verify(max_distance: int):
    """For rows sorted by bucket: links that join what lies within ``max_distance`` in each bucket.

    Of the links of a bucket only a spanning forest leaves the task: fewer links than fingerprints,
    with the same components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def links(fp: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            sizes = np.diff(ends, prepend=0)
            small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
            kept = sizes[(sizes > 1) & (sizes <= SMALL)]
            found = [(fp[small], in_small_buckets(fp[small], np.cumsum(kept), max_distance))]
            for e, n in zip(ends[sizes > SMALL], sizes[sizes > SMALL], strict=True):
                found.append((fp[e - n : e], within_bucket(fp[e - n : e], max_distance)))
            for nodes, label in found:
                linked = nodes != nodes[label]
                if linked.any():
                    columns = (nodes[linked].view(np.int64), nodes[label[linked]].view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "v"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            change = np.zeros(max(len(columns[0]) - 1, 0), bool)
            for c in columns[:3]:
                change |= c[1:] != c[:-1]
            ends = np.flatnonzero(change) + 1
            rest = columns
            if len(ends):
                yield from links(columns[3][: ends[-1]].view(np.uint64), ends)
                rest = [c[ends[-1] :] for c in columns]
        if rest is not None and len(rest[0]):
            yield from links(rest[3].view(np.uint64), np.array([len(rest[3])]))

    return run


def near_links(fps: DataFrame, *, max_distance: int = 4, large: int = LARGE) -> DataFrame:
    """``u, v``: links whose components are those of all pairs of distinct ``fp`` within ``max_distance``."""
    n, both = bit_counts(fps)
    rows, made = respread(signatures(fps, plan(n, both, max_distance)), max_distance, large)
    dealt = rows.repartition("part", "key", "free").sortWithinPartitions("part", "key", "free")
    links = written(dealt.mapInArrow(verify(max_distance), "u long, v long").distinct(), "near-links")
    discard(*made)
    return links


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Fingerprints link at ``max_distance`` differing bits or fewer; ``component_id`` is the smallest
    id reachable over links, the row's own included. Rows of one fingerprint are one node of the
    search, so copies are never expanded into pairs. A bucket is searched in one task and sends a
    spanning forest; one of over ``LARGE`` fingerprints is dealt anew by its other bits first, at a
    fixed number of copies a row, so a large group of near copies stays linear in rows shuffled.

    Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other;
    null ids don't count for ``component_id`` unless a component has no other; repeated rows and
    ties get one row each; an empty table gives an empty result; other columns are ignored.
    """
    found = _components(docs, id_col=id_col, text_col=text_col, shingle=shingle, max_distance=max_distance)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4, also: tuple[str, ...] = ()
) -> DataFrame:
    marked = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, also=also), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_rows")), "fingerprint-nodes")
    parts = connected_components(near_links(nodes, max_distance=max_distance))
    labelled = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "_first", "_rows", F.coalesce("component", "fp").alias("_label"))
    labelled = written(labelled, "labelled")
    lowest = written(labelled.groupBy("_label").agg(F.min("_first").alias("component_id"), F.count(F.lit(1)).alias("_nodes")), "components")
    # Neither a component of many fingerprints nor a fingerprint of many rows, the empty text's for one, meets in one task.
    named = written(join_counted(labelled, lowest, "_label", "_nodes", limit=NAMED_BYTES).select("fp", "component_id", "_rows"), "named")
    discard(nodes, labelled, lowest)
    found = join_counted(marked, named, "fp", "_rows", limit=NAMED_BYTES)
    return found.select("doc_id", *also, "fp", "component_id")


@passes_columns
def keep_one_per_component(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the smallest id stays.

    All columns stay as they are. Of repeated rows with that id all stay; so do components of null
    ids. Rows are found again by id and text, so what holds for a row holds for no other of its id.
    """
    id_col, text_col = str(options.get("id_col", "doc_id")), str(options.get("text_col", "text"))
    keyed = docs.select("*", *row_key(F.col(id_col), F.col(text_col)))
    found = _components(keyed, **options, also=("_k1", "_k2"))
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("_k1", "_k2").distinct()
    return keyed.join(stay, ["_k1", "_k2"], "left_semi").select(*docs.columns)
