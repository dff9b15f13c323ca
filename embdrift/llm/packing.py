"""Best-fit packing after Martello-Toth dominance reduction.

Pieces of the same length are interchangeable, so the instance is the histogram of lengths: at most
``capacity`` numbers, whatever the corpus. On it the dominance criterion fixes small sets of up to
three pieces that no other set with the same longest piece can beat, many copies at once, until
none applies; the rest is packed best-fit in descending order of length. The plan is a list of
intervals (the k-th to l-th piece of a length go to these sequences at this offset), bounded by the
number of (length, free space) pairs. Spark ranks the pieces of each length and looks their places
up.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embdrift.llm.common import stored
from embdrift.llm.sharding import hash_bucket
from embdrift.llm.tokens import closed, encode_flat, text_runs


@dataclass(frozen=True)
class Run:
    """``count`` sequences in a row, from number ``first``, filled with the lengths ``pieces``."""

    first: int
    count: int
    pieces: tuple[int, ...]


class _Lengths:
    """Lengths that still have pieces, ascending, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.n = Counter({length: c for length, c in counts.items() if c > 0})
        self.order = sorted(self.n)

    def take(self, length: int, count: int) -> None:
        self.n[length] -= count
        if not self.n[length]:
            del self.n[length]
            self.order.pop(bisect.bisect_left(self.order, length))

    def at_most(self, space: int) -> int | None:
        k = bisect.bisect_right(self.order, space)
        return self.order[k - 1] if k else None

    def smallest(self, without: int, k: int, above: int = 0) -> list[int]:
        """The k smallest pieces longer than ``above`` besides one of length ``without`` (fewer if there are none)."""
        out: list[int] = []
        for length in self.order[bisect.bisect_right(self.order, above):]:
            have = self.n[length] - (length == without)
            out += [length] * min(have, k - len(out))
            if len(out) == k:
                break
        return out


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """((pieces of one sequence), how often) fixed by dominance, and the counts that are left.

    Lengths w are taken in descending order. With s = capacity - w, one set containing w is fixed
    if it dominates all others that contain w:
    - alone, if nothing fits beside it;
    - {w, p}, p the longest piece that fits, if p = s (any other filling splits off p's space), or
      if no two other pieces fit beside w together, or if p is at least as long as the longest
      sum of two that fit while no three fit;
    - {w, a, b} if no three fit beside w, a + b = s, a is the longest that fits, and no two pieces
      longer than b fit beside w together: of any other pair one is at most b, the other at most a.
    A length that the criterion cannot decide stays in the instance, for later sets and best-fit.
    """
    left, fixed = _Lengths(counts), []
    for w in sorted(left.n, reverse=True):
        while (have := left.n.get(w, 0)) and (found := _dominating(left, w, have, capacity - w)):
            need = Counter(found)
            count = min(left.n[x] // k for x, k in need.items())
            fixed.append((found, count))
            for x, k in need.items():
                left.take(x, k * count)
    return fixed, dict(left.n)


def _dominating(left: _Lengths, w: int, have: int, space: int) -> tuple[int, ...] | None:
    """The set with ``w`` that dominates all others with ``w`` among the pieces left, if there is one."""
    low = left.smallest(w, 3)
    if not low or low[0] > space:
        return (w,)
    p = left.at_most(space)
    if p == w and have == 1:  # the only such piece is w itself
        p = left.order[bisect.bisect_left(left.order, w) - 1]
    if p == space or len(low) < 2 or low[0] + low[1] > space:
        return (w, p)
    if len(low) == 3 and sum(low) <= space:
        return None  # sets of four and more are not examined
    # Only singles and pairs fit beside w: the longest pair sum, and whether p alone matches it.
    best, ends = 0, None
    for a in left.order:
        b = left.at_most(space - a) if a <= space else None
        if b is None or b < a:
            break
        if a + b > best:
            enough = all(left.n[x] >= k for x, k in Counter((w, a, b)).items())
            best, ends = a + b, (b, a) if enough else None
    if p >= best:
        return (w, p)
    if not ends or best != space or p not in ends:
        return None
    between = left.smallest(w, 2, min(ends))
    return None if len(between) == 2 and sum(between) <= space else (w, *ends)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal open sequences are filled together."""
    open_by: dict[int, list[list]] = defaultdict(list)  # free space -> [pieces, how many]
    spaces: list[int] = []

    def put(space: int, pieces: tuple[int, ...], n: int) -> None:
        if not open_by[space]:
            bisect.insort(spaces, space)
        open_by[space].append([pieces, n])

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            k = bisect.bisect_left(spaces, length)
            if k == len(spaces):
                # No open sequence has room: new ones, each with as many pieces as fit.
                per = capacity // length
                full, rest = divmod(todo, per)
                if full:
                    put(capacity - per * length, (length,) * per, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                todo = 0
                continue
            space = spaces[k]
            pieces, n = open_by[space][-1]
            per = min(space // length, todo)
            filled = min(n, todo // per)
            if filled == n:
                open_by[space].pop()
                if not open_by[space]:
                    spaces.pop(k)
            else:
                open_by[space][-1][1] -= filled
            put(space - per * length, pieces + (length,) * per, filled)
            todo -= per * filled
    return [(tuple(p), n) for runs in open_by.values() for p, n in runs if n]


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Sequences for all pieces of the histogram: dominance first, then best fit of what is left."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    fixed, rest = reduce_dominated(counts, capacity)
    out, first = [], 0
    for pieces, n in fixed + best_fit(rest, capacity):
        out.append(Run(first, n, pieces))
        first += n
    return out


def intervals(runs: list[Run]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, sequence number of that rank, offset): a rank r of the length
    lies in the last row whose first rank is at most r, in sequence ``number + r - first rank``."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    for run in runs:
        offset = 0
        for length in run.pieces:
            out[length].append((used[length], run.first, offset))
            used[length] += run.count
            offset += length
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def cut_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every row of ``docs`` (doc_id, text).

    A document is its ids and ``end_id`` (null or empty text: the end alone); only longer ones are
    cut, into pieces of ``capacity`` ids, the last one shorter.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for lo, hi in text_runs(texts):
                flat, edges = closed(*encode_flat(vocabulary_path, texts.slice(lo, hi - lo)), end_id)
                size = np.diff(edges)
                n = -(-size // capacity)  # pieces of each document
                doc = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                raw, at = memoryview(flat.astype("<u4")).cast("B"), 4 * (edges[doc] + start)
                sums = [zlib.crc32(raw[x:x + y]) for x, y in zip(at.tolist(), (4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int32()), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(pieces, "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint")


def pack(pieces: DataFrame, capacity: int = 2048, buckets: int = 64) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    The pieces are ranked inside their length in two steps, totals per (length, bucket) and a
    window inside each, so no length gathers in one task. The histogram (at most ``capacity``
    rows) goes through the driver, the plan (bounded by capacity squared, in practice some
    thousand rows) goes to the tasks. Repeated rows are pieces of their own.
    """
    # The input partition lets copies of one row spread; being written, the buckets stay as they are.
    spread = hash_bucket(buckets, F.col("doc_id"), F.col("ids_crc32"), F.col("piece"), F.spark_partition_id())
    pieces = stored(pieces.withColumn("bucket", spread), "pieces")
    parts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = intervals(plan(counts, capacity))
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    run = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "bucket", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("rank0"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("k", F.row_number().over(inside)).join(parts, ["length", "bucket"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank0") + F.col("k") - 1).alias("rank"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "rank"))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, bounds) if len(order) else []:
                rows = known[int(length[at[0]])]
                k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                seq[at] = rows[k, 1] + rank[at] - rows[k, 0]
                off[at] = rows[k, 2]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "piece", "start")] + [
                pa.array(length.astype(np.int64)), b.column("ids_crc32"), pa.array(seq), pa.array(off)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(places, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
                                     "sequence_id bigint, offset bigint")
