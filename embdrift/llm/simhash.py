"""SimHash near-duplicates found around the anchors of a covering code.

The anchors are a product code over the 64 fingerprint bits: perfect binary Golay codes (23 bits,
4096 words, every word within distance 3 of exactly one) on one or two blocks; the bits beside
the blocks have the single word zero. A fingerprint is copied to every anchor that a fingerprint
within half the distance limit has as its nearest one. Two fingerprints x, y that differ in at
most t bits have a fingerprint z between them with d(x, z), d(y, z) <= ceil(t / 2); both are
copied to z's anchor and are compared there, so no link is lost. (The copies lie within covering
radius plus threshold of their anchor; the midpoint makes them a few dozen instead of over a
thousand.)

At an anchor all its fingerprints are compared, in blocks, and one link per fingerprint to its
group is passed on, never all pairs. Equal fingerprints are one node before any copying.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embdrift.llm.common import LOWER_BYTES, packed, stored, unpacked
from embdrift.llm.components import components

#: Generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
_GOLAY = 0b110001110101
_SEED = 42


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(data -> code word, syndrome -> lowest-weight error) of the 23-bit code."""
    def remainder(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where(x >> bit & 1, _GOLAY << (bit - 11), 0)
        return x

    data = np.arange(1 << 12, dtype=np.int64) << 11
    errors = np.zeros(1 << 11, np.int64)
    ones = 1 << np.arange(23, dtype=np.int64)
    patterns = [np.zeros(1, np.int64), ones,
                np.array([a | b for i, a in enumerate(ones) for b in ones[:i]]),
                np.array([a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]])]
    for p in patterns:
        errors[remainder(p)] = p
    return data | remainder(data), errors


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, _GOLAY << (bit - 11), 0)
    return x


@cache
def _flips(bits: int, weight: int) -> np.ndarray:
    """All ``bits``-bit numbers of the weight."""
    if weight == 0:
        return np.zeros(1, np.int64)
    return np.array(sorted({int(p) | 1 << k for p in _flips(bits, weight - 1) for k in range(bits) if not int(p) >> k & 1}), np.int64)


@cache
def _reach(weight: int) -> list[np.ndarray]:
    """By syndrome: the differences (anchor number xor own nearest anchor number) of all anchors
    that ``weight`` bit flips lead to but fewer do not."""
    _, errors = _golay()
    syndromes = np.arange(1 << 11, dtype=np.int64)
    points = errors[syndromes]  # one representative of every coset, nearest word zero
    out = []
    for s in syndromes:
        near = set()
        for w in range(weight + 1):
            moved = points[s] ^ _flips(23, w)
            word = moved ^ errors[_syndrome(moved)]
            found = set((word >> 11).tolist())
            if w == weight:
                out.append(np.array(sorted(found - near), np.int64))
            near |= found
    return out


def _expand(base: np.ndarray, syndromes: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all rows and all anchors at exactly ``weight`` flips."""
    table = _reach(weight)
    lens = np.array([len(t) for t in table])
    flat = np.concatenate(table)
    first = np.cumsum(lens) - lens
    n = lens[syndromes]
    row = np.repeat(np.arange(len(base)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, base[row] ^ flat[first[syndromes[row]] + within]


def anchors(fps: np.ndarray, distance: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor number) of every copy of the fingerprints (uint64)."""
    half = (distance + 1) // 2
    own, syn = [], []
    _, errors = _golay()
    for b in range(blocks):
        x = ((fps >> np.uint64(23 * b)) & np.uint64((1 << 23) - 1)).astype(np.int64)
        s = _syndrome(x)
        own.append((x ^ errors[s]) >> 11)
        syn.append(s)
    if blocks == 1:
        parts = [_expand(own[0], syn[0], w) for w in range(half + 1)]
    else:
        parts = []
        for w0 in range(half + 1):
            row, a0 = _expand(own[0], syn[0], w0)
            for w1 in range(half + 1 - w0):
                sub, a1 = _expand(own[1][row], syn[1][row], w1)
                parts.append((row[sub], a0[sub] << 12 | a1))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of a whole text: a bit is 1 if set in over half the shingles' hashes.

    A-Z lower-cased, words cut at ASCII white space; fewer words than a shingle make one shingle
    of all; a text without words has fingerprint 0.
    """
    if not text:
        return 0
    ws = text.encode("utf-8", "replace").translate(LOWER_BYTES).split()
    if not ws:
        return 0
    raw = b" ".join(ws)
    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    starts = np.concatenate([[0], at + 1])
    ends = np.concatenate([at, [len(raw)]])
    k = min(shingle, len(ws))
    view, h = memoryview(raw), xxhash.xxh64_intdigest
    hashes = np.array([h(view[a:b], _SEED) for a, b in zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1:].tolist())], dtype=np.uint64)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[lo:lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    ones = np.flatnonzero(counts * 2 > len(hashes))
    return sum(1 << int(b) for b in ones)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``docs`` with fp (its 64 bits as a signed long)."""

    @F.pandas_udf("bigint")
    def fp(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn("fp", fp(F.col("text")))


def group_links(fps: np.ndarray, distance: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) index pairs, a > b, that connect what differs in at most ``distance`` bits: one link per
    fingerprint to the smallest index of its connected part, computed in blocks of pairs."""
    n = len(fps)
    label = np.arange(n)

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for lo in range(0, n, block):
        for ro in range(0, lo + 1, block):
            near = np.bitwise_count(fps[lo:lo + block, None] ^ fps[None, ro:ro + block]) <= distance
            a, b = np.nonzero(near)
            a, b = a + lo, b + ro
            keep = a > b
            a, b = a[keep], b[keep]
            # Rows that already share a label say nothing new.
            keep = label[a] != label[b]
            for x, y in zip(a[keep].tolist(), b[keep].tolist()):
                x, y = root(x), root(y)
                if x != y:
                    label[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(n)], np.int64)
    a = np.flatnonzero(roots != np.arange(n))
    return a, roots[a]


def links(fps: DataFrame, distance: int = 4, blocks: int = 2) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints (column fp) within ``distance`` bits.

    ``blocks``: 1 (4096 anchors, for up to some 100,000 fingerprints) or 2 (16.8 million).
    """
    if blocks not in (1, 2):
        raise ValueError("blocks is 1 or 2")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.asarray(b.column("fp")).astype(np.int64)
            for lo in range(0, len(f), 4096):
                part = f[lo:lo + 4096]
                row, anchor = anchors(part.view(np.uint64), distance, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(part[row])], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; the last anchor of a batch waits for the next one."""
        kept_a, kept_f = np.empty(0, np.int32), np.empty(0, np.int64)

        def groups(a: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            cut = np.flatnonzero(np.diff(a)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]])
            u = f.view(np.uint64)
            size = ends - starts
            small = size <= 64
            # Short groups together: each fingerprint against its k-th successor.
            last = np.repeat(ends, size)
            place = np.flatnonzero(np.repeat(small, size))
            k = 1
            while len(place):
                place = place[place + k < last[place]]
                hit = place[np.bitwise_count(u[place] ^ u[place + k]) <= distance]
                found.append((f[hit + k], f[hit]))
                k += 1
            for s, e in zip(starts[~small].tolist(), ends[~small].tolist()):
                x, y = group_links(u[s:e], distance)
                found.append((f[s + x], f[s + y]))
            x = np.concatenate([p[0] for p in found]) if found else np.empty(0, np.int64)
            y = np.concatenate([p[1] for p in found]) if found else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            a = np.concatenate([kept_a, np.asarray(b.column("anchor"))])
            f = np.concatenate([kept_f, np.asarray(b.column("fp"))])
            done = int(np.searchsorted(a, a[-1]))
            kept_a, kept_f = a[done:], f[done:]
            if done:
                yield groups(a[:done], f[:done])
        if len(kept_a):
            yield groups(kept_a, kept_f)

    copies = fps.select("fp").distinct().mapInArrow(spread, "anchor int, fp bigint")
    n = fps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = copies.repartition(int(n), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, blocks: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text).

    component_id: the smallest doc_id reachable through links, one's own included; null ids are
    smaller than none (a component of null ids only has null). Null, empty and blank texts have
    fingerprint 0 and are linked like any other; repeated rows stay repeated.
    """
    rows = stored(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "fingerprints")
    return rows.join(groups(rows, distance, blocks), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def groups(rows: DataFrame, distance: int = 4, blocks: int = 2) -> DataFrame:
    """fp, component (a fingerprint that names the group), component_id for all fingerprints of
    ``rows`` (doc_id, fp)."""
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes, distance, blocks))
    found = nodes.join(found, nodes.fp == found.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    whole = found.groupBy("component").agg(F.min("least").alias("component_id"))
    return found.select("fp", "component").join(whole, "component")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4, blocks: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id (a null id
    only where the group has no other; of repeated ids any one row). All columns are kept."""
    rows = fingerprints(packed(docs, "doc_id", "text"), shingle).drop("text").withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "fingerprinted")  # the row numbers are fixed by being written
    named = rows.select("doc_id", "fp", "row").join(groups(rows.select("doc_id", "fp"), distance, blocks), "fp")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x")).select("x.row")
    return unpacked(rows.join(first, "row", "left_semi"), docs)
