"""Approximate neighbours by product quantisation.

Coarse cells and, for the residuals to the cell centres, one small codebook per slice of the
dimensions are fitted on a bounded sample; every row is assigned and kept as a cell number and one byte
per slice.  A query meets the codes of the cells nearest to it: products of its slices with the codebooks'
entries give approximate similarities, the best of which are ranked again by exact cosine.  Both steps are
block scans (``similarity.over_blocks``): neither queries nor vectors are copied per cell or candidate.
How many cells and candidates that takes is found on an audit set against exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embdrift.functions.vectors import l2_normalize
from embdrift.operators.similarity import (
    DEFAULT_BLOCK_ROWS, TIE_DECIMALS, Best, ScanSpec, _same_ids, _unit, knn, merge_topk, offer_tile, over_blocks, scan)
from embdrift.operators.training import seeded_sample
from embdrift.session import materialize, ship_package

_TILE = 512  # queries of a block that are searched together


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means centres (at most as many as rows); an empty cell takes the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, far = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and its squared distance, in blocks."""
    out, far = np.empty(len(x), np.int64), np.empty(len(x))
    half = (centres * centres).sum(axis=1) / 2
    for lo in range(0, len(x), 8192):
        s = x[lo:lo + 8192] @ centres.T - half
        out[lo:lo + 8192] = s.argmax(axis=1)
        far[lo:lo + 8192] = (x[lo:lo + 8192] ** 2).sum(axis=1) - 2 * s.max(axis=1)
    return out, far


@dataclass(frozen=True)
class Codebook:
    centres: np.ndarray            # cell x dimension
    slices: tuple[np.ndarray, ...]  # per slice of the dimensions: entry x its dimensions

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, one byte per slice) of unit vectors."""
        cell = nearest(x, self.centres)[0]
        rest, at, codes = x - self.centres[cell], 0, []
        for book in self.slices:
            codes.append(nearest(rest[:, at:at + book.shape[1]], book)[0])
            at += book.shape[1]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def similarity(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate products of queries with the coded rows of one cell: the sum of the tables' entries,
        taken as one product with the rows that the codes stand for."""
        rows = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.slices)], axis=1) + self.centres[cell]
        return q.astype(np.float32) @ rows.astype(np.float32).T


def fit_codebook(docs: DataFrame, cells: int, width: int = 4, entries: int = 256, sample: int = 20_000, seed: int = 7) -> Codebook | None:
    """Fitted on the ``sample`` rows of ``docs`` (did, dvec: unit vectors) that come first by hash: at
    most ``sample`` vectors reach the driver, whatever the table.  None for an empty table."""
    rows = docs.orderBy(F.xxhash64("did", F.lit(seed)), "did").limit(sample).select("dvec").collect()
    if not rows:
        return None
    x = np.array([r.dvec for r in rows], np.float64)
    centres = lloyd(x, cells, seed=seed)
    rest = x - centres[nearest(x, centres)[0]]
    books = [lloyd(rest[:, at:at + width], min(entries, 256), seed=seed) for at in range(0, x.shape[1], width)]
    return Codebook(centres, tuple(books))


def coded(docs: DataFrame, book: Codebook) -> DataFrame:
    """(did, cell, code) of every row: one pass, one byte per slice."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, code = book.encode(np.vstack(pdf["dvec"].to_list()))
                yield pd.DataFrame({"did": pdf["did"], "cell": cell, "code": [c.tobytes() for c in code]})

    return docs.select("did", "dvec").mapInPandas(run, "did long, cell long, code binary")


class _Candidates:
    """The ``n`` nearest codes of each query of a block, among its ``probed`` nearest cells."""

    def __init__(self, book: Codebook, probed: int, n: int, q: dict):
        self.book, self.qid, self.Q = book, np.asarray(q["qid"], np.int64), q["qvec"]
        near = np.round(_unit(self.Q) @ _unit(book.centres).T, TIE_DECIMALS)
        order = np.argsort(-near, axis=1, kind="stable")[:, :probed]
        self.asks = np.zeros(near.shape, bool)
        np.put_along_axis(self.asks, order, True, axis=1)
        self.best = [Best(min(_TILE, len(self.qid) - lo), n) for lo in range(0, len(self.qid), _TILE)]

    def add(self, d: dict) -> None:
        did, cells = np.asarray(d["did"], np.int64), np.asarray(d["cell"], np.int64)
        code = np.frombuffer(b"".join(d["code"]), np.uint8).reshape(len(did), -1)
        order = np.argsort(cells, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
            cell, tag = int(cells[some[0]]), np.zeros(len(some), np.int64)
            for nth, best in enumerate(self.best):
                rows = np.flatnonzero(self.asks[nth * _TILE:(nth + 1) * _TILE, cell])
                for at in range(0, len(some) if len(rows) else 0, 4 * _TILE):
                    part = some[at:at + 4 * _TILE]
                    s = self.book.similarity(self.Q[rows + nth * _TILE], cell, code[part])
                    offer_tile(best, rows, s.astype(np.float64), did[part], tag[at:at + 4 * _TILE], None)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for nth, best in enumerate(self.best):
            row, s, did, _ = best.settle()
            ends = np.searchsorted(row, np.arange(len(best.kth) + 1)).astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(-s), pa.array(did)], ["far", "did"])
            qid = self.qid[nth * _TILE:nth * _TILE + len(best.kth)]
            yield pa.record_batch([pa.array(qid), pa.ListArray.from_arrays(pa.array(ends), found)], ["qid", "found"])


def candidates(queries: DataFrame, codes: DataFrame, book: Codebook, probed: int, n: int, block_rows: int,
               sizes: tuple[int, int]) -> DataFrame:
    """(qid, dids): the ``n`` rows of the greatest approximate similarity among the ``probed`` cells nearest to
    the query, best first.  Blocks of queries meet blocks of codes, a byte per slice of a row."""
    most = max(1, min(block_rows, (1 << 21) // n))
    found = over_blocks(queries.select("qid", "qvec"), codes, lambda q: _Candidates(book, probed, n, q),
                        "qid long, found array<struct<far double, did long>>", sizes, 8 * book.centres.shape[1], most,
                        doc_width=32 + len(book.slices))
    # A query has one list per partition of codes.
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, n)
    return found.groupBy("qid").agg(best.alias("found")).select("qid", F.col("found.did").alias("dids"))


class _Exact:
    """The ``k`` best by exact cosine of the rows that each query of a block names."""

    def __init__(self, k: int, q: dict):
        self.qid, self.Q, self.best = np.asarray(q["qid"], np.int64), q["qvec"], Best(len(q["qid"]), k)
        row = np.repeat(np.arange(len(self.qid)), [len(x) for x in q["dids"]])
        did = np.fromiter((y for x in q["dids"] for y in x), np.int64, len(row))
        order = np.argsort(did, kind="stable")
        self.row, self.did = row[order], did[order]

    def add(self, d: dict) -> None:
        did = np.asarray(d["did"], np.int64)
        for at, one in zip(*_same_ids_sorted(self.did, did)):
            s = np.einsum("pd,pd->p", self.Q[self.row[at]], d["dvec"][one])
            self.best.offer(self.row[at], np.round(s, TIE_DECIMALS), did[one], np.zeros(len(at), np.int64))

    def rows(self) -> Iterator[pd.DataFrame]:
        row, s, did, _ = self.best.settle()
        yield pd.DataFrame({"qid": self.qid[row], "did": did, "similarity": s})


def _same_ids_sorted(named: np.ndarray, did: np.ndarray) -> tuple[list, list]:
    """Equal pairs (place in ``named``, place in ``did``) in steps of bounded length."""
    left, right = [], []
    for lo in range(0, len(named), 1 << 16):
        r, c = _same_ids(named[lo:lo + (1 << 16)], did)
        if len(r):
            left.append(r + lo)
            right.append(c)
    return left, right


def reranked(found: DataFrame, queries: DataFrame, docs: DataFrame, k: int, block_rows: int, sizes: tuple[int, int], width: int) -> DataFrame:
    """(qid, rank, did, similarity) of the candidates by exact cosine: the blocks of queries, with the ids each
    query names, meet the blocks of vectors, so no vector is copied per candidate."""
    asks = queries.select("qid", "qvec").join(found, "qid")
    exact = over_blocks(asks, docs.select("did", "dvec"), lambda q: _Exact(k, q), "qid long, did long, similarity double",
                        sizes, width, min(block_rows, 4096))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "did"))
    return exact.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "rank", "did", "similarity")


def pq_search(queries: DataFrame, docs: DataFrame, k: int = 10, cells: int | None = None, recall: float = 0.9,
              audit: int = 256, width: int = 4, sample: int = 20_000, seed: int = 7, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(qid, rank, did, similarity), the approximate top ``k`` of every query.

    ``queries``: qid, qvec; ``docs``: did, dvec, all of one length.  The number of cells to probe and of
    candidates to rank again are the least pair for which the audit set finds a share ``recall`` of its exact
    neighbours (less two standard errors where the set is a sample of the queries); where even all
    cells do not, the search is ``knn``.
    """
    docs = materialize(docs.select("did", l2_normalize("dvec").alias("dvec")))
    queries = materialize(queries.select("qid", l2_normalize("qvec").alias("qvec")))
    n = docs.count()
    book = fit_codebook(docs, cells or max(1, min(1024, int(math.sqrt(n)) // 2)), width, sample=sample, seed=seed)
    if book is None:
        return knn(queries, docs, k, block_rows=block_rows).select("qid", "rank", "did", "similarity")
    codes = materialize(coded(docs, book))
    spark = docs.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(book.centres)], "did long, dvec array<double>")
    audited = materialize(seeded_sample(queries, audit + 1, seed, "qid").select("qid", "qvec"))
    setting = _settings(audited, docs, codes, centres, book, k, recall, audit, block_rows)
    if setting is None:
        return knn(queries, docs, k, block_rows=block_rows).select("qid", "rank", "did", "similarity")
    probed, some = setting
    sizes = queries.count(), n
    found = candidates(queries, codes, book, probed, some, block_rows, sizes)
    return reranked(found, queries, docs, k, block_rows, sizes, 8 * book.centres.shape[1])


def _probes(queries: DataFrame, centres: DataFrame, n: int, block_rows: int) -> DataFrame:
    near = merge_topk(scan(queries, centres, ScanSpec(k=n), block_rows), n).select("qid", F.col("did").alias("cell"), F.col("rank").alias("nth"))
    return queries.join(near, "qid")


def _settings(audited: DataFrame, docs: DataFrame, codes: DataFrame, centres: DataFrame, book: Codebook, k: int,
              recall: float, audit: int, block_rows: int) -> tuple[int, int] | None:
    """(cells, candidates) from one search of the audit queries through all cells: an exact neighbour
    is found with c cells and r candidates if its cell is among the query's c nearest and its place among all
    candidates is at most r (fewer cells only bring it forward)."""
    every = len(book.centres)
    probes = materialize(_probes(audited, centres, every, block_rows))
    most = 32 * k
    place = (candidates(audited, codes, book, every, most, block_rows, (audited.count(), codes.count()))
             .select("qid", F.posexplode("dids").alias("place", "did")).withColumn("place", F.col("place") + 1))
    true = knn(audited, docs, k, block_rows=block_rows).select("qid", "did").join(codes.select("did", "cell"), "did")
    rows = (true.join(probes.select("qid", "cell", "nth"), ["qid", "cell"]).join(place, ["qid", "did"], "left")
            .groupBy("qid").agg(F.collect_list(F.struct("nth", F.coalesce("place", F.lit(most + 1)).alias("place"))).alias("found")).collect())
    if not rows:
        return 1, k
    per_query = [(np.array([f.nth for f in r.found]), np.array([f.place for f in r.found])) for r in rows]
    best = None
    for some in (2 * k, 4 * k, 8 * k, 16 * k, most):
        for probed in range(1, every + 1):
            share = np.array([np.mean((nth <= probed) & (place <= some)) for nth, place in per_query])
            error = share.std(ddof=1) / math.sqrt(len(share)) if len(share) > audit else 0.0
            if share.mean() - 2 * error >= recall:
                cost = probed / every * len(book.slices) + some / k  # codes read a query against vectors fetched
                if best is None or cost < best[0]:
                    best = (cost, probed, some)
                break
    return best and (best[1], best[2])
