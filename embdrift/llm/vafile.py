"""Exact top-k inner products through vector-approximation files.

Every vector is quantised dimension by dimension into a few cells, one byte each; that file is all
the scans read. From a cell's ends follow bounds of the product with a query: with m the middle and
h the half width of a vector's cells, it lies within q.m -+ |q|.h, two matrix products for a whole
block. The first scan keeps the k best lower bounds of each query; the k-th of them over all blocks
is a score the k-th result surely reaches. The second scan names the rows whose upper bound reaches it for some
query of a query block, and only their exact vectors are read: in the order of falling upper bounds, until the
k-th exact score lies above every bound that is left. Blocks return k rows per query; a window ranks
them. Work is queries x rows in blocks of fixed size; nothing holds all pairs.

Equal vectors are one node, as rows and as queries, so copies cost nothing. The k best rows beside a
query's own lie among the k + 1 best rows, these among the k + 1 smallest ids of the k + 1 best nodes
(nodes with equal scores ordered by their smallest id): a better node has a better row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embdrift.llm.common import stored
from embdrift.llm.sharding import hash_bucket

_QUERY_STEP = 256   # queries bounded together: 256 x block_rows doubles are held
_EXACT = 2.0 ** 52  # sums of products below this are exact in doubles
_LONG = 2 ** 63 - 1


class Grid:
    """Cells of one vector length: ``low`` and ``high`` (dimension x cell) are the ends of each cell,
    ``marks`` (dimension x cell - 1) where the next one begins. Cells hold about equal shares of the
    sample; the outer ones reach to the least and largest component of the whole table."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int):
        cells = 1 << bits
        at = np.linspace(0, 1, cells + 1)[1:-1]
        self.marks = np.quantile(sample, at, axis=0, method="lower").T if len(sample) else np.repeat(low[:, None], cells - 1, axis=1)
        self.marks = np.clip(self.marks, low[:, None], high[:, None])
        self.low = np.concatenate([low[:, None], self.marks], axis=1)
        self.high = np.concatenate([self.marks, high[:, None]], axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for d in range(x.shape[1]):
            out[:, d] = np.searchsorted(self.marks[d], x[:, d], side="right")
        return out

    def spans(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middle and half width of the cells of each row."""
        d = np.arange(codes.shape[1])
        low, high = self.low[d, codes], self.high[d, codes]
        return low / 2 + high / 2, high / 2 - low / 2


def bounds(q: np.ndarray, middle: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of queries and rows, rounding included."""
    centre, reach = q @ middle.T, np.abs(q) @ half.T
    reach += 1e-13 * np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(np.abs(middle) + half, axis=1))
    return centre - reach, centre + reach


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of the query rows ``q`` with the vectors ``x`` (either one query and many
    vectors, or as many of both); beyond a long the value is the nearest long."""
    wide = np.abs(q.astype(np.float64)).max(initial=0) * np.abs(x.astype(np.float64)).max(initial=0) * max(1, x.shape[-1])
    if wide < _EXACT:
        return np.einsum("...d,...d->...", q.astype(np.float64), x.astype(np.float64)).astype(np.int64)
    exact = (q.astype(object) * x.astype(object)).sum(axis=-1)
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def nearest(q: np.ndarray, known: np.ndarray, x: np.ndarray, grid: Grid, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best vectors of a block for each query, as (query, vector, score) places; equal scores go
    to the earlier vector.

    Vectors are read in the order of falling upper bounds, a run for all open queries at a time. A
    query is done when its k-th score, or the lower bound ``known`` of its k-th result, lies above the next bound.
    """
    upper = bounds(q.astype(np.float64), *grid.spans(grid.codes(x)))[1]
    order = np.argsort(-upper, axis=1)
    score = np.full((len(q), k), -_LONG - 1, np.int64)
    row = np.full((len(q), k), -1, np.int64)
    todo, at, run = np.arange(len(q)), 0, 4 * k
    while len(todo) and at < len(x):
        cols = order[todo, at:at + run]
        got = products(q[todo][:, None, :], x[cols])
        for t, r, s in zip(todo, np.concatenate([row[todo], cols], axis=1), np.concatenate([score[todo], got], axis=1)):
            r, s = r[r >= 0], s[r >= 0]
            best = np.lexsort((r, -s))[:k]
            row[t, : len(best)], score[t, : len(best)] = r[best], s[best]
        at += cols.shape[1]
        run = min(2 * run, max(4 * k, 2_000_000 // max(1, len(todo) * x.shape[1])))
        if at < len(x):
            sure = np.where(row[todo, k - 1] >= 0, score[todo, k - 1].astype(np.float64), -np.inf)
            todo = todo[upper[todo, order[todo, at]] >= np.maximum(sure, known[todo])]
    i, c = np.nonzero(row >= 0)
    return i, row[i, c], score[i, c]


def _matrix(column: pd.Series, dtype=np.int64) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(dtype, copy=False)


def top_k(rows: DataFrame, queries: Column, k: int = 5, scale: int = 256, bits: int = 6, block_rows: int = 8192,
          query_rows: int = 2048, sample_rows: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that ``queries`` selects, the ``k`` other
    rows of the largest product of floor(``scale`` * x) vectors, ties to the smaller id (null last).

    Vectors that are null or hold null or non-finite components take no part; components beyond a
    long count as the nearest long, and so do scores. Vectors of different lengths are not compared.
    Repeated rows (same id and vector) count once; rows of one id with different vectors are rows of
    their own. Fewer than k rows: all of them. Extra columns are not read; an empty table gives no rows.
    Cells are fitted on at most ``sample_rows`` rows (the first by hash); the sample and the cells, 2^bits
    bytes-sized numbers per dimension of each vector length, are all that passes through the driver.
    """
    if k < 1 or not 1 <= bits <= 8:
        raise ValueError("k must be positive and bits between 1 and 8")
    raw = F.col(vec_col).cast("array<double>")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = rows.select(F.col(id_col).alias("id"), raw.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("v IS NOT NULL").where(fine)
    base = base.select("id", "asks", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("x")).distinct()
    base = stored(base.withColumn("node", F.md5(F.array_join("x", ","))), "rows")
    exact = base.groupBy("node").agg(F.first("x").alias("x"), F.max("asks").alias("asks"), F.min("id").alias("least"))
    exact = stored(exact.withColumn("dim", F.size("x")), "exact")
    few = k + 1  # nodes and rows to find, a query's own included
    total, asking = exact.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0))).first()
    blocks, parts = max(1, math.ceil(total / block_rows)), max(1, math.ceil(asking / query_rows))
    exact = exact.withColumn("block", hash_bucket(blocks, F.col("node")))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, same in pdf.groupby("dim"):
                x = _matrix(same["x"])
                yield pd.DataFrame({"dim": [dim], "low": [x.min(axis=0)], "high": [x.max(axis=0)]})

    reach = exact.where("dim > 0").select("dim", "x").mapInPandas(ends, "dim int, low array<bigint>, high array<bigint>")
    reach = reach.select("dim", F.posexplode(F.arrays_zip("low", "high")).alias("p", "e")).groupBy("dim", "p").agg(
        F.min("e.low").alias("low"), F.max("e.high").alias("high"))
    limits: dict[int, dict[int, tuple[int, int]]] = {}
    for r in reach.collect():
        limits.setdefault(r.dim, {})[r.p] = (r.low, r.high)
    sample: dict[int, list] = {}
    for r in exact.where("dim > 0").select("dim", "x").orderBy("node").limit(sample_rows).collect():
        sample.setdefault(r.dim, []).append(r.x)
    grids = {0: Grid(np.empty((0, 0)), np.empty(0), np.empty(0), bits)}
    for dim, ps in limits.items():
        low, high = np.array([ps[p] for p in range(dim)], np.float64).T
        grids[dim] = Grid(np.array(sample.get(dim, np.empty((0, dim))), np.float64), low, high, bits)

    def quantised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, same in pdf.groupby("dim"):
                codes = grids[dim].codes(_matrix(same["x"]))
                yield pd.DataFrame({"dim": dim, "block": same["block"], "node": same["node"], "code": [c.tobytes() for c in codes]})

    cells = stored(exact.mapInPandas(quantised, "dim int, block bigint, node string, code binary"), "cells")
    ask = exact.where("asks").select("dim", "node", "x", hash_bucket(parts, F.lit("q"), F.col("node")).alias("part"))
    every_block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block")
    every_part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part")
    keys = ["dim", "part", "block"]

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple]:
        """(some queries, lower bounds, upper bounds) in steps."""
        codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
        spans = grids[codes.shape[1]].spans(codes)
        for lo in range(0, len(left), _QUERY_STEP):
            some = left.iloc[lo:lo + _QUERY_STEP]
            yield some, *bounds(_matrix(some["x"], np.float64), *spans)

    def lower(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"node": [], "low": []}).astype({"node": object, "low": float})]
        if len(left) and len(right):
            n = min(few, len(right))
            for some, low, _ in scan(left, right):
                top = np.partition(low, len(right) - n, axis=1)[:, len(right) - n:]
                out.append(pd.DataFrame({"node": np.repeat(some["node"].to_numpy(), n), "low": top.ravel()}))
        return pd.concat(out)

    asked = ask.select("dim", "part", "node", "x", every_block)
    seen = cells.select("dim", "block", "node", "code", every_part)
    firsts = asked.groupBy(*keys).cogroup(seen.groupBy(*keys)).applyInPandas(lower, "node string, low double")
    by_low = Window.partitionBy("node").orderBy(F.desc("low"))
    known = firsts.withColumn("r", F.row_number().over(by_low)).where(f"r <= {few}").groupBy("node").agg(
        F.when(F.count(F.lit(1)) == few, F.min("low")).otherwise(float("-inf")).alias("known"))
    asked = stored(ask.join(known, "node"), "asking").select("dim", "part", "node", "x", "known", every_block)

    def reaching(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        wanted = np.zeros(len(right), bool)
        if len(left) and len(right):
            for some, _, high in scan(left, right):
                wanted |= (high >= some["known"].to_numpy()[:, None]).any(axis=0)
        return pd.DataFrame({"part": key[1], "node": right["node"].to_numpy()[wanted]})

    wanted = asked.groupBy(*keys).cogroup(seen.groupBy(*keys)).applyInPandas(reaching, "part bigint, node string")
    read = wanted.join(exact.select("dim", "block", "node", "least", "x"), "node")

    def refined(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "node": [], "score": []}).astype({"query": object, "node": object, "score": "int64"})]
        if len(left) and len(right):
            right = right.sort_values(["least", "node"], na_position="last")
            x, node = _matrix(right["x"]), right["node"].to_numpy()
            for lo in range(0, len(left), _QUERY_STEP):
                some = left.iloc[lo:lo + _QUERY_STEP]
                i, r, s = nearest(_matrix(some["x"]), some["known"].to_numpy(), x, grids[key[0]], few)
                out.append(pd.DataFrame({"query": some["node"].to_numpy()[i], "node": node[r], "score": s}))
        return pd.concat(out)

    found = asked.groupBy(*keys).cogroup(read.groupBy(*keys)).applyInPandas(refined, "query string, node string, score bigint")
    found = found.join(exact.select("node", "least"), "node")
    by_node = Window.partitionBy("query").orderBy(F.desc("score"), F.col("least").asc_nulls_last(), "node")
    found = found.withColumn("r", F.row_number().over(by_node)).where(f"r <= {few}").select("query", "node", "score")
    in_node = Window.partitionBy("node").orderBy(F.col("id").asc_nulls_last())
    members = base.withColumn("r", F.row_number().over(in_node)).where(f"r <= {few}").select("node", "id")
    asking_rows = base.where("asks").select(F.col("node").alias("query"), F.col("id").alias("query_id"))
    pairs = asking_rows.join(found.join(members.withColumnRenamed("id", "vec_id"), "node"), "query")
    pairs = pairs.where(~((F.col("query") == F.col("node")) & F.col("query_id").eqNullSafe(F.col("vec_id"))))
    by_score = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "node")
    return pairs.withColumn("rank", F.row_number().over(by_score)).where(f"rank <= {int(k)}").select(
        "query_id", "rank", "vec_id", "score")
