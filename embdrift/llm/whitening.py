"""Whitening of integer-scaled embeddings by a distributed QR and the qd singular value route.

The distinct vectors are counted and summed exactly, centred, and reduced to one triangular factor
R with R'R = n V: each task folds its rows into a factor of its own, factors are folded in groups
of fixed size until one is left. Only that factor, dimension x dimension numbers, comes to the driver, where
``bidiagonal`` finds the singular values and directions (see there). Two more passes apply them:
one checks the covariance of the whitened fit list, one whitens all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embdrift.llm.bidiagonal import right_singular
from embdrift.llm.common import stored

_FAN = 32  # factors folded into one
_SAFE = 2 ** 62
_LONG = 2 ** 63 - 1


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64, copy=False)


def scaled_deviation(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exact: longs, or Python integers where longs could overflow."""
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, total), default=0)
    if most < _SAFE:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def square_sums(y: np.ndarray) -> list[int | None]:
    """Sum of squares per row; null where it is no long."""
    if y.dtype == object or float(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) >= _SAFE:
        return [s if s <= _LONG else None for s in (int((r.astype(object) ** 2).sum()) for r in y)]
    return (y * y).sum(axis=1).tolist()


class Whitener:
    """Directions (rows) and scales of one vector length; see ``fit``."""

    def __init__(self, n: int, total: list[int], values: np.ndarray, directions: np.ndarray):
        self.n, self.total = n, total
        e = values / n
        real = e[: len(directions)] > len(total) * np.finfo(float).eps * (e[0] if len(e) else 0.0)
        self.directions, self.variance = directions[real], e[: len(directions)][real]
        self.explained = self.variance / e.sum() if len(self.variance) else self.variance
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return scaled_deviation(x, self.n, self.total).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions.T / np.sqrt(self.variance)


def integer_rows(rows: DataFrame, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, dim, x (array of floor(scale * c) + shift) of the rows whose vector is not null and holds
    no null or non-finite entries; entries beyond +-2^61 count as that number."""
    raw = F.col(vec_col).cast("array<double>")
    fine = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    edge = float(2 ** 61)
    x = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), c * F.lit(float(scale))))) + F.lit(shift))
    return rows.select(F.col(id_col).alias("vec_id"), raw.alias("v")).where("v IS NOT NULL").where(fine).select(
        "vec_id", F.size("v").alias("dim"), x.alias("x"))


def fit(distinct: DataFrame, components: int = 16) -> dict[int, Whitener]:
    """One ``Whitener`` per vector length of ``distinct`` (dim, x), the rows all different.

    At most dimension^2 numbers per vector length come to the driver. Eigenvalues that are zero
    beside the largest (to double precision) give no component.
    """
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, same in pdf.groupby("dim"):
                x = _matrix(same["x"])  # halves add up without overflow
                yield pd.DataFrame({"dim": [dim], "n": [len(x)], "high": [(x >> 31).sum(axis=0)], "low": [(x & (2 ** 31 - 1)).sum(axis=0)]})

    parts = distinct.where("dim > 0").mapInPandas(sums, "dim int, n bigint, high array<bigint>, low array<bigint>")
    parts = stored(parts, "sums")
    count = {r.dim: r.n for r in parts.groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    total: dict[int, dict[int, int]] = {d: {} for d in count}
    halves = parts.select("dim", F.posexplode(F.arrays_zip("high", "low")).alias("p", "s")).groupBy("dim", "p").agg(
        F.sum(F.col("s.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("s.low").cast("decimal(38,0)")).alias("low"))
    for r in halves.collect():
        total[r.dim][r.p] = int(r.high) * 2 ** 31 + int(r.low)
    models = {d: Whitener(n, [total[d][p] for p in range(d)], np.empty(0), np.empty((0, d))) for d, n in count.items()}

    def factors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, same in pdf.groupby("dim"):
                y = models[dim].centred(_matrix(same["x"]))
                held[dim] = np.linalg.qr(np.concatenate([held[dim], y]) if dim in held else y, mode="r")
        part = TaskContext.get().partitionId()
        for dim, r in held.items():
            yield pd.DataFrame({"dim": [dim], "part": [part], "r": [r.ravel()]})

    def folded(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [np.asarray(r).reshape(-1, key[0]) for r in pdf.sort_values("part")["r"]]
        return pd.DataFrame({"dim": [key[0]], "part": [key[1]], "r": [np.linalg.qr(np.concatenate(rows), mode="r").ravel()]})

    kind = "dim int, part int, r array<double>"
    level = stored(distinct.where("dim > 0").mapInPandas(factors, kind), "factors")
    while (level.agg(F.max("part")).first()[0] or 0) > 0:
        level = level.withColumn("to", F.expr(f"cast(part div {_FAN} as int)"))
        level = stored(level.groupBy("dim", "to").applyInPandas(folded, kind), "factors")
    for r in level.collect():
        m = np.array(r.r).reshape(-1, r.dim)
        square = np.zeros((r.dim, r.dim))
        square[: len(m)] = m
        model = models[r.dim]
        models[r.dim] = Whitener(model.n, model.total, *right_singular(square, min(components, r.dim)))

    def covariance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, same in pdf.groupby("dim"):
                w = models[dim].whitened(_matrix(same["x"]))
                m = np.concatenate([w.T @ w, w.sum(axis=0)[None, :]])
                yield pd.DataFrame({"dim": dim, "place": np.arange(m.size), "s": m.ravel()})

    moments = distinct.where("dim > 0").mapInPandas(covariance, "dim int, place int, s double").groupBy("dim", "place").agg(F.sum("s").alias("s"))
    by_dim: dict[int, list] = {}
    for r in moments.collect():  # (components + 1) * components numbers per length
        by_dim.setdefault(r.dim, []).append((r.place, r.s))
    for dim, found in by_dim.items():
        n, c = models[dim].n, len(models[dim].variance)
        m = np.array([s for _, s in sorted(found)]).reshape(c + 1, c)
        mean = m[c] / n
        models[dim].identity_error = float(np.abs(m[:c] / n - np.outer(mean, mean) - np.eye(c)).max(initial=0.0))
    return models


def whiten(rows: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every row
    with a whole vector and each of its first ``components`` components.

    Fitted on each distinct integer vector once; vectors of different lengths are fitted apart.
    Null ids and repeated rows are rows like others; rows left out: null vectors, null or non-finite entries.
    Components without variance (fewer distinct vectors than dimensions, constant data) are left out, so a table
    of equal vectors, like an empty one, gives no rows. deviation is null where it is no long. Extra
    columns are not read. Memory: a few dimension^2 numbers per task.
    """
    whole = stored(integer_rows(rows, scale, shift, id_col, vec_col), "whole")
    models = fit(stored(whole.select("dim", "x").distinct(), "distinct"), components)

    def applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, same in pdf.groupby("dim"):
                if not (dim and len(models[dim].variance)):
                    continue
                model, x = models[dim], _matrix(same["x"])
                c = len(model.variance)
                dev = pd.array(square_sums(scaled_deviation(x, model.n, model.total)), "Int64")
                yield pd.DataFrame({
                    "vec_id": same["vec_id"].astype("Int64").repeat(c), "component": np.tile(np.arange(1, c + 1), len(x)), "n": model.n,
                    "deviation": dev.repeat(c), "whitened": model.whitened(x).ravel(),
                    "explained": np.tile(model.explained, len(x)), "identity_error": model.identity_error})

    return whole.mapInPandas(applied, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
                                      "explained double, identity_error double")
