"""Vector column functions, all JVM-side expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    """Dot product of two equal-length double arrays."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v) -> Column:
    """Divide by the L2 norm; a zero vector is divided by 1 (stays zero).

    The norm is the accumulator of one ``aggregate`` and the division runs in
    its finish lambda, so the norm is computed once per row (not per element).
    """
    v = _c(v)

    def finish(acc):
        n = F.sqrt(acc)
        d = F.when(n == 0, F.lit(1.0)).otherwise(n)
        return F.transform(v, lambda x: x / d)

    return F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x, finish)


def cosine_similarity(a, b) -> Column:
    """NULL when either side has zero norm (the reference yields NaN)."""
    def finish(acc):
        return F.when((acc["p"] == 0) | (acc["q"] == 0), F.lit(None).cast("double")).otherwise(
            acc["d"] / (F.sqrt(acc["p"]) * F.sqrt(acc["q"])))
    z = F.zip_with(_c(a), _c(b), lambda x, y: F.struct((x * y).alias("d"), (x * x).alias("p"), (y * y).alias("q")))
    zero = F.struct(F.lit(0.0).cast("double").alias("d"), F.lit(0.0).cast("double").alias("p"),
                    F.lit(0.0).cast("double").alias("q"))
    return F.aggregate(z, zero, lambda acc, e: F.struct((acc["d"] + e["d"]).alias("d"), (acc["p"] + e["p"]).alias("p"),
                                                         (acc["q"] + e["q"]).alias("q")), finish)


def cosine_distance(a, b) -> Column:
    """P10: 1 - cos(a, b) in [0, 2]; NULL for a zero vector."""
    return F.lit(1.0) - cosine_similarity(a, b)


def drift_score(a, b) -> Column:
    """P10: min(cosine distance, 1); NULL stays NULL (``least`` would skip it)."""
    d = cosine_distance(a, b)
    return F.when(d > 1.0, F.lit(1.0)).otherwise(d)


def clamp01(c) -> Column:
    """Clamp to [0, 1]; NaN and NULL-free negatives become 0."""
    c = _c(c)
    return F.least(F.greatest(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def parse_vector(s) -> Column:
    """P8: '[0.1,0.2]' text literal -> array<double>."""
    return F.from_json(_c(s), "array<double>")


def format_vector(v, decimals: int = 8) -> Column:
    """array<double> -> '[0.10000000,...]' with a fixed number of decimals."""
    fmt = f"%.{decimals}f"
    return F.concat(F.lit("["), F.array_join(F.transform(_c(v), lambda x: F.format_string(fmt, x)), ","), F.lit("]"))


def scale(v, w) -> Column:
    """Element-wise product (diagonal adapter)."""
    return F.zip_with(_c(v), _c(w), lambda x, y: x * y)
