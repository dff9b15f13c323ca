"""One exact global rank (W3, J15): positions in a total order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, buckets: Sequence[Column], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """0-based position of every row in ``order``.

    ``buckets`` are coarse ascending sort keys that agree with ``order`` (a row
    of an earlier bucket never follows one of a later bucket) and depend on the
    row's own values only, so every evaluation of the plan deals rows alike.
    Rows are counted per bucket, a running sum over the buckets (one row each)
    gives each bucket's first position, and ``row_number`` ranks inside it.
    Choose buckets that bound the rows of a task; ``order`` should end in a
    unique column.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    rows = df.select("*", *[b.alias(n) for b, n in zip(buckets, names)])
    counts = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    before = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(n).alias(f"{n}_o") for n in names],
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    same = [F.col(n).eqNullSafe(F.col(f"{n}_o")) for n in names]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    inside = Window.partitionBy(*names).orderBy(*order)
    ranked = rows.withColumn("_k", F.row_number().over(inside))
    return ranked.join(offsets, cond).select(*df.columns, (F.col("_first") + F.col("_k") - 1).alias(name))
