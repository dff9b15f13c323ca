"""Reports: nearest-rank latency percentiles (A13), JSON report sink helper."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (50, 95, 99)


def latency_report(df: DataFrame, group: Sequence[str], value: str = "latency_ms",
                   approximate: bool = False, bucket_width: float = 1.0) -> DataFrame:
    """p50/p95/p99 (nearest rank), mean, min, max per group, rounded to 3.

    Exact percentiles by counting: rows per (group, value), summed per value
    bucket, running sums over the buckets find the bucket of each rank, and
    only the values of those buckets are cumulated.  No group's values gather
    in one task unless they lie in one bucket of ``bucket_width``.
    ``approximate`` takes ``percentile_approx`` instead.  ``p99_is_max`` flags
    groups under 100 requests, where nearest-rank p99 is the maximum.
    """
    group = list(group)
    basic = df.groupBy(*group).agg(
        F.count("*").alias("requests"), F.count(value).alias("_n"),
        F.round(F.avg(value), 3).alias("mean_ms"), F.round(F.min(value), 3).alias("min_ms"),
        F.round(F.max(value), 3).alias("max_ms"), (F.count("*") < 100).alias("p99_is_max"),
        *([F.percentile_approx(value, p / 100, 10000).alias(f"_p{p}") for p in PERCENTILES] if approximate else []))
    if approximate:
        pct = [F.round(f"_p{p}", 3).alias(f"p{p}_ms") for p in PERCENTILES]
        return basic.select(*group, "requests", *pct, "mean_ms", "min_ms", "max_ms", "p99_is_max")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    on = F.lit(True)
    for c in same:
        on = on & c
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_b", F.floor(F.col("_v") / bucket_width))
    by_bucket = counts.groupBy(*group, "_b").agg(F.sum("_c").alias("_c"))
    run = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    by_bucket = by_bucket.withColumn("_upto", F.sum("_c").over(run)).withColumn("_below", F.col("_upto") - F.col("_c"))
    # Nearest rank: the ceil(p * n)-th smallest value, in whole numbers.
    ranks = basic.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), F.floor((F.col("_n") * p + 99) / 100).alias("k")) for p in PERCENTILES])).alias("_r"))
    wanted = by_bucket.join(ranks, on).filter((F.col("_r.k") > F.col("_below")) & (F.col("_r.k") <= F.col("_upto"))).select(
        *[F.col(f"_g{i}") for i in range(len(group))], F.col("_b").alias("_wb"), "_below", F.col("_r.p").alias("p"),
        F.col("_r.k").alias("k"))
    inside = Window.partitionBy(*group, "p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = counts.join(wanted, on & (F.col("_b") == F.col("_wb"))).withColumn(
        "_at", F.col("_below") + F.sum("_c").over(inside)).filter(F.col("_at") >= F.col("k"))
    best = found.groupBy(*[F.col(f"_g{i}") for i in range(len(group))]).agg(
        *[F.round(F.min(F.when(F.col("p") == p, F.col("_v"))), 3).alias(f"p{p}_ms") for p in PERCENTILES])
    return basic.join(best, on, "left").select(*group, "requests", *[f"p{p}_ms" for p in PERCENTILES],
                                               "mean_ms", "min_ms", "max_ms", "p99_is_max")
