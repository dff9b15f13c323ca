"""Vector aggregates: centroids (A1), per-source variance (A11), pooling.

Centroids use ``Summarizer`` over ``array_to_vector``: a typed aggregate with
map-side partial aggregation, so one partial vector per group and partition
crosses the shuffle (never the member vectors), and it accumulates in double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embdrift.functions.vectors import l2_normalize


def centroid_agg(vector_col: str = "vector", weight_col: str | None = None) -> Column:
    """Aggregate expression -> struct(mean vector, count)."""
    vec = array_to_vector(F.col(vector_col))
    s = Summarizer.metrics("mean", "count")
    return s.summary(vec, F.col(weight_col)) if weight_col else s.summary(vec)


def centroid(df: DataFrame, group: Sequence[str | Column] = (), vector_col: str = "vector",
             weight_col: str | None = None, count_col: str | None = None) -> DataFrame:
    """A1: element-wise mean and member count per group.

    No rows -> no group (densify adds count 0 / NULL centroid explicitly).
    ``weight_col`` turns the mean into a weighted mean (pre-aggregated input);
    ``count_col`` then names the member count to sum instead of counting rows.
    """
    src = df.filter(F.col(vector_col).isNotNull())
    aggs = [centroid_agg(vector_col, weight_col).alias("_s")]
    if count_col:
        aggs.append(F.sum(count_col).alias("_n"))
    g = src.groupBy(*group).agg(*aggs) if group else src.agg(*aggs)
    n = F.col("_n") if count_col else F.col("_s.count")
    keys = [c for c in g.columns if c not in ("_s", "_n")]
    return g.select(*keys, vector_to_array(F.col("_s.mean")).alias("centroid"),
                    n.cast("long").alias("document_count"))


def vector_sum(df: DataFrame, group: Sequence[str], vector_col: str = "vector") -> DataFrame:
    """Element-wise sum and count per group (mean x count, same aggregate)."""
    c = centroid(df, group, vector_col)
    return c.select(*group, F.transform("centroid", lambda x: x * F.col("document_count")).alias("vector_sum"),
                    "document_count")


def between_source_variance(df: DataFrame, source_col: str = "source", vector_col: str = "vector") -> DataFrame:
    """Per-source centroids, then population variance across centroids per dimension.

    Output: one row per dimension (dim, variance, n_sources).  Only
    sources x dims rows are exploded (never the member vectors).
    """
    c = centroid(df, [source_col], vector_col)
    ex = c.select(source_col, F.posexplode("centroid").alias("dim", "x"))
    return ex.groupBy("dim").agg(F.var_pop("x").alias("variance"),
                                 F.count("*").alias("n_sources"))


def pool_chunks(df: DataFrame, doc_col: str, vector_col: str = "vector", mask_col: str | None = None) -> DataFrame:
    """Masked mean pooling of part vectors into one unit vector per document."""
    src = df.filter(F.col(mask_col)) if mask_col else df
    c = centroid(src, [doc_col], vector_col)
    return c.select(doc_col, l2_normalize("centroid").alias("vector"), F.col("document_count").alias("parts"))
