"""Embedding work lists: joins J1-J4 and backfill progress G6.

The reference splits "unembedded OR stale" into two indexable queries; in
Spark the two are an anti join and an inner join, unioned.  Both shuffle the
documents and vectors on the document id (or broadcast the smaller side when
AQE sees it is small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embedded_documents(docs: DataFrame, emb: DataFrame, doc_id: str = "id",
                       emb_doc_id: str = "document_id") -> DataFrame:
    """Inner equi-join of vectors to their documents."""
    return docs.join(emb.withColumnRenamed(emb_doc_id, doc_id), doc_id, "inner")


def unembedded(docs: DataFrame, emb: DataFrame, doc_id: str = "id", emb_doc_id: str = "document_id") -> DataFrame:
    """Documents without a vector."""
    return docs.join(emb.select(F.col(emb_doc_id).alias(doc_id)), doc_id, "left_anti")


def stale_embeddings(docs: DataFrame, emb: DataFrame, active: str | None, doc_id: str = "id",
                     emb_doc_id: str = "document_id") -> DataFrame:
    """Vectors whose model version is NULL or differs from the active one."""
    e = emb.select(F.col(emb_doc_id).alias(doc_id), "model_version")
    stale = e.filter(~F.col("model_version").eqNullSafe(F.lit(active)))
    return docs.join(stale, doc_id, "inner")


def claim(docs: DataFrame, emb: DataFrame, active: str | None, batch: int | None = 50,
          doc_id: str = "id", emb_doc_id: str = "document_id") -> DataFrame:
    """J4 + X1: unembedded first, then stale (only with an active model), by id.

    ``batch`` is the claim size (the feature of a claim); ``None`` gives the
    full backfill list.  Spark tasks own disjoint partitions, so no row locks.
    """
    a = unembedded(docs, emb, doc_id, emb_doc_id).select(doc_id, F.lit(0).alias("priority"))
    out = a
    if active is not None:
        b = stale_embeddings(docs, emb, active, doc_id, emb_doc_id).select(doc_id, F.lit(1).alias("priority"))
        out = a.unionByName(b)
    out = out.orderBy("priority", doc_id)
    return out.limit(batch) if batch else out


def backfill_progress(docs: DataFrame, emb: DataFrame, active: str | None, doc_id: str = "id",
                      emb_doc_id: str = "document_id", source_col: str = "source") -> DataFrame:
    """Per source, vectors and the share already on the active version."""
    j = docs.select(doc_id, source_col).join(
        emb.select(F.col(emb_doc_id).alias(doc_id), "model_version"), doc_id, "inner")
    on_active = F.col("model_version").eqNullSafe(F.lit(active)).cast("double")
    return j.groupBy(source_col).agg(F.count("*").alias("vectors"), F.avg(on_active).alias("share_active"))
