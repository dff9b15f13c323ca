"""Embedding drift: baseline choice (A2, A3), scoring (P10 + breach, J16), summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embdrift import config
from embdrift.functions.vectors import drift_score
from embdrift.operators.centroid import centroid
from embdrift.operators.windows import densify_windows, drift_windows


def bootstrap_baseline(emb: DataFrame, n: int = config.BOOTSTRAP_VECTORS,
                       min_documents: int = config.MIN_DOCUMENTS,
                       ts_col: str = "first_embedded_at", id_col: str = "document_id",
                       vector_col: str = "vector") -> DataFrame:
    """A2: mean of the first ``n`` vectors by first_embedded_at (ties by id).

    Returns one row (baseline_id, centroid, document_count), or none while
    fewer than ``min_documents`` vectors exist (the reference would write a
    fresh baseline on every poll in that state).  ``orderBy.limit`` plans as a
    per-partition top-n merged once: bounded by ``n`` whatever the input size.
    """
    first = emb.select(ts_col, id_col, vector_col).orderBy(ts_col, id_col).limit(n)
    c = centroid(first, (), vector_col)
    return c.filter(F.col("document_count") >= min_documents).select(
        F.lit("bootstrap").alias("baseline_id"), "centroid", "document_count")


def select_baseline(windows: DataFrame, min_documents: int = config.MIN_DOCUMENTS) -> DataFrame:
    """A3: earliest window without a baseline of its own holding >= min_documents."""
    cand = windows.filter((F.col("document_count") >= min_documents) & F.col("centroid").isNotNull())
    if "baseline_id" in windows.columns:
        cand = cand.filter(F.col("baseline_id").isNull())
    key = F.struct("window_start", "window_size")
    best = cand.agg(F.min_by(F.struct("window_size", "window_start", "centroid", "document_count"), key).alias("b"))
    return best.filter(F.col("b").isNotNull()).select(
        F.concat_ws("@", "b.window_size", F.col("b.window_start").cast("string")).alias("baseline_id"),
        F.col("b.centroid").alias("centroid"), F.col("b.document_count").alias("document_count"))


def score_windows(windows: DataFrame, baseline: DataFrame, threshold: float = config.DRIFT_THRESHOLD) -> DataFrame:
    """J16 + P10: attach the (one-row) baseline and score every window.

    The baseline enters as a scalar subquery (evaluated once, shipped as a
    literal); no join and no shuffle.  Empty windows score 0.0, not breached;
    a zero centroid gives a NULL score and is not breached.
    """
    b_vec = baseline.select("centroid").scalar()
    b_id = baseline.select("baseline_id").scalar()
    # Scalar subqueries may not sit inside a lambda: project them first.
    w = windows.select("*", b_id.alias("baseline_id"), b_vec.alias("_baseline"))
    score = F.when(F.col("document_count") == 0, F.lit(0.0)).otherwise(drift_score("centroid", "_baseline"))
    return w.select(
        *windows.columns, "baseline_id",
        score.alias("drift_score"),
        F.lit(threshold).alias("threshold"),
    ).withColumn("breached", F.coalesce(F.col("drift_score") > threshold, F.lit(False)))


def drift_report(emb: DataFrame, width_seconds: int = config.DRIFT_WINDOW_SECONDS,
                 slide_seconds: int | None = None, threshold: float = config.DRIFT_THRESHOLD,
                 min_documents: int = config.MIN_DOCUMENTS, densify: bool = True) -> DataFrame:
    """Flagship: windows -> centroids -> bootstrap baseline -> score -> breach."""
    w = drift_windows(emb, width_seconds, slide_seconds)
    if densify:
        w = densify_windows(w, width_seconds, slide_seconds)
    base = bootstrap_baseline(emb, min_documents=min_documents)
    return score_windows(w, base, threshold)


def drift_summary(emb_count: DataFrame, doc_count: DataFrame, scored: DataFrame,
                  threshold: float = config.DRIFT_THRESHOLD) -> DataFrame:
    """Totals plus the newest window holding documents; default threshold when none."""
    newest = scored.filter(F.col("document_count") > 0).agg(
        F.max_by(F.struct("window_size", "window_start", "drift_score", "breached", "threshold"),
                 F.struct("window_start", "window_size")).alias("n"))
    return newest.select(
        doc_count.select(F.count("*")).scalar().alias("total_documents"),
        emb_count.select(F.count("*")).scalar().alias("total_embeddings"),
        F.col("n.window_size").alias("latest_window_size"),
        F.col("n.window_start").alias("latest_window_start"),
        F.round("n.drift_score", 6).alias("latest_drift_score"),
        F.coalesce(F.col("n.breached"), F.lit(False)).alias("latest_breached"),
        F.coalesce(F.col("n.threshold"), F.lit(threshold)).alias("threshold"))
