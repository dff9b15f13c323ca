"""Retrieval evaluation: ranking metrics (E1, W2, P15), same-source retrieval (E2),
pair gate (E3), promotion (E4), per-domain benchmark (E8, A15), guards (A17).

Ranks are counts ("how many documents score ahead of the gold one"), so no
query ever sorts its candidate list; only top-k rows are merged for NDCG.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embdrift import config
from embdrift.functions.vectors import dot, l2_normalize
from embdrift.operators.centroid import vector_sum
from embdrift.operators.similarity import ScanSpec, scan
from embdrift.session import materialize


# Weights of the quality scores.
PAIR_MRR, PAIR_RECALL = 0.7, 0.3
SOURCE_MRR, SOURCE_RECALL, SOURCE_MARGIN = 0.65, 0.2, 0.15


def _discounted_ideal(m: Column, k: int) -> Column:
    """IDCG for one exact (gain 2) and m related (gain 1) documents: 2 + Σ_{r=1}^{min(m,k-1)} 1/log2(r+2)."""
    n = F.least(m, F.lit(k - 1))
    tail = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0),
                       lambda acc, r: acc + 1.0 / F.log2(r + 2))
    return F.lit(config.GAIN_EXACT) + F.when(n >= 1, tail).otherwise(F.lit(0.0))


def rank_queries(pairs: DataFrame, k: int = 10, id_col: str = "item_id", source_col: str = "source",
                 qvec: str = "query_vector", dvec: str = "doc_vector") -> DataFrame:
    """E1 per query: query i must retrieve document i among all documents.

    Output (qid, source, rank, rr, hit1, hit5, ndcg).  Ties: sim desc (after the
    scan's rounding), doc id asc.  A row whose query vector is NULL is a
    candidate only.
    """
    p = materialize(pairs.select(F.col(id_col).alias("id"), F.col(source_col).alias("label"),
                                 F.col(qvec).alias("q"), F.col(dvec).alias("d")))
    # E8 with sampled queries: only rows with a query vector ask, every row is a candidate.
    asks = p.filter(F.col("q").isNotNull())
    q = asks.select(F.col("id").alias("qid"), F.col("q").alias("qvec"),
                    F.col("id").alias("gold_did"), F.col("label").alias("qlabel"),
                    dot(l2_normalize("q"), l2_normalize("d")).alias("gold_sim"))
    d = p.select(F.col("id").alias("did"), F.col("d").alias("dvec"), F.col("label").alias("dlabel"))
    n = p.agg(F.count("q"), F.count("*")).first()
    rows = scan(q, d, ScanSpec(k=k, gold=True), sizes=(n[0], n[1]))
    # One pass over the kernel's rows: counts summed and tops ranked in one window per query.
    rows = rows.join(q.select("qid", "gold_did", "qlabel"), "qid")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(
        F.when(F.col("kind") == "top", 0).otherwise(1), F.desc("sim"), F.asc("did")))
    rows = rows.withColumn("place", place)
    gain = (F.when(F.col("did") == F.col("gold_did"), config.GAIN_EXACT)
            .when(F.col("dlabel") == F.col("qlabel"), config.GAIN_RELATED).otherwise(0.0))
    shown = (F.col("kind") == "top") & (F.col("place") <= k)
    base = rows.groupBy("qid", "qlabel").agg(
        F.sum(F.when(F.col("kind") == "ahead", F.col("cnt"))).alias("ahead"),
        F.sum(F.when(shown, gain / F.log2(F.col("place") + 1))).alias("dcg"))
    sizes = d.groupBy(F.col("dlabel").alias("qlabel")).agg((F.count("*") - 1).alias("m"))
    out = base.join(sizes, "qlabel", "left")
    rank = (F.coalesce("ahead", F.lit(0)) + 1).cast("long")
    idcg = _discounted_ideal(F.coalesce("m", F.lit(0)), k)
    return out.select("qid", F.col("qlabel").alias("source"), rank.alias("rank"),
                      (1.0 / rank).alias("rr"), (rank == 1).cast("double").alias("hit1"),
                      (rank <= 5).cast("double").alias("hit5"),
                      (F.coalesce("dcg", F.lit(0.0)) / idcg).alias("ndcg"))


def ranking_metrics(per_query: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """E1 aggregate: MRR, recall@1, recall@5, NDCG@10 rounded to 6 digits."""
    aggs = [F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("hit1"), 6).alias("recall_at_1"),
            F.round(F.avg("hit5"), 6).alias("recall_at_5"), F.round(F.avg("ndcg"), 6).alias("ndcg_at_10"),
            F.count("*").alias("queries")]
    return per_query.groupBy(*group).agg(*aggs) if group else per_query.agg(*aggs)


def benchmark(pairs: DataFrame, k: int = 10, **kw) -> DataFrame:
    """Ranking metrics per domain over all candidates, and their plain means as ``overall``.

    ``queries`` counts rows with a query vector, ``candidates`` all rows.
    """
    n = pairs.count()
    dom = ranking_metrics(rank_queries(pairs, k, **kw), ("source",)).withColumnRenamed("source", "domain")
    dom = materialize(dom)  # one row per domain; two readers
    overall = dom.agg(F.lit("overall").alias("domain"), *[F.round(F.avg(c), 6).alias(c) for c in
                      ("mrr", "recall_at_1", "recall_at_5", "ndcg_at_10")], F.sum("queries").alias("queries"))
    return dom.unionByName(overall).withColumn("candidates", F.lit(n).cast("long"))


def pair_quality(pairs: DataFrame, min_pairs: int = config.MIN_EVALUATION_PAIRS, **kw) -> DataFrame:
    """E1 on (query, document) pairs; quality = 0.7·mrr + 0.3·recall@5 (from rounded metrics).

    Guard (A17): fewer than ``min_pairs`` pairs -> all zeros.
    """
    m = ranking_metrics(rank_queries(pairs, **kw))
    ok = F.col("queries") >= min_pairs
    cols = ["mrr", "recall_at_1", "recall_at_5", "ndcg_at_10"]
    out = m.select(*[F.when(ok, F.col(c)).otherwise(0.0).alias(c) for c in cols], "queries")
    return out.withColumn("quality", F.round(PAIR_MRR * F.col("mrr") + PAIR_RECALL * F.col("recall_at_5"), 6))


def score_retrieval(df: DataFrame, id_col: str = "document_id", source_col: str = "source",
                    vector_col: str = "vector", min_rows: int = 4, min_sources: int = 2) -> DataFrame:
    """Same-source retrieval with self excluded.

    rank = 1 + #documents scoring above the best same-source neighbour (two
    block scans: the best neighbour, then the count).  The mean margin needs
    no pair scan: q·(S_source − q)/(n−1) − q·(S_all − S_source)/(N − n) with
    S the sums of unit vectors (A1).
    """
    u = materialize(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                              l2_normalize(vector_col).alias("v")))
    n_rows = u.count()
    q = u.select(F.col("id").alias("qid"), F.col("v").alias("qvec"), F.col("source").alias("qlabel"))
    d = u.select(F.col("id").alias("did"), F.col("v").alias("dvec"), F.col("source").alias("dlabel"))
    best = (scan(q, d, ScanSpec(exclude_self=True, same_max=True), sizes=(n_rows, n_rows))
            .filter(F.col("kind") == "same_max").groupBy("qid").agg(F.max("sim").alias("threshold")))
    q2 = q.join(best, "qid")
    above = (scan(q2, d, ScanSpec(exclude_self=True, above=True), sizes=(n_rows, n_rows))
             .filter(F.col("kind") == "above").groupBy("qid").agg(F.sum("cnt").alias("ahead")))
    sums = vector_sum(u, ["source"], "v").withColumnRenamed("vector_sum", "s_src").withColumnRenamed(
        "document_count", "n_src")
    total = u.agg(F.count("*").alias("n_all"))
    s_all = vector_sum(u.withColumn("_all", F.lit(1)), ["_all"], "v").select("vector_sum")
    pq = (u.join(sums, "source")
          .select("*", s_all.scalar().alias("s_all"), total.scalar().alias("n_all")))
    same = (dot("v", "s_src") - dot("v", "v")) / (F.col("n_src") - 1)
    other = (dot("v", "s_all") - dot("v", "s_src")) / (F.col("n_all") - F.col("n_src"))
    per = (pq.filter((F.col("n_src") > 1) & (F.col("n_all") > F.col("n_src")))
           .select(F.col("id").alias("qid"), (same - other).alias("margin"))
           .join(above, "qid", "left"))
    rank = F.coalesce("ahead", F.lit(0)) + 1
    m = per.agg(F.avg(1.0 / rank).alias("mrr"), F.avg((rank <= 5).cast("double")).alias("r5"),
                F.avg("margin").alias("mm"), F.count("*").alias("queries"))
    guard = df.agg(F.count("*").alias("n"), F.count_distinct(source_col).alias("s"))
    ok = (guard.select("n").scalar() >= min_rows) & (guard.select("s").scalar() >= min_sources) & (F.col("queries") > 0)
    quality = SOURCE_MRR * F.col("mrr") + SOURCE_RECALL * F.col("r5") + SOURCE_MARGIN * ((F.col("mm") + 1.0) / 2.0)
    return m.select(*[F.round(F.when(ok, c).otherwise(0.0), 6).alias(n) for c, n in
                      [(F.col("mrr"), "mrr"), (F.col("r5"), "recall_at_5"), (F.col("mm"), "mean_margin"),
                       (quality, "quality")]])


def promotion_gate(base: DataFrame, candidate: DataFrame,
                   min_improvement: float = config.ACTIVATION_MIN_IMPROVEMENT,
                   key: tuple[str, ...] = ()) -> DataFrame:
    """improvement = (cand − base)/max(base, 1e-6); PASSED if > min_improvement."""
    b = base.select(*key, F.col("quality").alias("baseline_quality"))
    c = candidate.select(*key, F.col("quality").alias("candidate_quality"))
    j = b.join(c, list(key)) if key else b.select("*", c.select("candidate_quality").scalar().alias("candidate_quality"))
    imp = (F.col("candidate_quality") - F.col("baseline_quality")) / F.greatest(F.col("baseline_quality"), F.lit(1e-6))
    evaluated = (F.col("candidate_quality") != 0) | (F.col("baseline_quality") != 0)
    return j.select("*", F.round(imp, 6).alias("improvement"),
                    F.when(evaluated & (imp > min_improvement), "PASSED").otherwise("REJECTED").alias("status"))
