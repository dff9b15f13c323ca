"""Retrieval-evaluation queries on the pair vectors (F9) and arrivals (F1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from embdrift.operators import retrieval as R
from embdrift.operators import similarity as S
from embdrift.operators import training as TR
from embdrift.plans.catalog import register
from embdrift.sources import fixtures as FX

# Unit vectors and all-pairs similarities for the oracle (fine at sf0.01: 500 x 500).
_UNIT = """
{name} AS (SELECT *, list_transform({col}, lambda x: x / CASE WHEN n_{out} = 0 THEN 1.0 ELSE n_{out} END) AS {out}
           FROM (SELECT *, sqrt(list_sum(list_transform({col}, lambda y: y * y))) AS n_{out} FROM {src}))"""

_PAIR_SIMS = (
    "WITH " + _UNIT.format(name="pq", col="query_vector", out="qu", src="pair_vectors") + "," +
    _UNIT.format(name="pd", col="doc_vector", out="du", src="pq") + """,
sims AS (SELECT q.item_id AS qid, q.source AS qsrc, d.item_id AS did, d.source AS dsrc,
                round(list_dot_product(q.qu, d.du), 10) AS sim FROM pd q, pd d),
gold AS (SELECT qid, sim AS g FROM sims WHERE qid = did),
rk AS (SELECT s.qid, 1 + count(*) FILTER (WHERE s.did <> s.qid AND (s.sim > g.g OR (s.sim = g.g AND s.did < s.qid))) AS rank
       FROM sims s JOIN gold g USING (qid) GROUP BY s.qid),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, did ASC) AS r FROM sims QUALIFY r <= 10),
dcg AS (SELECT qid, sum(CASE WHEN did = qid THEN 2.0 WHEN dsrc = qsrc THEN 1.0 ELSE 0.0 END / log2(r + 1)) AS dcg
        FROM top GROUP BY qid),
msz AS (SELECT source, count(*) - 1 AS m FROM pair_vectors GROUP BY source),
disc AS (SELECT r, 1.0 / log2(r + 2) AS dsc FROM range(1, 10) t(r)),
idcg AS (SELECT source, 2.0 + coalesce((SELECT sum(dsc) FROM disc WHERE disc.r <= msz.m), 0.0) AS idcg FROM msz),
per AS (SELECT q.item_id AS qid, q.source, rk.rank, 1.0 / rk.rank AS rr,
               CASE WHEN rk.rank = 1 THEN 1.0 ELSE 0.0 END AS hit1, CASE WHEN rk.rank <= 5 THEN 1.0 ELSE 0.0 END AS hit5,
               coalesce(dcg.dcg, 0.0) / idcg.idcg AS ndcg
        FROM pair_vectors q JOIN rk ON rk.qid = q.item_id LEFT JOIN dcg ON dcg.qid = q.item_id
        JOIN idcg ON idcg.source = q.source)""")


def _pairs(t):
    return FX.pair_vectors(t)


@register("pair_ranking_metrics", operators=("E1", "W2", "P15", "J10"), sql=FX.with_fixtures(_PAIR_SIMS + """
SELECT round(avg(rr), 6) AS mrr, round(avg(hit1), 6) AS recall_at_1, round(avg(hit5), 6) AS recall_at_5,
       round(avg(ndcg), 6) AS ndcg_at_10, count(*) AS queries FROM per""", "pair_vectors"), bench=True)
def pair_ranking_metrics(t):
    return R.ranking_metrics(R.rank_queries(_pairs(t)))


# Every fourth row asks; all rows are candidates.
_SAMPLED = _PAIR_SIMS.replace("FROM pd q, pd d)", "FROM pd q, pd d WHERE q.item_id % 4 = 0)").replace(
    "FROM pair_vectors q JOIN rk", "FROM (SELECT * FROM pair_vectors WHERE item_id % 4 = 0) q JOIN rk")


@register("retrieval_benchmark", operators=("E8", "A15", "E1"), sql=FX.with_fixtures(_SAMPLED + """,
dom AS (SELECT source AS domain, round(avg(rr), 6) AS mrr, round(avg(hit1), 6) AS recall_at_1,
               round(avg(hit5), 6) AS recall_at_5, round(avg(ndcg), 6) AS ndcg_at_10, count(*) AS queries
        FROM per GROUP BY source),
al AS (SELECT domain, mrr, recall_at_1, recall_at_5, ndcg_at_10, queries FROM dom
       UNION ALL
       SELECT 'overall', round(avg(mrr), 6), round(avg(recall_at_1), 6), round(avg(recall_at_5), 6),
              round(avg(ndcg_at_10), 6), CAST(sum(queries) AS BIGINT) FROM dom)
SELECT *, (SELECT count(*) FROM pair_vectors) AS candidates FROM al""", "pair_vectors"))
def retrieval_benchmark(t):
    p = _pairs(t)
    asks = F.when(F.col("item_id") % 4 == 0, F.col("query_vector"))
    return R.benchmark(p.withColumn("query_vector", asks))


_BY_DOMAIN = """,
dom AS (SELECT source AS domain, round(avg(rr), 6) AS mrr, round(avg(hit1), 6) AS recall_at_1,
               round(avg(hit5), 6) AS recall_at_5, round(avg(ndcg), 6) AS ndcg_at_10, count(*) AS queries
        FROM per GROUP BY source),
al AS (SELECT domain, mrr, recall_at_1, recall_at_5, ndcg_at_10, queries FROM dom
       UNION ALL
       SELECT 'overall', round(avg(mrr), 6), round(avg(recall_at_1), 6), round(avg(recall_at_5), 6),
              round(avg(ndcg_at_10), 6), CAST(sum(queries) AS BIGINT) FROM dom)
SELECT *, (SELECT count(*) FROM pair_vectors) AS candidates FROM al"""


@register("retrieval_benchmark_all", operators=("E8", "A15", "E1"), sql=FX.with_fixtures(_PAIR_SIMS + _BY_DOMAIN, "pair_vectors"))
def retrieval_benchmark_all(t):
    """E8 over the whole corpus: every row asks."""
    return R.benchmark(_pairs(t))


SAMPLE_QUERIES, SAMPLE_SEED = 500, 42  # the reference's number of sampled queries

_SEEDED = _PAIR_SIMS.replace("FROM pd q, pd d)", f"""FROM pd q, pd d WHERE q.item_id IN (
  SELECT item_id FROM pair_vectors ORDER BY sha256('{SAMPLE_SEED}:' || CAST(item_id AS VARCHAR)), item_id LIMIT {SAMPLE_QUERIES}))""")


@register("retrieval_benchmark_seeded", operators=("E8", "A15", "E1", "T8"), sql=FX.with_fixtures(_SEEDED + _BY_DOMAIN, "pair_vectors"))
def retrieval_benchmark_seeded(t):
    """E8 with the reference's form of sampling: the seeded sample asks, all rows are candidates."""
    p = _pairs(t)
    asks = TR.seeded_sample(p.select("item_id"), SAMPLE_QUERIES, SAMPLE_SEED, "item_id").select("item_id", F.lit(True).alias("asks"))
    p = p.join(asks, "item_id", "left")
    return R.benchmark(p.withColumn("query_vector", F.when(F.col("asks"), F.col("query_vector"))))


@register("knn_top10", operators=("J11", "J10"), sql=FX.with_fixtures(_PAIR_SIMS + """
SELECT qid, r AS rank, did, round(sim, 6) AS similarity FROM top""", "pair_vectors"))
def knn_top10(t):
    p = _pairs(t)
    q = p.select(F.col("item_id").alias("qid"), F.col("query_vector").alias("qvec"))
    d = p.select(F.col("item_id").alias("did"), F.col("doc_vector").alias("dvec"))
    return S.knn(q, d, 10).select("qid", F.col("rank").cast("long").alias("rank"), "did",
                                  F.round("similarity", 6).alias("similarity"))


@register("similarity_above", operators=("J10",), sql=FX.with_fixtures(_PAIR_SIMS + """
SELECT qid, count(*) FILTER (WHERE sim > 0.2) AS n_above FROM sims GROUP BY qid""", "pair_vectors"))
def similarity_above(t):
    p = _pairs(t)
    q = p.select(F.col("item_id").alias("qid"), F.col("query_vector").alias("qvec"))
    d = p.select(F.col("item_id").alias("did"), F.col("doc_vector").alias("dvec"))
    r = S.pair_similarity(q, d, 0.2)
    return q.select("qid").join(r, "qid", "left").select("qid", F.coalesce("n_above", F.lit(0)).cast("long").alias("n_above"))


_SAME_SRC = ("WITH " + _UNIT.format(name="u", col="vector", out="v", src="embedding_arrivals") + """,
sims AS (SELECT a.document_id AS qid, a.source AS qs, b.document_id AS did, b.source AS ds,
                round(list_dot_product(a.v, b.v), 10) AS sim FROM u a, u b WHERE a.document_id <> b.document_id),
best AS (SELECT qid, max(sim) AS bs FROM sims WHERE qs = ds GROUP BY qid),
per AS (SELECT s.qid, 1 + count(*) FILTER (WHERE s.sim > b.bs) AS rank,
               avg(s.sim) FILTER (WHERE s.qs = s.ds) - avg(s.sim) FILTER (WHERE s.qs <> s.ds) AS margin
        FROM sims s JOIN best b USING (qid) GROUP BY s.qid
        HAVING count(*) FILTER (WHERE s.qs <> s.ds) > 0),
m AS (SELECT avg(1.0 / rank) AS mrr, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS r5, avg(margin) AS mm FROM per)
SELECT round(mrr, 6) AS mrr, round(r5, 6) AS recall_at_5, round(mm, 6) AS mean_margin,
       round(0.65 * mrr + 0.2 * r5 + 0.15 * ((mm + 1.0) / 2.0), 6) AS quality FROM m""")


@register("same_source_retrieval", operators=("E2", "A17", "A1"), sql=FX.with_fixtures(_SAME_SRC, "embedding_arrivals"))
def same_source_retrieval(t):
    return R.score_retrieval(FX.embedding_arrivals(t))


def _adapted_pairs(t):
    w = TR.fit_adapter(FX.embedding_arrivals(t))
    p = _pairs(t)
    p = TR.apply_adapter(p, w, "query_vector")
    return TR.apply_adapter(p, w, "doc_vector")


_VAR = ("WITH ex AS (SELECT source, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS dim FROM embedding_arrivals),"
        "cen AS (SELECT source, dim, avg(x) AS c FROM ex GROUP BY source, dim),"
        "var AS (SELECT dim, var_pop(c) AS variance, count(*) AS n_sources FROM cen GROUP BY dim)")


# Ranks of the same pairs under two sets of vectors, as quality scores.
def _quality(prefix: str, src: str) -> str:
    return (_UNIT.format(name=f"{prefix}pq", col="query_vector", out="qu", src=src) + "," +
            _UNIT.format(name=f"{prefix}pd", col="doc_vector", out="du", src=f"{prefix}pq") + f""",
{prefix}s AS (SELECT q.item_id AS qid, d.item_id AS did, round(list_dot_product(q.qu, d.du), 10) AS sim
              FROM {prefix}pd q, {prefix}pd d),
{prefix}g AS (SELECT qid, sim AS g FROM {prefix}s WHERE qid = did),
{prefix}r AS (SELECT s.qid, 1 + count(*) FILTER (WHERE s.did <> s.qid AND (s.sim > g.g OR (s.sim = g.g AND s.did < s.qid))) AS rank
              FROM {prefix}s s JOIN {prefix}g g USING (qid) GROUP BY s.qid),
{prefix}m AS (SELECT round(avg(1.0 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS r5, count(*) AS n
              FROM {prefix}r),
{prefix}q AS (SELECT round(0.7 * CASE WHEN n >= 8 THEN mrr ELSE 0.0 END + 0.3 * CASE WHEN n >= 8 THEN r5 ELSE 0.0 END, 6) AS quality
              FROM {prefix}m)""")


@register("pair_gate", operators=("E3", "E4", "E5", "U4", "A17"), sql=FX.with_fixtures(_VAR + """,
wt AS (SELECT dim, CASE WHEN max(n_sources) OVER () < 2 OR max(variance) OVER () = 0 THEN 1.0
                  ELSE 1.0 + variance / max(variance) OVER () END AS w FROM var),
wl AS (SELECT list(w ORDER BY dim) AS w FROM wt),
adapted AS (SELECT item_id, source, list_transform(list_zip(query_vector, wl.w), lambda p: p[1] * p[2]) AS query_vector,
                   list_transform(list_zip(doc_vector, wl.w), lambda p: p[1] * p[2]) AS doc_vector FROM pair_vectors, wl),
""" + _quality("b", "pair_vectors") + "," + _quality("c", "adapted") + """
SELECT b.quality AS baseline_quality, c.quality AS candidate_quality,
       round((c.quality - b.quality) / greatest(b.quality, 1e-6), 6) AS improvement,
       CASE WHEN (c.quality <> 0 OR b.quality <> 0) AND (c.quality - b.quality) / greatest(b.quality, 1e-6) > 0.10
            THEN 'PASSED' ELSE 'REJECTED' END AS status
FROM bq b, cq c""", "embedding_arrivals", "pair_vectors"))
def pair_gate(t):
    """E3 + E4: base vectors against the diagonal adapter fitted on the arrivals."""
    return R.promotion_gate(R.pair_quality(_pairs(t)), R.pair_quality(_adapted_pairs(t)))


@register("between_source_variance", operators=("A11",), sql=FX.with_fixtures(
    _VAR + " SELECT CAST(dim AS INTEGER) AS dim, round(variance, 9) AS variance, n_sources FROM var", "embedding_arrivals"))
def between_source_variance(t):
    from embdrift.operators.centroid import between_source_variance as bsv
    r = bsv(FX.embedding_arrivals(t))
    return r.select("dim", F.round("variance", 9).alias("variance"), "n_sources")


@register("adapter_weights", operators=("E5",), sql=FX.with_fixtures(_VAR + """
SELECT CAST(dim AS INTEGER) AS dim,
       round(CASE WHEN max(n_sources) OVER () < 2 OR max(variance) OVER () = 0 THEN 1.0
                  ELSE 1.0 + variance / max(variance) OVER () END, 9) AS weight FROM var""", "embedding_arrivals"))
def adapter_weights(t):
    w = TR.fit_adapter(FX.embedding_arrivals(t))
    return w.select(F.posexplode("weights").alias("dim", "weight")).select("dim", F.round("weight", 9).alias("weight"))


@register("adapted_vectors", operators=("U4", "P9"), sql=FX.with_fixtures(_VAR + """,
wt AS (SELECT dim, CASE WHEN max(n_sources) OVER () < 2 OR max(variance) OVER () = 0 THEN 1.0
                  ELSE 1.0 + variance / max(variance) OVER () END AS w FROM var),
sc AS (SELECT document_id, list(x * w ORDER BY dim) AS sv
       FROM (SELECT document_id, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS dim FROM embedding_arrivals)
       JOIN wt USING (dim) GROUP BY document_id)
SELECT document_id, CAST(i - 1 AS INTEGER) AS dim, round(x / nrm, 6) AS value
FROM (SELECT document_id, unnest(sv) AS x, generate_subscripts(sv, 1) AS i,
             sqrt(list_sum(list_transform(sv, lambda y: y * y))) AS nrm FROM sc)""", "embedding_arrivals"))
def adapted_vectors(t):
    a = TR.apply_adapter(FX.embedding_arrivals(t), TR.fit_adapter(FX.embedding_arrivals(t)))
    return a.select("document_id", F.posexplode("vector").alias("dim", "value")).select(
        "document_id", "dim", F.round("value", 6).alias("value"))


@register("hard_negatives", operators=("E6",), sql=FX.with_fixtures(_PAIR_SIMS + """,
cand AS (SELECT s.qid, s.did, s.sim, s.sim < g.g AS below FROM sims s JOIN gold g USING (qid) WHERE s.did <> s.qid),
b AS (SELECT * FROM cand WHERE below QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, did) = 1),
a AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, did) = 1)
SELECT a.qid AS item_id, coalesce(b.did, a.did) AS negative_id, round(coalesce(b.sim, a.sim), 6) AS negative_sim,
       b.did IS NULL AS fallback
FROM a LEFT JOIN b USING (qid)""", "pair_vectors"))
def hard_negatives(t):
    r = TR.hard_negatives(_pairs(t))
    return r.select("item_id", "negative_id", F.round("negative_sim", 6).alias("negative_sim"), "fallback")
