"""Ingest and work-list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from embdrift.functions import text as TX
from embdrift.functions.vectors import l2_normalize  # noqa: F401
from embdrift.operators import ingest as I
from embdrift.operators import worklist as WL
from embdrift.plans.catalog import register
from embdrift.sources import fixtures as FX

W = r"[\t\n\x{0b}\x{0c}\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
assert W == TX.PY_WHITESPACE

ISO_SQL = ("strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN '' "
           "ELSE '.' || lpad(CAST(epoch_us({ts}) % 1000000 AS VARCHAR), 6, '0') END || '+00:00'")
KEY_SQL = "sha256(concat_ws(':', source, external_id, " + ISO_SQL.format(ts="occurred_at") + "))"
WORDS_SQL = ("CASE WHEN regexp_replace({t}, '^{W}+|{W}+$', '', 'g') = '' THEN []::VARCHAR[] "
             "ELSE regexp_split_to_array(regexp_replace({t}, '^{W}+|{W}+$', '', 'g'), '{W}+') END")


def words_sql(t: str) -> str:
    return WORDS_SQL.format(t=t, W=W)


ACTIVE = "v1"
CATEGORIES = [f"src{i}" for i in range(10)]


@register("validate_incoming", operators=("P1", "P4"), sql=FX.with_fixtures("""
WITH m AS (SELECT *, arrival % 97 = 0 AS bad_time, arrival % 89 = 0 AS bad_meta FROM incoming_docs)
SELECT arrival, len(reasons) = 0 AS valid, array_to_string(reasons, ',') AS reasons,
       CASE WHEN len(reasons) = 0 THEN occurred_at END AS occurred_at
FROM (SELECT arrival, occurred_at, list_filter([
        CASE WHEN external_id IS NULL OR length(external_id) = 0 THEN 'empty_document_id' END,
        CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty_text' END,
        CASE WHEN source IS NULL OR length(source) = 0 THEN 'empty_source' END,
        CASE WHEN bad_time THEN 'bad_timestamp' END,
        CASE WHEN bad_meta THEN 'bad_metadata' END], lambda x: x IS NOT NULL) AS reasons
      FROM m)""", "incoming_docs"))
def validate_incoming(t):
    """P1 / P4 on text timestamps (Z and +02:00 forms, some broken) and metadata (objects, some lists)."""
    inc = FX.incoming_docs(t)
    utc = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    east = F.date_format(F.col("occurred_at") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    text_ts = F.when(F.col("arrival") % 97 == 0, "yesterday").when(F.col("arrival") % 2 == 0, utc).otherwise(east)
    meta = F.when(F.col("arrival") % 89 == 0, "[1, 2]").when(F.col("arrival") % 5 == 0, '{"k": 1}')
    valid, rejected = I.validate_documents(inc.withColumn("occurred_at", text_ts).withColumn("metadata", meta),
                                           metadata_col="metadata")
    return (valid.select("arrival", F.lit(True).alias("valid"), F.lit("").alias("reasons"), "occurred_at")
            .unionByName(rejected.select("arrival", F.lit(False).alias("valid"), F.array_join("reasons", ",").alias("reasons"),
                                         F.lit(None).cast("timestamp").alias("occurred_at"))))


@register("ingest_keys", operators=("P2", "P3", "P5"), sql=FX.with_fixtures(f"""
SELECT arrival, {KEY_SQL} AS idempotency_key, sha256(text) AS content_hash,
       source || '/' || {KEY_SQL} || '.json' AS object_key
FROM incoming_docs""", "incoming_docs"))
def ingest_keys(t):
    return I.with_keys(FX.incoming_docs(t)).select("arrival", "idempotency_key", "content_hash", "object_key")


@register("dedup_incoming", operators=("D1", "D2"), sql=FX.with_fixtures(f"""
WITH k AS (SELECT *, {KEY_SQL} AS idempotency_key FROM incoming_docs WHERE length(text) > 0),
stored AS (SELECT *, {KEY_SQL} AS idempotency_key FROM docs WHERE lang = 'en'),
first AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source, external_id ORDER BY arrival) = 1)
SELECT arrival, external_id, idempotency_key FROM first
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source = first.source AND s.external_id = first.external_id)
  AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.idempotency_key = first.idempotency_key)""", "incoming_docs"))
def dedup_incoming(t):
    valid, _ = I.validate_documents(FX.incoming_docs(t))
    stored = I.with_keys(FX.docs(t).filter(F.col("lang") == "en"))
    out = I.dedup_documents(I.with_keys(valid), stored)
    return out.select("arrival", "external_id", "idempotency_key")


@register("dedup_text", operators=("D3", "P3"), sql=FX.with_fixtures("""
SELECT id, sha256(text) AS content_hash FROM docs
QUALIFY row_number() OVER (PARTITION BY text ORDER BY id) = 1""", "docs"))
def dedup_text(t):
    return I.dedup_text(FX.docs(t)).select("id", TX.content_hash("text").alias("content_hash"))


@register("duplicate_groups", operators=("D4",), sql=FX.with_fixtures("""
SELECT sha256(text) AS content_hash, count(*) AS copies, min(id) AS first_id
FROM docs GROUP BY 1 HAVING count(*) > 1""", "docs"))
def duplicate_groups(t):
    return I.duplicate_groups(FX.docs(t))


@register("corpus_filter", operators=("P6",), sql=FX.with_fixtures(f"""
SELECT id, n_words FROM (SELECT id, source, len({words_sql('text')}) AS n_words FROM docs)
WHERE source IN ({", ".join(repr(c) for c in CATEGORIES)}) AND n_words BETWEEN 25 AND 200""", "docs"))
def corpus_filter(t):
    return I.filter_corpus(FX.docs(t), CATEGORIES).select("id", "n_words")


@register("query_document_pairs", operators=("P7",), sql=FX.with_fixtures(f"""
SELECT id, array_to_string(w[1:15], ' ') AS query, array_to_string(w[16:], ' ') AS document
FROM (SELECT id, {words_sql('text')} AS w FROM docs) WHERE len(w) >= 55""", "docs"))
def query_document_pairs(t):
    return I.split_pairs(FX.docs(t)).select("id", "query", "document")


@register("embedded_documents", operators=("J1",), sql=FX.with_fixtures("""
SELECT d.id, d.source, d.lang, e.model_version FROM docs d JOIN embedding_arrivals e ON e.document_id = d.id""",
                                                                     "docs", "embedding_arrivals"))
def embedded_documents(t):
    return WL.embedded_documents(FX.docs(t), FX.embedding_arrivals(t).drop("source")).select(
        "id", "source", "lang", "model_version")


@register("unembedded", operators=("J2",), sql=FX.with_fixtures("""
SELECT id FROM docs WHERE id NOT IN (SELECT document_id FROM embedding_arrivals)""", "docs", "embedding_arrivals"))
def unembedded(t):
    return WL.unembedded(FX.docs(t), FX.embedding_arrivals(t)).select("id")


@register("stale_embeddings", operators=("J3",), sql=FX.with_fixtures(f"""
SELECT d.id, e.model_version FROM docs d JOIN embedding_arrivals e ON e.document_id = d.id
WHERE e.model_version IS DISTINCT FROM '{ACTIVE}'""", "docs", "embedding_arrivals"))
def stale_embeddings(t):
    return WL.stale_embeddings(FX.docs(t), FX.embedding_arrivals(t), ACTIVE).select("id", "model_version")


_CLAIM_SQL = f"""
SELECT id, priority FROM (
  SELECT id, 0 AS priority FROM docs WHERE id NOT IN (SELECT document_id FROM embedding_arrivals)
  UNION ALL
  SELECT d.id, 1 FROM docs d JOIN embedding_arrivals e ON e.document_id = d.id
  WHERE e.model_version IS DISTINCT FROM '{ACTIVE}')
ORDER BY priority, id"""


@register("work_claim", operators=("J4", "X1", "T9"), sql=FX.with_fixtures(_CLAIM_SQL + " LIMIT 50",
                                                                        "docs", "embedding_arrivals"))
def work_claim(t):
    return WL.claim(FX.docs(t), FX.embedding_arrivals(t), ACTIVE, batch=50)


@register("work_backfill", operators=("J4", "X1"), sql=FX.with_fixtures(_CLAIM_SQL, "docs", "embedding_arrivals"),
          bench=True)
def work_backfill(t):
    return WL.claim(FX.docs(t), FX.embedding_arrivals(t), ACTIVE, batch=None)


@register("backfill_progress", operators=("G6",), sql=FX.with_fixtures(f"""
SELECT d.source, count(*) AS vectors,
       round(avg(CASE WHEN e.model_version IS NOT DISTINCT FROM '{ACTIVE}' THEN 1.0 ELSE 0.0 END), 6) AS share_active
FROM docs d JOIN embedding_arrivals e ON e.document_id = d.id GROUP BY d.source""", "docs", "embedding_arrivals"))
def backfill_progress(t):
    r = WL.backfill_progress(FX.docs(t), FX.embedding_arrivals(t), ACTIVE)
    return r.select("source", "vectors", F.round("share_active", 6).alias("share_active"))


@register("embedding_upsert", operators=("S7",), sql=FX.with_fixtures(f"""
WITH upd AS (SELECT document_id, vector, '{ACTIVE}' AS model_version,
                    TIMESTAMP '2024-01-02 00:00:00' AS created_at
             FROM embedding_arrivals_shifted WHERE model_version IS DISTINCT FROM '{ACTIVE}')
SELECT b.document_id,
       CASE WHEN u.document_id IS NOT NULL THEN u.model_version ELSE b.model_version END AS model_version,
       CASE WHEN u.document_id IS NOT NULL THEN u.created_at ELSE b.created_at END AS created_at,
       b.first_embedded_at,
       d.dim, round((CASE WHEN u.document_id IS NOT NULL THEN u.vector ELSE b.vector END)[d.dim + 1], 6) AS value
FROM embedding_arrivals b LEFT JOIN upd u USING (document_id) CROSS JOIN range(0, 64) d(dim)""", "embedding_arrivals_shifted"))
def embedding_upsert(t):
    base = FX.embedding_arrivals(t)
    upd = (FX.embedding_arrivals_shifted(t)
           .filter(~F.col("model_version").eqNullSafe(F.lit(ACTIVE)))
           .select("document_id", "vector", F.lit(ACTIVE).alias("model_version"),
                   F.lit("2024-01-02 00:00:00").cast("timestamp").alias("created_at"),
                   F.lit("2024-01-02 00:00:00").cast("timestamp").alias("first_embedded_at")))
    out = I.upsert(base, upd, ["document_id"], keep=["first_embedded_at"])
    return out.select("document_id", "model_version", "created_at", "first_embedded_at",
                      F.posexplode("vector").alias("dim", "value")).withColumn("dim", F.col("dim").cast("long")).withColumn(
        "value", F.round("value", 6))
