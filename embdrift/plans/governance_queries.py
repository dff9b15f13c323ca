"""Governance queries: retention, constraint audit, registry fold, activations, listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from embdrift.operators import governance as G
from embdrift.operators import ingest as I
from embdrift.plans.catalog import register
from embdrift.sources import fixtures as FX

NOW = "2024-02-15 00:00:00"


# Five tables of the registry side, derived from the fixtures, with their references.
_PURGE_SQL = """
e0 AS (SELECT document_id, created_at FROM embedding_arrivals),
d0 AS (SELECT epoch(date_trunc('hour', ts))::BIGINT AS drift_window_id,
              CASE WHEN epoch(date_trunc('hour', ts))::BIGINT % 7200 = 0
                   THEN epoch(date_trunc('hour', ts))::BIGINT - 86400 END AS baseline_id,
              date_trunc('hour', ts) AS created_at FROM events GROUP BY 1, 2, 3),
l0 AS (SELECT epoch(window_start)::BIGINT AS linguistic_window_id, window_end AS created_at FROM linguistic_windows),
j0 AS (SELECT job_id, queued_at, (SELECT min(drift_window_id) FROM d0) + 3600 * (job_id % 1000) AS drift_window_id FROM training_jobs),
s0 AS (SELECT job_id AS training_job_id,
              (SELECT min(linguistic_window_id) FROM l0) + 86400 * (job_id % 30) AS linguistic_window_id, drift_window_id FROM j0),
e1 AS (SELECT * FROM e0 WHERE created_at >= {now} - INTERVAL 90 DAY),
d1 AS (SELECT * FROM d0 WHERE created_at >= {now} - INTERVAL 30 DAY),
l1 AS (SELECT * FROM l0 WHERE created_at >= {now} - INTERVAL 30 DAY),
j1 AS (SELECT * FROM j0 WHERE queued_at >= {now} - INTERVAL 365 DAY),
s1 AS (SELECT * FROM s0 WHERE training_job_id IN (SELECT job_id FROM j1)
                          AND linguistic_window_id IN (SELECT linguistic_window_id FROM l1))"""


def _purge_tables(t):
    h = F.date_trunc("hour", "ts")
    dw = t.events.select(F.unix_seconds(h).alias("drift_window_id"), h.alias("created_at")).distinct()
    dw = dw.withColumn("baseline_id", F.when(F.col("drift_window_id") % 7200 == 0, F.col("drift_window_id") - 86400))
    lw = FX.linguistic_windows(t).select(F.unix_seconds("window_start").alias("linguistic_window_id"),
                                         F.col("window_end").alias("created_at"))
    first_d = dw.agg(F.min("drift_window_id").alias("m")).select("m").scalar()
    first_l = lw.agg(F.min("linguistic_window_id").alias("m")).select("m").scalar()
    jobs = FX.training_jobs(t).select("job_id", "queued_at", (first_d + (F.col("job_id") % 1000) * 3600).alias("drift_window_id"))
    signals = jobs.select(F.col("job_id").alias("training_job_id"),
                          (first_l + (F.col("job_id") % 30) * 86400).alias("linguistic_window_id"), "drift_window_id")
    return {"embeddings": FX.embedding_arrivals(t), "drift_windows": dw, "linguistic_windows": lw,
            "training_jobs": jobs, "training_linguistic_signals": signals}


@register("retention_counts", operators=("G1",), sql=FX.with_fixtures("WITH " + _PURGE_SQL.format(now=f"TIMESTAMP '{NOW}'").strip() + """
SELECT 'embeddings' AS table_name, (SELECT count(*) FROM e0) - count(*) AS deleted, count(*) AS kept,
       CAST(0 AS BIGINT) AS references_left FROM e1
UNION ALL SELECT 'drift_windows', (SELECT count(*) FROM d0) - count(*), count(*),
       count(CASE WHEN baseline_id IN (SELECT drift_window_id FROM d1) THEN 1 END) FROM d1
UNION ALL SELECT 'linguistic_windows', (SELECT count(*) FROM l0) - count(*), count(*), 0 FROM l1
UNION ALL SELECT 'training_jobs', (SELECT count(*) FROM j0) - count(*), count(*),
       count(CASE WHEN drift_window_id IN (SELECT drift_window_id FROM d1) THEN 1 END) FROM j1
UNION ALL SELECT 'training_linguistic_signals', (SELECT count(*) FROM s0) - count(*), count(*),
       count(CASE WHEN drift_window_id IN (SELECT drift_window_id FROM d1) THEN 1 END) FROM s1""",
    "embedding_arrivals", "linguistic_windows", "training_jobs"))
def retention_counts(t):
    """G1: the five tables after retention, with SET NULL and CASCADE effects."""
    b = _purge_tables(t)
    after = G.purge(b["embeddings"], b["drift_windows"], b["linguistic_windows"], b["training_jobs"],
                    b["training_linguistic_signals"], NOW)
    return G.purge_counts(b, after, {"drift_windows": "baseline_id", "training_jobs": "drift_window_id",
                                     "training_linguistic_signals": "drift_window_id"})


_KEY_SQL = ("sha256(concat_ws(':', source, external_id, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || "
            "CASE WHEN epoch_us(occurred_at) % 1000000 = 0 THEN '' ELSE '.' || "
            "lpad(CAST(epoch_us(occurred_at) % 1000000 AS VARCHAR), 6, '0') END || '+00:00'))")


@register("constraint_audit", operators=("G2",), sql=FX.with_fixtures(f"""
WITH k AS (SELECT *, {_KEY_SQL} AS idempotency_key, sha256(text) AS content_hash FROM incoming_docs),
st AS (SELECT registry, version, arg_max(status, ts * 10 + seq) AS status FROM
         (SELECT registry, version, status, epoch(ts)::BIGINT AS ts, seq FROM model_events) GROUP BY ALL),
-- columns that the fixtures lack, some of them out of range on purpose
lx AS (SELECT *, composite_score - 0.1 AS entity_kl, composite_score / 2 AS topic, composite_score * 2 AS pvalue, 0.65 AS threshold
       FROM linguistic_windows),
dx AS (SELECT 'ONE_HOUR' AS window_size, ts AS window_start, ts + INTERVAL 1 HOUR AS window_end, value / 100 AS score, 0.08 AS threshold,
              value - 1 AS kl, value AS w1, event_id % 5 AS document_count, CASE WHEN event_id % 10 <> 0 THEN [1.0] END AS centroid
       FROM events),
jx AS (SELECT *, job_id % 5 AS attempts, job_id % 4 AS max_attempts, (job_id % 11) / 10.0 AS weight FROM training_jobs)
SELECT 'documents' AS table_name, 'digest_format' AS rule,
       CAST(sum(CASE WHEN NOT regexp_full_match(idempotency_key, '[0-9a-f]{{64}}')
                       OR NOT regexp_full_match(content_hash, '[0-9a-f]{{64}}') THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM k
UNION ALL SELECT 'documents', 'non_empty_text', CAST(sum(CASE WHEN length(text) = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM k
UNION ALL SELECT 'documents', 'unique_idempotency_key', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
          FROM (SELECT count(*) AS n FROM k GROUP BY idempotency_key)
UNION ALL SELECT 'documents', 'unique_source_external_id', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
          FROM (SELECT count(*) AS n FROM k GROUP BY source, external_id)
UNION ALL SELECT 'embeddings', 'vector_width', CAST(sum(CASE WHEN len(vector) <> 64 THEN 1 ELSE 0 END) AS BIGINT)
          FROM embedding_arrivals
UNION ALL SELECT 'embeddings', 'unique_document', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
          FROM (SELECT count(*) AS n FROM embedding_arrivals GROUP BY document_id)
UNION ALL SELECT 'embeddings', 'document_exists', count(*)
          FROM embedding_arrivals e WHERE e.document_id NOT IN (SELECT id FROM docs)
UNION ALL SELECT 'linguistic_windows', 'score_range',
          CAST(sum(CASE WHEN composite_score < 0 OR composite_score > 1 THEN 1 ELSE 0 END) AS BIGINT) FROM linguistic_windows
UNION ALL SELECT 'linguistic_windows', 'end_after_start',
          CAST(sum(CASE WHEN window_end <= window_start THEN 1 ELSE 0 END) AS BIGINT) FROM linguistic_windows
UNION ALL SELECT 'model_versions', 'one_active_per_registry', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
          FROM (SELECT count(*) AS n FROM st WHERE status = 'ACTIVE' GROUP BY registry)
UNION ALL SELECT 'model_versions', 'unique_version', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
          FROM (SELECT count(*) AS n FROM st GROUP BY registry, version)
UNION ALL SELECT 'model_versions', 'artifact_digest',
          CAST(sum(CASE WHEN NOT regexp_full_match(sha256(version), '[0-9a-f]{{64}}') THEN 1 ELSE 0 END) AS BIGINT) FROM st
UNION ALL SELECT 'linguistic_windows', 'document_count', CAST(sum(CASE WHEN document_count < 0 THEN 1 ELSE 0 END) AS BIGINT) FROM lx
UNION ALL SELECT 'linguistic_windows', 'entity_divergence', CAST(sum(CASE WHEN entity_kl < 0 THEN 1 ELSE 0 END) AS BIGINT) FROM lx
UNION ALL SELECT 'linguistic_windows', 'topic_distance', CAST(sum(CASE WHEN topic < 0 THEN 1 ELSE 0 END) AS BIGINT) FROM lx
UNION ALL SELECT 'linguistic_windows', 'pvalue_range', CAST(sum(CASE WHEN pvalue < 0 OR pvalue > 1 THEN 1 ELSE 0 END) AS BIGINT) FROM lx
UNION ALL SELECT 'linguistic_windows', 'threshold_range',
          CAST(sum(CASE WHEN threshold < 0 OR threshold > 1 THEN 1 ELSE 0 END) AS BIGINT) FROM lx
UNION ALL SELECT 'linguistic_windows', 'unique_start_end', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
          FROM (SELECT count(*) AS n FROM lx GROUP BY window_start, window_end)
UNION ALL SELECT 'drift_windows', 'score_range', CAST(sum(CASE WHEN score < 0 OR score > 1 THEN 1 ELSE 0 END) AS BIGINT) FROM dx
UNION ALL SELECT 'drift_windows', 'threshold_range', CAST(sum(CASE WHEN threshold < 0 OR threshold > 1 THEN 1 ELSE 0 END) AS BIGINT) FROM dx
UNION ALL SELECT 'drift_windows', 'divergence', CAST(sum(CASE WHEN kl < 0 THEN 1 ELSE 0 END) AS BIGINT) FROM dx
UNION ALL SELECT 'drift_windows', 'wasserstein', CAST(sum(CASE WHEN w1 < 0 THEN 1 ELSE 0 END) AS BIGINT) FROM dx
UNION ALL SELECT 'drift_windows', 'end_after_start', CAST(sum(CASE WHEN window_end <= window_start THEN 1 ELSE 0 END) AS BIGINT) FROM dx
UNION ALL SELECT 'drift_windows', 'document_count', CAST(sum(CASE WHEN document_count < 0 THEN 1 ELSE 0 END) AS BIGINT) FROM dx
UNION ALL SELECT 'drift_windows', 'centroid_iff_documents',
          CAST(sum(CASE WHEN (document_count = 0) <> (centroid IS NULL) THEN 1 ELSE 0 END) AS BIGINT) FROM dx
UNION ALL SELECT 'drift_windows', 'unique_size_start', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
          FROM (SELECT count(*) AS n FROM dx GROUP BY window_size, window_start)
UNION ALL SELECT 'training_jobs', 'max_attempts', CAST(sum(CASE WHEN max_attempts < 1 THEN 1 ELSE 0 END) AS BIGINT) FROM jx
UNION ALL SELECT 'training_jobs', 'attempts_range',
          CAST(sum(CASE WHEN attempts < 0 OR attempts > max_attempts THEN 1 ELSE 0 END) AS BIGINT) FROM jx
UNION ALL SELECT 'training_jobs', 'unique_trigger_window', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
          FROM (SELECT count(*) AS n FROM jx GROUP BY trigger, window_id)
UNION ALL SELECT 'training_jobs', 'unique_model_version', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
          FROM (SELECT count(*) AS n FROM jx GROUP BY job_id)
UNION ALL SELECT 'training_linguistic_signals', 'weight_range',
          CAST(sum(CASE WHEN weight < 0 OR weight > 1 THEN 1 ELSE 0 END) AS BIGINT) FROM jx
UNION ALL SELECT 'training_linguistic_signals', 'unique_job_window', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
          FROM (SELECT count(*) AS n FROM jx GROUP BY job_id, window_id)""",
    "incoming_docs", "embedding_arrivals", "linguistic_windows", "model_events", "training_jobs"))
def constraint_audit(t):
    k = I.with_keys(FX.incoming_docs(t))
    hexd = "^[0-9a-f]{64}$"
    docs_rules = G.audit_rules(k, "documents", {
        "digest_format": ~F.col("idempotency_key").rlike(hexd) | ~F.col("content_hash").rlike(hexd),
        "non_empty_text": F.length("text") == 0})
    e = FX.embedding_arrivals(t)
    lw = FX.linguistic_windows(t)
    lx = lw.select("*", (F.col("composite_score") - 0.1).alias("entity_kl"), (F.col("composite_score") / 2).alias("topic"),
                   (F.col("composite_score") * 2).alias("pvalue"), F.lit(0.65).alias("threshold"))
    dx = t.events.select(F.lit("ONE_HOUR").alias("window_size"), F.col("ts").alias("window_start"),
                         (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("window_end"), (F.col("value") / 100).alias("score"),
                         F.lit(0.08).alias("threshold"), (F.col("value") - 1).alias("kl"), F.col("value").alias("w1"),
                         (F.col("event_id") % 5).alias("document_count"),
                         F.when(F.col("event_id") % 10 != 0, F.array(F.lit(1.0))).alias("centroid"))
    jx = FX.training_jobs(t).select("*", (F.col("job_id") % 5).alias("attempts"), (F.col("job_id") % 4).alias("max_attempts"),
                                    ((F.col("job_id") % 11) / 10.0).alias("weight"))

    def outside(c: str):
        return (F.col(c) < 0) | (F.col(c) > 1)

    raw_state = FX.model_events(t).groupBy("registry", "version").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"))
    parts = [
        docs_rules,
        G.audit_unique(k, "documents", ["idempotency_key"], "unique_idempotency_key"),
        G.audit_unique(k, "documents", ["source", "external_id"], "unique_source_external_id"),
        G.audit_rules(e, "embeddings", {"vector_width": F.size("vector") != 64}),
        G.audit_unique(e, "embeddings", ["document_id"], "unique_document"),
        G.audit_fk(e, FX.docs(t), "document_id", "id", "embeddings", "document_exists"),
        G.audit_rules(lw, "linguistic_windows", {
            "score_range": (F.col("composite_score") < 0) | (F.col("composite_score") > 1),
            "end_after_start": F.col("window_end") <= F.col("window_start")}),
        G.audit_unique(raw_state.filter(F.col("status") == "ACTIVE"), "model_versions", ["registry"],
                       "one_active_per_registry"),
        G.audit_unique(raw_state, "model_versions", ["registry", "version"], "unique_version"),
        G.audit_rules(raw_state, "model_versions", {"artifact_digest": ~F.sha2("version", 256).rlike(hexd)}),
        G.audit_rules(lx, "linguistic_windows", {
            "document_count": F.col("document_count") < 0, "entity_divergence": F.col("entity_kl") < 0,
            "topic_distance": F.col("topic") < 0, "pvalue_range": outside("pvalue"), "threshold_range": outside("threshold")}),
        G.audit_unique(lx, "linguistic_windows", ["window_start", "window_end"], "unique_start_end"),
        G.audit_rules(dx, "drift_windows", {
            "score_range": outside("score"), "threshold_range": outside("threshold"), "divergence": F.col("kl") < 0,
            "wasserstein": F.col("w1") < 0, "end_after_start": F.col("window_end") <= F.col("window_start"),
            "document_count": F.col("document_count") < 0,
            "centroid_iff_documents": (F.col("document_count") == 0) != F.col("centroid").isNull()}),
        G.audit_unique(dx, "drift_windows", ["window_size", "window_start"], "unique_size_start"),
        G.audit_rules(jx, "training_jobs", {
            "max_attempts": F.col("max_attempts") < 1,
            "attempts_range": (F.col("attempts") < 0) | (F.col("attempts") > F.col("max_attempts"))}),
        G.audit_unique(jx, "training_jobs", ["trigger", "window_id"], "unique_trigger_window"),
        G.audit_unique(jx, "training_jobs", ["job_id"], "unique_model_version"),
        G.audit_rules(jx, "training_linguistic_signals", {"weight_range": outside("weight")}),
        G.audit_unique(jx, "training_linguistic_signals", ["job_id", "window_id"], "unique_job_window"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("registry_state", operators=("G3",), sql=FX.with_fixtures("""
WITH cur AS (SELECT registry, version, status, ts AS status_ts FROM model_events
             QUALIFY row_number() OVER (PARTITION BY registry, version ORDER BY ts DESC, seq DESC) = 1),
act AS (SELECT registry, arg_max(version, epoch(status_ts)::VARCHAR || '|' || version) AS a FROM (
          SELECT * FROM cur WHERE status = 'ACTIVE'
          QUALIFY row_number() OVER (PARTITION BY registry ORDER BY status_ts DESC, version DESC) = 1) GROUP BY registry)
SELECT cur.registry, cur.version,
       CASE WHEN cur.status = 'ACTIVE' AND cur.version <> act.a THEN 'PASSED' ELSE cur.status END AS status
FROM cur LEFT JOIN act USING (registry)""", "model_events"))
def registry_state(t):
    return G.registry_state(FX.model_events(t)).select("registry", "version", "status")


@register("activation_history", operators=("W4",), sql=FX.with_fixtures("""
SELECT registry, version, ts AS activated_at,
       CASE WHEN lag(version) OVER w <> version THEN lag(version) OVER w END AS previous_version
FROM model_events WHERE status = 'ACTIVE'
WINDOW w AS (PARTITION BY registry ORDER BY ts, version)""", "model_events"))
def activation_history(t):
    return G.activation_history(FX.model_events(t)).select("registry", "version", "activated_at", "previous_version")


def _requests(t):
    ev = FX.model_events(t)
    return ev.filter(F.col("status") == "PASSED").select(
        "registry", "version", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))


@register("activation_events", operators=("G4",), sql=FX.with_fixtures("""
WITH req AS (SELECT registry, version, ts + INTERVAL 1 DAY AS ts FROM model_events WHERE status = 'PASSED'),
acts AS (SELECT registry, ats, max(version) AS prev_version FROM (
           SELECT registry, version, ts AS ats FROM model_events WHERE status = 'ACTIVE'
           UNION ALL SELECT registry, version, ts FROM req) GROUP BY registry, ats),
p AS (SELECT r.registry, r.version, r.ts, a.prev_version FROM req r
      ASOF LEFT JOIN acts a ON r.registry = a.registry AND r.ts > a.ats)
SELECT registry, version, 'ACTIVE' AS status, ts FROM p
UNION ALL
SELECT registry, prev_version, 'PASSED', ts FROM p WHERE prev_version IS NOT NULL AND prev_version <> version""",
    "model_events"))
def activation_events(t):
    return G.activation_events(_requests(t), FX.model_events(t)).select("registry", "version", "status", "ts")


@register("rollback_events", operators=("G4", "ST7", "G3"), sql="""
WITH d AS (SELECT user_id % 10 AS registry, 'v' || CAST(event_id AS VARCHAR) AS model_version,
                  lag('v' || CAST(event_id AS VARCHAR)) OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS previous_version,
                  ts, event_type = 'error' AS should_rollback FROM events)
SELECT registry, model_version AS version, 'ARCHIVED' AS status, ts FROM d WHERE should_rollback AND previous_version IS NOT NULL
UNION ALL SELECT registry, previous_version, 'ACTIVE', ts FROM d WHERE should_rollback AND previous_version IS NOT NULL""")
def rollback_events(t):
    """G4, rollback branch: failed versions are archived, the ones before them restored."""
    v = F.concat(F.lit("v"), F.col("event_id").cast("string"))
    e = t.events.select((F.col("user_id") % 10).alias("registry"), v.alias("model_version"), "event_id",
                        F.col("ts").alias("observed_at"), (F.col("event_type") == "error").alias("should_rollback"))
    w = Window.partitionBy("registry").orderBy("event_id")
    d = e.withColumn("previous_version", F.lag("model_version").over(w))
    return G.rollback_events(d).select("registry", "version", "status", "ts")


_MANIFEST = """'{"embedding_dim": ' || CAST(CASE WHEN p_partkey % 7 = 0 THEN 128 ELSE 64 END AS VARCHAR) ||
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE ', "onnx": {"uri": "s3://models/onnx/' || CAST(p_partkey AS VARCHAR) || '.onnx", "sha256": "' ||
  CASE WHEN p_partkey % 13 = 0 THEN sha256('other') ELSE sha256(p_name) END || '"' ||
  CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ', "kind": "encoder"' ELSE
    CASE WHEN p_partkey % 17 = 0 THEN ', "kind": "adapter"' ELSE ', "kind": "projection"' END END || '}' END || '}'"""


@register("artifact_audit", operators=("P16",), sql=f"""
WITH m AS (SELECT *, {_MANIFEST} AS body FROM part)
SELECT p_partkey AS version, array_to_string(list_filter([
  CASE WHEN p_partkey % 19 = 0 THEN 'missing_object' END,
  CASE WHEN p_partkey % 19 <> 0 AND p_partkey % 5 = 0 THEN 'digest_mismatch' END,
  CASE WHEN p_partkey % 19 <> 0 AND p_partkey % 7 = 0 THEN 'width_mismatch' END,
  CASE WHEN p_partkey % 19 <> 0 AND p_partkey % 11 = 0 THEN 'onnx_metadata_incomplete' END,
  CASE WHEN p_partkey % 19 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 3 = 2 AND p_partkey % 17 = 0 THEN 'unknown_kind' END,
  CASE WHEN p_partkey % 19 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 23 = 0 THEN 'missing_model' END,
  CASE WHEN p_partkey % 19 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 23 <> 0 AND p_partkey % 13 = 0 THEN 'model_digest_mismatch' END],
  lambda x: x IS NOT NULL), ',') AS problems FROM m""")
def artifact_audit(t):
    """P16 over manifests and model files written out of ``part``, with faults of every kind."""
    k = F.col("p_partkey")
    sha = F.when(k % 13 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("p_name", 256))
    kind = (F.when(k % 3 == 0, "").when(k % 3 == 1, ', "kind": "encoder"')
            .when(k % 17 == 0, ', "kind": "adapter"').otherwise(', "kind": "projection"'))
    onnx = F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(
        F.lit(', "onnx": {"uri": "s3://models/onnx/'), k.cast("string"), F.lit('.onnx", "sha256": "'), sha, F.lit('"'), kind, F.lit("}")))
    body = F.concat(F.lit('{"embedding_dim": '), F.when(k % 7 == 0, "128").otherwise("64"), onnx, F.lit("}"))
    p = t.part.select(k.alias("version"), F.col("p_name"), body.alias("body"))
    # Another bucket holds an object of the same key: only whole paths may match.
    uri = F.concat(F.lit("s3://models/manifests/"), F.col("version").cast("string"), F.lit(".json"))
    files = (p.filter(F.col("version") % 19 != 0).select(F.concat(F.lit("/store/models/manifests/"), F.col("version").cast("string"),
                                                                F.lit(".json")).alias("path"), F.col("body").cast("binary").alias("content"))
             .unionByName(p.select(F.concat(F.lit("/store/backup/manifests/"), F.col("version").cast("string"), F.lit(".json")).alias("path"),
                                   F.lit("{}").cast("binary").alias("content")))
             .unionByName(p.filter(F.col("version") % 23 != 0).select(
                 F.concat(F.lit("/store/models/onnx/"), F.col("version").cast("string"), F.lit(".onnx")).alias("path"),
                 F.col("p_name").cast("binary").alias("content"))))
    digest = F.when(F.col("version") % 5 == 0, F.sha2(F.lit("stale"), 256)).otherwise(F.sha2("body", 256))
    reg = p.select("version", uri.alias("artifact_uri"), digest.alias("sha256"))
    return G.audit_artifacts(reg, files, 64, "/store").select("version", F.array_join("problems", ",").alias("problems"))


@register("decision_audit", operators=("E9",), sql="""
WITH m AS (SELECT CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'baseline' ELSE 'm' || CAST(o_orderkey AS VARCHAR) END AS version,
             CASE o_orderstatus WHEN 'F' THEN 'PASSED' WHEN 'O' THEN 'REJECTED' ELSE 'TRAINING' END AS status,
             CASE WHEN o_custkey % 5 <> 0 THEN (o_custkey % 40) / 100.0 - 0.1 END AS improvement,
             CASE WHEN o_custkey % 9 = 0 THEN 0.0 WHEN o_custkey % 9 = 1 THEN NULL ELSE 0.5 END AS baseline_quality,
             CASE WHEN o_custkey % 9 <= 1 THEN 0.0 ELSE 0.6 END AS candidate_quality FROM orders),
c AS (SELECT *, baseline_quality IS NOT DISTINCT FROM 0.0 AND candidate_quality = 0.0
             OR baseline_quality IS NULL AND candidate_quality = 0.0 AS zero, status = 'PASSED' AS up FROM m WHERE version <> 'baseline')
SELECT 'model' AS entity, version AS id, 'decided_not_evaluated' AS rule FROM c WHERE status IN ('PASSED', 'REJECTED') AND zero
UNION ALL SELECT 'model', version, 'promoted_without_gain' FROM c WHERE up AND NOT zero AND NOT improvement > 0.10
UNION ALL SELECT 'model', version, 'rejected_with_gain' FROM c WHERE status = 'REJECTED' AND NOT zero AND improvement > 0.10
UNION ALL SELECT 'job', CAST(o_orderkey AS VARCHAR), 'failed_job' FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'serving', 'baseline', 'promoted_not_served' WHERE (SELECT count(*) FROM c WHERE up) > 0""")
def decision_audit(t):
    """E9 over model decisions derived from orders; traffic is served by the baseline."""
    o = t.orders
    first = o.agg(F.min("o_orderkey").alias("k")).select("k").scalar()
    cust = F.col("o_custkey")
    models = o.select("*", first.alias("_first")).select(
        F.when(F.col("o_orderkey") == F.col("_first"), "baseline").otherwise(F.concat(F.lit("m"), F.col("o_orderkey").cast("string"))).alias("version"),
        F.when(F.col("o_orderstatus") == "F", "PASSED").when(F.col("o_orderstatus") == "O", "REJECTED").otherwise("TRAINING").alias("status"),
        F.when(cust % 5 != 0, (cust % 40) / 100.0 - 0.1).alias("improvement"),
        F.when(cust % 9 == 0, 0.0).when(cust % 9 != 1, 0.5).alias("baseline_quality"),
        F.when(cust % 9 <= 1, 0.0).otherwise(0.6).alias("candidate_quality"))
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "P", "FAILED").otherwise("SUCCEEDED").alias("status"))
    served = o.agg(F.lit("baseline").alias("served_version"))
    return G.audit_decisions(models, jobs, FX.linguistic_windows(t), served)


@register("latest_jobs", operators=("T1",), sql=FX.with_fixtures("""
SELECT job_id, queued_at, status FROM training_jobs ORDER BY queued_at DESC, job_id DESC LIMIT 20""", "training_jobs"))
def latest_jobs(t):
    return G.latest(FX.training_jobs(t), "queued_at", 20, tie="job_id").select("job_id", "queued_at", "status")


@register("linguistic_summary", operators=("T3",), sql=FX.with_fixtures("""
SELECT count(*) AS window_count, arg_max(window_start, window_end) AS latest_window_start,
       max(window_end) AS latest_window_end, arg_max(composite_score, window_end) AS latest_composite_score
FROM linguistic_windows""", "linguistic_windows"))
def linguistic_summary(t):
    return G.linguistic_summary(FX.linguistic_windows(t))


@register("job_lookup", operators=("T4",), sql=FX.with_fixtures("""
SELECT job_id, trigger, status, queued_at FROM training_jobs WHERE job_id = 7""", "training_jobs"))
def job_lookup(t):
    return G.lookup(FX.training_jobs(t), "job_id", 7).select("job_id", "trigger", "status", "queued_at")


@register("totals", operators=("A4",), sql=FX.with_fixtures("""
SELECT (SELECT count(*) FROM documents) AS total_documents, (SELECT count(*) FROM embeddings) AS total_embeddings,
       (SELECT count(*) FROM linguistic_windows) AS linguistic_windows""", "linguistic_windows"))
def totals(t):
    lw = FX.linguistic_windows(t)
    return lw.agg(F.count("*").alias("linguistic_windows")).select(
        t.documents.select(F.count("*")).scalar().alias("total_documents"),
        t.embeddings.select(F.count("*")).scalar().alias("total_embeddings"), "linguistic_windows")
