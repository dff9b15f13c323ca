"""E9 decision audit, P16 artifact audit, S2 corpus reader, S6 report sink, ST10 alert stream."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from embdrift.operators import governance as G
from embdrift.sources import io as IO


MODEL = ("version string, status string, improvement double, baseline_quality double, candidate_quality double")


def _audit(spark, models, served, docs=5):
    jobs = spark.createDataFrame([(1, "FAILED"), (2, "SUCCEEDED")], "job_id long, status string")
    wins = spark.createDataFrame([(10, 0), (11, docs)], "window_id long, document_count long")
    s = spark.createDataFrame([(served,)], "served_version string")
    return {(r.entity, r.id, r.rule) for r in G.audit_decisions(spark.createDataFrame(models, MODEL), jobs, wins, s).collect()}


def test_audit_decisions(spark):
    models = [("baseline", "ACTIVE", None, None, None), ("m1", "ACTIVE", 0.2, 0.5, 0.6), ("m2", "PASSED", 0.05, 0.5, 0.52),
              ("m3", "REJECTED", 0.3, 0.4, 0.52), ("m4", "PASSED", 0.0, 0.0, 0.0), ("m5", "REJECTED", None, None, None)]
    wrong = {("model", "m2", "promoted_without_gain"), ("model", "m3", "rejected_with_gain"),
             ("model", "m4", "decided_not_evaluated"), ("job", "1", "failed_job")}
    assert _audit(spark, models, "m1") == wrong
    assert _audit(spark, models, "m2") == wrong | {("serving", "m2", "served_without_gain")}
    assert _audit(spark, models, "baseline", docs=0) == wrong | {("serving", "baseline", "promoted_not_served"),
                                                                 ("window", "all", "no_window_analysed")}


def test_audit_baseline_serves_when_nothing_was_promoted(spark):
    models = [("baseline", "ACTIVE", None, None, None), ("m1", "REJECTED", 0.01, 0.5, 0.505)]
    assert _audit(spark, models, "baseline") == {("job", "1", "failed_job")}
    assert ("serving", "m1", "baseline_not_served") in _audit(spark, models, "m1")


def test_audit_artifacts(spark, tmp):
    def put(bucket, key, data):
        p = os.path.join(tmp, bucket, key)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(data)
        return hashlib.sha256(data).hexdigest()

    model = put("models", "m1/model.onnx", b"weights")

    def manifest(bucket, name, dim=64, **onnx):
        onnx = {"uri": "s3://models/m1/model.onnx", "sha256": model} | onnx
        return put(bucket, f"{name}/manifest.json", json.dumps({"embedding_dim": dim, "onnx": onnx}).encode())

    rows = [("m1", "s3://models/m1/manifest.json", manifest("models", "m1")),
            ("m2", "s3://models/m2/manifest.json", manifest("models", "m2", 32, kind="adapter")),
            ("m3", "s3://models/m3/manifest.json", manifest("other", "m3")),  # the object lies in another bucket
            ("m4", "s3://models/m4/manifest.json", manifest("models", "m4", kind="projection", sha256="0" * 64)),
            ("m5", "s3://models/m5/manifest.json", put("models", "m5/manifest.json", b"[1]"))]
    reg = spark.createDataFrame(rows, "version string, artifact_uri string, sha256 string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tmp)
    got = {r.version: set(r.problems) for r in G.audit_artifacts(reg, files, 64, f"file:{tmp}").collect()}
    assert got == {"m1": set(), "m2": {"width_mismatch", "unknown_kind"}, "m3": {"missing_object"},
                   "m4": {"model_digest_mismatch"}, "m5": {"manifest_not_an_object"}}


def test_rollback_archives_and_restores(spark):
    from datetime import datetime
    t0 = datetime(2024, 1, 1)
    d = spark.createDataFrame([("r", "v2", "v1", t0, True), ("r", "v3", None, t0, True), ("r", "v1", "v0", t0, False)],
                              "registry string, model_version string, previous_version string, observed_at timestamp, should_rollback boolean")
    assert {(r.version, r.status) for r in G.rollback_events(d).collect()} == {("v2", "ARCHIVED"), ("v1", "ACTIVE")}


def test_read_corpus_and_report(spark, tmp):
    paths = []
    for i, rows in enumerate([[{"text": "a b c", "label_text": "x"}], [{"text": "d e", "label_text": "y"}]]):
        p = os.path.join(tmp, f"c{i}.jsonl")
        with open(p, "w") as f:
            for r in rows:
                f.write(json.dumps(r) + "\n")
        paths.append(p)
    df = IO.read_corpus(spark, paths)
    assert sorted(r.label_text for r in df.collect()) == ["x", "y"]
    out = os.path.join(tmp, "report")
    IO.write_report(df.groupBy("label_text").count(), out)
    assert len([f for f in os.listdir(out) if f.endswith(".json")]) == 1


def test_alert_stream_end_to_end(spark, tmp):
    from datetime import datetime
    from embdrift.streaming import drift_stream as DS
    # 150 vectors in one domain, then 150 in another: windows after the shift breach
    rows = [(datetime.fromtimestamp(1704067200 + i), [1.0, 0.05 * (i % 3)] if i < 150 else [0.05 * (i % 3), 1.0])
            for i in range(300)]
    src = os.path.join(tmp, "vec")
    emb = spark.createDataFrame(rows, "first_embedded_at timestamp, vector array<double>")
    emb.write.parquet(src)
    from embdrift.operators.drift import bootstrap_baseline
    base = bootstrap_baseline(emb.withColumn("document_id", F.monotonically_increasing_id()))
    jobs = spark.createDataFrame([(1, "MANUAL", "SUCCEEDED", datetime(2023, 1, 1))],
                                 "job_id long, trigger string, status string, queued_at timestamp")
    ling = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 2), 0.7)],
                                 "window_start timestamp, window_end timestamp, composite_score double")
    out = os.path.join(tmp, "alerts")
    from embdrift import config
    pol = config.ThrottlePolicy(min_documents=10, cooldown_hours=0.0, max_daily_trains=100)
    q = DS.start_alert_stream(DS.file_stream(spark, src, emb.schema), base, jobs, ling, out,
                              os.path.join(tmp, "ck"), policy=pol)
    q.awaitTermination()
    got = [json.loads(r.value) for r in spark.read.parquet(out).collect()]
    assert got and all(a["priority"] == "dual_signal_high" and a["linguistic_drift_score"] == 0.7 for a in got)
    assert all(a["drift_score"] > 0.08 for a in got)
