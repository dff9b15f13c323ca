"""Structured Streaming: batch = stream (ST1), idempotent sink (ST6), late rows (ST4),
live stateful rollback (ST7) and throttle (ST8), archive (S3)."""

import os
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from embdrift import config
from embdrift.operators.drift import bootstrap_baseline
from embdrift.operators.windows import drift_windows
from embdrift.sources import fixtures as FX
from embdrift.sources.tables import Tables
from embdrift.streaming import drift_stream as DS
from embdrift.streaming import stateful as SS

SF = "/root/testdata/sf0.001"


def _arrivals(spark, tmp):
    emb = FX.embedding_arrivals_shifted(Tables(spark, SF)).select("document_id", "first_embedded_at", "vector")
    src = os.path.join(tmp, "arrivals")
    emb.repartition(4).write.parquet(src)
    return emb, src


def test_stream_equals_batch_for_closed_windows(spark, tmp):
    emb, src = _arrivals(spark, tmp)
    stream = DS.file_stream(spark, src, emb.schema)
    base = bootstrap_baseline(emb)
    out, ck = os.path.join(tmp, "windows"), os.path.join(tmp, "ck")
    q = DS.start_drift_stream(stream, base, out, ck)
    q.awaitTermination()
    got = spark.read.parquet(out)
    batch = drift_windows(emb, 40)
    last = batch.agg(F.max("window_start")).collect()[0][0]
    want = batch.filter(F.col("window_start") < last)  # the open window is held back by the watermark
    g = sorted((r.window_start, r.document_count) for r in got.collect())
    w = sorted((r.window_start, r.document_count) for r in want.collect())
    assert g == w
    # ST6: replaying from a fresh checkpoint appends nothing new
    q2 = DS.start_drift_stream(DS.file_stream(spark, src, emb.schema), base, out, os.path.join(tmp, "ck2"))
    q2.awaitTermination()
    assert spark.read.parquet(out).count() == len(g)


def test_late_rows_dropped_and_counted(spark, tmp):
    schema = "first_embedded_at timestamp, vector array<double>"
    src = os.path.join(tmp, "late")
    d1 = spark.createDataFrame([(datetime(2024, 1, 1, 0, s // 60, s % 60), [1.0, 0.0]) for s in (1, 50, 90)], schema)
    d1.write.mode("append").parquet(src)
    late = DS.LateRows()
    spark.streams.addListener(late)
    stream = DS.file_stream(spark, src, d1.schema, max_files=1)
    q = (DS.drift_windows_stream(stream, 40).writeStream.outputMode("append").format("memory")
         .queryName("late_windows").option("checkpointLocation", os.path.join(tmp, "ck")).start())
    q.processAllAvailable()
    spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 2), [0.0, 1.0])], schema).write.mode("append").parquet(src)
    q.processAllAvailable()
    run = str(q.runId)
    q.stop()
    deadline = time.time() + 20  # progress events arrive on another thread
    while late.dropped.get(run, 0) < 1 and time.time() < deadline:
        time.sleep(0.2)
    spark.streams.removeListener(late)
    assert late.dropped[run] >= 1
    rows = spark.sql("SELECT * FROM late_windows").collect()
    assert all(r.document_count == 1 for r in rows)


def test_live_rollback_clears_after_rollback(spark, tmp):
    src = os.path.join(tmp, "metrics")
    rows = [("v2", 503 if i < 60 else 200, datetime(2024, 1, 1, 0, i // 60, i % 60)) for i in range(120)]
    spark.createDataFrame(rows, "model_version string, status_code int, observed_at timestamp").write.parquet(src)
    stream = DS.file_stream(spark, src, "model_version string, status_code int, observed_at timestamp")
    pol = config.RollbackPolicy(error_rate_threshold=0.05, window_seconds=300, min_requests=50)
    out = SS.rollback_stream(stream, {"v2": "v1"}, pol)
    q = out.writeStream.outputMode("append").format("memory").queryName("rb").option(
        "checkpointLocation", os.path.join(tmp, "ck")).start()
    q.processAllAvailable()
    q.stop()
    res = spark.sql("SELECT * FROM rb ORDER BY evaluated_at").collect()
    reasons = [r.reason for r in res]
    first = reasons.index("error_rate_exceeded")
    assert first == 49  # 50th request: 50 errors of 50
    assert reasons[first + 1] == "insufficient_requests"  # ring cleared after the rollback


def test_live_throttle_accepted_alert_becomes_history(spark, tmp):
    src = os.path.join(tmp, "alerts")
    rows = [("t", i, datetime(2024, 1, 1, 10 + i, 0, 0), 500, 0.5, None) for i in range(3)]
    spark.createDataFrame(rows, "tenant string, window_id long, now timestamp, document_count long, "
                                "embedding_drift double, linguistic_drift double").write.parquet(src)
    stream = DS.file_stream(spark, src, "tenant string, window_id long, now timestamp, document_count long, "
                                        "embedding_drift double, linguistic_drift double")
    q = SS.throttle_stream(stream).writeStream.outputMode("append").format("memory").queryName("th").option(
        "checkpointLocation", os.path.join(tmp, "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.window_id: r.reason for r in spark.sql("SELECT * FROM th").collect()}
    assert got == {0: "accepted", 1: "cooldown_active", 2: "cooldown_active"}


def test_archive_stream_partitions_by_source(spark, tmp):
    src = os.path.join(tmp, "events")
    spark.createDataFrame([("d1", "hello", "s1", "2024-01-01T00:00:00Z", None)],
                          "document_id string, text string, source string, timestamp string, metadata string"
                          ).write.json(src)
    from embdrift.sources.io import read_document_stream
    stream = read_document_stream(spark, "json", src)
    out = os.path.join(tmp, "archive")
    DS.start_archive_stream(stream, out, os.path.join(tmp, "ck")).awaitTermination()
    rows = spark.read.json(out)
    assert rows.count() == 1 and rows.first()["source"] == "s1"
    # the same batches once more, from a fresh checkpoint: the same files again, nothing doubled
    DS.start_archive_stream(stream, out, os.path.join(tmp, "ck2")).awaitTermination()
    assert spark.read.json(out).count() == 1


def test_live_rollback_orders_large_groups(spark, tmp):
    """12,000 shuffled requests of one version, one a second, in one batch: frames as in batch form."""
    from embdrift.operators.policy import rollback_decisions
    import random
    n = 12_000
    rows = [("v2", 503 if i % 40 == 0 else 200, datetime(2024, 1, 1) + timedelta(seconds=i), i) for i in range(n)]
    random.Random(3).shuffle(rows)
    schema = "model_version string, status_code int, observed_at timestamp, request_id long"
    src = os.path.join(tmp, "metrics")
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(src)
    pol = config.RollbackPolicy(error_rate_threshold=0.5, window_seconds=300, min_requests=5)
    q = SS.rollback_stream(DS.file_stream(spark, src, schema), {"v2": "v1"}, pol).writeStream.outputMode("append").format(
        "memory").queryName("rb_large").option("checkpointLocation", os.path.join(tmp, "ck")).start()
    q.processAllAvailable()
    q.stop()
    prev = spark.createDataFrame([("v2", "v1")], "version string, previous_version string")
    want = {r.observed_at: (r.request_count, round(r.error_rate, 9)) for r in rollback_decisions(df, prev, pol).collect()}
    got = {r.evaluated_at: (r.request_count, round(r.error_rate, 9)) for r in spark.sql("SELECT * FROM rb_large").collect()}
    assert got == want and len(got) == n


def test_batch_folder_is_replaced_on_replay(spark, tmp):
    out = os.path.join(tmp, "alerts")
    b = spark.createDataFrame([("k", "v1")], "key string, value string")
    DS.overwrite_batch(b, out, 0)
    DS.overwrite_batch(b, out, 1)
    DS.overwrite_batch(b, out, 1)
    assert spark.read.parquet(out).count() == 2
