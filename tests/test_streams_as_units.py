"""Ingest as one unit, alerts that cool the next ones, chained window aggregates, message decoding."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from embdrift import config
from embdrift.operators import policy as P
from embdrift.operators.windows import drift_windows
from embdrift.sources.io import DOCUMENT_EVENT, decode_messages, read_document_stream
from embdrift.streaming import drift_stream as DS
from embdrift.streaming import ingest_stream as IS


def event(i, text="some text", source="s", ts="2024-03-01T10:00:00Z", metadata=None):
    return {"document_id": i, "text": text, "source": source, "timestamp": ts, "metadata": metadata}


def put(path, name, events):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join(json.dumps(e) for e in events))


def run_ingest(spark, base, checkpoint="ck", **kw):
    counts = []
    stream = read_document_stream(spark, "json", os.path.join(base, "in"), {"maxFilesPerTrigger": "1"})
    for q in IS.start_ingest_stream(stream, *[os.path.join(base, d) for d in ("table", "archive", "bloom", checkpoint)],
                                    rejected=os.path.join(base, f"bad-{checkpoint}"), progress=lambda k, n: counts.append((k, n)), **kw):
        q.awaitTermination()
    return counts


def test_ingest_keeps_the_first_and_archives_before_it_stores(spark, tmp):
    put(f"{tmp}/in", "a.json", [event("1", "late", ts="2024-03-01T12:00:00Z"), event("1", "first"), event("2"), event("2", source="t"), event("")])
    put(f"{tmp}/in", "b.json", [event("1", "again", ts="2024-02-01T10:00:00Z"), event("3", metadata='{"a": 1}'), event("4", text="")])
    counts = run_ingest(spark, tmp)
    table = spark.read.parquet(f"{tmp}/table")
    got = {(r.source, r.document_id): r.text for r in table.collect()}
    assert set(got) == {("s", "1"), ("s", "2"), ("t", "2"), ("s", "3")} and got["s", "1"] in ("first", "again")
    assert table.count() == 4 and sum(n["new"] for _, n in counts) == 4
    archived = spark.read.json(f"{tmp}/archive")
    assert {r.object_key for r in archived.collect()} == {r.object_key for r in table.collect()} and archived.count() == 4
    assert all(json.loads(r.payload)["document_id"] for r in archived.collect())
    assert sorted(r.reasons for r in spark.read.parquet(f"{tmp}/bad-ck").collect()) == [["empty_document_id"], ["empty_text"]]
    # Late copies, from a fresh checkpoint whose state knows nothing: the filter and the table keep them out.
    put(f"{tmp}/in", "c.json", [event("1", "copy"), event("9")] + [event(f"n{k}") for k in range(50)])
    counts = run_ingest(spark, tmp, "ck2")
    rows, looked_up, new = (sum(n[c] for _, n in counts) for c in ("rows", "looked_up", "new"))
    assert new == 51 and rows == 55 and looked_up <= 4 + 3  # only keys that the filter knows are looked up
    after = spark.read.parquet(f"{tmp}/table")
    assert after.groupBy("source", "document_id").count().filter("count > 1").count() == 0
    assert {r.text for r in after.filter("document_id = '1'").collect()} == {got["s", "1"]}


def test_replayed_batch_replaces_itself(spark, tmp):
    paths = [f"{tmp}/{d}" for d in ("table", "archive", "bloom")]
    rows = spark.createDataFrame([("s", str(k), datetime(2024, 3, 1), json.dumps(event(str(k)))) for k in range(20)],
                                 "source string, document_id string, occurred_at timestamp, payload string")
    first = IS.store_batch(spark, rows, 0, *paths)
    again = IS.store_batch(spark, rows, 0, *paths)  # as if the write had failed before the commit
    assert first["new"] == again["new"] == 20 and spark.read.parquet(paths[0]).count() == 20
    assert spark.read.json(paths[1]).count() == 20
    later = IS.store_batch(spark, rows, 1, *paths)
    assert later == {"rows": 20, "looked_up": 20, "new": 0} and spark.read.parquet(paths[0]).count() == 20


def test_archive_comes_first(spark, tmp, monkeypatch):
    paths = [f"{tmp}/{d}" for d in ("table", "archive", "bloom")]
    rows = spark.createDataFrame([("s", "1", datetime(2024, 3, 1), json.dumps(event("1")))],
                                 "source string, document_id string, occurred_at timestamp, payload string")

    def broken(*a, **kw):
        raise OSError("object store is away")

    monkeypatch.setattr(IS, "archive_raw", broken)
    with pytest.raises(OSError):
        IS.store_batch(spark, rows, 0, *paths)
    assert not os.path.exists(paths[0])  # no row without its archive


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("_k"))
    words = {r.word: r.bits for r in IS.bloom_bits(keys, 1 << 15, 5).collect()}
    known = keys.filter(IS.maybe_stored(F.col("_k"), words, 1 << 15, 5)).count()
    other = spark.range(3000, 6000).select(F.sha2(F.col("id").cast("string"), 256).alias("_k"))
    wrong = other.filter(IS.maybe_stored(F.col("_k"), words, 1 << 15, 5)).count()
    assert known == 3000 and wrong < 150


def test_messages_are_decoded(spark):
    rows = [(b"k1", json.dumps(event("1", metadata='{"a": 1}')).encode()), (b"k2", b"no json"), (None, json.dumps({"document_id": "2"}).encode()), (b"k4", None)]
    got = decode_messages(spark.createDataFrame(rows, "key binary, value binary")).collect()
    assert [f.name for f in DOCUMENT_EVENT] == list(got[0].asDict())[1:]
    assert [(r.key, r.document_id, r.text) for r in got] == [("k1", "1", "some text"), ("k2", None, None), (None, "2", None), ("k4", None, None)]


def test_two_close_breaches_give_one_alert(spark, tmp):
    """Breaches 10 minutes apart, in one batch and over two: the first one cools the others down."""
    schema = "document_id long, first_embedded_at timestamp, vector array<double>"
    start = datetime(2024, 3, 1, 10)
    base = spark.createDataFrame([("b", [1.0, 0.0], 100)], "baseline_id string, centroid array<double>, document_count long")
    jobs = spark.createDataFrame([], "job_id long, window_id long, trigger string, status string, queued_at timestamp")
    ling = spark.createDataFrame([], "window_start timestamp, window_end timestamp, composite_score double")
    src = f"{tmp}/vectors"
    minutes = {"0": (0, 10), "1": (20, 30), "2": (8 * 60, 8 * 60 + 1)}  # the last one is past the cooldown
    for name, at in minutes.items():
        rows = [(k, start + timedelta(minutes=m, seconds=k), [0.0, 1.0]) for m in at for k in range(20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(0, start + timedelta(days=1), [1.0, 0.0])], schema).coalesce(1).write.mode("append").parquet(src)
    pol = config.ThrottlePolicy(min_documents=5, cooldown_hours=6.0, max_daily_trains=5)

    def run(out, ck, files):
        stream = DS.file_stream(spark, src, schema, max_files=files)
        DS.start_alert_stream(stream, base, jobs, ling, f"{tmp}/{out}", f"{tmp}/{ck}", policy=pol).awaitTermination()
        return sorted(int(json.loads(r.value)["window_id"]) for r in spark.read.parquet(f"{tmp}/{out}").collect())

    in_order = run("one", "ck1", None)
    assert len(in_order) == 2 and in_order[1] - in_order[0] > 6 * 3600
    assert run("many", "ck2", 1) == in_order


def test_sequence_equals_the_live_form(spark, tmp):
    from embdrift.streaming import stateful as SS
    alerts = [("t", i, datetime(2024, 3, 1) + timedelta(minutes=97 * i), 50 if i % 11 == 0 else 500, 0.01 * (i % 13), 0.9 if i % 5 == 0 else None)
              for i in range(150)] + [("t", 500, datetime(2024, 3, 1), 500, 0.5, None)] * 2
    schema = "tenant string, window_id long, now timestamp, document_count long, embedding_drift double, linguistic_drift double"
    df = spark.createDataFrame(alerts, schema)
    jobs = spark.createDataFrame([], "job_id long, trigger string, queued_at timestamp")
    got = sorted((r.window_id, r.now, r.reason, r.priority) for r in P.throttle_sequence(df.repartition(3), jobs, tenant_col="tenant").withColumn(
        "priority", F.coalesce("priority", F.lit(""))).collect())
    df.coalesce(1).write.parquet(f"{tmp}/alerts")
    q = SS.throttle_stream(DS.file_stream(spark, f"{tmp}/alerts", schema)).writeStream.outputMode("append").format("memory").queryName("seq").option(
        "checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    live = sorted((r.window_id, r.reason, r.priority or "") for r in spark.sql("SELECT * FROM seq").collect())
    assert sorted((w, r, p) for w, _, r, p in got) == live and sum(r[2] == "accepted" for r in got) > 10


def test_sliding_windows_count_each_row_once(spark, tmp):
    schema = "first_embedded_at timestamp, vector array<double>"
    rows = [(datetime(2024, 3, 1) + timedelta(seconds=7 * k), [float(k % 5), 1.0]) for k in range(600)]
    df = spark.createDataFrame(rows, schema)
    df.orderBy("first_embedded_at").coalesce(1).write.parquet(f"{tmp}/in")
    end = spark.createDataFrame([(datetime(2024, 3, 3), [0.0, 0.0])], schema)
    end.coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    stream = DS.file_stream(spark, f"{tmp}/in", schema, max_files=1)
    q = DS.drift_windows_stream(stream, 600, 60).writeStream.outputMode("append").format("memory").queryName("slid").option(
        "checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.window_start: (r.document_count, [round(x, 9) for x in r.centroid]) for r in drift_windows(df, 600, 60).collect()}
    got = {r.window_start: (r.document_count, [round(x, 9) for x in r.centroid]) for r in spark.sql("SELECT * FROM slid").collect()}
    assert got == want
    inputs = sum(p["numInputRows"] for p in q.recentProgress)
    panes = max(p["stateOperators"][-1]["numRowsTotal"] + p["stateOperators"][-1]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"])
    assert inputs == 601 and panes <= 2 * (600 * 7 // 60 + 2)  # the first aggregate holds panes, not rows x 10
