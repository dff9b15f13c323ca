"""Repeated keys, ties and nulls in as-of joins, counts, deduplication and upserts."""

import glob
import os
from datetime import datetime

from pyspark.sql import functions as F

from embdrift.operators import ingest as I
from embdrift.operators import policy as P


def at(hour, day=1):
    return datetime(2024, 3, day, hour)


def jobs(spark):
    return spark.createDataFrame([(1, at(0)), (2, at(4)), (3, at(23)), (4, None)], "job_id long, queued_at timestamp")


def test_asof_of_repeated_and_null_keys_takes_each_rows_own_time(spark):
    left = spark.createDataFrame([(7, at(1)), (7, at(5)), (7, at(5)), (None, at(4)), (None, at(3)), (8, at(0, 2)), (9, None), (10, datetime(2024, 2, 1))],
                                 "window_id long, now timestamp").withColumn("last", F.lit("old"))
    got = P.asof_last(left, jobs(spark), "window_id", "now", "queued_at", "job_id", out="last", out_ts="last_ts").collect()
    assert sorted(((r.window_id, r.now, r["last"], r.last_ts) for r in got), key=repr) == sorted([
        (7, at(1), 1, at(0)), (7, at(5), 2, at(4)), (7, at(5), 2, at(4)), (None, at(4), 2, at(4)), (None, at(3), 1, at(0)),
        (8, at(0, 2), 3, at(23)), (9, None, None, None), (10, datetime(2024, 2, 1), None, None)], key=repr)


def test_count_since_midnight_of_repeated_and_null_keys(spark):
    left = spark.createDataFrame([(7, at(1)), (7, at(5)), (None, at(5)), (7, at(5)), (8, at(1, 2)), (9, None)], "window_id long, now timestamp")
    got = P.count_since_midnight(left, jobs(spark), "window_id", "now", "queued_at", out="n").collect()
    assert sorted(((r.window_id, r.now, r.n) for r in got), key=repr) == sorted(
        [(7, at(1), 1), (7, at(5), 2), (None, at(5), 2), (7, at(5), 2), (8, at(1, 2), 0), (9, None, None)], key=repr)


def test_admission_of_a_redelivered_alert(spark):
    alerts = spark.createDataFrame([(7, at(1)), (7, at(1)), (7, at(12)), (8, at(12))], "window_id long, now timestamp")
    done = spark.createDataFrame([(1, 7, "DRIFT_ALERT", "SUCCEEDED", at(2)), (2, 7, "DRIFT_ALERT", "SUCCEEDED", at(3))],
                                 "job_id long, window_id long, trigger string, status string, queued_at timestamp")
    got = P.admit_training(alerts, done).collect()
    assert sorted((r.window_id, r.now, r.reason) for r in got) == [
        (7, at(1), "window_has_job"), (7, at(1), "window_has_job"), (7, at(12), "window_has_job"), (8, at(12), "accepted")]


def test_text_copies_keep_nulls_apart(spark):
    rows = [(1, "a", None), (2, None, "a"), (3, "a", None), (4, "a", "b"), (5, "ab", ""), (6, None, None), (7, "", ""), (8, None, None), (None, "a", None)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    assert sorted(r.id for r in I.dedup_text(df, ("text", "label")).collect()) == [1, 2, 4, 5, 6, 7]
    tied = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "z"), (1, "b", "z")], "id long, text string, label string")
    got = sorted(map(tuple, I.dedup_text(tied).collect()))
    assert len(got) == 2 and got[1] == (1, "b", "z") and got[0] in ((1, "a", "x"), (1, "a", "y"))
    assert got == sorted(map(tuple, I.dedup_text(tied.repartition(3)).collect()))  # the same choice every time


def test_first_arrival_with_ties_and_nulls(spark):
    rows = [("s", "1", 5, "late"), ("s", "1", 3, "x"), ("s", "1", 3, "y"), (None, "1", 1, "null source"), (None, "1", 2, "again"),
            ("s", None, 1, "null id"), ("s:1", "", 1, "other key"), ("s", "9", 1, "stored"), ("t", "2", None, "no arrival")]
    df = spark.createDataFrame(rows, "source string, external_id string, arrival long, text string")
    stored = spark.createDataFrame([("s", "9"), ("q", None)], "source string, external_id string")
    got = {(r.source, r.external_id): r.text for r in I.dedup_documents(df, stored).collect()}
    assert got.pop(("s", "1")) in "xy"
    assert got == {(None, "1"): "null source", ("s", None): "null id", ("s:1", ""): "other key", ("t", "2"): "no arrival"}
    again = spark.createDataFrame([("s", None)], "source string, external_id string")
    assert ("s", None) not in {(r.source, r.external_id) for r in I.dedup_documents(df, again).collect()}


def test_upsert_takes_the_last_update_of_a_key(spark):
    base = spark.createDataFrame([(1, "a", 10), (None, "n", 11)], "k long, v string, first long")
    updates = spark.createDataFrame([(1, "b", 5, 1), (1, "c", 6, 2), (2, "x", 7, 2), (2, "y", 8, 1), (None, "m", 9, 1), (3, "t", 1, 1), (3, "u", 1, 1)],
                                    "k long, v string, first long, at long")
    got = {r.k: (r.v, r.first) for r in I.upsert(base, updates, ["k"], keep=["first"], order=["at"]).collect()}
    assert got.pop(3) in (("t", 1), ("u", 1))
    assert got == {1: ("c", 10), 2: ("x", 7), None: ("m", 11)}
    assert I.upsert(base, updates, ["k"]).count() == 4


def test_upsert_table_rewrites_touched_buckets_only(spark, tmp):
    path = os.path.join(tmp, "table")
    rows = [(k, f"v{k}", 0) for k in range(200)] + [(None, "null key", 0)]
    first = spark.createDataFrame(rows, "k long, v string, first long")
    assert I.upsert_table(spark, path, first, ["k"], keep=["first"], buckets=16)

    def files():
        return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}

    before = files()
    assert I.upsert_table(spark, path, first, ["k"], keep=["first"], buckets=16) == [] and files() == before
    updates = spark.createDataFrame([(5, "new", 9), (5, "v5", 9), (1000, "more", 9), (None, "null key", 9), (7, "v7", 9)], "k long, v string, first long")
    touched = I.upsert_table(spark, path, updates.withColumn("v", F.when(F.col("k") == 5, "new").otherwise(F.col("v"))), ["k"], keep=["first"], buckets=16)
    assert 1 <= len(touched) <= 2
    after = files()
    kept = [f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched]
    assert len(kept) >= 14 and all(after.get(f) == before[f] for f in kept)
    got = {r.k: (r.v, r.first) for r in spark.read.parquet(path).collect()}
    assert got == {**{k: (v, 0) for k, v, _ in rows}, 5: ("new", 0), 1000: ("more", 9)}
