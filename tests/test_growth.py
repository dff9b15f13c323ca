"""Operators whose cost must follow their input: what is shuffled, held and repeated."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from embdrift import config
from embdrift.operators import policy as P

T0 = datetime(2024, 3, 1)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rollback_frames_are_running_sums(spark):
    rng = random.Random(4)
    rows = [(i, f"v{i % 2}", rng.choice([200, 200, 503, None]), T0 + timedelta(seconds=rng.randrange(0, 400)) if i % 9 else None)
            for i in range(300)]
    m = spark.createDataFrame(rows, "request_id long, model_version string, status_code int, observed_at timestamp")
    act = spark.createDataFrame([("v0", None), ("v1", "v0")], "version string, previous_version string")
    pol = config.RollbackPolicy(window_seconds=30, min_requests=1)
    got = P.rollback_decisions(m, act, pol)
    # A frame that moves at both ends costs its whole length for every row.
    plan = plan_of(got)
    assert "RangeFrame, unboundedpreceding$()" in plan and plan.count("RangeFrame") == plan.count("RangeFrame, unboundedpreceding$()")

    def frame(r):
        return [x for x in rows if x[1] == r[1] and (
            x[3] is None if r[3] is None else x[3] is not None and r[3] - timedelta(seconds=30) <= x[3] <= r[3])]

    want = {r[0]: (len(frame(r)), sum((x[2] or 0) >= 500 for x in frame(r))) for r in rows}
    assert {r.request_id: (r.request_count, r.errors) for r in got.collect()} == want


def test_scan_copies_no_vectors_and_equals_brute_force(spark, monkeypatch):
    from embdrift.operators import similarity as S
    monkeypatch.setattr(S, "_TILE_QUERIES", 16)
    monkeypatch.setattr(S, "_TILE_DOCS", 32)
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(150, 6)), 2, axis=0)  # every vector twice: ties
    y = x + 0.4 * np.repeat(rng.normal(size=(150, 6)), 2, axis=0)
    x[5] = 0.0
    lab = [None if i % 11 == 0 else f"s{i % 4}" for i in range(300)]
    u, v = (m / np.where(np.linalg.norm(m, axis=1) == 0, 1, np.linalg.norm(m, axis=1))[:, None] for m in (y, x))
    sim = np.round(u @ v.T, S.TIE_DECIMALS)
    d = spark.createDataFrame([(i, [float(c) for c in x[i]], lab[i]) for i in range(300)], "did long, dvec array<double>, dlabel string")
    q = spark.createDataFrame([(i, [float(c) for c in y[i]], lab[i], i, float(sim[i, i]), float(sim[i, i])) for i in range(0, 300, 2)],
                              "qid long, qvec array<double>, qlabel string, gold_did long, gold_sim double, threshold double")
    out = S.scan(q, d, S.ScanSpec(k=3, exclude_self=True, gold=True, above=True, same_max=True, below=True), block_rows=20, min_tasks=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "Exchange" not in plan
    rows = out.collect()
    assert len([r for r in rows if r.kind == "above"]) > 150  # several partitions of documents
    for i in range(0, 300, 2):
        mine = [r for r in rows if r.qid == i]
        other = [j for j in range(300) if j != i]
        order = sorted(other, key=lambda j: (-sim[i, j], j))
        for kind, want in (("top", order), ("below", [j for j in order if sim[i, j] < sim[i, i]])):
            got = sorted(((-r.sim, r.did, r.dlabel) for r in mine if r.kind == kind))[:3]
            assert got == [(-sim[i, j], j, lab[j] or "") for j in want[:3]]
        assert sum(r.cnt for r in mine if r.kind == "above") == sum(sim[i, j] > sim[i, i] for j in other)
        assert sum(r.cnt for r in mine if r.kind == "ahead") == sum(sim[i, j] > sim[i, i] or (sim[i, j] == sim[i, i] and j < i) for j in other)
        same = [sim[i, j] for j in other if lab[j] == lab[i]]
        assert max(r.sim for r in mine if r.kind == "same_max") == max(same)
    assert S.scan(q.limit(0), d, S.ScanSpec(k=1)).count() == 0 and S.scan(q, d.limit(0), S.ScanSpec(k=1)).count() == 0
    with pytest.raises(Exception, match="one length"):
        S.knn(q, d.withColumn("dvec", F.when(F.col("did") != 7, F.col("dvec"))), 1).collect()


def test_candidates_and_ranking_copy_no_vectors(spark):
    from embdrift.operators import quantised as PQ
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    d = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "did long, dvec array<double>")
    got = PQ.pq_search(d.selectExpr("did as qid", "dvec as qvec"), d, 5, cells=8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan and "Generate" not in plan
    assert got.count() == 2000


def window_texts(spark, windows=6, docs=12):
    rng = random.Random(3)
    rows = [(w, w * docs + i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", f"w{rng.randrange(40)}"]) for _ in range(30)))
            for w in range(windows) for i in range(docs)]
    return spark.createDataFrame(rows, "wid long, doc_id long, text string")


def test_window_topics_shuffle_texts_not_tokens(spark):
    from embdrift.operators import linguistic as L
    rows = window_texts(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the features are many
    try:
        near = L.keyword_topics(L.Sides(rows, "prev"))
        plan = near._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.wid, r.side, r.label, round(r.share, 9)) for r in near.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # Below every cut of the tokens the texts come by window; nothing above is dealt by (window, term) before it is counted.
    lines = plan.splitlines()
    for nth, line in enumerate(lines):
        if "hashpartitioning" in line and "term#" in line.split("hashpartitioning")[1].split(")")[0]:
            assert "Generate" not in lines[nth + 1] + lines[nth + 2] + lines[nth + 3]
    assert "REPARTITION_BY_COL" in plan
    split = rows.withColumn("side", F.lit("window")).unionByName(rows.withColumn("side", F.lit("baseline")).withColumn("wid", F.col("wid") + 1))
    far = L.keyword_topics(L.Sides(split, "split"))
    assert got == sorted((r.wid, r.side, r.label, round(r.share, 9)) for r in far.collect())


def test_window_topics_cut_texts_once(spark, monkeypatch):
    from embdrift.operators import linguistic as L
    from embdrift.operators import packed
    monkeypatch.setattr(packed, "SLICE_TOKENS", 50)  # windows lie across slices, and across batches
    odd = [(2, 24, "alpha late beta"), (2, None, "beta gamma"), (2, None, "gamma the beta gamma"), (3, 900, "a ?"), (4, 901, " "), (None, 902, "alpha beta"),
           (9, 903, "one two one two"), (9, 904, "two one"), (11, 905, "x"), (12, 906, "the"), (13, 907, "Öl Öl éa")]
    docs = spark.createDataFrame([tuple(r) for r in window_texts(spark).collect()] + odd, "wid long, doc_id long, text string").repartition(3)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        near = L.keyword_topics(L.Sides(docs, "prev"))
        plan = near._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.wid, r.side, r.label, round(r.share, 9)) for r in near.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert plan.count("regexp_extract_all") == 1  # the texts are cut once
    known = docs.filter("wid IS NOT NULL")
    split = known.withColumn("side", F.lit("window")).unionByName(known.withColumn("side", F.lit("baseline")).withColumn("wid", F.col("wid") + 1))
    far = L.keyword_topics(L.Sides(split, "split"))
    assert got == sorted((r.wid, r.side, r.label, round(r.share, 9)) for r in far.collect())
    assert (13, "window", "öl öl") in {r[:3] for r in got} and not {11, 12} & {r[0] for r in got if r[1] == "window"}


def test_emerging_topics_make_the_topics_once(spark):
    from embdrift.operators import linguistic as L
    found = L.emerging_topics(L.keyword_topics(L.Sides(window_texts(spark), "prev")))
    assert plan_of(found).count("regexp_extract_all") == 1
    rows = [(1, "window", "a", 0.6), (1, "baseline", "a", 0.5), (1, "window", "b_c", 0.1), (1, "baseline", "d", 0.9), (1, "window", "e", 0.04),
            (2, "window", "a", 0.5), (2, "baseline", "a", 0.45), (3, "baseline", "a", 1.0)]
    got = L.emerging_topics(spark.createDataFrame(rows, "wid long, side string, label string, share double"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a", 0.6, ["a"]), (1, 2, "b_c", 0.1, ["b", "c"])]


def test_activation_requests_are_judged_once(spark):
    from embdrift.operators import governance as G
    ev = spark.createDataFrame([(1, "m1", "ACTIVE", T0, 1), (1, "m2", "PASSED", T0, 1), (1, "m3", "REJECTED", T0, 1)],
                               "registry long, version string, status string, ts timestamp, seq int")
    later = T0 + timedelta(days=1)
    req = spark.createDataFrame([(1, "m2", later), (1, "m3", later)], "registry long, version string, ts timestamp")
    out = G.activation_events(req, ev)
    plan = plan_of(out)
    assert "from_json" not in plan and plan.count("to_json") == 0  # requests come written, not worked out again
    assert sorted((r.version, r.status, r.seq) for r in out.collect()) == [("m1", "PASSED", 2), ("m2", "ACTIVE", 2)]


def test_window_centroids_deal_no_tokens(spark):
    from embdrift.operators import linguistic as L
    rows = window_texts(spark)
    odd = [(2, 24, "alpha late"), (2, None, "beta gamma"), (3, 900, "a ?"), (4, 901, " "), (None, 902, "alpha beta")]
    rows = spark.createDataFrame([tuple(r) for r in rows.collect()] + odd, rows.schema)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # windows lie across batches
    try:
        near = L.document_centroid_distance(L.Sides(rows, "prev"), max_features=20)
        plan = near._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.wid, round(r.centroid_distance, 9)) for r in near.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert plan.count("regexp_extract_all") == 1  # the texts are cut once
    assert "term#" not in "".join(p.split(")")[0] for p in plan.split("hashpartitioning")[1:])
    known = rows.filter("wid IS NOT NULL")
    split = known.withColumn("side", F.lit("window")).unionByName(known.withColumn("side", F.lit("baseline")).withColumn("wid", F.col("wid") + 1))
    far = L.document_centroid_distance(L.Sides(split, "split"), max_features=20)
    assert got == sorted((r.wid, round(r.centroid_distance, 9)) for r in far.collect()) and len(got) == 7


def test_large_group_counts_frequent_bigrams_only(spark):
    from collections import Counter
    from embdrift.operators import linguistic as L
    rng = random.Random(11)
    rows = [(w, side, i, " ".join(rng.choice(["alpha beta", "the", "gamma", "beta delta", f"w{rng.randrange(9)}", "éa ok"]) for _ in range(rng.randrange(0, 9))) or "?")
            for i, (w, side) in enumerate((w, side) for w in (0, 1) for side in ("baseline", "window") for _ in range(25))]
    rows += [(2, "window", 900, "one two one two"), (2, "baseline", 901, "solo")]  # ties, and a side of one word
    docs = spark.createDataFrame(rows, "wid long, side string, doc_id long, text string")
    for features, ngrams in ((3, True), (12, True), (4, False)):
        weights = L.tfidf_rows(L.Sides(docs, "split"), True, features, ngrams)
        plan = weights._jdf.queryExecution().executedPlan().toString()
        assert "NGram" not in plan and "regexp_extract_all" not in plan  # texts are not cut again where the weights are
        got = {(r.wid, r.side, r.doc_id, r.term): round(r.weight, 9) for r in weights.collect()}
        want = {}
        for key in {r[:2] for r in rows}:
            cut = {r[2]: [t for t in r[3].replace("?", "").split() if t != "the"] for r in rows if r[:2] == key}
            tf = {i: Counter(t + ([f"{a} {b}" for a, b in zip(t, t[1:])] if ngrams else [])) for i, t in cut.items()}
            cf = sum(tf.values(), Counter())
            best = sorted(cf, key=lambda t: (-cf[t], t))[:features]
            idf = {t: np.log((1 + len(cut)) / (1 + sum(t in c for c in tf.values()))) + 1 for t in best}
            for i, c in tf.items():
                norm = np.sqrt(sum((c[t] * idf[t]) ** 2 for t in best))
                want.update({(*key, i, t): round(c[t] * idf[t] / norm, 9) for t in best if c[t]})
        assert got == want


def test_window_counts_are_packed(spark):
    from collections import Counter
    from embdrift.functions import text as TX
    from embdrift.operators import linguistic as L
    odd = [(2, 24, "alpha late"), (2, None, "Beta Gamma"), (3, 900, "a ?"), (4, 901, " "), (None, 902, "alpha beta"), (9, 903, "x")]
    rows = [tuple(r) for r in window_texts(spark).collect()] + odd
    docs = spark.createDataFrame(rows, "wid long, doc_id long, text string")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # windows lie across batches
    try:
        for counts, tokens, key in ((L.term_counts, TX.tokens, "term"), (L.entity_counts, TX.proper_noun_runs, "entity")):
            cut = [(r.wid, r.t) for r in docs.select("wid", tokens("text").alias("t")).collect() if r.wid is not None]
            own = Counter((w, t) for w, ts in cut for t in ts)
            long = counts(L.Sides(docs, "prev"))
            assert {(r.wid, r.side, r[key]): r.n for r in long.collect()} == (
                {(w, "window", t): n for (w, t), n in own.items()} | {(w + 1, "baseline", t): n for (w, t), n in own.items()})
            aligned = L.align_counts(counts(L.Sides(docs, "prev"), packed=True), key)
            for frame in (long, aligned):  # no table of all the windows' terms in a task
                assert "HashAggregate(keys=[wid" not in "".join(
                    x for x in frame._jdf.queryExecution().executedPlan().toString().splitlines() if f"{key}#" in x)
            assert {(r.wid, r[key]): (r.b, r.w) for r in aligned.collect()} == {
                (w, t): (own[w - 1, t], own[w, t]) for w, t in set(own) | {(w + 1, t) for w, t in own}}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_report_tables_are_written_by_columns(spark):
    from embdrift.operators import linguistic as L
    docs = window_texts(spark)
    report = L.linguistic_report(L.Sides(docs, "prev"))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert all("text#" in line for line in plan.splitlines() if "Scan ExistingRDD" in line)  # no serialised rows but the input's
    assert report.count() == 7


def test_packed_counts_are_small(spark):
    from embdrift.operators import linguistic as L
    text = " ".join(f"word{i % 3000}" for i in range(6000))
    docs = spark.createDataFrame([(1, 1, text), (2, 2, "? 1 2"), (2, 3, "! 3")], "wid long, doc_id long, text string").coalesce(1)
    rows = L.term_counts(L.Sides(docs, "prev"), packed=True).collect()
    assert all(len(r.terms) < 12_000 for r in rows)  # 3,000 terms and their counts, a third of their text
    got = L.align_counts(L.term_counts(L.Sides(docs, "prev"), packed=True), "term").collect()
    assert {(r.wid, r.b, r.w) for r in got} == {(1, 0, 2), (2, 2, 0)} and len(got) == 6000


def test_slices_hold_whole_rows(spark):
    import pyarrow as pa
    from embdrift.operators.packed import slices
    batch = pa.RecordBatch.from_pydict({"x": list(range(6))})
    parts = [(p.column("x").to_pylist(), n.tolist()) for p, n in slices(batch, np.array([3, 0, 9, 1, 2, 2]), 4)]
    assert parts == [([0, 1], [3, 0]), ([2], [9]), ([3, 4], [1, 2]), ([5], [2])]


def test_encoder_holds_a_slice_of_tokens(spark, monkeypatch):
    import hashlib
    from embdrift.operators import embedding as EM
    monkeypatch.setattr(EM, "SLICE_TOKENS", 50)
    texts = [" ".join(f"Wörd{(i * j) % 23}" for j in range(i % 40)) for i in range(200)] + [None, "? !", "x " + "yy " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    run = EM.slices

    def seen(batch, lens, size):
        for part, n in run(batch, lens, size):
            assert n.sum() <= 50 or len(n) == 1  # in the worker: more than a slice at once fails the job
            yield part, n

    monkeypatch.setattr(EM, "slices", seen)
    got = {r.id: r.vector for r in EM.embed(df, dim=16).collect()}
    for i, text in enumerate(texts):
        v = np.zeros(16)
        for t in (text or "").lower().replace("?", "").replace("!", "").split():
            h = hashlib.md5(t.encode()).hexdigest()
            v[int(h[:8], 16) % 16] += (1 if int(h[8], 16) < 8 else -1) if len(t) > 1 else 0
        if (text or "").lower().replace("?", "").replace("!", "").strip():
            assert np.allclose(got.pop(i), v / (np.linalg.norm(v) or 1.0), rtol=0, atol=1e-15)
    assert not got
