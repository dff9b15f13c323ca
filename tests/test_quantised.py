"""Product quantisation search."""

import numpy as np

from embdrift.operators import quantised as PQ
from embdrift.operators import similarity as S
from embdrift.operators.embedding import recall_at_k


def frames(spark, x, every):
    d = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "did long, dvec array<double>").repartition(4)
    return d.selectExpr("did as qid", "dvec as qvec").filter(f"qid % {every} = 0"), d


def clustered(n=1500, groups=30, dim=24):
    rng = np.random.default_rng(5)
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dim))


def test_lloyd_and_tables():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(50, 4)) * 0.01 + c for c in ([0] * 4, [5] * 4, [-5] * 4)])
    centres = PQ.lloyd(x, 3)
    assert sorted(np.round(centres[:, 0]).tolist()) == [-5, 0, 5]
    assert len(PQ.lloyd(x[:2], 5)) == 2 and len(np.unique(PQ.lloyd(np.ones((9, 2)), 4), axis=0)) == 1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    book = PQ.Codebook(PQ.lloyd(u, 3), (rng.normal(size=(7, 2)), rng.normal(size=(9, 2))))
    cell, codes = book.encode(u)
    for c in range(3):
        at = np.flatnonzero(cell == c)
        decoded = book.centres[c] + np.concatenate([book.slices[m][codes[at, m]] for m in range(2)], axis=1)
        assert np.allclose(book.similarity(u[:10], c, codes[at]), u[:10] @ decoded.T, atol=1e-5)


def test_recall_on_clustered_vectors_with_few_cells(spark, monkeypatch):
    q, d = frames(spark, clustered(), 5)
    seen, plain = [], PQ._settings
    monkeypatch.setattr(PQ, "_settings", lambda *a: seen.append((plain(*a), len(a[4].centres))) or seen[-1][0])
    got = PQ.pq_search(q, d, 10, cells=30, sample=600).cache()
    (probed, some), cells = seen[0]
    assert cells == 30 and probed <= 10 and some <= 80  # most cells and vectors are never read
    assert recall_at_k(got, S.knn(q, d, 10), 10).first().recall_at_k >= 0.9
    assert got.groupBy("qid").count().filter("count <> 10").count() == 0
    codes = PQ.coded(d.selectExpr("did", "dvec"), PQ.fit_codebook(d, 30, sample=100))
    assert codes.select("did").distinct().count() == d.count()  # fitted on some rows, every row is there


def test_small_tables_and_ties(spark):
    q, d = frames(spark, clustered(7, 2), 1)
    got = PQ.pq_search(q, d, 10).collect()
    want = S.knn(q, d, 10).collect()
    assert sorted((r.qid, r.rank, r.did) for r in got) == sorted((r.qid, r.rank, r.did) for r in want)
    q, d = frames(spark, np.ones((40, 8)), 10)  # any of the equal vectors, each once
    got = PQ.pq_search(q, d, 3).collect()
    assert sorted((r.qid, r.rank) for r in got) == [(i, k + 1) for i in (0, 10, 20, 30) for k in range(3)]
    assert len({(r.qid, r.did) for r in got}) == 12 and all(r.similarity == 1.0 for r in got)
    assert PQ.pq_search(q.limit(0), d, 3).count() == 0 and PQ.pq_search(q, d.limit(0), 3).count() == 0
