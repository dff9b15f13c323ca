"""Filter audit as a stream (11), vector-approximation search (12), whitening (13)."""

import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from embdrift.llm import filters, vafile, whitening
from embdrift.llm.bidiagonal import bidiagonalise, dqds, right_singular


def plain_audit(rows, labels):
    """rows: (doc_id, text, source); labels: id -> (quality, toxic)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
                                  ("C", 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)), ("D", re.search(r"[#$%&*|]", t)),
                                  ("E", i is not None and least[t] < i)) if bad}
        docs.append((s or "", fails, *labels.get(i, (None, None))))
    out = Counter()
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = Counter(next(f for f in o if f in d[1]) for o in orders for d in mine if d[1])
        for o in orders:
            here = mine
            for k, f in enumerate(o):
                gone = [d for d in here if f in d[1]]
                out[part, o, k + 1] = (
                    len(here) - len(gone), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine),
                    sum(d[2] == 1 for d in gone), sum(d[3] == 1 for d in gone), shapley[f])
                here = [d for d in here if f not in d[1]]
    return dict(out)


def audited(spark, path, labels, **kw):
    table = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()], "doc_id long, quality int, toxic int")
    got = filters.audit(spark, path, table, **kw).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in got}


def audit_rows():
    rng = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "x#y", "delta", "é", "zeta"] + [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "ONE TWO", "a" * 50, "w0 " * 400, " ".join(words[8:260]), "B" * 3 + " lower" * 250] + [
        " ".join(rng.choice(words) for _ in range(rng.choice([3, 150, 260, 500]))) for _ in range(25)]
    rows = [(i, rng.choice(texts), rng.choice(["s1", "s2", None, "", "hot", "hot", "hot"])) for i in rng.sample(range(1000), 240)]
    rows += [(5000 - k, texts[7], "hot") for k in range(300)]  # one text, ids falling from file to file
    rows += [(7, texts[6], "s1"), (7, texts[6], "s2"), (7, texts[6], "s2"), (None, texts[6], "s1"), (None, None, None), (3, texts[6], "s2")]
    return rows


def test_audit_equals_plain_form_in_any_order_of_files(spark, tmp):
    rows = audit_rows()
    labels = {i: (int(i % 3 == 0), int(i % 5 == 0)) for i, _, _ in rows if i is not None and i % 2}
    want = plain_audit(rows, labels)
    for name, order in (("up", lambda r: r[0] or 0), ("down", lambda r: -(r[0] or 0))):
        path = os.path.join(tmp, name)
        ordered = sorted(rows, key=order)
        for k in range(5):  # five files, one micro-batch each
            part = ordered[len(rows) * k // 5:len(rows) * (k + 1) // 5]
            spark.createDataFrame(part, "doc_id long, text string, source string").withColumns(
                {"mask": F.lit(1), "part": F.lit("x")}).coalesce(1).write.mode("append").parquet(path)
        assert spark.read.parquet(path).count() == len(rows)
        assert audited(spark, path, labels, batches=5, buckets=4) == want
    one = os.path.join(tmp, "one")
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(one)
    file = next(os.path.join(one, f) for f in os.listdir(one) if f.endswith(".parquet"))
    assert audited(spark, file, labels, buckets=1) == want  # a file, not a folder


def test_audit_of_empty_tables_and_doubtful_labels(spark, tmp):
    path = os.path.join(tmp, "none")
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(path)
    assert audited(spark, path, {}) == {}
    path = os.path.join(tmp, "few")
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(path)  # no source
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (2, 1, None), (2, 1, 7), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = filters.audit(spark, path, labels).where("filter_order = 'ABCDE' and step = 1").collect()
    assert [(r.part, r.removed, r.good_lost, r.toxic_lost, r.shapley) for r in got] == [("", 2, 1, 1, 240)]


def plain_top(rows, k, scale, asks):
    seen = sorted({(i, tuple(int(np.floor(scale * np.float64(x))) for x in v)) for i, v in rows
                   if v is not None and all(x is not None and np.isfinite(x) for x in v)}, key=repr)
    out = set()
    for i, v in seen:
        if i is not None and asks(i):
            all_ = [(-sum(a * b for a, b in zip(v, w)), j is None, j) for j, w in seen if (j, w) != (i, v) and len(v) == len(w)]
            for r, (s, _, j) in enumerate(sorted(all_, key=lambda t: (t[0], t[1], t[2] or 0))[:k]):
                out.add((i, r + 1, j, -s))
    return out


@pytest.mark.parametrize("bits", [2, 6])
def test_topk_equals_brute_force(spark, bits):
    rng = np.random.default_rng(bits)
    vecs = list(rng.normal(size=(300, 8)))
    vecs += [vecs[0]] * 120 + [vecs[0] + 0.002 * rng.normal(size=8) for _ in range(100)]  # a third: copies and near copies
    vecs += [np.zeros(8), -vecs[0], 1000 * vecs[1], np.round(vecs[2], 1), np.round(vecs[2], 1)]
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(vecs)) - 20, vecs)]
    rows += [(900, None), (901, [float("nan")] * 8), (902, [None] + [1.0] * 7), (903, [float("inf")] * 8), (904, [1.0, 2.0]), (910, [2.0, 1.0]),
             (1000, []), (906, []), (None, rows[0][1]), (0, rows[3][1]), rows[10], rows[10]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as score", "3 as dim")
    got = vafile.top_k(df.repartition(3), F.col("vec_id") % 10 == 0, k=4, bits=bits, block_rows=50, query_rows=20, sample_rows=64).collect()
    found = [(r.query_id, r.rank, r.vec_id, r.score) for r in got]
    assert set(found) == plain_top(rows, 4, 256, lambda i: i % 10 == 0) and len(found) == len(set(found))


def test_topk_of_few_rows_and_huge_numbers(spark):
    def run(rows, **kw):
        return {tuple(r) for r in vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 1, **kw).collect()}

    assert run([]) == set() and run([(1, [1.0])]) == set()
    assert run([(1, [1.0]), (2, [0.5]), (3, [2.0])], k=5) == {(1, 1, 3, 512 * 256), (1, 2, 2, 128 * 256)}
    big = 2.0 ** 40
    assert run([(1, [big, -big]), (2, [big, big - 1]), (3, [big, -big]), (4, [1e300, 0.0])], scale=1) == {
        (1, 1, 3, 2**63 - 1), (1, 2, 4, 2**63 - 1), (1, 3, 2, 2**40)}


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    x, q = np.floor(30 * rng.normal(size=(2000, 16))), np.floor(30 * rng.normal(size=(9, 16)))
    grid = vafile.Grid(x[:100], x.min(axis=0), x.max(axis=0), 5)
    low, high = vafile.bounds(q, *grid.spans(grid.codes(x)))
    exact = q @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    sure = np.sort(low, axis=1)[:, -5]
    assert ((high >= sure[:, None]).sum(axis=1) < 200).all()  # most rows are never read


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_qd_values_and_vectors(d):
    rng = np.random.default_rng(d)
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    for m in (np.triu(rng.normal(size=(d, d))), np.zeros((d, d)), np.eye(d), np.diag(10.0 ** -np.arange(d)) @ turn,
              np.diag([3.0] * (d // 2) + [1.0] * (d - d // 2)) @ turn, np.diag(np.sqrt(2 + 1e-13 * rng.normal(size=d))) @ turn):
        a, b, w = bidiagonalise(m)
        assert np.allclose(w @ w.T, np.eye(d), atol=1e-12)
        assert np.allclose((m @ w).T @ (m @ w), (lambda t: t.T @ t)(np.diag(a) + np.diag(b, 1)), atol=1e-12 * max(1, np.abs(m).max() ** 2))
        values, vectors = right_singular(m, d)
        want = np.linalg.eigvalsh(m.T @ m)[::-1]
        assert np.allclose(values, want, atol=1e-12 * max(want[0], 1e-300))
        assert np.allclose(vectors @ vectors.T, np.eye(d), atol=1e-9)
        assert np.allclose(m.T @ m @ vectors.T, vectors.T * values, atol=1e-11 * max(want[0], 1e-300))
    graded = 10.0 ** -np.arange(d)
    assert np.allclose(dqds(graded, np.zeros(d - 1)) / graded ** 2, 1, rtol=1e-14)  # small values as exact as large ones


def plain_whitened(rows, components=16):
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(64 * np.array([v for _, v in good], float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, total = len(u), u.sum(axis=0)
    centred = (n * u - total) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return [i for i, _ in good], n, ((n * x - total) ** 2).sum(axis=1), (n * x - total) / n @ v / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def test_whitening_equals_plain_form(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(700, 20)) * np.linspace(3, 0.5, 20) @ np.linalg.qr(rng.normal(size=(20, 20)))[0]
    vecs = list(base) + [base[0]] * 400  # copies weigh nothing in the fit
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    bad = [(2000, None), (2001, [None] * 20), (2002, [float("nan")] + [0.0] * 19), (2003, [float("-inf")] * 20)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 as dim", "2 as x", "3 as n")
    ids, n, deviation, white, explained = plain_whitened(rows)
    got = whitening.whiten(df.repartition(40)).toPandas()
    assert len(got) == 16 * len(ids) and set(got.n) == {n} and got.identity_error.max() <= 1e-9
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    sign = np.sign((table * white).sum(axis=0))
    assert np.allclose(table * sign, white, atol=1e-8)
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-9)
    assert got.groupby("vec_id").deviation.first().loc[ids].tolist() == deviation.tolist()


def test_whitening_of_odd_tables(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()

    assert run([]) == [] and run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == [] and run([(1, []), (2, [])]) == []
    two = run([(1, [0.0, 1.0]), (None, [1.0, 1.0]), (1, [0.0, 1.0]), (3, [5.0]), (4, [7.0])])  # one direction each, lengths apart
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation, round(abs(r.whitened), 9), round(r.explained, 9)) for r in two) == sorted(
        [("1", 1, 2, 64 * 64, 1.0, 1.0)] * 2 + [("None", 1, 2, 64 * 64, 1.0, 1.0)] + [(i, 1, 2, 128 * 128, 1.0, 1.0) for i in "34"])
    huge = run([(1, [1e300]), (2, [-1e300]), (3, [0.0])])
    assert [r.deviation for r in huge if r.vec_id == 1] == [None] and len(huge) == 3
    assert whitening.square_sums(np.array([[3_000_000_000, 0]])) == [9 * 10**18]
