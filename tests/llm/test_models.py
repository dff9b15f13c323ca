"""Toxicity (1), quality by compression (7), language model (2)."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from embdrift.llm import common, compression, eftrie, lm, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def held_out_accuracy(spark, score, label, mod, rest, share=0.8):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.read(spark, sf, "documents").select("doc_id", "text"), common.read(spark, sf, "labels")
    keep = F.pmod(common.crc_class("doc_id", mod), F.lit(mod))
    sample = common.bounded_sample(docs, labels, label, keep != rest, 400, 20_000)
    assert 0 < len(sample) <= 800 and all(0 < len(t) <= 20_000 for t, _ in sample)
    rows = docs.where(keep == rest).join(common.marks(labels, label), "doc_id").orderBy(F.xxhash64("doc_id")).limit(400)
    share = common.label_share(docs, labels, label, keep != rest)
    got = score(sample, rows, share).select("label", "score").collect()
    hit = {v: [r.score >= 0.3 for r in got if r.label == v] for v in (0, 1)}
    return {v: sum(h == bool(v) for h in x) / max(1, len(x)) for v, x in hit.items()}


def test_toxicity_learns(spark):
    acc = held_out_accuracy(spark, lambda s, rows, share: toxicity.score(spark, rows, toxicity.fit(s, share=share)), "toxic", 4, 2)
    assert acc[1] >= 0.7 and acc[0] >= 0.95, acc


def test_compression_learns(spark):
    acc = held_out_accuracy(spark, lambda s, rows, _: compression.score(spark, rows, compression.fit(s)), "quality", 5, 0)
    assert acc[1] >= 0.95 and acc[0] >= 0.8, acc


ODD = [(1, None), (2, ""), (None, "bad bad"), (3, " \n"), (4, "é😀"), (5, "x" * 50_000), (6, "good word " * 20_000), (6, "good word"), (6, "good word")]


@pytest.mark.parametrize("kind", ["toxicity", "compression"])
def test_scores_of_odd_texts(spark, kind):
    rng = random.Random(1)
    sample = [(" ".join(rng.choice(["good", "fine", "word", "text"]) for _ in range(60)), 0) for _ in range(60)]
    sample += [(t + " horrid", 1) for t, _ in sample[:30]]
    mod = {"toxicity": toxicity, "compression": compression}[kind]
    model = toxicity.fit(sample, toxicity.Config(steps=60)) if kind == "toxicity" else compression.fit(sample)
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("lang", F.lit(None).cast("string"))
    got = mod.score(spark, df, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.text == "good word"}) == 1
    assert mod.score(spark, df.limit(0), model).count() == 0
    empty = {r.score for r in got if not r.text}
    assert len(empty) == 1


def test_flat_models_without_both_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for sample in ([], [("a b", 1)], [("a b", 0)] * 3):
        for got in (toxicity.score(spark, df, toxicity.fit(sample)), compression.score(spark, df, compression.fit(sample))):
            assert all(0 <= r.score <= 1 for r in got.collect())


def test_cnn_windows_stay_inside_texts():
    m = toxicity.fit([("a", 1)])  # flat, but with random filters
    m.out = np.ones_like(m.out)
    words = toxicity.Words(m.config.buckets)
    texts = ["one two three four", "five", "", None, "six seven", "one two three four"]
    together = toxicity.logits(m, words, texts)
    alone = np.array([toxicity.logits(m, words, [t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_language_thresholds(spark):
    rows = [("en", 0.1 + 0.2 * (i % 2), i % 2) for i in range(100)] + [("de", 0.4 + 0.4 * (i % 2), i % 2) for i in range(100)] \
        + [("fr", 0.9, 1), (None, 0.5, 1)]
    got = toxicity.language_thresholds(spark.createDataFrame(rows, "lang string, score double, label int"))
    assert 0.1 < got["en"] <= 0.3 and 0.4 < got["de"] <= 0.8 and got["fr"] == 0.3
    df = spark.createDataFrame([("en",), (None,), ("xx",)], "lang string")
    assert [r.t for r in df.select(toxicity.threshold_column(got).alias("t")).collect()] == [got["en"], 0.3, 0.3]


def test_contradicting_labels_drop_out(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "d"), (4, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, 1), (None, 1), (4, 7)], "doc_id long, quality int")
    assert sorted(map(tuple, common.marks(labels, "quality").collect())) == [(2, 1), (3, 1)]
    assert common.bounded_sample(docs, labels, "quality", F.lit(True), 5, 100) == [("b", 1)]
    twice = docs.unionAll(docs).unionAll(spark.createDataFrame([(2, "zz")], docs.schema))
    assert common.bounded_sample(twice, labels, "quality", F.lit(True), 5, 100) == [("b", 1)]
    assert common.bounded_sample(docs, labels, "quality", F.lit(True), 5, 0) == []


# ---- Elias-Fano -----------------------------------------------------------------------------

@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 2**63), (5, 3), (1000, 100), (1000, 2**40), (3000, 2**64 - 1), (70_000, 10**7)])
def test_elias_fano_round_trip(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    ef = eftrie.EliasFano(eftrie.EliasFano.build(values))
    assert (ef.get(np.arange(n)) == values).all()
    probe = np.unique(np.concatenate([values, values + np.uint64(1), values - np.uint64(1), rng.integers(0, top, 200, dtype=np.uint64, endpoint=True)]))
    place, same = ef.successor(probe)
    assert (place == np.searchsorted(values, probe)).all()
    assert (same == np.isin(probe, values)).all()


def plain_trigrams(docs, config):
    """The same model by dictionaries: log10 P per document."""
    c3, c2c, c2p, c1, uni = (collections.Counter() for _ in range(5))
    seqs = {}
    for i, (doc_id, text, held) in enumerate(docs):
        t = ["<b>", "<b>", *WORD.findall(ascii_lower(text or "")), "<e>"]
        seqs[i] = t
        if held:
            continue
        uni.update(t[2:])
        for a, b, c in zip(t, t[1:], t[2:]):
            c3[a, b, c] += 1
            c2c[a, b] += 1
            c2p[b, c] += 1
            c1[b] += 1
    total, kinds = sum(uni.values()), len(uni)
    (k2, b2), (k3, b3) = config.smoothing

    def weight(n, k, b):
        x = k * n ** b
        return x / (n + x) if n else 1.0

    out = []
    for i in seqs:
        t, s, base = seqs[i], 0.0, 0.0
        for a, b, c in zip(t, t[1:], t[2:]):
            p1 = (uni[c] + 1) / (total + kinds + 1)
            w2 = weight(c1[b], k2, b2)
            p2 = (1 - w2) * (c2p[b, c] / c1[b] if c1[b] else 0) + w2 * p1
            w3 = weight(c2c[a, b], k3, b3)
            p3 = (1 - w3) * (c3[a, b, c] / c2c[a, b] if c2c[a, b] else 0) + w3 * p2
            s += math.log10(p3)
            base += math.log10(p1)
        out.append((docs[i][0], len(t) - 2, sum(uni[x] > 0 for x in t[2:]), total, base, s))
    return out


def test_numbered_pairs_give_the_same_trigrams(monkeypatch):
    rng = np.random.default_rng(3)
    c = lm.Chunk("", np.arange(50, dtype=np.uint64), rng.integers(0, 50, 400).astype(np.int32), np.array([150, 250]),
                 np.zeros(2, np.int64), np.ones(2, np.uint8), np.array([0, 1], np.uint8))
    at = c.positions()
    grams, n = c.counted(at)
    key, pairs = c.keys(at)
    monkeypatch.setattr(lm, "MARKED_BITS", 4)
    grams2, n2 = c.counted(at)
    key2, pairs2 = c.keys(at)
    assert pairs is None and pairs2 is not None and (n == n2).all() and all((a == b).all() for a, b in zip(grams, grams2))
    assert all((a == b).all() for a, b in zip(c.split(key, pairs), c.split(key2, pairs2)))


@pytest.mark.parametrize("chunk,shard", [(10**6, 10**6), (60, 40)])
def test_scores_equal_plain_trigrams(spark, chunk, shard):
    """Small chunks and shards make frequent words, and the start mark, split over several shards."""
    rng = random.Random(6)
    words = ["the", "the", "the", "of", "a", "The", "x", "y", "zebra", "Été"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.random() < 0.2) for i in range(150)]
    docs += [(900, None, False), (901, "", True), (None, "the of\ta", False), (902, "unseen words only", True), (902, "the the the the", False),
             (902, "the the the the", False), (903, " ".join(["the"] * 400), False)]
    cfg = lm.Config(chunk_tokens=chunk, shard_tokens=shard, node_bits=16)
    df = spark.createDataFrame(docs, "doc_id long, text string, out boolean").repartition(3)
    df = common.stored(df, "lm-test")
    got = lm.score(df, F.col("out"), cfg).collect()
    want = plain_trigrams([(r.doc_id, r.text, r.out) for r in df.collect()], cfg)
    assert len(got) == len(want)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], round(x[4], 6))
    for g, w in zip(sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key), sorted(want, key=key)):
        assert g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        assert g[5] == pytest.approx(w[5], rel=2e-3, abs=2e-3)


def test_trigram_model_is_normalised_enough():
    q = eftrie.Quantiser(12)
    p = np.array([0.0, 1.0, 0.5, 1e-3, 1e-9])
    assert np.allclose(q.value(q.code(p)), p, rtol=0.01) and q.value(q.code(p))[0] == 0


def test_lm_without_training_or_rows(spark):
    df = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, out boolean")
    got = {r.doc_id: r for r in lm.score(df, F.col("out")).collect()}
    assert got[1].train_tokens == 0 and got[1].n_known == 0 and got[1].base_score == 0.0 and got[1].score == pytest.approx(0.0, abs=1e-3)
    assert lm.score(df.limit(0), F.col("out")).count() == 0


def test_crc_class(spark):
    df = spark.createDataFrame([(0,), (12345,), (-7,), (None,)], "doc_id long")
    got = [r.c for r in df.select(common.crc_class("doc_id", 7).alias("c")).collect()]
    assert got == [zlib.crc32(b"0") % 7, zlib.crc32(b"12345") % 7, zlib.crc32(b"-7") % 7, 0]


def test_select_and_words_looked_up_once():
    from embdrift.llm.eftrie import EliasFano, Trie, _select_in_word
    rng = np.random.default_rng(5)
    words = np.concatenate([rng.integers(0, 2**64, 300, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64), [~np.uint64(0)]])
    for w in words:
        ones = [i for i in range(64) if int(w) >> i & 1]
        got = _select_in_word(np.full(len(ones), w), np.arange(len(ones), dtype=np.uint64))
        assert got.tolist() == ones
    for x in (np.sort(rng.integers(0, 50, 200)), rng.integers(0, 50, 200), np.empty(0, np.int64)):
        kinds, back = eftrie._kinds(x)
        assert np.array_equal(kinds, np.unique(x)) and np.array_equal(kinds[back], x)
    # One search of the vocabulary for all questions on a shard, and answers as for hashes.
    hashes = np.unique(rng.integers(0, 2**64, 40, np.uint64))
    n = len(hashes) - 5  # the last words have no count
    grams = np.unique(rng.integers(0, n, (400, 3)), axis=0)
    v, u, w = grams.T.astype(np.int64)
    c = np.ones(len(v), np.int64)

    def pairs(a, b):
        k, m = np.unique(a * 100 + b, return_counts=True)
        return k // 100, k % 100, m

    arrays = Trie.build(hashes, pairs(v, w), (v, u, w, c), {"v": np.bincount(v, minlength=len(hashes)), "context": pairs(v, u)}, ((1.5, .85), (2., .95)), 12)
    trie = Trie(arrays, 12)
    a, b, d = rng.integers(0, len(hashes), (3, 3000))
    calls = []
    trie.seq["words"].successor = lambda x, run=trie.seq["words"].successor: calls.append(len(x)) or run(x)
    numbers = trie.numbers(hashes)
    halves = [trie.ask(numbers, a[s], b[s], d[s]) for s in (slice(0, 1500), slice(1500, 3000))]
    assert calls == [len(hashes)]
    for got, want in zip(map(np.concatenate, zip(*halves)), trie.query(hashes[a], hashes[b], hashes[d])):
        assert np.array_equal(got, want)
    values = np.sort(rng.integers(0, 10**6, 500))
    ef = EliasFano(EliasFano.build(values))
    assert np.array_equal(ef.get(np.arange(500)), values)


def test_texts_are_cut_once_behind_the_word_counts(spark):
    """Pairs of frequent words, trigrams and sums read the cut texts of one shuffle; texts are not cut anew for each."""
    docs = [(i, "the of the a the " + "xyz"[i % 3], i % 5 == 0) for i in range(60)]
    df = common.stored(spark.createDataFrame(docs, "doc_id long, text string, out boolean").repartition(3), "lm-once")
    got = lm.score(df, F.col("out"), lm.Config(chunk_tokens=60, shard_tokens=40, node_bits=16))  # "the" is frequent
    assert len(got.collect()) == 60
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[doc_id", plan)) == 1
    assert plan.count("ReusedExchange") == 2


@pytest.mark.parametrize("limit,run", [(10**6, 10**6), (10**6, 40), (30, 10**6), (7, 40), (1, 1)])
def test_chunks_hold_the_words_of_every_text(monkeypatch, limit, run):
    odd = ["", None, "  ", "a\x1cb \x1d c", " x y  z", "A\tB\x0bC\x0cD\r\nE ", "É é ÀB", "x" * 70 + " y", "the " * 50, "\x85q \x00 n\x00m", "ſ K"] * 3
    ids, held = [None if i % 5 == 0 else i for i in range(len(odd))], [i % 3 == 0 for i in range(len(odd))]
    b = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(odd, pa.string()), pa.array(held)], ["doc_id", "text", "held_out"])
    whole = lm.text_runs
    monkeypatch.setattr(lm, "text_runs", lambda texts: whole(texts, run))
    chunks = list(lm.chunks_of(iter([b, b.slice(0, 0), b.slice(7, 9)]), lm.Config(chunk_tokens=limit)))
    rows = [*zip(ids, odd, held), *list(zip(ids, odd, held))[7:16]]
    want = [[int(lm.BEGIN)] * 2 + [xxhash.xxh64_intdigest(w.encode()) for w in WORD.findall(ascii_lower(t or ""))] + [int(lm.END)] for _, t, _ in rows]
    got = [c.words[part].tolist() for c in chunks for part in np.split(c.seq, np.cumsum(c.lens)[:-1])]
    assert got == want
    assert [d if h else None for c in chunks for d, h in zip(c.doc_id.tolist(), c.has_id)] == [r[0] for r in rows]
    assert [bool(x) for c in chunks for x in c.held_out] == [r[2] for r in rows]
    for c in chunks:
        assert np.array_equal(c.words, np.unique(c.words)) and (len(c.lens) == 1 or int((c.lens - 2).sum()) <= limit + 1)
        again = lm.Chunk.load(c.name, c.dump())
        assert np.array_equal(again.words, c.words) and np.array_equal(again.seq, c.seq)
    assert list(lm.chunks_of(iter([b.slice(0, 0)]), lm.Config())) == []
    large = pa.array(odd, pa.large_string())  # as sessions with large Arrow types send texts
    assert all(np.array_equal(x, y) for x, y in zip(lm._cut(large), lm._cut(pa.array(odd, pa.string()))))


def test_successor_in_long_runs_of_one_high_part():
    """Many values with the same high bits: their ones fill whole words."""
    for values in (np.repeat([5, 7, 9, 11, 1000], [200, 64, 63, 65, 128]), np.r_[np.arange(300), 10**9], np.zeros(129, np.int64), np.arange(0, 64 * 70, 64)):
        ef = eftrie.EliasFano(eftrie.EliasFano.build(values))
        probe = np.unique(np.r_[values, values + 1, 0, 3, 500, 10**6, 10**10]).astype(np.uint64)
        place, same = ef.successor(probe)
        assert np.array_equal(place, np.searchsorted(values.astype(np.uint64), probe))
        assert np.array_equal(same, np.isin(probe, values))
    assert np.array_equal(lm.distinct(np.array([3, 1, 3, 2]))[0], [1, 2, 3]) and np.array_equal(lm.distinct(np.array([3, 1, 3, 2]))[1], [2, 0, 2, 1])
    assert np.array_equal(lm.distinct(np.array([1, 1, 4]))[1], [0, 0, 1]) and len(lm.distinct(np.empty(0, np.int64))[0]) == 0
