"""SimHash around anchors (9), HNSW (8), components."""

import random

import numpy as np
import pytest
import xxhash

from embdrift.llm import hnsw, simhash
from embdrift.llm.components import components


def plain_components(n, near):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in np.flatnonzero(near(a)):
            x, y = root(a), root(int(b))
            parent[max(x, y)] = min(x, y)
    return [root(x) for x in range(n)]


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300), (1, 0), (None, 5)]
    random.Random(1).shuffle(links)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200, 202: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_golay_covers_within_three():
    words, errors = simhash._golay()
    assert len(set(words.tolist())) == 4096
    w = words[np.bitwise_count(words) > 0]
    assert np.bitwise_count(w).min() == 7 and (np.bitwise_count(errors) <= 3).all() and len(set(errors.tolist())) == 2048


@pytest.mark.parametrize("blocks", [1, 2])
@pytest.mark.parametrize("distance", [0, 1, 3, 4])
def test_close_fingerprints_share_an_anchor(blocks, distance):
    rng = np.random.default_rng(distance + 10 * blocks)
    x = rng.integers(0, 2**64, 400, dtype=np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for bit in rng.choice(64, distance, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(bit)
    rx, ax = simhash.anchors(x, distance, blocks)
    ry, ay = simhash.anchors(y, distance, blocks)
    sx, sy = [set(ax[rx == k].tolist()) for k in range(len(x))], [set(ay[ry == k].tolist()) for k in range(len(y))]
    assert all(a & b for a, b in zip(sx, sy))
    assert all(len(s) == (rx == k).sum() for k, s in enumerate(sx))  # no anchor twice


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [None, "", " \n\t", "one", "One two", "one two three four", "A B c D É", "x " * 2000, "one TWO three four five"]


def test_fingerprints():
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["a", "B", "cc", "é", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t), repr(t)[:60]


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(800)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 400))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((1000 + len(rows) * 7 % 997, " ".join(w)))
    return rows + [(5000, "repeated row here now"), (5000, "repeated row here now"), (None, "repeated row here now"), (None, "alone null id text of its own")]


def test_groups_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df.repartition(3)).collect()
    fp = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    label = plain_components(len(rows), lambda a: np.bitwise_count(fp[a] ^ fp[:a]) <= 4)
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((str(i), f"{int(f):016x}", least.get(c)) for (i, _), f, c in zip(rows, fp, label)), key=repr)
    assert sorted(((str(r.doc_id), r.fingerprint, r.component_id) for r in got), key=repr) == want
    one = simhash.near_duplicates(df, blocks=1).collect()
    assert sorted(((str(r.doc_id), r.component_id) for r in one), key=repr) == sorted(((a, c) for a, _, c in want), key=repr)
    clash = df.withColumnRenamed("doc_id", "doc_id").selectExpr("*", "1 as fp", "2 as row", "'x' as component")
    kept = simhash.keep_one(clash)
    assert kept.columns == clash.columns and kept.count() == len(set(label))
    assert {r.fp for r in kept.collect()} == {1}
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_group_links_connect_dense_groups():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, dtype=np.uint64)
    f = np.unique(np.array([base ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(64) for b in range(64)]))
    a, b = simhash.group_links(f, 4, block=100)
    assert len(a) == len(f) - 1 and set(b.tolist()) == {0}


def test_long_runs_at_one_anchor(spark):
    """More near-equal fingerprints than a short run holds, over several Arrow batches."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, dtype=np.uint64)
    f = np.unique(np.array([base ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(30) for b in range(64)]))
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in f], "fp long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = components(simhash.links(df, 4, 1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(f) and len({r.component for r in got}) == 1


def test_hnsw_recall_and_links(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 24))
    vecs = [c + 0.12 * rng.normal(size=24) for c in centres for _ in range(rng.integers(1, 30))] + list(rng.normal(size=(300, 24)))
    vecs = [np.asarray(v) * rng.uniform(0.1, 50) for v in vecs]
    rows = [(i * 3 % 10007, [float(x) for x in v]) for i, v in enumerate(vecs)]
    rows += [(20001, rows[0][1]), (20002, rows[0][1]), (20003, None), (20004, [0.0] * 24), (20005, [float("nan")] + [1.0] * 23),
             (20006, [1.0] * 23 + [None]), (20007, [float("inf")] * 24), (20008, []), (20009, [1.0, 2.0]), (20010, [2.0, 4.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "'x' as kept_by")
    got = hnsw.near_duplicates(df.repartition(4), 0.95, least_shards=3, part_rows=200).collect()
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[k] = np.array(v) / np.linalg.norm(v)

    def near(a):
        return np.array([a in unit and b in unit and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95 for b in range(a)], bool)

    label = plain_components(len(rows), near)
    least, links = {}, np.zeros(len(rows), int)
    for a in range(len(rows)):
        n = near(a)
        links[a] += n.sum()
        links[np.flatnonzero(n)] += 1
        if rows[a][0] is not None:
            least[label[a]] = min(rows[a][0], least.get(label[a], rows[a][0]))
    want = sorted(((str(i), int(n), least.get(c), i is not None and i == least.get(c)) for (i, _), n, c in zip(rows, links, label)), key=repr)
    found = sorted(((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got), key=repr)
    assert sum(n for _, n, _, _ in found) >= 0.9 * links.sum()
    assert sum(n for _, n, _, _ in found) % 2 == 0  # both ends of every link count it
    assert found == want
    assert hnsw.near_duplicates(df.limit(0)).count() == 0
    assert hnsw.near_duplicates(df.filter("vec_id in (20003, 20004)")).count() == 2


def test_audit_widens_until_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.build(x.astype(np.float32), m=6, ef=16)
    r, c = hnsw.audited_hits(g, x, x.astype(np.float32), x, 0.7, ef=2)
    true = (x @ x.T >= 0.7).sum()
    assert len(r) >= 0.9 * true and (np.einsum("pd,pd->p", x[r], x[c]) >= 0.7).all()


def test_audit_widens_for_planted_probes():
    """No two nodes are linked, but nodes that no beam reaches are missed by their probes."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    probe = hnsw.probes(x, 0.95, np.arange(50))
    assert np.allclose(np.einsum("pd,pd->p", probe, x[:50]), 0.951)
    g = hnsw.build(x.astype(np.float32), m=6, ef=16)
    whole = [a.copy() for a in g.layers]
    asked = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(hnsw, "compared", lambda exact, q, todo, threshold: asked.append(len(todo)) or iter(()))
        list(hnsw.audited_blocks(g, x, x.astype(np.float32), x, 0.95, own=np.arange(600)))
        assert 600 not in asked
        for a, b in zip(g.layers, whole):
            a[:] = np.where(b >= 100, -1, b)  # 500 nodes lie apart
        g.entry = 0
        list(hnsw.audited_blocks(g, x, x.astype(np.float32), x, 0.95, own=np.arange(600)))
        assert 600 in asked


def test_forest_spans():
    a, b = np.array(["x", "y", "p", "y"]), np.array(["y", "z", "q", "x"])
    u, v = hnsw.forest(a, b)
    assert len(u) == 3 and {frozenset(p) for p in zip(u.tolist(), v.tolist())} == {frozenset("xy"), frozenset("xz"), frozenset("pq")}


def hot_and_pairs(hot, pairs, dim=24):
    """Unit vectors: one group of ``hot`` near copies, then ``pairs`` pairs of near copies."""
    rng = np.random.default_rng(6)
    base = [rng.normal(size=dim)] * hot + [v for v in rng.normal(size=(pairs, dim)) for _ in range(2)]
    x = np.array(base) + 0.01 * rng.normal(size=(len(base), dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_hot_group_keeps_beams_and_blocks_bounded(monkeypatch):
    """A group larger than the widest beam: its counts are exact and it is one group, from small blocks."""
    x = hot_and_pairs(700, 30)
    g = hnsw.build(x.astype(np.float32), m=6, ef=16)
    names = np.array([f"n{k * 37 % 1009:04d}" for k in range(len(x))], "S5")
    widths, plain = [], hnsw.search
    monkeypatch.setattr(hnsw, "search", lambda g, layer, q, start, ef: widths.append(ef) or plain(g, layer, q, start, ef))
    monkeypatch.setattr(hnsw, "_PAIR_BLOCK", 20_000, raising=False)
    copies = np.arange(len(x)) % 3 + 1
    links = hnsw.Links(names, copies, names, copies, within=True)
    for r, c in hnsw.audited_blocks(g, x, x.astype(np.float32), x, 0.95):
        assert len(r) <= max(20_000, hnsw._QUERY_BLOCK * hnsw._WIDEST)
        links.add(r, c)
    assert max(widths) <= hnsw._WIDEST
    true = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    n = links.n[links.own]
    assert (n[:700] == (true @ copies)[:700]).all() and (n <= true @ copies).all()
    far = hnsw.Links(names[:500], copies[:500], names[500:], copies[500:], within=False)  # both ends get their due
    for r, c in hnsw.compared(x[500:], x[:500], np.arange(500), 0.95):
        far.add(r, c)
    cross = true[:500, 500:]
    assert far.n[far.own].tolist() == (cross @ copies[500:]).tolist() and far.n[far.ids].tolist() == (copies[:500] @ cross).tolist()
    u, v = links.forest()
    hot = set(names[:700].tolist())
    assert sum(a in hot for a in u.tolist()) == 699 and all((a in hot) == (b in hot) for a, b in zip(u.tolist(), v.tolist()))


def test_audit_counts_small_groups():
    """Pairs that no beam reaches beside a large group: their links are found all the same."""
    x = hot_and_pairs(1000, 40)
    g = hnsw.build(x.astype(np.float32), m=6, ef=16)
    for adj in g.layers:
        adj[adj >= 1000] = -1
    g.entry = 0
    r, c = hnsw.audited_hits(g, x, x.astype(np.float32), x, 0.95)
    assert len(r) == (x @ x.T >= 0.95).sum()


def test_audit_leaves_out_the_query_itself():
    """Each query finds itself and misses its copy: half of its hits, but none of its links."""
    x = hot_and_pairs(0, 64)
    n = len(x)
    g = hnsw.Graph(x.astype(np.float32), [np.full((n, 1), -1, np.int64)], 0)
    seen = []

    def only_itself(g, exact, q, q_exact, threshold, ef):
        seen.append(ef)
        k = np.argmax(exact @ q_exact.T, axis=0)
        yield np.arange(len(q)), k

    with pytest.MonkeyPatch.context() as m:
        m.setattr(hnsw, "hits", only_itself)
        blocks = list(hnsw.audited_blocks(g, x, x.astype(np.float32), x, 0.95, recall=0.5, own=np.arange(n)))
    assert sorted(set(seen)) == [32, 64, 128] and sum(len(r) for r, _ in blocks) == 2 * n


def test_visited_marks_are_those_of_a_block(monkeypatch):
    """However many queries ask at once, a block's marks are held, and the audited products come in blocks."""
    x = hot_and_pairs(0, 1500)
    g = hnsw.build(x.astype(np.float32), m=6, ef=16)
    asked, plain = [], hnsw.search
    monkeypatch.setattr(hnsw, "search", lambda g, layer, q, start, ef: asked.append(len(q)) or plain(g, layer, q, start, ef))
    monkeypatch.setattr(hnsw, "_PAIR_BLOCK", 20_000)
    r, c = hnsw.audited_hits(g, x, x.astype(np.float32), x, 0.95, own=np.arange(len(x)))
    assert max(asked) <= hnsw._QUERY_BLOCK
    assert len(r) >= 0.99 * (x @ x.T >= 0.95).sum()


def test_a_graph_travels_in_pieces():
    import pyarrow as pa
    x = hot_and_pairs(20, 600)
    plain = np.concatenate([x.astype(np.float32).astype(np.float64), 3 * x[:1]])  # not all hold in single precision
    for v in (plain, plain[:-1]):
        g = hnsw.build(hnsw.unit(v).astype(np.float32), m=6, ef=16)
        names, copies = np.array([f"n{k:04d}" for k in range(len(v))], "S32"), np.arange(len(v)) % 3 + 1
        raw = hnsw.pack_graph(g, names, copies, v)
        pieces = hnsw.in_pieces(raw)
        assert len(pieces) > 3 and all(len(p.as_buffer()) <= 1 << 16 for p in pieces)
        place = np.arange(len(pieces))
        mixed = place[::-1]
        whole = hnsw.of_pieces(pa.chunked_array([pieces]), place)
        assert whole.to_pybytes() == hnsw.of_pieces(pa.chunked_array([pieces.take(pa.array(mixed))]), mixed).to_pybytes() == raw
        h, ids, n, exact = hnsw.unpack_graph(whole)
        assert len(g.layers) > 1 and h.entry == g.entry and all((a == b).all() for a, b in zip(g.layers, h.layers, strict=True))
        assert (ids == names).all() and (n == copies).all() and (exact == hnsw.unit(v)).all() and (h.vec == g.vec).all()
    assert len(raw) < 225 * len(v)  # 24 numbers of 4 bytes to a vector, not 8
