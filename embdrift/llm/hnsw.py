"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node with a multiplicity. The nodes are dealt over shards by hash; each shard
gets a graph. Every two shards meet once, and every shard meets itself: the nodes of one query the graph of the
other, in parts. A beam descends the layers, widens for a query as long as half of its beam lies above
the threshold, and widens for all queries of the part until an audit finds the recall it asks for:
of the links that exact search finds for evenly spaced queries, and of planted probes, nodes turned away
until they are hardly within the threshold. Past a fixed width matrix products with the whole shard
take the beam's place. Hits are verified by cosine in double precision. They come in blocks of
bounded size, each added to the number of links of both its ends and to a spanning forest over node
numbers, never held as all pairs; components unite the forests.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embdrift.llm.common import stored
from embdrift.llm.components import components
from embdrift.llm.sharding import hash_bucket

_EXPAND = 4        # beam entries expanded at a time
_QUERY_BLOCK = 512  # queries searched together: their visited marks are block * nodes bytes
_WIDEST = 256      # widest beam; comparing a query with the whole shard costs less than wider ones
_PAIR_BLOCK = 4_000_000  # products of queries and nodes held at a time
_PIECE = 1 << 16   # bytes of a graph in one row: the JVM's buffers follow the largest rows
_SLACK = 1e-4      # single precision may be off by less; double precision decides


@dataclass
class Graph:
    vec: np.ndarray            # unit vectors, single precision
    layers: list[np.ndarray]   # per layer: node -> neighbours, -1 where there are fewer
    entry: int


def search(g: Graph, layer: int, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search in one layer for all queries at once: (ids, similarities), best first, -1 / -2 padded."""
    adj, n, nq = g.layers[layer], len(g.vec), len(q)
    seen = np.zeros((nq, n), bool)
    ids = np.full((nq, ef), -1, np.int64)
    sim = np.full((nq, ef), -2.0, np.float32)
    open_ = np.zeros((nq, ef), bool)
    row = np.arange(nq)
    first = start.reshape(nq, -1)[:, :ef]
    for k in range(first.shape[1]):
        new = (first[:, k] >= 0) & ~seen[row, first[:, k]]
        ids[new, k] = first[new, k]
        sim[new, k] = np.einsum("qd,qd->q", g.vec[first[new, k]], q[new])
        open_[new, k] = True
        seen[row[new], first[new, k]] = True
    active = row
    while len(active):
        rank = np.where(open_[active], sim[active], -3)
        take = np.argsort(-rank, axis=1)[:, :_EXPAND]
        at = active[:, None]
        ok = np.take_along_axis(rank, take, 1) > -3
        open_[at, take] = False
        nb = np.where(ok[:, :, None], adj[np.maximum(ids[at, take], 0)], -1).reshape(len(active), -1)
        # Unseen neighbours, each once: a repeat within the row is dropped after sorting.
        nb = np.sort(nb, axis=1)
        fresh = nb >= 0
        fresh[:, 1:] &= nb[:, 1:] != nb[:, :-1]
        fresh &= ~seen[at, np.maximum(nb, 0)]
        r, c = np.nonzero(fresh)
        seen[active[r], nb[r, c]] = True
        s = np.full(nb.shape, -2.0, np.float32)
        s[r, c] = np.einsum("pd,pd->p", g.vec[nb[r, c]], q[active[r]])
        all_sim = np.concatenate([sim[active], s], axis=1)
        all_ids = np.concatenate([ids[active], np.where(fresh, nb, -1)], axis=1)
        all_open = np.concatenate([open_[active], fresh], axis=1)
        best = np.argsort(-all_sim, axis=1, kind="stable")[:, :ef]
        sim[active] = np.take_along_axis(all_sim, best, 1)
        ids[active] = np.take_along_axis(all_ids, best, 1)
        open_[active] = np.take_along_axis(all_open, best, 1)
        active = active[open_[active].any(axis=1)]
    return ids, sim


def descend(g: Graph, q: np.ndarray, to: int) -> np.ndarray:
    """Nearest node found by greedy steps from the top layer down to just above layer ``to``."""
    at = np.full(len(q), g.entry, np.int64)
    for lo in range(0, len(q), _QUERY_BLOCK):
        part = slice(lo, lo + _QUERY_BLOCK)
        for layer in range(len(g.layers) - 1, to, -1):
            at[part] = search(g, layer, q[part], at[part], 1)[0][:, 0]
    return at


def _pick(vec: np.ndarray, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """Up to ``m`` neighbours for each row of candidates (-1 / -2: none), -1 padded: a candidate nearer
    to a picked one than to the node is passed over, unless places stay free."""
    out = np.full((len(cand), m), -1, np.int64)
    for lo in range(0, len(cand), _QUERY_BLOCK):
        order = np.argsort(-sim[lo:lo + _QUERY_BLOCK], axis=1, kind="stable")
        c = np.take_along_axis(cand[lo:lo + _QUERY_BLOCK], order, 1)
        s = np.take_along_axis(sim[lo:lo + _QUERY_BLOCK], order, 1)
        there = c >= 0
        v = vec[np.maximum(c, 0)]
        mutual = v @ v.transpose(0, 2, 1)
        picked = np.zeros(c.shape, bool)
        for k in range(int(there.sum(axis=1).max(initial=0))):
            nearest = np.where(picked[:, :k], mutual[:, k, :k], -2).max(axis=1, initial=-2)
            picked[:, k] = there[:, k] & (nearest <= s[:, k]) & (picked.sum(axis=1) < m)
        first = np.argsort(np.where(picked, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :m]
        got = np.where(np.take_along_axis(there, first, 1), np.take_along_axis(c, first, 1), -1)
        out[lo:lo + len(got), : got.shape[1]] = got
    return out


def _reversed(source: np.ndarray, target: np.ndarray, sim: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links source -> target by target: the targets, and their up to ``most`` nearest sources with similarities, padded."""
    order = np.lexsort((-sim, target))
    source, target, sim = source[order], target[order], sim[order]
    nodes, first, n = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, n)
    keep = place < most
    row = np.repeat(np.arange(len(nodes)), n)[keep]
    cand, near = np.full((len(nodes), most), -1, np.int64), np.full((len(nodes), most), -2.0, np.float32)
    cand[row, place[keep]], near[row, place[keep]] = source[keep], sim[keep]
    return nodes, cand, near


def build(vec: np.ndarray, m: int = 12, ef: int = 48, seed: int = 3) -> Graph:
    """A graph over unit vectors. Nodes enter in batches that at most double the graph; those of a
    batch see each other too. Upper layers hold a geometrically falling share of the nodes."""
    n = len(vec)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(1 - rng.random(n)) / math.log(m)).astype(int), 8)
    top = int(level.max())
    order = np.argsort(-level, kind="stable")  # upper nodes first: every layer has its entry early
    g = Graph(vec, [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(top + 1)], int(order[0]))
    done = 1
    while done < n:
        batch = order[done:done + min(done, _QUERY_BLOCK)]
        for layer in range(int(level[batch].max()), -1, -1):
            new = batch[level[batch] >= layer]
            q, adj = vec[new], g.layers[layer]
            ids, sim = search(g, layer, q, descend(g, q, layer), ef)
            mutual = q @ q.T
            np.fill_diagonal(mutual, -2)
            peers = np.argsort(-mutual, axis=1, kind="stable")[:, : min(m, len(new) - 1)]
            near = _pick(vec, np.concatenate([ids, new[peers]], axis=1),
                         np.concatenate([sim, np.take_along_axis(mutual, peers, 1)], axis=1), m)
            adj[new, :m] = near
            r, c = np.nonzero(near >= 0)
            back = near[r, c]
            nodes, cand, s = _reversed(new[r], back, np.einsum("pd,pd->p", vec[new[r]], vec[back]), adj.shape[1])
            have = adj[nodes]
            have = np.where((have[:, :, None] == cand[:, None, :]).any(axis=2), -1, have)  # each once
            s_have = np.where(have >= 0, np.einsum("rcd,rd->rc", vec[np.maximum(have, 0)], vec[nodes]), -2)
            adj[nodes] = _pick(vec, np.concatenate([have, cand], axis=1), np.concatenate([s_have, s], axis=1), adj.shape[1])
        done += len(batch)
    return g


def unit(x: np.ndarray) -> np.ndarray:
    """The rows of ``x`` in double precision and at unit length."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def pack_graph(g: Graph, ids: np.ndarray, copies: np.ndarray, plain: np.ndarray) -> bytes:
    """A header, then the arrays as they lie in memory; upper layers by the rows of their own nodes.  ``plain``: the
    vectors as they were given, in single precision where that holds them."""
    with np.errstate(over="ignore"):
        single = plain.astype(np.float32)
    arrays = [single if (single == plain).all() else plain, ids, copies, g.layers[0].astype(np.int32)]
    for a in g.layers[1:]:
        own = np.flatnonzero((a >= 0).any(axis=1))
        arrays += [own, a[own].astype(np.int32)]
    head = json.dumps([g.entry, [[a.dtype.str, a.shape] for a in arrays]]).encode()
    out = [len(head).to_bytes(8, "little") + head]
    out.append(bytes(-len(out[0]) % 64))
    for a in arrays:
        out += [a.tobytes(), bytes(-a.nbytes % 64)]
    return b"".join(out)


def unpack_graph(raw: bytes | pa.Buffer) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """The graph, and the node names and copies (views of ``raw``) and unit vectors."""
    raw = memoryview(raw)
    at = 8 + int.from_bytes(raw[:8], "little")
    entry, kinds = json.loads(bytes(raw[8:at]))
    arrays = []
    for kind, shape in kinds:
        at += -at % 64
        arrays.append(np.frombuffer(raw, kind, math.prod(shape), at).reshape(shape))
        at += arrays[-1].nbytes
    plain, ids, copies, *layers = arrays
    whole = [layers[0]]
    for own, rows in zip(layers[1::2], layers[2::2]):
        whole.append(np.full((len(ids), rows.shape[1]), -1, np.int32))
        whole[-1][own] = rows
    exact = unit(plain)
    return Graph(exact.astype(np.float32), whole, entry), ids, copies, exact


def in_pieces(raw: bytes) -> pa.BinaryArray:
    """``raw`` cut into values of ``_PIECE`` bytes."""
    ends = np.minimum(np.arange(0, len(raw) + _PIECE, _PIECE), len(raw)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def of_pieces(pieces: pa.ChunkedArray, place: np.ndarray) -> pa.Buffer:
    """The bytes that ``in_pieces`` cut; where they lie in order, they are not copied."""
    if pieces.num_chunks == 1 and (np.diff(place) > 0).all():
        flat = pieces.chunk(0)
        ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset: flat.offset + len(flat) + 1]
        return flat.buffers()[2].slice(ends[0], ends[-1] - ends[0])
    return pa.py_buffer(b"".join(memoryview(pieces[int(k)].as_buffer()) for k in np.argsort(place)))


def hits(g: Graph, exact: np.ndarray, q: np.ndarray, q_exact: np.ndarray, threshold: float, ef: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs of cosine >= threshold among what the beams found, in blocks.

    A query with hits in more than half of its beam searches again with a beam twice as wide, up to
    all nodes; past ``_WIDEST`` it is compared with all of them.
    """
    todo, start = np.arange(len(q)), descend(g, q, 0)
    while len(todo) and min(ef, len(g.vec)) <= _WIDEST:
        width = min(ef, len(g.vec))
        again = []
        for lo in range(0, len(todo), _QUERY_BLOCK):
            part = todo[lo:lo + _QUERY_BLOCK]
            ids, sim = search(g, 0, q[part], start[part], width)
            full = (sim[:, width // 2] >= threshold - _SLACK) & (width < len(g.vec))
            again.append(part[full])
            r, c = np.nonzero((sim >= threshold - _SLACK) & ~full[:, None])
            node, query = ids[r, c], part[r]
            sure = np.einsum("pd,pd->p", exact[node], q_exact[query]) >= threshold
            yield query[sure], node[sure]
        todo, ef = np.concatenate(again), ef * 2
    yield from compared(exact, q_exact, todo, threshold)


def compared(exact: np.ndarray, q_exact: np.ndarray, todo: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs of cosine >= threshold of the queries ``todo`` with all nodes, in blocks of
    at most ``_PAIR_BLOCK`` products (or one query's)."""
    step = max(1, _PAIR_BLOCK // len(exact))
    for lo in range(0, len(todo), step):
        part = todo[lo:lo + step]
        r, c = np.nonzero(q_exact[part] @ exact.T >= threshold)
        yield part[r], c


def probes(exact: np.ndarray, threshold: float, pick: np.ndarray, seed: int = 9) -> np.ndarray:
    """The nodes ``pick`` turned in a random direction until their cosine with where they were is
    a thousandth above the threshold."""
    away = np.random.default_rng(seed).normal(size=exact[pick].shape)
    away -= np.einsum("pd,pd->p", away, exact[pick])[:, None] * exact[pick]
    size = np.linalg.norm(away, axis=1, keepdims=True)
    cosine = min(1.0, threshold + 1e-3)
    turned = cosine * exact[pick] + math.sqrt(1 - cosine ** 2) * away / np.where(size > 0, size, 1)
    return turned / np.linalg.norm(turned, axis=1, keepdims=True)


def audited_blocks(g: Graph, exact: np.ndarray, q: np.ndarray, q_exact: np.ndarray, threshold: float,
                   ef: int = 32, recall: float = 0.99, planted: float = 0.95, audit: int = 128,
                   own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``hits`` with a beam doubled until the audit is content with what is found for ``audit`` evenly spaced
    queries and nodes: a share ``recall`` of a query's links by exact search, as the mean over the
    queries that have any, so that small groups count as much as large ones, and a share ``planted``
    of the nodes by their probes. ``own``: the node that is the query itself (-1: not in this shard),
    which is no link. Where no beam up to ``_WIDEST`` or the shard's size does, all queries are
    compared with all nodes."""
    pick = np.unique(np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int))
    me = np.full(len(pick), -1) if own is None else own[pick]
    step = max(1, _PAIR_BLOCK // max(1, len(pick)))
    linked = np.concatenate([exact[lo:lo + step] @ q_exact[pick].T >= threshold for lo in range(0, len(exact), step)])  # nodes x audited queries
    linked[me[me >= 0], np.flatnonzero(me >= 0)] = False
    want = linked.sum(axis=0)
    at = np.unique(np.linspace(0, len(exact) - 1, min(audit, len(exact))).astype(int))
    probe = probes(exact, threshold, at)
    while ef <= _WIDEST:
        found, seen = np.zeros(len(pick), np.int64), np.zeros(len(at), bool)
        for r, c in hits(g, exact, q[pick], q_exact[pick], threshold, ef):
            found += np.bincount(r[c != me[r]], minlength=len(pick))
        for r, c in hits(g, exact, probe.astype(np.float32), probe, threshold, ef):
            seen[r[c == at[r]]] = True
        share = np.minimum(found, want)[want > 0] / want[want > 0]
        if (not len(share) or share.mean() >= recall) and (exact.shape[1] < 2 or seen.mean() >= planted):
            yield from hits(g, exact, q, q_exact, threshold, ef)
            return
        if ef >= len(g.vec):
            break
        ef *= 2
    yield from compared(exact, q_exact, np.arange(len(q)), threshold)


def audited_hits(*args, **kw) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``audited_blocks`` at once, for small shards."""
    rows, nodes = zip(*audited_blocks(*args, **kw))
    return np.concatenate(rows), np.concatenate(nodes)


class Links:
    """Links of queries ``own`` with nodes ``ids`` (names), added block by block: how many each end
    has, and what they connect. Its size is that of the names, whatever the number of links.
    ``within``: queries and nodes are of one shard, where a pair is taken from its smaller name's query only."""

    def __init__(self, own: np.ndarray, own_copies: np.ndarray, ids: np.ndarray, copies: np.ndarray, within: bool):
        self.names, at = np.unique(np.concatenate([own, ids]), return_inverse=True)
        self.own, self.ids, self.within = at[: len(own)], at[len(own):], within
        self.own_copies, self.copies = own_copies, copies
        self.n = np.zeros(len(self.names), np.int64)
        self.label = np.arange(len(self.names))

    def add(self, r: np.ndarray, c: np.ndarray) -> None:
        if self.within:
            once = self.own[r] < self.ids[c]
            r, c = r[once], c[once]
        left, right = self.own[r], self.ids[c]
        self.n += np.bincount(left, weights=self.copies[c], minlength=len(self.n)).astype(np.int64)
        self.n += np.bincount(right, weights=self.own_copies[r], minlength=len(self.n)).astype(np.int64)
        a, b = self.label[left], self.label[right]
        if (a != b).any():
            leaf, root = forest(a[a != b], b[a != b])
            to = np.arange(len(self.names))
            to[leaf] = root
            self.label = to[self.label]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        leaf = np.flatnonzero(self.label != np.arange(len(self.names)))
        return self.names[leaf], self.names[self.label[leaf]]


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (left, right), node names of any kind: fewer links than nodes."""
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left):]
    label = np.arange(len(names))
    while True:
        lo = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, lo)
        np.minimum.at(after, b, lo)
        np.minimum.at(after, label[a], lo)
        np.minimum.at(after, label[b], lo)
        after = after[after]
        if (after == label).all():
            break
        label = after
    leaf = np.flatnonzero(label != np.arange(len(names)))
    return names[leaf], names[label[leaf]]


def near_duplicates(rows: DataFrame, threshold: float = 0.95, shard_rows: int = 100_000, least_shards: int = 4,
                    part_rows: int = 50_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept for every row of ``rows``.

    n_links: other rows linked directly; component_id: the smallest id reachable, its own included;
    kept: id = component_id. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing and stand alone. Vectors of different lengths do not link. Rows with a null id
    link like others; a component of null ids only has a null id and is not kept. Repeated rows of
    one id count as rows of their own. ``shard_rows`` bounds a shard's memory, ``part_rows`` a query
    part's; every two shards meet, so the work grows with vectors x shards / 2.
    """
    vec = F.col(vec_col).cast("array<double>")
    base = rows.select(F.col(id_col).alias("id"), vec.alias("v"))
    fine = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) \
        & F.exists("v", lambda x: x != 0)
    base = base.withColumn("node", F.when(fine, F.md5(F.array_join("v", ","))))
    base = stored(base.select("id", "node", F.when(F.col("node").isNotNull(), F.col("v")).alias("v")), "vectors")
    good = base.where("node IS NOT NULL")
    nodes = good.groupBy("node").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    nodes = stored(nodes.withColumn("dim", F.size("v")), "nodes")
    count = nodes.count()
    shards = max(least_shards, math.ceil(count / shard_rows))
    parts = max(1, math.ceil(count / shards / part_rows))
    dealt = nodes.withColumn("shard", hash_bucket(shards, F.col("node"))).withColumn("part", hash_bucket(parts, F.lit("q"), F.col("node")))

    def ordered(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, copies and vectors by name."""
        own = np.array(t["node"].to_pylist(), "S32")
        order = np.argsort(own)
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["v"].chunks])
        return own[order], t["copies"].to_numpy()[order], flat.reshape(len(own), -1)[order]

    def graph(key, nodes):
        ids, copies, plain = ordered(nodes)
        pieces = in_pieces(pack_graph(build(unit(plain).astype(np.float32)), ids, copies, plain))
        n = len(pieces)
        return pa.table({"dim": pa.array(np.full(n, key[0].as_py()), pa.int32()), "shard": pa.array(np.full(n, key[1].as_py()), pa.int64()),
                         "piece": pa.array(np.arange(n), pa.int32()), "graph": pieces})

    graphs = stored(dealt.groupBy("dim", "shard").applyInArrow(graph, "dim int, shard bigint, piece int, graph binary"), "graphs")

    def answer(a: list, b: list, n: list) -> pa.Table:
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "n": pa.array(n, pa.int64())})

    def ask(key, left, right):
        if not left.num_rows or not right.num_rows:
            return answer([], [], [])
        g, ids, copies, exact = unpack_graph(of_pieces(left["graph"], left["piece"].to_numpy()))
        own, own_copies, q_exact = ordered(right)
        q_exact = unit(q_exact)
        links = Links(own, own_copies, ids, copies, within=key[1].as_py() == key[2].as_py())
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)  # ids ascend
        at = np.where(ids[at] == own, at, -1)
        for r, c in audited_blocks(g, exact, q_exact.astype(np.float32), q_exact, threshold, own=at):
            links.add(r, c)
        (x, y), linked = links.forest(), np.flatnonzero(links.n)
        a = [t.decode() for t in [*x.tolist(), *links.names[linked].tolist()]]
        b = [t.decode() for t in y.tolist()] + [""] * len(linked)
        return answer(a, b, [0] * len(x) + links.n[linked].tolist())

    def each(name: str, least, most: int):
        return F.explode(F.sequence(least, F.lit(most).cast("bigint"))).alias(name)

    zero = F.lit(0).cast("bigint")
    left = graphs.select("dim", "shard", "piece", "graph", F.explode(F.sequence(zero, F.col("shard"))).alias("home")).select("*", each("part", zero, parts - 1))
    right = dealt.select("dim", "node", "v", "copies", "part", F.col("shard").alias("home"), each("shard", F.col("shard"), shards - 1))
    keys = ["dim", "shard", "home", "part"]
    found = stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(ask, "a string, b string, n bigint"), "found")
    degree = found.where("b = ''").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    group = components(found.where("b <> ''").select("a", "b"))
    member = (nodes.select("node", "copies", "least").join(degree, "node", "left").join(group, "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    whole = member.groupBy("component").agg(F.min("least").alias("component_id"))
    member = member.join(whole, "component").select(
        "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = base.select("id", "node").join(member, "node", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
