"""Language-model scoring with sharded Elias-Fano n-gram tries.

Texts are cut into chunks of documents inside the scan's tasks: once to count words, once into a
shuffle by chunk that all further steps read. A chunk sends each of its different n-grams once, with
its count among training texts, to the shard that owns it, and gets numbers back in the same order:

1. word counts: shards by word; the answer is c(w) over all training texts. Totals N and V and the
   words above ``shard_tokens`` (at most N / shard_tokens of them) become known here.
2. trigrams u v w: shards by middle word v, so that all counts with v meet: c(u v w), c(u v),
   c(v w), c(v). The shard builds its trie, maps it into memory and answers every trigram of
   every chunk with x, y of P(w | u v) = x + y * P(w), quantised.
   A word above ``shard_tokens`` is dealt over several shards by (u, w); the pair counts that such
   a part cannot see come from shards by pair (step 1b), addressed to the parts that need them.
3. each chunk puts answers and texts together and sums the log10 probabilities per document.

A frequent n-gram thus crosses the shuffle once per chunk and no shard grows with a word's
frequency. Chunks are named by a digest of what they hold: an input that does not read the same
twice fails instead of mixing answers.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embdrift.llm.common import stored
from embdrift.llm.eftrie import Quantiser, Trie
from embdrift.llm.tokens import text_runs

#: Hashes of the marks beside words; their strings hold white space, so no word has them.
END = np.uint64(xxhash.xxh64_intdigest(" end"))
BEGIN = np.uint64(xxhash.xxh64_intdigest(" begin"))
#: Bits of a trigram's number beside a mark and the sign.
MARKED_BITS = 62
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Config:
    chunk_tokens: int = 2_000_000  # bounds a chunk's memory (one longer text is a chunk of its own)
    shard_tokens: int = 2_000_000  # training and scored n-grams of a shard, about
    smoothing: tuple[tuple[float, float], tuple[float, float]] = ((1.5, 0.85), (2.0, 0.95))
    node_bits: int = 12            # of probabilities in the trie
    answer_bits: int = 14          # of x and y


# ---- arrays over the wire -------------------------------------------------------------------

def dump(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, compressed together.

    Each is cut to the bytes that its largest value needs and stored byte plane by byte plane,
    which zstandard packs better than whole numbers.
    """
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        head += [width, len(a)]
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    raw = np.array(head, "<u8").tobytes() + b"".join(body)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def load(raw: bytes) -> list[np.ndarray]:
    """The arrays of ``dump``, as 64-bit unsigned integers."""
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    head = np.frombuffer(raw, "<u8", 2 * n, 8).reshape(-1, 2)
    at, out = 8 + 16 * n, []
    for width, size in head.tolist():
        planes = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size)
        a = np.zeros((size, 8), np.uint8)
        a[:, :width] = planes.T
        out.append(a.view("<u8").ravel())
        at += width * size
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, the first as it is; ``np.cumsum`` undoes it."""
    out = ascending.copy()
    out[1:] -= ascending[:-1]
    return out


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs (order matters)."""
    with np.errstate(over="ignore"):
        x = (a * _MIX) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, ascending, and the place of each entry among them: ``np.unique`` with its
    inverse. Ascending numbers need no sort."""
    if not (key[1:] < key[:-1]).any():
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        return key[first], np.cumsum(first) - 1
    order = np.argsort(key)
    run = key[order]
    first = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.empty(0, bool)
    back = np.empty(len(key), np.int64)
    back[order] = np.cumsum(first) - 1
    return run[first], back


# ---- chunks ---------------------------------------------------------------------------------

@dataclass
class Chunk:
    name: str
    words: np.ndarray   # ascending hashes, BEGIN and END among them
    seq: np.ndarray     # places in words: per document BEGIN BEGIN t1 .. tn END
    lens: np.ndarray    # entries of seq per document
    doc_id: np.ndarray
    has_id: np.ndarray
    held_out: np.ndarray

    def train_positions(self) -> np.ndarray:
        return np.repeat(~self.held_out.astype(bool), self.lens)

    def dump(self) -> bytes:
        """Words are numbered from the most frequent on, equally frequent ones ascending: small numbers pack well."""
        order = np.argsort(-np.bincount(self.seq, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        return dump(steps(self.words[order]), rank[self.seq], self.lens, self.doc_id.view(np.uint64), self.has_id, self.held_out)

    @classmethod
    def load(cls, name: str, raw: bytes) -> Chunk:
        w, s, n, d, h, o = load(raw)
        w = np.cumsum(w, dtype=np.uint64)  # steps down came as numbers modulo 2 ** 64
        order = np.argsort(w)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        return cls(name, w[order], place[s.view(np.int64)], n.astype(np.int64), d.view(np.int64), h.astype(np.uint8), o.astype(np.uint8))

    # Word counts.
    def word_counts(self) -> np.ndarray:
        """Training count of each word; BEGIN counts documents, END too."""
        starts = np.cumsum(self.lens) - self.lens
        seq = np.delete(self.seq, starts)  # one BEGIN of the two
        keep = np.delete(self.train_positions(), starts)
        return np.bincount(seq[keep], minlength=len(self.words))

    # Trigrams, each as one number v | u | w; where three places do not fit 62 bits (over a million
    # different words, so one huge text), pairs are numbered first and the number is pair | w.
    def positions(self) -> np.ndarray:
        """Places in seq of the last words of the trigrams."""
        place = np.cumsum(self.lens) - self.lens
        inside = np.ones(len(self.seq), bool)
        inside[place] = inside[place + 1] = False
        return np.flatnonzero(inside)

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(number of the trigram at each place, pairs if they are numbered)."""
        bits, pairs = len(self.words).bit_length(), None
        key = self.seq[at - 1].astype(np.int64)
        key <<= bits
        key |= self.seq[at - 2]
        if 3 * bits > MARKED_BITS:
            pairs, key = distinct(key)
        key <<= bits
        key |= self.seq[at]
        return key, pairs

    def split(self, key: np.ndarray, pairs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(v, u, w) of trigram numbers."""
        bits = len(self.words).bit_length()
        low = (1 << bits) - 1
        both = key >> bits if pairs is None else pairs[key >> bits]
        return both >> bits, both & low, key & low

    def counted(self, at: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """((v, u, w) of the different trigrams ascending, how often they occur in training documents)."""
        key, pairs = self.keys(at)
        key <<= 1
        key |= self.train_positions()[at]
        key.sort()
        train = (key & 1).astype(np.int32)
        key >>= 1
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        return self.split(key[first], pairs), np.add.reduceat(train, first) if len(first) else train


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the different words, place of each word of the texts among them, where each text's words
    begin, and their end). Arrow lower-cases A-Z, cuts at ASCII white space and numbers the words."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    edges, flat = np.asarray(cut.offsets, np.int64), cut.flatten()
    real = np.asarray(pc.binary_length(flat)) > 0  # white space around a text cuts off empty words
    if not real.all():
        edges, flat = np.concatenate([[0], np.cumsum(real)])[edges], flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    kinds = coded.dictionary
    line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(kinds)], pa.int32()), kinds), pa.scalar(" ", kinds.type))
    words = line[0].as_buffer().to_pybytes().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(kinds)), np.asarray(coded.indices), edges


def _chunk(name: str, parts: list[tuple], ids: list, held: list) -> Chunk:
    """The chunk of some texts; parts: (hashes, places of the words, words of each text)."""
    used = []
    for hashes, at, _ in parts:
        seen = np.zeros(len(hashes), bool)
        seen[at] = True
        used.append(np.flatnonzero(seen))
    words, to = distinct(np.concatenate([np.array([BEGIN, END], np.uint64), *[p[0][u] for p, u in zip(parts, used)]]))
    begin, end, to = to[0], to[1], to[2:].astype(np.int32)
    lens = np.concatenate([n for _, _, n in parts]) + 3
    seq = np.full(int(lens.sum()), begin, np.int32)
    after = np.cumsum(lens)
    inside = np.ones(len(seq), bool)
    inside[after - lens] = inside[after - lens + 1] = inside[after - 1] = False
    seq[after - 1] = end
    place = []
    for (hashes, at, _), u in zip(parts, used):
        number = np.zeros(len(hashes), np.int32)
        number[u], to = to[:len(u)], to[len(u):]
        place.append(number[at])
    seq[inside] = np.concatenate(place)
    c = Chunk("", words, seq, lens, np.array([d or 0 for d in ids], np.int64),
              np.array([d is not None for d in ids], np.uint8), np.array(held, np.uint8))
    digest = xxhash.xxh64(words.tobytes())
    for a in (c.seq, c.lens, c.doc_id, c.held_out):
        digest.update(a.tobytes())
    c.name = f"{name}-{digest.hexdigest()}"
    return c


def chunks_of(batches: Iterator[pa.RecordBatch], config: Config) -> Iterator[Chunk]:
    """Chunks of a task's rows (doc_id, text, held_out), in the order of the rows."""
    from pyspark import TaskContext

    context = TaskContext.get()
    part, number = context.partitionId() if context else 0, 0
    parts, ids, held, size = [], [], [], 0
    for b in batches:
        texts, doc_id, out = b.column("text"), b.column("doc_id").to_pylist(), b.column("held_out").to_pylist()
        for lo, hi in text_runs(texts):
            hashes, at, edges = _cut(texts.slice(lo, hi - lo))
            lens, first = np.diff(edges), 0
            for k, n in enumerate([*lens.tolist(), None]):
                full = n is not None and size and size + n > config.chunk_tokens
                if (full or n is None) and k > first:
                    parts.append((hashes, at[edges[first]:edges[k]], lens[first:k]))
                    ids += doc_id[lo + first:lo + k]
                    held += out[lo + first:lo + k]
                    first = k
                if full:
                    yield _chunk(f"{part}-{number}", parts, ids, held)
                    number += 1
                    parts, ids, held, size = [], [], [], 0
                size += (n or 0) + 1
            size -= 1  # no text was the last one
    if parts:
        yield _chunk(f"{part}-{number}", parts, ids, held)
    parts = texts = hashes = at = None
    pa.default_memory_pool().release_unused()  # the worker serves other steps' tasks next


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """The chunks of rows (chunk, payload)."""
    for b in batches:
        for name, payload in zip(b.column("chunk").to_pylist(), b.column("payload")):
            yield Chunk.load(name, payload.as_buffer())


# ---- step 1: word counts --------------------------------------------------------------------

_MESSAGE = "shard int, chunk string, payload binary"


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, ["shard", "chunk", "payload"], [pa.int32(), pa.string(), pa.binary()])


def _split(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) for every shard that occurs, the places in their order."""
    small = len(shard) and shard.max() < 1 << 16
    order = np.argsort(shard.astype(np.uint16) if small else shard, kind="stable")  # 16 bits: by counting, in one pass
    cut = np.flatnonzero(np.diff(shard[order])) + 1
    for at in np.split(order, cut) if len(order) else []:
        yield int(shard[at[0]]), at


def word_shards(words: np.ndarray, shards: int) -> np.ndarray:
    return (mix(words, np.uint64(1) + np.zeros_like(words)) % np.uint64(shards)).astype(np.int32)


def _count_words(pdf: pd.DataFrame, hot_from: int) -> pd.DataFrame:
    """Reducer of step 1: one answer per message; totals ride on the first."""
    messages = [load(p) for p in pdf["payload"]]
    sizes = [len(m[0]) for m in messages]
    words, back = np.unique(np.concatenate([np.cumsum(m[0], dtype=np.uint64) for m in messages]), return_inverse=True)
    count = np.bincount(back, weights=np.concatenate([m[1] for m in messages]).astype(np.float64), minlength=len(words)).astype(np.int64)
    cut = np.split(back, np.cumsum(sizes)[:-1])
    token = words != BEGIN
    hot = count >= hot_from
    n = len(pdf)
    return pd.DataFrame({
        "chunk": pdf["chunk"], "shard": pdf["shard"], "payload": [dump(count[b]) for b in cut],
        "tokens": [int(count[token].sum())] + [0] * (n - 1), "kinds": [int((count[token] > 0).sum())] + [0] * (n - 1),
        "grams": [int(sum(sizes))] + [0] * (n - 1),
        "hot": [dump(words[hot], count[hot]) if hot.any() else None] + [None] * (n - 1)})


# ---- hot words ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Layout:
    """Who owns which trigram: the number of shards, and for words above the limit (ascending
    hashes) their counts; such a word has ceil(count / limit) parts."""

    shards: int
    limit: int
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    count: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def find(self, words: np.ndarray) -> np.ndarray:
        """Place of each word among the hot ones, -1 for others."""
        if not len(self.hot):
            return np.full(len(words), -1, np.int64)
        k = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return np.where(self.hot[k] == words, k, -1)

    def owner(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Shard of trigrams, from the hashes and the hot place of v."""
        part = np.zeros(len(v), np.uint64)
        at = np.flatnonzero(hot >= 0)
        if len(at):
            parts = -(-self.count[hot[at]] // self.limit)
            part[at] = mix(u[at], w[at]) % parts.astype(np.uint64)
        return (mix(v, part + np.uint64(2)) % np.uint64(self.shards)).astype(np.int32)


_BEFORE, _AFTER = np.uint64(11), np.uint64(12)


def _pair_key(v: np.ndarray, other: np.ndarray, kind: np.uint64) -> np.ndarray:
    return mix(mix(v, other), np.full(len(v), kind, np.uint64))


def _hot_pairs(c: Chunk, layout: Layout, shards: int) -> list[tuple]:
    """Step 1b: training counts of pairs with a hot middle word, with the parts that need them."""
    place = c.positions()
    hot = layout.find(c.words)
    place = place[hot[c.seq[place - 1]] >= 0]
    if not len(place):
        return []
    (v, u, w), n = c.counted(place)
    hot = hot[v]
    v, u, w = c.words[v], c.words[u], c.words[w]
    target = layout.owner(u, v, w, hot)
    key = np.concatenate([_pair_key(v, u, _BEFORE), _pair_key(v, w, _AFTER)])
    rows = []
    for shard, p in _split((key % np.uint64(shards)).astype(np.int32)):
        k, t, m = key[p], np.concatenate([target, target])[p], np.concatenate([n, n])[p]
        # One entry per (pair, part): counts summed, both ascending.
        order = np.lexsort((t, k))
        k, t, m = k[order], t[order], m[order]
        new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])])
        rows.append((shard, c.name, dump(steps(k[new]), t[new], np.add.reduceat(m, new))))
    return rows


def _count_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Reducer of step 1b: the counts of pairs, sorted by the shard that they go to."""
    messages = [load(p) for p in pdf["payload"]]
    k = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in messages])
    t, m = (np.concatenate([x[j] for x in messages]) for j in (1, 2))
    keys, back = np.unique(k, return_inverse=True)
    total = np.bincount(back, weights=m.astype(np.float64)).astype(np.int64)
    width = np.int64(len(keys))
    need = np.unique(t.astype(np.int64) * width + back)
    rows = [(s, dump(steps(keys[need[p] % width]), total[need[p] % width])) for s, p in _split((need // width).astype(np.int32))]
    return pd.DataFrame(rows, columns=["shard", "payload"])


# ---- step 2: trigrams -----------------------------------------------------------------------

def _by_owner(c: Chunk, layout: Layout, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, places) of the chunk's different trigrams: the same on the way out and on the way back."""
    hot = layout.find(c.words)[v]
    if (hot >= 0).any():
        owner = layout.owner(c.words[u], c.words[v], c.words[w], hot)
    else:
        owner = layout.owner(c.words, c.words, c.words, np.full(len(c.words), -1))[v]
    return list(_split(owner))


def _gram_rows(c: Chunk, layout: Layout) -> Iterator[tuple]:
    (v, u, w), n = c.counted(c.positions())
    number = np.zeros(len(c.words), np.int64)
    for shard, p in _by_owner(c, layout, v, u, w):
        pv, pu, pw = v[p], u[p], w[p]
        seen = np.zeros(len(c.words), bool)
        seen[pv] = seen[pu] = seen[pw] = True
        used = np.flatnonzero(seen)
        number[used] = np.arange(len(used))
        yield shard, c.name, dump(steps(c.words[used]), steps(number[pv]), number[pu], number[pw], n[p])


def shard_trie(words: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, config: Config,
               layout: Layout, pair_keys: np.ndarray, pair_counts: np.ndarray) -> bytes:
    """The trie of a shard from its different trigrams (places in ``words``, ascending by v, u, w) and
    their training counts; pairs with a hot v have their counts in ``pair_counts``."""
    width = np.int64(len(words) + 1)
    hot = layout.find(words)

    def pairs(other: np.ndarray, kind: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, back = distinct(v * width + other)
        a, b = (keys // width).astype(np.int32), (keys % width).astype(np.int32)
        del keys
        count = np.bincount(back, weights=n.astype(np.float64), minlength=len(a)).astype(np.int64)
        del back
        at = np.flatnonzero(hot[a] >= 0)
        if len(at):
            k = np.searchsorted(pair_keys, key := _pair_key(words[a[at]], words[b[at]], kind))
            if not len(pair_keys) or (pair_keys[np.minimum(k, len(pair_keys) - 1)] != key).any():
                raise RuntimeError("counts of a frequent word's pairs are missing")
            count[at] = pair_counts[k]
        some = count > 0
        return a[some], b[some], count[some]

    total = np.bincount(v, weights=n.astype(np.float64), minlength=len(words)).astype(np.int64)
    total[hot >= 0] = layout.count[hot[hot >= 0]]
    seen = n > 0
    arrays = Trie.build(words, pairs(w, _AFTER), (v[seen], u[seen], w[seen], n[seen]),
                        {"v": total, "context": pairs(u, _BEFORE)}, config.smoothing, config.node_bits)
    return Trie.save(arrays, config.node_bits)


def _answer_grams(pdf: pd.DataFrame, config: Config, layout: Layout) -> pd.DataFrame:
    """Reducer of step 2: build the shard's trie, map it, answer every message."""
    given = pdf["chunk"].isna()
    extra = [load(p) for p in pdf.loc[given, "payload"]]
    pdf = pdf[~given]
    if pdf.empty:
        return pd.DataFrame({"chunk": [], "shard": [], "payload": []})
    keys = np.concatenate([np.cumsum(e[0], dtype=np.uint64) for e in extra]) if extra else np.empty(0, np.uint64)
    pair_counts = np.concatenate([e[1] for e in extra]).astype(np.int64) if extra else np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, pair_counts = keys[order], pair_counts[order]
    sizes, vocabularies = [], []
    for payload in pdf["payload"]:  # unpacked twice, as all messages' arrays would not be small
        vocabulary, dv = load(payload)[:2]
        sizes.append(len(dv))
        vocabularies.append(np.cumsum(vocabulary, dtype=np.uint64))
    edges = np.cumsum([0, *map(len, vocabularies)])
    words, number = distinct(np.concatenate(vocabularies))
    del vocabularies
    bits = max(1, len(words).bit_length())
    low = np.int64((1 << bits) - 1)
    ends = np.cumsum([0, *sizes])
    key, last, n = np.empty(ends[-1], np.int64), np.empty(ends[-1], np.int32), np.empty(ends[-1], np.float64)
    for k, payload in enumerate(pdf["payload"]):
        _, dv, mu, mw, mn = load(payload)
        to, own = number[edges[k]:edges[k + 1]], slice(ends[k], ends[k + 1])
        key[own] = to[np.cumsum(dv.view(np.int64))] << bits | to[mu.view(np.int64)]
        last[own], n[own] = to[mw.view(np.int64)], mn
    del number
    context = None
    if 3 * bits > 63:  # too many words of a shard for one number: contexts are numbered first
        context, key = distinct(key)
    key <<= bits
    key |= last
    del last
    grams, back = distinct(key)
    del key
    back = back.astype(np.int32)
    n = np.bincount(back, weights=n, minlength=len(grams)).astype(np.int64)
    w = (grams & low).astype(np.int32)
    grams >>= bits
    if context is not None:
        grams = context[grams]
    v, u = (grams >> bits).astype(np.int32), (grams & low).astype(np.int32)
    del grams
    raw = shard_trie(words, v, u, w, n, config, layout, keys, pair_counts)
    quant = Quantiser(config.answer_bits)
    handle, path = tempfile.mkstemp(prefix="trie-", suffix=".eft")  # the task's own, gone with it
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(raw)
        del raw
        trie = Trie.open(path)
        x, y = np.empty(len(v), np.uint16), np.empty(len(v), np.uint16)
        numbers = trie.numbers(words)
        for lo in range(0, len(v), 1 << 15):
            s = slice(lo, lo + (1 << 15))
            px, py = trie.ask(numbers, u[s], v[s], w[s])
            x[s], y[s] = quant.code(px), quant.code(py)
        del trie
    finally:
        os.unlink(path)
    cut = np.split(back, np.cumsum(sizes)[:-1])
    return pd.DataFrame({"chunk": pdf["chunk"], "shard": pdf["shard"], "payload": [dump(x[b], y[b]) for b in cut]})


# ---- step 3: sums ---------------------------------------------------------------------------

def _score_chunk(cut: pd.DataFrame, answers: pd.DataFrame, config: Config, layout: Layout, word_shard_count: int, total: int,
                 kinds: int) -> pd.DataFrame:
    if len(cut) != 1:
        raise RuntimeError("the documents did not read the same twice; write them to a table first")
    c = Chunk.load(cut["chunk"].iloc[0], cut["payload"].iloc[0])
    by = {(k, int(s)): p for k, s, p in zip(answers["kind"], answers["shard"], answers["payload"])}
    count = np.empty(len(c.words), np.int64)
    at = c.positions()
    key, pairs = c.keys(at)
    key, back = distinct(key)
    v, u, w = c.split(key, pairs)
    parts = _by_owner(c, layout, v, u, w)
    del key, u
    x, y = np.empty(len(v)), np.empty(len(v))
    quant = Quantiser(config.answer_bits)
    try:
        for s, p in _split(word_shards(c.words, word_shard_count)):
            count[p] = load(by["word", s])[0].astype(np.int64)
        for s, p in parts:
            cx, cy = load(by["gram", s])
            x[p], y[p] = quant.value(cx), quant.value(cy)
    except KeyError:
        raise RuntimeError("the documents did not read the same twice; write them to a table first") from None
    base = (count + 1.0) / (total + kinds + 1.0)
    log_p = np.log10(x + y * base[w])[back]
    last = c.seq[at]
    grams = c.lens - 2
    starts = np.cumsum(grams) - grams
    sums = lambda z: np.add.reduceat(z, starts)
    return pd.DataFrame({
        "doc_id": pd.array(c.doc_id, "Int64").copy() if c.has_id.all() else pd.array(
            [int(d) if h else None for d, h in zip(c.doc_id, c.has_id)], "Int64"),
        "held_out": c.held_out.astype(bool), "n_tokens": grams, "n_known": sums((count[last] > 0).astype(np.int64)),
        "train_tokens": np.full(len(grams), total, np.int64), "base_score": sums(np.log10(base)[last]), "score": sums(log_p)})


def score(docs: DataFrame, held_out: Column, config: Config = Config()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    The model learns from rows where ``held_out`` is false (null: false). Tokens: A-Z lower-cased
    words, then one end. base_score: sum of log10((c + 1) / (N + V + 1)); score: sum of the trigram
    model's log10 probabilities, whose lowest order is the base. A null or empty text has the end
    alone; null ids and repeated rows are rows like others; without training rows N = V = 0.
    Words are known by 64-bit hash.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def word_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_of(batches, config):
            n = c.word_counts()
            yield _messages([(s, c.name, dump(steps(c.words[p]), n[p])) for s, p in _split(word_shards(c.words, shards))])

    answer = "chunk string, shard int, payload binary"
    counted = rows.mapInArrow(word_messages, _MESSAGE).groupBy("shard").applyInPandas(
        lambda pdf: _count_words(pdf, config.shard_tokens), answer + ", tokens bigint, kinds bigint, grams bigint, hot binary")
    counted = stored(counted, "lm-words")
    t = counted.agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    total, kinds = int(t.n or 0), int(t.v or 0)
    # Words above the limit: at most N / shard_tokens of them, and BEGIN.
    hot = [load(r.hot) for r in counted.where("hot IS NOT NULL").select("hot").collect()]
    names = np.concatenate([h[0] for h in hot]).astype(np.uint64) if hot else np.empty(0, np.uint64)
    counts = np.concatenate([h[1] for h in hot]).astype(np.int64) if hot else np.empty(0, np.int64)
    order = np.argsort(names)
    layout = Layout(max(shards, -(-total // config.shard_tokens)), config.shard_tokens, names[order], counts[order])
    pair_shards = layout.shards

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_of(batches, config):
            yield _batch([(c.name, c.dump())], ["chunk", "payload"], [pa.string(), pa.binary()])

    def pair_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _loaded(batches):
            yield _messages(_hot_pairs(c, layout, pair_shards))

    def gram_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _loaded(batches):
            for row in _gram_rows(c, layout):
                yield _messages([row])

    # Steps 1b, 2 and 3 read the cut texts from one shuffle: its plan is the same in all three.
    cut = rows.mapInArrow(cut_texts, "chunk string, payload binary").repartition("chunk")
    grams = cut.mapInArrow(gram_messages, _MESSAGE)
    if len(names):
        pairs = cut.mapInArrow(pair_messages, _MESSAGE).groupBy("shard").applyInPandas(_count_pairs, "shard int, payload binary")
        grams = grams.unionByName(pairs.select("shard", F.lit(None).cast("string").alias("chunk"), "payload"))
    answered = grams.groupBy("shard").applyInPandas(lambda pdf: _answer_grams(pdf, config, layout), answer)
    kind = lambda df, k: df.select("chunk", F.lit(k).alias("kind"), "shard", "payload")
    answers = kind(counted, "word").unionByName(kind(answered, "gram"))
    return cut.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        lambda texts, given: _score_chunk(texts, given, config, layout, shards, total, kinds),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
