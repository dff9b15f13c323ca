"""Elias-Fano sequences and an n-gram trie of three levels over them, all in flat arrays.

A trie file is one run of 64-bit words after a small header; ``Trie.open`` maps it into memory, and
queries touch only the pages they need. All operations are vectorised over queries.
"""

from __future__ import annotations

import json

import numpy as np

_ONE = np.uint64(1)
_ALL = ~np.uint64(0)


#: Every byte's bits counted from the left of a multiplication: 0x01 in each byte.
_BYTES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)
#: Place of the k-th one of a byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8).ravel()


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one of each word: the ones up to each byte's end side by side in one
    number, the byte by comparing all eight with k at once, the place in it from a table."""
    n = word - ((word >> _ONE) & np.uint64(0x5555555555555555))
    n = (n & np.uint64(0x3333333333333333)) + ((n >> np.uint64(2)) & np.uint64(0x3333333333333333))
    n += n >> np.uint64(4)
    n &= np.uint64(0x0F0F0F0F0F0F0F0F)
    n *= _BYTES
    upto = k * _BYTES
    upto |= _TOPS
    upto -= n
    upto &= _TOPS
    at = np.bitwise_count(upto).astype(np.uint64)  # bytes whose ones do not reach k
    at <<= np.uint64(3)
    n <<= np.uint64(8)
    n >>= at
    n &= np.uint64(255)
    place = word >> at
    place &= np.uint64(255)
    place <<= np.uint64(3)
    place += k
    place -= n
    at += _IN_BYTE[place.view(np.int64)]
    return at.view(np.int64)


def _kinds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with its inverse; ascending numbers need no sort."""
    if len(x) and not (x[1:] < x[:-1]).any():
        new = np.concatenate([[True], x[1:] != x[:-1]])
        return x[new], np.cumsum(new) - 1
    return np.unique(x, return_inverse=True)


class EliasFano:
    """A non-decreasing sequence of unsigned integers: low bits packed, high bits in unary.

    ``arrays``: [meta (n, low bits), low words, high words, ones before each high word].
    """

    def __init__(self, arrays: list[np.ndarray]):
        meta, self.low, self.high, self.ones = arrays
        self.n, self.bits = int(meta[0]), int(meta[1])
        self.mask = np.uint64((1 << self.bits) - 1)
        self.zeros = np.arange(len(self.ones), dtype=np.uint64) * np.uint64(64) - self.ones  # before each high word

    @staticmethod
    def build(values: np.ndarray) -> list[np.ndarray]:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = min(56, max(0, (top // n).bit_length() - 1)) if n else 0
        low = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        step = 1 << 16  # a multiple of 64 values fills whole words
        for lo in range(0, n if bits else 0, step):
            part = values[lo:lo + step] & np.uint64((1 << bits) - 1)
            raw = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits].ravel()
            raw = np.concatenate([raw, np.zeros(-len(raw) % 64, np.uint8)])
            words = np.packbits(raw, bitorder="little").view(np.uint64)
            low[lo * bits // 64: lo * bits // 64 + len(words)] = words
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (top >> bits) + n + 1
        high = np.zeros((size + 63) // 64 + 1, np.uint64)
        # The places ascend strictly: the ones of a word are a run, summed by their powers.
        word = places >> 6
        if n:
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            high[word[first]] = np.bitwise_or.reduceat(_ONE << (places & 63).astype(np.uint64), first)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.uint64))]).astype(np.uint64)
        return [np.array([n, bits], np.uint64), low, high, ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        return self._window(self.low, i * self.bits) & self.mask

    @staticmethod
    def _window(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The 64 bits from each bit on."""
        word, shift = at >> 6, (at & 63).view(np.uint64)
        out = words[word]
        out >>= shift
        word += 1
        upper = words[word]
        upper <<= _ONE
        upper <<= np.uint64(63) - shift
        out |= upper
        return out

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th one (zero) of the high bits."""
        before = self.ones if one else self.zeros
        word = np.searchsorted(before, k.astype(np.uint64), side="right") - 1
        bits = self.high[np.minimum(word, len(self.high) - 1)]
        return word * 64 + _select_in_word(bits if one else bits ^ _ALL, k.astype(np.uint64) - before[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value >= x, whether it equals x); place n if there is none."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        h = x >> np.uint64(self.bits)
        beyond = h >= np.uint64(len(self.high) * 64 - self.n)  # zeros there are, padding included
        h = np.where(beyond, 0, h).astype(np.int64)
        at = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1, 0)
        lo = at - h
        # The values of the high part are the run of ones from there on; only one that fills a word is searched.
        run = self._window(self.high, np.minimum(at, 64 * (len(self.high) - 1) - 1))
        run = np.bitwise_count(run & ~(run + _ONE)).astype(np.int64)
        long = np.flatnonzero(run == 64)
        run[long] = self._select(h[long], False) - at[long]
        end = np.minimum(lo + run, self.n)
        lo = np.minimum(lo, self.n)
        hi, want = end.copy(), x & self.mask
        todo = np.flatnonzero(lo < hi)
        while len(todo):  # most ranges are short: each step looks at the open ones alone
            a, b = lo[todo], hi[todo]
            mid = (a + b) >> 1
            less = self._low(mid) < want[todo]
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            lo[todo], hi[todo] = a, b
            todo = todo[a < b]
        same = (lo < end) & (self._low(np.minimum(lo, self.n - 1)) == want) & ~beyond
        return np.where(beyond, self.n, lo), same


def ranged(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Ascending sequence from ranges that each ascend: every range is lifted by the last value
    (plus one) of the range before. ``first``: start of each range and the end."""
    values = np.asarray(values, np.int64)
    if not len(values):
        return values
    n = np.diff(first)
    last = np.where(n > 0, values[np.maximum(first[1:] - 1, 0)] + 1, 0)
    return values + np.repeat(np.cumsum(last) - last, n)


class Quantiser:
    """Probabilities as codes: 0 is zero, 1 to 2**bits - 1 are steps of their logarithm."""

    def __init__(self, bits: int, span: float = 48.0):
        self.top, self.step = (1 << bits) - 1, span / ((1 << bits) - 2)

    def code(self, p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            c = np.rint(-np.log(p) / self.step) + 1
        return np.where(p > 0, np.clip(c, 1, self.top), 0).astype(np.uint16)

    def value(self, code: np.ndarray) -> np.ndarray:
        return np.where(code > 0, np.exp(-(code.astype(np.float64) - 1) * self.step), 0.0)


def back_off_weight(count: np.ndarray, kappa: float, beta: float) -> np.ndarray:
    """Share of the lower order after a context seen ``count`` times: as if kappa * count ** beta
    different words had followed it (Witten-Bell with Heaps' law for the number of kinds)."""
    kinds = kappa * np.maximum(count, 1.0) ** beta
    return np.where(count > 0, kinds / (count + kinds), 1.0)


class Trie:
    """Trigrams u v w stored from their middle word, which makes every need local to v:

    - level 1: the words v, with the weight of the unigram level after v;
    - level 2: per v its successors w, ascending, with the quantised bigram part
      (1 - weight(v)) * c(v w) / c(v);
    - contexts: per v the words u before it, with the weight of the bigram level after u v;
    - level 3: per (v, u) the successors w as ranks among the successors of v (the shorter
      context), which need few bits, with the quantised part (1 - weight(u v)) * c(u v w) / c(u v).

    A query finds v and w by successor search in the vocabulary, w among v's successors, u among
    v's contexts, and w's rank among those of (u, v); every search runs in one lifted Elias-Fano
    sequence and is checked against the bounds of its range.
    """

    SEQUENCES = ("words", "level1", "first2", "level2", "first_c", "contexts", "first3", "level3")
    CODES = ("weight1", "part2", "weight2", "part3")

    def __init__(self, arrays: dict[str, np.ndarray], bits: int):
        self.seq = {s: EliasFano([arrays[f"{s}.{k}"] for k in range(4)]) for s in self.SEQUENCES}
        self.codes = {c: arrays[c] for c in self.CODES}
        self.q = Quantiser(bits)

    @staticmethod
    def build(words: np.ndarray, pairs: tuple[np.ndarray, ...], triples: tuple[np.ndarray, ...], counts: dict[str, np.ndarray],
              smoothing: tuple[tuple[float, float], tuple[float, float]], bits: int) -> dict[str, np.ndarray]:
        """Arrays of a trie.

        words: ascending 64-bit word hashes; all other arrays hold places in it.
        pairs: (v, w, c(v w)) ascending by (v, w), all counts above 0.
        triples: (v, u, w, c(u v w)) ascending, counts above 0; every (v, w) is among the pairs.
        counts: "v" c(v) by place of v, "context" (v, u, c(u v)) ascending with counts above 0.
        """
        q = Quantiser(bits)
        (k2, b2), (k3, b3) = smoothing
        pv, pw, pc = pairs
        cv, cu, cc = counts["context"]
        tv, tu, tw, tc = triples
        seen = np.zeros(len(words), bool)
        seen[pv] = seen[cv] = True
        vs = np.flatnonzero(seen)
        n_v = counts["v"][vs].astype(np.float64)
        weight1 = back_off_weight(n_v, k2, b2)
        width = np.int64(len(words) + 1)
        out: dict[str, np.ndarray] = {}

        def add(name: str, values: np.ndarray) -> None:  # one sequence after the other: few plain arrays at a time
            out.update({f"{name}.{k}": a for k, a in enumerate(EliasFano.build(values))})

        add("words", words)
        add("level1", vs)
        out["weight1"] = q.code(weight1)
        first2 = np.searchsorted(pv, np.r_[vs, len(words) + 1].astype(pv.dtype))
        add("first2", first2)
        add("level2", ranged(first2, pw))
        iv = np.repeat(np.arange(len(vs)), np.diff(first2))
        out["part2"] = q.code((1 - weight1[iv]) * pc / np.maximum(n_v[iv], 1))
        del iv
        first_c = np.searchsorted(cv, np.r_[vs, len(words) + 1].astype(cv.dtype))
        add("first_c", first_c)
        add("contexts", ranged(first_c, cu))
        weight2 = back_off_weight(cc.astype(np.float64), k3, b3)
        out["weight2"] = q.code(weight2)
        ctx = np.searchsorted(cv * width + cu, tv * width + tu)
        out["part3"] = q.code((1 - weight2[ctx]) * tc / cc[ctx])
        first3 = np.searchsorted(ctx, np.arange(len(cv) + 1))
        del ctx
        add("first3", first3)
        rank = np.searchsorted(pv * width + pw, tv * width + tw)
        rank -= first2[np.searchsorted(vs, tv)]
        add("level3", ranged(first3, rank))
        return out

    @staticmethod
    def save(arrays: dict[str, np.ndarray], bits: int) -> bytes:
        """One file: length of the header, header (JSON: bits, name -> place, type, length), arrays."""
        at, table, body = 0, {}, []
        for name, a in arrays.items():
            raw = a.tobytes() + b"\0" * (-a.nbytes % 8)
            table[name] = [at, a.dtype.str, len(a)]
            body.append(raw)
            at += len(raw)
        head = json.dumps({"bits": bits, "arrays": table}).encode()
        head += b" " * (-len(head) % 8)
        return len(head).to_bytes(8, "little") + head + b"".join(body)

    @classmethod
    def open(cls, path: str) -> Trie:
        """The trie of a saved file, memory-mapped."""
        raw = np.asarray(np.memmap(path, np.uint8, "r"))  # mapped all the same, indexed without the class' checks
        size = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8:8 + size].tobytes())
        base = 8 + size
        arrays = {}
        for name, (at, kind, n) in head["arrays"].items():
            kind = np.dtype(kind)
            arrays[name] = raw[base + at: base + at + n * kind.itemsize].view(kind)
        return cls(arrays, head["bits"])

    def _within(self, level: str, first: str, rng: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of value x in the range numbers ``rng`` of a lifted sequence; equal questions
        in a row are asked once."""
        new = np.flatnonzero(np.concatenate([[True], (rng[1:] != rng[:-1]) | (x[1:] != x[:-1])])) if len(rng) else np.empty(0, np.int64)
        if len(new) < len(rng):
            times = np.diff(np.append(new, len(rng)))
            place, found = self._within(level, first, rng[new], x[new])
            return np.repeat(place, times), np.repeat(found, times)
        seq, starts = self.seq[level], self.seq[first]
        kinds, back = _kinds(rng)  # the bounds once per range
        if len(kinds) and (span := int(kinds[-1] - kinds[0]) + 2) <= 2 * len(kinds):  # close together: each bound once
            bounds, at = starts.get(np.arange(kinds[0], kinds[0] + span)).astype(np.int64), kinds - kinds[0]
            lo, hi = bounds[at], bounds[at + 1]
        else:
            lo, hi = starts.get(kinds).astype(np.int64), starts.get(kinds + 1).astype(np.int64)
        lift = np.zeros(len(kinds), np.uint64)
        if (some := lo > 0).any():
            lift[some] = seq.get(lo[some] - 1) + _ONE
        place, same = seq.successor(x.astype(np.uint64) + lift[back])
        return place, same & (place < hi[back])

    def numbers(self, words: np.ndarray) -> tuple[np.ndarray, ...]:
        """For word hashes: (place in the vocabulary, known, place in level 1, in level 1)."""
        place, known = self.seq["words"].successor(words)
        return place, known, *self.seq["level1"].successor(place.astype(np.uint64))

    def query(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x, y) with P(w | u v) = x + y * P(w), for word hashes u, v, w."""
        kinds, back = np.unique(np.concatenate([u, v, w]), return_inverse=True)
        return self.ask(self.numbers(kinds), *np.split(back, 3))

    def ask(self, numbers: tuple[np.ndarray, ...], u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``query`` for places among words whose ``numbers`` are known, so that each word is searched once."""
        n = len(v)
        x, y = np.zeros(n), np.ones(n)
        if not n or not self.seq["level1"].n:
            return x, y
        place, known, level1, in_level1 = numbers
        iu, known_u, iw, known_w = place[u], known[u], place[w], known[w]
        at = np.flatnonzero((known & in_level1)[v])
        one = level1[v]
        y[at] = self.q.value(self.codes["weight1"][one[at]])
        # Bigram level.
        pair_at = at[known_w[at]]
        p2, hit = self._within("level2", "first2", one[pair_at], iw[pair_at])
        pair_at, p2 = pair_at[hit], p2[hit]
        x[pair_at] = self.q.value(self.codes["part2"][p2])
        rank = np.full(n, -1, np.int64)
        rank[pair_at] = p2 - self.seq["first2"].get(one[pair_at]).astype(np.int64) if len(pair_at) else rank[pair_at]
        # Context u v: the weight of all below it.
        ctx_at = at[known_u[at]]
        c, hit = self._within("contexts", "first_c", one[ctx_at], iu[ctx_at])
        ctx_at, c = ctx_at[hit], c[hit]
        below = self.q.value(self.codes["weight2"][c])
        x[ctx_at] *= below
        y[ctx_at] *= below
        # Trigram level: w by its rank among v's successors.
        tri = rank[ctx_at] >= 0
        tri_at, c = ctx_at[tri], c[tri]
        p3, hit = self._within("level3", "first3", c, rank[tri_at])
        x[tri_at[hit]] += self.q.value(self.codes["part3"][p3[hit]])
        return x, y
