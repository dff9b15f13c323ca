"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first letters, so unseen
inflections of a known stem are near it. Filters of several widths slide over the word vectors,
each keeps its maximum over the whole text, and a logistic layer scores the maxima. Training runs
on a bounded sample; thresholds are calibrated per language on labelled rows beside the score,
which never sees the language.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPLIT = re.compile(r"[\W_]+")
#: Lengths of the word beginnings that are hashed besides the whole word.
STEMS = (3, 4, 5)
_CACHE_LIMIT = 300_000


@dataclass(frozen=True)
class Config:
    buckets: int = 1 << 15
    dim: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 12
    steps: int = 600  # batches, whatever the size of the sample
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-5
    seed: int = 7


@dataclass
class Model:
    config: Config
    emb: np.ndarray                 # buckets x dim
    conv: list[np.ndarray]          # per width: (width, dim, filters)
    bias: np.ndarray                # widths * filters
    out: np.ndarray                 # widths * filters
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)  # calibrated logit = a * logit + b


class Words:
    """Text -> rows of hashed parts of its words, through a bounded cache of seen words."""

    def __init__(self, buckets: int, limit: int | None = _CACHE_LIMIT):
        self.buckets, self.limit, self.seen, self.parts = buckets, limit, {}, []

    def _add(self, word: str) -> int:
        raw = word.encode("utf-8", "replace")
        ids = [zlib.crc32(raw) % self.buckets]
        # A beginning is hashed with its length; a word that is too short repeats its own bucket.
        ids += [zlib.crc32(b"%d:" % n + word[:n].encode("utf-8", "replace")) % self.buckets if len(word) >= n else ids[0] for n in STEMS]
        self.parts.append(ids)
        self.seen[word] = k = len(self.parts) - 1
        return k

    def rows(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and the number of words of each text (at least one)."""
        if self.limit and len(self.parts) > self.limit:
            self.seen, self.parts = {}, []
        seen, add = self.seen, self._add
        ids, lens = [], np.empty(len(texts), np.int64)
        for k, t in enumerate(texts):
            ws = _SPLIT.split(t.lower()) if t else [""]
            lens[k] = len(ws)
            ids += [seen[w] if w in seen else add(w) for w in ws]
        return np.array(ids, np.int64), lens


def logits(m: Model, words: Words, texts: Sequence[str | None], limit: int = 400_000) -> np.ndarray:
    """Uncalibrated logits of whole texts; runs of at most ``limit`` words (or one text) at a time."""
    out, k = np.empty(len(texts)), 0
    while k < len(texts):
        n, chars = k, 0
        while n < len(texts) and (n == k or chars < limit * 6):
            chars += len(texts[n] or "")
            n += 1
        ids, lens = words.rows(texts[k:n])
        used, ids = np.unique(ids, return_inverse=True)
        vec = m.emb[np.array([words.parts[u] for u in used])].sum(axis=1)
        ends = np.cumsum(lens)
        pooled = np.concatenate([np.maximum.reduceat(_windows(vec, ids, ends, c), ends - lens, axis=0) for c in m.conv], axis=1)
        out[k:n] = np.maximum(pooled + m.bias, 0) @ m.out + m.out_bias
        k = n
    return out


def fit(sample: Sequence[tuple[str, int]], config: Config = Config(), share: float | None = None) -> Model:
    """Train on (text, label) rows; a fifth of them, unseen, calibrates the logit (Platt).

    ``share``: the share of label 1 among all labelled rows, where the sample has another one; the
    calibrated logit is moved by the difference of the log odds. Gradients flow through the maxima only: per text and feature, the words of one window.
    Without rows of both labels the model is flat at the smoothed share.
    """
    rng = np.random.default_rng(config.seed)
    nf = len(config.widths) * config.filters
    m = Model(config, (rng.standard_normal((config.buckets, config.dim)) * 0.02).astype(np.float32),
              [(rng.standard_normal((w, config.dim, config.filters)) * 0.3).astype(np.float32) for w in config.widths],
              np.zeros(nf, np.float32), (rng.standard_normal(nf) * 0.3).astype(np.float32), 0.0)
    pos = sum(y for _, y in sample)
    if not pos or pos == len(sample):
        m.out[:] = 0
        m.out_bias = float(np.log((pos + 1) / (len(sample) - pos + 1)))
        return m
    words = Words(config.buckets, limit=None)  # bounded by the sample
    order = rng.permutation(len(sample))
    cut = max(1, len(sample) // 5)
    held, train = order[:cut], order[cut:]
    docs = [words.rows([t])[0] for t, _ in sample]
    parts = np.array(words.parts)
    label = np.array([y for _, y in sample], np.float32)
    part = label[train].mean()
    weight = np.where(label == 1, 0.5 / max(part, 1e-3), 0.5 / max(1 - part, 1e-3)).astype(np.float32)
    params = [m.emb, *m.conv, m.bias, m.out]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, ob = 0, np.zeros(2)
    while step < config.steps:
        todo = rng.permutation(train)
        # Texts of like length share a batch, batches come in random order.
        todo = todo[np.argsort([len(docs[d]) // 200 for d in todo], kind="stable")]
        batches = [todo[k:k + config.batch] for k in range(0, len(todo), config.batch)]
        for b in rng.permutation(len(batches))[: config.steps - step]:
            rate = config.rate * (1 - step / config.steps)
            rows = batches[b]
            ids = np.concatenate([docs[d] for d in rows])
            lens = np.array([len(docs[d]) for d in rows])
            used, ids = np.unique(ids, return_inverse=True)
            vec = m.emb[parts[used]].sum(axis=1)
            ends = np.cumsum(lens)
            starts = ends - lens
            grads = [None, *[np.zeros_like(c) for c in m.conv], np.zeros_like(m.bias), np.zeros_like(m.out)]
            gvec = np.zeros_like(vec)
            pooled, best = [], []
            for w, k in zip(config.widths, m.conv):
                acc = _windows(vec, ids, ends, k)
                top = np.maximum.reduceat(acc, starts, axis=0)
                pooled.append(top)
                best.append(_argmax(acc, top, starts, lens))
            p = np.concatenate(pooled, axis=1) + m.bias
            h = np.maximum(p, 0)
            z = h @ m.out + m.out_bias
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) * weight[rows] / len(rows)
            grads[-1] = h.T @ g
            gob = g.sum()
            gh = np.outer(g, m.out) * (p > 0)
            grads[-2] = gh.sum(0)
            for i, (w, k) in enumerate(zip(config.widths, m.conv)):
                gi = gh[:, i * config.filters:(i + 1) * config.filters]  # texts x filters
                for j in range(w):
                    at = best[i] + j
                    ok = (at < ends[:, None]).astype(np.float32)
                    word = ids[np.minimum(at, len(ids) - 1)]  # texts x filters
                    gg = gi * ok
                    grads[1 + i][j] += np.einsum("tf,tfd->df", gg, vec[word])
                    np.add.at(gvec, word.ravel(), (gg[:, :, None] * k[j].T[None]).reshape(-1, config.dim))
            step += 1
            touched = np.flatnonzero(np.abs(gvec).sum(1))
            _adam_rows(m.emb, moment[0], parts[used[touched]], gvec[touched], rate, step)
            for q, mo, gr in zip(params[1:], moment[1:], grads[1:]):
                _adam(q, mo, gr + config.decay * q, rate, step)
            ob = 0.9 * ob + 0.1 * np.array([gob, gob * gob])
            m.out_bias -= rate * ob[0] / (np.sqrt(ob[1]) + 1e-8)
    z = logits(m, words, [sample[d][0] for d in held])
    m.scale = _platt(z, label[held])
    if share is not None and 0 < share < 1:
        odds = pos / (len(sample) - pos)
        m.scale = (m.scale[0], m.scale[1] + float(np.log(share / (1 - share) / odds)))
    return m


def _windows(vec, ids, ends, k):
    """One filter bank at every word: the words of all texts stand in a row, and what would reach
    beyond the end of its text counts as zero vectors."""
    acc = (vec @ k[0])[ids]
    for j in range(1, len(k)):
        part = (vec @ k[j])[ids[j:]]
        for e in range(1, j + 1):
            at = ends - e
            part[at[(at >= 0) & (at < len(part))]] = 0
        acc[: len(part)] += part
    return acc


def _argmax(acc, top, starts, lens):
    """Place of each text's maximum, per filter."""
    out = np.empty(top.shape, np.int64)
    for t, (s, n) in enumerate(zip(starts, lens)):
        out[t] = s + acc[s:s + n].argmax(axis=0)
    return out


def _adam(p, mo, g, rate, step):
    mo[0][...] = 0.9 * mo[0] + 0.1 * g
    mo[1][...] = 0.99 * mo[1] + 0.01 * g * g
    p -= rate * (mo[0] / (1 - 0.9 ** step)) / (np.sqrt(mo[1] / (1 - 0.99 ** step)) + 1e-8)


def _adam_rows(emb, mo, parts, g, rate, step):
    """Adagrad on the touched rows of the embedding only."""
    rows, inv = np.unique(parts.ravel(), return_inverse=True)
    gr = np.zeros((len(rows), emb.shape[1]), np.float32)
    np.add.at(gr, inv, np.repeat(g, parts.shape[1], axis=0))
    mo[1][rows] += gr * gr
    emb[rows] -= 5 * rate * gr / (np.sqrt(mo[1][rows]) + 1e-6)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a z + b) by Newton steps; a stays positive, or the logit stays as it is."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * np.maximum(p * (1 - p), 1e-7)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * (w - [1, 0]))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score: the calibrated probability of label 1 for its whole ``text``.

    Row-local, no shuffle. Null and empty texts score like one empty word. The model's size is
    fixed by its Config (about 1.6 MB), whatever the data, and is broadcast. An input column score
    is replaced.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        words = Words(m.config.buckets)
        for texts in batches:
            z = m.scale[0] * logits(m, words, texts.tolist()) + m.scale[1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn("score", probability(F.col("text")))


def language_thresholds(scored: DataFrame, grid: int = 50, default: float = 0.3, least: int = 20) -> dict[str, float]:
    """lang -> threshold with the best F1 on labelled rows (lang, score, label).

    Scores are counted on a grid per language, so the driver gets languages * (grid + 1) rows at
    most. A language with under ``least`` rows of either label keeps ``default``.
    """
    bins = (scored.where(F.col("lang").isNotNull())
            .groupBy("lang", F.floor(F.col("score") * grid).cast("int").alias("bin"))
            .agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).collect())
    out = {}
    for lang in sorted({r.lang for r in bins}):
        pos, neg = np.zeros(grid + 1), np.zeros(grid + 1)
        for r in bins:
            if r.lang == lang:
                pos[min(r.bin, grid)] += r.pos
                neg[min(r.bin, grid)] += r.n - r.pos
        if pos.sum() < least or neg.sum() < least:
            out[lang] = default
            continue
        tp, fp = pos[::-1].cumsum()[::-1], neg[::-1].cumsum()[::-1]
        f1 = 2 * tp / (tp + fp + pos.sum())
        # Of equally good thresholds the middle one.
        good = np.flatnonzero(f1[1:grid] >= f1[1:grid].max() - 1e-12) + 1
        out[lang] = float(good[len(good) // 2] / grid)
    return out


def threshold_column(thresholds: dict[str, float], default: float = 0.3) -> Column:
    """The threshold of a row's ``lang``; unknown and null languages have ``default``."""
    out = F.lit(default)
    for lang, t in thresholds.items():
        out = F.when(F.col("lang") == lang, F.lit(t)).otherwise(out)
    return out
