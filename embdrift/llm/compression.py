"""Quality classifier by compression: two zstandard dictionaries, one calibrated difference.

One dictionary is trained on good, one on bad labelled texts. A text is cut into blocks, each block
is compressed with either dictionary, and the normalised difference of the total sizes

    (bytes with the good dictionary - bytes with the bad one) / (their sum + PRIOR_BYTES)

tells which kind it resembles; the constant keeps a few bytes of a short text from saying much. Blocks keep the dictionaries in play through whole long texts, where
a single stream would soon compress from its own past. A logistic curve over the difference and
the size, fitted on labelled texts that the dictionaries did not see, makes it a probability of
label 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Weight of "no difference" against the bytes of a text.
PRIOR_BYTES = 200
#: Size at which a text counts as half short in the calibration.
SHORT_BYTES = 200


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the calibration curve
    block: int
    level: int


class Sizes:
    """Compressed sizes of a text under both dictionaries of a model."""

    def __init__(self, model: Model):
        self.block = model.block
        self.by = []
        for raw in (model.good, model.bad):
            shared = zstandard.ZstdCompressionDict(raw)
            shared.precompute_compress(level=model.level)  # else every block digests the dictionary anew
            self.by.append(zstandard.ZstdCompressor(dict_data=shared, write_content_size=False, write_checksum=False,
                                                    write_dict_id=False))

    def difference(self, text: str | None) -> tuple[float, int]:
        """(difference: -1 to 1, above 0: nearer to the bad texts; bytes). A null or empty text: 0, 0."""
        raw = memoryview((text or "").encode("utf-8", "replace"))
        if not len(raw):
            return 0.0, 0
        good, bad = (sum(len(c.compress(raw[k:k + self.block])) for k in range(0, len(raw), self.block)) for c in self.by)
        return (good - bad) / (good + bad + PRIOR_BYTES), len(raw)


def train_dictionary(texts: Sequence[str], block: int, size: int) -> bytes:
    """A dictionary of at most ``size`` bytes from the blocks of the texts.

    Too little text for the trainer: the text itself, as a raw-content dictionary.
    """
    samples = [raw[k:k + block] for raw in (t.encode("utf-8", "replace") for t in texts) for k in range(0, len(raw), block)]
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"        "


def _curve(d: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1, d, d*|d| and a share that falls with the size: the level of d depends on how much of a
    text its first, unprimed bytes are."""
    d = d * 10
    return np.stack([np.ones_like(d), d, d * np.abs(d), SHORT_BYTES / (SHORT_BYTES + size)], axis=1)


def probability(model: Model, d: np.ndarray, size: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_curve(d, size) @ np.array(model.weights), -30, 30)))


def fit(sample: Sequence[tuple[str, int]], block: int = 2048, dictionary: int = 64 << 10, level: int = 3) -> Model:
    """A model from (text, label) rows; label 1 is good.

    Even rows of each label train the dictionaries, odd rows the curve, in which every label
    weighs the same. Rows of one label only give a flat curve at that label's smoothed share.
    """
    parts = {v: [t for t, y in sample if y == v] for v in (0, 1)}
    dicts = {v: train_dictionary(parts[v][::2], block, dictionary) for v in (0, 1)}
    model = Model(dicts[1], dicts[0], (0.0,) * 4, block, level)
    if not parts[0] or not parts[1]:
        share = (len(parts[1]) + 1) / (len(sample) + 2)
        return Model(dicts[1], dicts[0], (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0), block, level)
    sizes = Sizes(model)
    held = {v: parts[v][1::2] or parts[v] for v in (0, 1)}
    x = _curve(*np.array([sizes.difference(t) for v in (0, 1) for t in held[v]], float).T)
    y = np.array([v for v in (0, 1) for _ in held[v]], float)
    wt = np.where(y == 1, 0.5 / max(1, len(held[1])), 0.5 / max(1, len(held[0])))
    w, ridge = np.zeros(4), 1e-4 * np.eye(4)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (wt * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge, x.T @ (wt * (p - y)) + ridge @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return Model(dicts[1], dicts[0], tuple(float(v) for v in w), block, level)


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with difference and score (0 to 1, higher: label 1 likelier) of its whole ``text``.

    Row-local: no shuffle. Null and empty texts have difference 0. The model is bounded by the
    dictionary size (two of at most 64 KB by default) and travels as a broadcast variable. Input
    columns named difference or score are replaced.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("difference double, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sizes = Sizes(shared.value)
        for texts in batches:
            d, size = np.array([sizes.difference(t) for t in texts], float).reshape(-1, 2).T
            yield pd.DataFrame({"difference": d, "score": probability(shared.value, d, size)})

    out = docs.withColumn("_scored", scored(F.col("text")))
    return out.withColumns({"difference": F.col("_scored.difference"), "score": F.col("_scored.score")}).drop("_scored")
