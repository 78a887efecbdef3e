"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate rates suit rare words, and the L1 term leaves most of the
hashed coordinates at exactly zero, so the weights are a compact table whose
size the hash space bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import small_batches
from tesserae.llm.text import WordHasher, mix, tokens

BITS = 20
#: Labelled rows that the model is fitted on, at most (a hash of doc_id picks them; in expectation).
MAX_TRAIN = 16_000
#: Bytes of their texts, at most (in expectation; the same hash picks fewer rows beyond).
MAX_BYTES = 96_000_000
THRESHOLD = 0.7
#: The bias of a model without labelled rows.
UNTAUGHT = -3.0
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SKIP = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Ftrl:
    """Settings: rate alpha and beta of the per-coordinate rates, l1, l2, passes over the rows."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.0
    passes: int = 5


def features(text: str | None, hasher: WordHasher) -> np.ndarray:
    """Distinct hashed coordinates of words, word pairs and pairs that skip a word."""
    w = hasher.of(tokens(text)) if text else np.zeros(0, np.uint64)
    parts = [mix(w)]
    if len(w) > 1:
        parts.append(mix(w[:-1] * _ODD + w[1:]))
    if len(w) > 2:
        parts.append(mix(w[:-2] * _SKIP + w[2:]))
    return np.unique((np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32))


class Trainer:
    """Online FTRL-proximal; coordinate 2**BITS is the bias, without L1."""

    def __init__(self, how: Ftrl):
        self.how = how
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, how = self.z[at], self.n[at], self.how
        return np.where(np.abs(z) <= how.l1, 0.0, (np.sign(z) * how.l1 - z) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2))

    def bias(self) -> float:
        return float(-self.z[-1] / ((self.how.beta + np.sqrt(self.n[-1])) / self.how.alpha))

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        for where, now in ((at, w), (np.array([-1]), np.array([b]))):
            n = self.n[where]
            self.z[where] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.how.alpha * now
            self.n[where] = n + g * g


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        order, label, text = (c.to_pylist() for c in batch.columns)
        rows = [features(t, hasher).tobytes() for t in text]
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(label, pa.int32()), pa.array(rows, pa.binary())], names=["o", "y", "x"])


def _fitter(how: Ftrl):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, np.frombuffer(x, np.int32)) for b in batches for y, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        trainer = Trainer(how)
        for _ in range(how.passes):
            for y, x in rows:
                trainer.learn(x, y)
        w = trainer.weights(slice(0, -1))
        at = np.flatnonzero(w)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << BITS), pa.int64()), pa.array(np.append(w[at], trainer.bias()))], names=["i", "w"])

    return fit


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, how: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero coordinates and their weights; the last is the bias.

    Learns from rows of ``labels`` (doc_id, toxic) whose two columns are not
    null: at most ``max_train`` of them with MAX_BYTES of text in expectation,
    chosen by hashes of doc_id and text and ordered by that of doc_id.
    Conflicting labels of one doc_id count as rows each, as do several texts of one.  Texts are featurised where
    they lie; the labels that are broadcast and the one task that fits, in
    hash order, are bounded by the two limits, and a text has 4 MB of features
    at most.  Without labelled rows the model is the bias alone and scores 0.047.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("_d"), F.col("toxic").cast("int").alias("_y"), F.xxhash64("doc_id").alias("_o"))

    def below(key: Column, part: float) -> Column:
        return F.lit(True) if part >= 1 else key < F.lit(int(-(2**63) + 2**64 * part))

    some = known.where(below(F.col("_o"), max_train / max(known.count(), 1)))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_d"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    # ids may come with many texts, and texts may be long
    rows = rows.where(below(F.xxhash64("doc_id", "text", F.lit(11)), min(MAX_BYTES / max(size["bytes"], 1), 1.25 * max_train / max(size["rows"], 1))))
    rows = rows.select("_o", "_y", "text").mapInArrow(_featurize, "o long, y int, x binary")
    fitted = rows.repartition(1).sortWithinPartitions("o", "y", "x").mapInArrow(_fitter(how), "i long, w double").collect()
    fitted = [tuple(r) for r in fitted] or [(1 << BITS, UNTAUGHT)]
    return np.array([r[0] for r in fitted], np.int64), np.array([r[1] for r in fitted])


def scorer(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]):
    """A column function of texts to scores from 0 to 1; null and empty texts get the bias's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, w = shared.value
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = w
        bias = dense[-1]
        hasher = WordHasher()
        for text in texts:
            sums = np.array([dense[features(t, hasher)].sum() for t in text])
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums + bias, -35, 35))))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of ``docs``, by a model learned from ``labels``; other columns aren't read.

    Repeated rows and null ids get a row each, an empty table none.
    """
    score = scorer(docs, train(docs, labels))
    return docs.select("doc_id", score(F.col("text")).alias("score"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more; columns as they were."""
    score = scorer(docs, train(docs, labels))
    return docs.where(score(F.col("text")) < threshold)
