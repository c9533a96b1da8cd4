"""Quality classifier: supervised subword embeddings.

Words, word pairs, patterns of equal neighbours and character n-grams are hashed into buckets,
each with a learned vector; a document is the average of its vectors, and a softmax layer on it
gives the class. Vectors and layer are trained together by stochastic gradient descent in numpy
on a bounded, balanced sample of labelled rows. As averaging and layer are linear, scoring needs
one number per bucket.

Defined cases: a null or empty text has no features and gets the score of the classes' bias; with
labels of one class or none, every score is that class's share (0.5 without labels). Other
columns, whatever their names, are ignored; a table without rows gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold
from .labelled import Spans, byte_grams, featured, sample_joined, sigmoid, to_buckets, word_spans

FOLDS = 5
HELD_OUT = 0
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    per_class: int = 1500  # labelled rows of each class at most, the bound on the sample
    buckets: int = 1 << 16
    dimensions: int = 8
    epochs: int = 12
    rate: float = 0.5
    seed: int = 7


def grams(text: str, buckets: int) -> np.ndarray:
    """The bucket of every feature of a text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    parts = [byte_grams(data, n, buckets) for n in (3, 4)]
    starts, ends = word_spans(data)
    if len(starts):
        each = Spans(data).hashes(starts, ends)
        parts.append(to_buckets(each, buckets))
        parts.append(to_buckets(each[1:] * np.uint64(0x9E3779B97F4A7C15) + each[:-1], buckets))
        same = (each[1:] == each[:-1]).astype(np.int64)
        # Patterns of three words, equal or not, as often as they occur.
        parts.append(((same[1:] * 2 + same[:-1]) * 7919 + 11) & (buckets - 1))
    return np.concatenate(parts)


def features(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and the share of each among all features."""
    counts = np.bincount(grams(text, buckets), minlength=buckets)
    ids = np.flatnonzero(counts)
    shares = counts[ids] / max(1, counts.sum())
    return ids.astype(np.int32), shares.astype(np.float32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """One weight per bucket and a bias: the log-odds of class 1 against class 0."""
    classes = [label for label, _, _ in rows]
    share = np.mean(classes) if classes else 0.5
    if len(set(classes)) < 2:
        return np.zeros(settings.buckets, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    random = np.random.default_rng(settings.seed)
    vectors = random.normal(0, 0.1, (settings.buckets, settings.dimensions)).astype(np.float32)
    layer = random.normal(0, 1, (settings.dimensions, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, at = settings.epochs * len(rows), 0
    weight = {c: len(classes) / (2 * classes.count(c)) for c in (0, 1)}
    for _ in range(settings.epochs):
        for k in random.permutation(len(rows)):
            label, ids, shares = rows[k]
            rate = settings.rate * (1 - at / steps)
            at += 1
            mean = shares @ vectors[ids]
            logits = mean @ layer + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            wrong *= weight[label]
            back = layer @ wrong
            layer -= rate * np.outer(mean, wrong)
            bias -= rate * 0.1 * wrong
            # Shares are small, so vectors move by a multiple of them.
            vectors[ids] -= (rate * 40 * shares)[:, None] * back
    folded = vectors @ (layer[:, 1] - layer[:, 0])
    return folded.astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    chosen = sample_joined(docs, labels, "quality", fold("doc_id", FOLDS) != HELD_OUT, settings.per_class)
    buckets = settings.buckets
    rows = featured(chosen, lambda text: features(text, buckets))
    return train([(int(label), np.frombuffer(ids, np.int32), np.frombuffer(shares, np.float32)) for label, (ids, shares) in rows if label in (0, 1)], settings)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> Column:
    """A column expression: the probability of class 1 of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        weights, bias = shared.value
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            ids = grams(text or "", len(weights))
            out[k] = bias + float(weights[ids].mean(dtype=np.float64)) if len(ids) else bias
        return pd.Series(sigmoid(out))

    return scored(F.col("text"))


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels, settings)
    scored = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows predicted good, with all their columns."""
    return docs.where(score(docs, fit(docs, labels, settings)) >= THRESHOLD)
