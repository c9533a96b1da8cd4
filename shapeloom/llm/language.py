"""Language identification by error-correcting output codes.

Every language has a codeword; its bits part the languages in many different ways. A binary
classifier over character n-grams learns each bit. A text's outputs are compared with all
codewords, each bit weighted by how well its classifier does: the codeword with the least loss
wins, and a text whose second-best loss is close is flagged as ambiguous. Training is numpy on a
bounded sample of rows with a language.

Defined cases: a null text and one without letters is ``und`` with score 0 and not ambiguous; so
is every text when no row has a language. One learned language is every text's. Other columns,
whatever their names, are ignored; a table without rows gives none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .labelled import byte_grams, featured, sample_labelled, sigmoid

FOLDS = 3
HELD_OUT = 1
NONE = "und"


@dataclass(frozen=True)
class Settings:
    per_language: int = 400  # rows of each language at most, the bound on the sample
    rows: int = 100_000  # of all languages together; one row of each is taken in any case
    buckets: int = 1 << 14
    bits: int = 15  # more are used where there are many languages
    epochs: int = 60
    rate: float = 2.0
    close: float = 0.1  # losses that differ by less are ambiguous
    seed: int = 5


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 and -1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # bits, sum 1
    close: float = 0.1


_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def features(text: str, buckets: int) -> np.ndarray:
    """Normalised counts of runs of 1 to 4 bytes, letters only, words set apart by one blank."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    counts = sum(np.bincount(byte_grams(data, n, buckets), minlength=buckets) for n in (1, 2, 3, 4))
    root = np.sqrt(counts.astype(np.float32))
    return root / max(1e-6, float(np.sqrt((root * root).sum())))


def sparse(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filled buckets and their values, as small as they are sent."""
    ids = np.flatnonzero(values)
    return ids.astype(np.uint32), values[ids].astype(np.float16)


def codewords(languages: int, bits: int, seed: int) -> np.ndarray:
    """The best of many random codes by least distance; no bit puts all languages on one side."""
    random, best, far = np.random.default_rng(seed), None, -1
    for _ in range(max(1, min(200, 50_000_000 // (languages * languages)))):
        codes = random.integers(0, 2, (languages, bits)) * 2 - 1
        flat = np.abs(codes.sum(0)) == languages
        codes[0, flat] *= -1 if languages > 1 else 1
        alike = codes.astype(np.float32) @ codes.T.astype(np.float32)
        np.fill_diagonal(alike, -bits)
        apart = int(bits - alike.max()) // 2
        if apart > far:
            best, far = codes, apart
    return best


# Rows made dense at once while training.
_DENSE_ROWS = 2_000


def train(rows: list[tuple[str, tuple[np.ndarray, np.ndarray]]], settings: Settings = Settings()) -> Model:
    """``rows``: a language, and the filled buckets with their values."""
    languages = sorted({label for label, _ in rows})
    bits = max(settings.bits, 4 * len(languages).bit_length()) if len(languages) > 16 else settings.bits
    if not languages:
        return Model([], np.zeros((0, bits)), np.zeros((settings.buckets, bits), np.float32), np.zeros(bits), np.ones(bits) / bits, settings.close)
    codes = codewords(len(languages), bits, settings.seed)
    number = {label: k for k, label in enumerate(languages)}
    of = np.array([number[label] for label, _ in rows])
    y = codes[of]
    # Every language weighs the same.
    weigh = (1 / np.bincount(of)[of]).astype(np.float32)
    weigh /= weigh.sum()

    def dense(at: int) -> np.ndarray:
        x = np.zeros((min(_DENSE_ROWS, len(rows) - at), settings.buckets), np.float32)
        for line, (_, (ids, values)) in zip(x, rows[at:], strict=False):
            line[ids] = values
        return x

    starts = range(0, len(rows), _DENSE_ROWS)
    kept = [dense(0)] if len(starts) == 1 else None

    def parts():
        return ((at, kept[0] if kept else dense(at)) for at in starts)

    weights, bias = np.zeros((settings.buckets, bits), np.float32), np.zeros(bits, np.float32)
    for _ in range(settings.epochs):
        gradient, slope = np.zeros_like(weights), np.zeros_like(bias)
        for at, x in parts():
            some = slice(at, at + len(x))
            wrong = (-y[some] * sigmoid(-y[some] * (x @ weights + bias)) * weigh[some, None]).astype(np.float32)
            gradient += x.T @ wrong
            slope += wrong.sum(0)
        weights -= settings.rate * 10 * (gradient + 1e-6 * weights)
        bias -= settings.rate * slope
    missed = sum((weigh[at : at + len(x), None] * sigmoid(-y[at : at + len(x)] * (x @ weights + bias))).sum(0) for at, x in parts())
    trust = np.maximum(1e-3, 0.5 - missed)
    return Model(languages, codes, weights, bias, trust / trust.sum(), settings.close)


def decode(model: Model, outputs: np.ndarray) -> tuple[str, float, bool]:
    """Language, score and whether a second one is close; of equal losses the first language."""
    losses = (np.log1p(np.exp(-np.clip(model.codes * outputs, -30, 30))) * model.trust).sum(1)
    order = np.argsort(losses, kind="stable")
    shares = np.exp(-8 * (losses - losses[order[0]]))
    near = len(order) > 1 and losses[order[1]] - losses[order[0]] < model.close
    return model.languages[order[0]], float(1 / shares.sum()), bool(near)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    learn = fold("doc_id", FOLDS) != HELD_OUT
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).agg(F.count_distinct("lang")).first()[0]
    most = max(1, min(settings.per_language, settings.rows // max(1, known)))
    chosen = sample_labelled(docs, "lang", learn, most)
    buckets = settings.buckets
    rows = featured(chosen, lambda text: (*sparse(features(text, buckets)), np.array([has_letter(text)])))
    return train([(label, (np.frombuffer(ids, np.uint32), np.frombuffer(v, np.float16).astype(np.float32))) for label, (ids, v, letters) in rows if letters == b"\x01"], settings)


def languages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, settings))
    buckets = settings.buckets

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        known, out = model.value, []
        for text in texts:
            if not text or not known.languages or not has_letter(text):
                out.append((NONE, 0.0, False))
            else:
                out.append(decode(known, features(text, buckets) @ known.weights + known.bias))
        return pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    told = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), predict("text").alias("told"))
    return told.select("doc_id", "held_out", "told.lang_pred", "told.score", "told.ambiguous")
