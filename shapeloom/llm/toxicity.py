"""Toxicity: a sparse linear classifier with a counterfactual penalty.

Features are the words of a text and the starts of its words, each counted once, hashed into
buckets. Besides the log-loss, training minimises the squared change of the score when the
identity terms of a labelled text are swapped for others of their group, so that a mention of a
group by itself does not move the score; an L1 penalty keeps only words that tell. Groups are
given for four languages. Where sampled texts hold no identity term, mentions are added by
template: every ``template_every``-th text, chosen by its hash, is learned once more with a
neutral sentence about a group, its counterfactual being the same text with the sentence about
another one. ``penalty_report`` tells how many rows had a counterfactual and what the penalty
does. Training is numpy on a bounded, balanced sample of labelled rows.

Defined cases: a null or empty text has no features and gets the score of the bias; with labels
of one class or none, every score is that class's share (0.5 without labels). Other columns,
whatever their names, are ignored; a table without rows gives none.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold
from .labelled import Spans, featured, sample_joined, sigmoid, to_buckets, word_spans

FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.3

# Groups of identity terms by language; within a group any term may stand for another.
IDENTITY_GROUPS = {
    "en": (
        ("women", "men", "girls", "boys"),
        ("woman", "man", "girl", "boy"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("black", "white", "asian", "latino", "arab", "african", "european"),
        ("gay", "straight", "lesbian", "bisexual", "transgender"),
        ("immigrants", "natives", "refugees", "foreigners"),
        ("old", "young", "disabled", "deaf", "blind"),
        ("mexican", "american", "chinese", "indian", "german", "french", "spanish"),
    ),
    "de": (
        ("frauen", "männer", "mädchen", "jungen"),
        ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
        ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
        ("einwanderer", "einheimische", "flüchtlinge", "ausländer"),
        ("türken", "polen", "deutsche", "franzosen", "spanier", "chinesen"),
        ("alte", "junge", "behinderte", "gehörlose", "blinde"),
    ),
    "fr": (
        ("femmes", "hommes", "filles", "garçons"),
        ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
        ("gays", "lesbiennes", "bisexuels", "hétérosexuels"),
        ("immigrés", "autochtones", "réfugiés", "étrangers"),
        ("arabes", "africains", "européens", "asiatiques", "américains"),
        ("vieux", "jeunes", "handicapés", "sourds", "aveugles"),
    ),
    "es": (
        ("mujeres", "hombres", "niñas", "niños"),
        ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
        ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
        ("inmigrantes", "nativos", "refugiados", "extranjeros"),
        ("árabes", "africanos", "europeos", "asiáticos", "mexicanos"),
        ("viejos", "jóvenes", "discapacitados", "sordos", "ciegos"),
    ),
}
# Neutral sentences about a group.
TEMPLATES = {"en": "There are {} here.", "de": "Hier gibt es {}.", "fr": "Il y a des {} ici.", "es": "Aquí hay {}."}


@dataclass(frozen=True)
class Settings:
    per_class: int = 2000  # labelled rows of each class at most, the bound on the sample
    buckets: int = 1 << 18
    epochs: int = 15
    rate: float = 0.2
    sparsity: float = 0.03
    least_rows: int = 5  # features of fewer sampled rows are not learned
    swap_penalty: float = 1.0
    template_every: int = 4  # of the sampled texts; 0: none
    seed: int = 11


_GROUPS = [group for groups in IDENTITY_GROUPS.values() for group in groups]
_TERM = re.compile(r"\b(" + "|".join(sorted({t for g in _GROUPS for t in g}, key=lambda t: (-len(t), t))) + r")\b", re.I)
_NEXT: dict[str, str] = {}
for _group in _GROUPS:
    for _k, _term in enumerate(_group):
        _NEXT.setdefault(_term, _group[(_k + 1) % len(_group)])
_LETTERLESS = bytes(b if b >= 128 or chr(b).isalnum() or b == 39 else 32 for b in range(256))


def swapped(text: str) -> str:
    """Every identity term replaced by the next one of its group."""
    return _TERM.sub(lambda m: _NEXT.get(m[0].lower(), m[0]), text)


def mentioned(text: str, every: int) -> tuple[str, str] | None:
    """A text with a neutral sentence about a group, and with the same about another one; which
    texts, which group and which terms follows from the text's hash."""
    lot = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    if not every or lot % every:
        return None
    language = sorted(TEMPLATES)[lot // every % len(TEMPLATES)]
    groups = IDENTITY_GROUPS[language]
    group = groups[lot // (every * len(TEMPLATES)) % len(groups)]
    at = lot // 1009 % len(group)
    one, other = group[at], group[(at + 1 + lot // 9973 % (len(group) - 1)) % len(group)]
    return tuple(f"{text} {TEMPLATES[language].format(term)}" for term in (one, other))


def features(text: str, buckets: int) -> np.ndarray:
    """Buckets of the words and word starts, with repeats."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERLESS), np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.int64)
    spans = Spans(data)
    parts = [to_buckets(spans.hashes(starts, ends), buckets)]
    for n in (4, 5):
        longer = starts[ends - starts > n]
        parts.append(to_buckets(spans.hashes(longer, longer + n) * np.uint64(2 * n + 1), buckets))
    return np.concatenate(parts)


def pair_features(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and of its counterfactual."""
    other = swapped(text)
    ids = np.unique(features(text, buckets)).astype(np.int32)
    return ids, ids if other == text else np.unique(features(other, buckets)).astype(np.int32)


def row_features(text: str, settings: Settings) -> tuple[np.ndarray, ...]:
    """The buckets of a text and of its counterfactual, and those of the pair made by template
    (empty where there is none)."""
    made = mentioned(text, settings.template_every)
    pair = (np.unique(features(t, settings.buckets)).astype(np.int32) for t in made) if made else (np.zeros(0, np.int32),) * 2
    return (*pair_features(text, settings.buckets), *pair)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    classes = [label for label, _, _ in rows]
    share = np.mean(classes) if classes else 0.5
    weights = np.zeros(settings.buckets)
    if len(set(classes)) < 2:
        return weights.astype(np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    squares, bias, bias_square = np.full(settings.buckets, 1e-2), 0.0, 1.0
    random = np.random.default_rng(settings.seed)
    balance = {c: (len(classes) / (2 * classes.count(c))) ** 0.5 for c in (0, 1)}
    seen = np.zeros(settings.buckets, np.int64)
    for _, ids, _ in rows:
        seen[ids] += 1
    known = lambda ids: ids[seen[ids] >= settings.least_rows]
    rows = [(label, own := known(ids), own if other is ids else np.union1d(known(other), np.setdiff1d(other, ids))) for label, ids, other in rows]

    def move(ids: np.ndarray, by: np.ndarray | float) -> None:
        squares[ids] += by * by
        step = settings.rate / np.sqrt(squares[ids])
        moved = weights[ids] - step * by
        weights[ids] = np.sign(moved) * np.maximum(np.abs(moved) - step * settings.sparsity, 0)

    for _ in range(settings.epochs):
        for k in random.permutation(len(rows)):
            label, ids, other = rows[k]
            wrong = (float(sigmoid(weights[ids].sum() + bias)) - label) * balance[label]
            move(ids, wrong)
            bias_square += wrong * wrong
            bias -= settings.rate * wrong / np.sqrt(bias_square)
            if other is not ids and len(other):
                only, instead = np.setdiff1d(ids, other), np.setdiff1d(other, ids)
                change = weights[only].sum() - weights[instead].sum()
                if change:
                    move(only, settings.swap_penalty * change)
                    move(instead, -settings.swap_penalty * change)
    return weights.astype(np.float32), bias


def _learned(docs: DataFrame, labels: DataFrame, settings: Settings) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The sampled rows, with their counterfactuals (the same array: none), then those made by template."""
    chosen = sample_joined(docs, labels, "toxic", fold("doc_id", FOLDS) != HELD_OUT, settings.per_class)
    own, made = [], []
    for label, arrays in featured(chosen, lambda text: row_features(text, settings)):
        if label in (0, 1):
            ids, other, one, two = (np.frombuffer(a, np.int32) for a in arrays)
            own.append((int(label), ids, ids if np.array_equal(ids, other) else other))
            if len(one):
                made.append((int(label), one, two))
    return own + made


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    return train(_learned(docs, labels, settings), settings)


def penalty_report(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> dict[str, float]:
    """Rows learned from, rows with a counterfactual, and the mean change of the score (log-odds)
    between them and their counterfactuals without and with the penalty."""
    rows = _learned(docs, labels, settings)
    pairs = [(ids, other) for _, ids, other in rows if other is not ids]

    def change(penalty: float) -> float:
        weights, _ = train(rows, replace(settings, swap_penalty=penalty))
        return float(np.mean([abs(weights[a].sum() - weights[b].sum()) for a, b in pairs])) if pairs else 0.0

    return {"rows": len(rows), "with_counterfactual": len(pairs), "change_without": change(0.0), "change_with": change(settings.swap_penalty)}


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> Column:
    """A column expression: the probability that ``text`` is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        weights, bias = shared.value
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            ids = features(text or "", len(weights))
            ids = np.unique(ids[weights[ids] != 0])
            out[k] = bias + float(weights[ids].sum())
        return pd.Series(sigmoid(out))

    return scored(F.col("text"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels, settings)
    scored = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
