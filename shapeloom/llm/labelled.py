"""Bounded samples of labelled rows for training, and hashed features in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup

# Of all values of a 64-bit hash, the share that is below this part of it.
_WHOLE = float(2**64)


def _likely(rows: DataFrame, hash_: Column, most: int) -> DataFrame:
    """The rows of each ``label`` with a low hash: few more than ``most`` of each.

    Counted first, a row per label and task being all that is shuffled. Which rows are taken in
    the end is decided later; this only keeps the rest from being moved.
    """
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    share = (most + 6 * most**0.5 + 20) / F.col("rows")
    bounds = lookup(counts.select(F.col("label").alias("of"), F.least(share, F.lit(1.0)).alias("share")), "label-shares")
    low = (hash_.cast("double") + F.lit(_WHOLE / 2)) / F.lit(_WHOLE) <= F.col("share")
    return rows.join(bounds, F.col("label") == F.col("of")).where(low).drop("of", "share")


def _least(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of each label, those with the least hashes of id and text;
    every task keeps no more than that of each label before anything is shuffled."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")


def sample_labelled(docs: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """doc_id, text, label of at most ``per_class`` rows of each value of the column ``label``;
    rows without id or label, or outside ``learn``, never."""
    rows = docs.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", F.col(label).alias("label"))
    # By id and text, so that one id with very many rows is as likely as they are.
    return _least(_likely(rows, F.xxhash64("doc_id", "text"), per_class), per_class)


def sample_joined(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """As ``sample_labelled``, the label coming from a table of its own: ids may be repeated in
    either one, and the bound holds for the rows that come out."""
    rows = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label")).distinct()
    chosen = lookup(_likely(rows, F.xxhash64("doc_id"), per_class), "labelled-ids")
    return _least(docs.select("doc_id", "text").join(chosen, "doc_id"), per_class)


def featured(chosen: DataFrame, features: Callable[[str], tuple[np.ndarray, ...]]) -> list[tuple[object, tuple[np.ndarray, ...]]]:
    """(label, arrays) of the sampled rows, whole texts, made into features in tasks.

    The sample is bounded by its parameter, and so is what reaches the driver: a row's features
    are hashed into a fixed number of buckets.
    """
    kind = chosen.schema["label"].dataType
    out = T.StructType([T.StructField("label", kind), T.StructField("doc_id", chosen.schema["doc_id"].dataType), T.StructField("arrays", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[np.ascontiguousarray(x).tobytes() for x in features(t.as_py() or "")] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.binary()))], names=out.names)

    found = chosen.select("label", "doc_id", "text").mapInArrow(run, out).collect()
    found.sort(key=lambda r: (str(r["doc_id"]), r["arrays"]))  # one order, whatever the tasks' order
    return [(r["label"], tuple(r["arrays"])) for r in found]


def byte_grams(data: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of each run of ``n`` bytes."""
    count = len(data) - n + 1
    if count < 1:
        return np.zeros(0, np.int64)
    total = np.full(count, n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(n):
        total = (total ^ data[k : k + count]) * np.uint64(0x100000001B3)
    return ((total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) & (buckets - 1)


_FACTOR = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes above the blank start and end."""
    inside = np.concatenate(([False], data > 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


class Spans:
    """Hashes of any spans of bytes, by sums of powers modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(_powers[0]) <= n:
            for k, factor in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
                table = np.full(2 * n + 1, factor, np.uint64)
                table[0] = 1
                _powers[k] = np.cumprod(table, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * _powers[1][starts]
        raw = (raw ^ (raw >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return raw ^ (raw >> np.uint64(32))


def to_buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) & (buckets - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
