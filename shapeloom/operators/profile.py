"""Complexity of each document, and the manifest made of it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapeloom.functions.json_text import measure
from shapeloom.functions.paths import parent_name
from shapeloom.operators.shred import DEFAULT_LEVELS, TEXT, parse_documents

# A document beyond any one of these is of high complexity.
DEPTH_LIMIT = 3
KEYS_LIMIT = 100
SIZE_LIMIT = 30_000

MANIFEST_COLUMNS = [
    "file",
    "object_type",
    "complexity",
    "keys",
    "depth",
    "arrays",
    "array_len",
    "size_bytes",
    "schema_generated",
]


_MEASURES = ["size_bytes_", "keys_", "depth_", "arrays_", "array_len_"]


def document_complexity(
    docs: DataFrame,
    keys: list[str],
    with_size: bool = True,
    levels: int = DEFAULT_LEVELS,
) -> DataFrame:
    """``keys, depth, arrays, array_len`` per document, and ``size_bytes`` (in characters).

    Every document is measured inside its row: nothing is put out per node, and what is shuffled
    is one short row per document. The result does not depend on ``levels``.
    """
    measured = _measured(parse_documents(docs), keys)
    return measured.groupBy(*keys).agg(
        F.sum("keys_").alias("keys"),
        F.max("depth_").alias("depth"),
        F.sum("arrays_").alias("arrays"),
        F.sum("array_len_").alias("array_len"),
        *[F.max("size_bytes_").alias("size_bytes")] * with_size,
    )


def _measured(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """A row of ``keys`` and measures for every document that carries its text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in batch.column(len(keys)).to_pylist()]
            told = zip(*found, strict=True) if found else [()] * len(_MEASURES)
            columns = [pa.array(c, pa.int32() if name == "depth_" else pa.int64()) for name, c in zip(_MEASURES, told, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], names=[*keys, *_MEASURES])

    carried = parsed.select(*[F.col(f"`{k}`") for k in keys], TEXT)
    told = [T.StructField(name, T.IntegerType() if name == "depth_" else T.LongType()) for name in _MEASURES]
    return carried.mapInArrow(work, T.StructType([*carried.schema.fields[:-1], *told]))


def complexity_level() -> Column:
    high = (
        (F.col("depth") > DEPTH_LIMIT)
        | (F.col("keys") > KEYS_LIMIT)
        | (F.col("size_bytes") > SIZE_LIMIT)
    )
    return F.when(high, "high").otherwise("low")


def classify_complexity(profile: DataFrame) -> DataFrame:
    return profile.withColumn("complexity", complexity_level())


def complexity_counts(profile: DataFrame) -> DataFrame:
    """Documents per dataset and level."""
    return (
        classify_complexity(profile)
        .groupBy("dataset", "complexity")
        .agg(F.count(F.lit(1)).alias("documents"))
    )


def build_manifest(docs: DataFrame, levels: int = DEFAULT_LEVELS) -> DataFrame:
    """One manifest row per readable document of ``file, json``; nothing is generated yet."""
    profile = classify_complexity(document_complexity(docs, ["file"], levels=levels))
    return profile.select(
        "file",
        parent_name(F.col("file")).alias("object_type"),
        "complexity",
        "keys",
        "depth",
        "arrays",
        "array_len",
        "size_bytes",
        F.lit("False").alias("schema_generated"),
    )

