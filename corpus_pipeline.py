"""From raw documents to packed training sequences, in stages.

Each stage takes what the one before it kept, written as Parquet and read again. All but the
last return the columns of ``documents``. A stage that begins deletes the work tables of the stage
before it, whose result is written by then: a stage's result must be written before the next
stage is called.

Defined cases are those of the operators: null and empty texts, null and repeated doc_id and
columns of any name pass through; of rows alike in all columns one stays, as copies of each other;
a stage without rows gives none. Ties go by the smallest doc_id, null last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shapeloom.llm import exact, nearness, packing, quality, secrets
from shapeloom.llm.common import release, release_since, stored, table, work_mark

# Where the work tables of the stage before begin, by application.
_begun: dict[str, int] = {}


def _anew(spark: SparkSession, docs: DataFrame) -> None:
    """A stage begins: the one before it needs its work tables no more."""
    application = spark.sparkContext.applicationId
    if application in _begun:
        release_since(spark, _begun[application], docs)
    _begun[application] = work_mark(spark)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    _anew(spark, docs)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    _anew(spark, docs)
    return exact.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    _anew(spark, docs)
    return nearness.drop_near_copies(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; what looks like a secret is masked in its text."""
    _anew(spark, docs)
    return secrets.mask_secrets(docs, length="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as pieces of sequences."""
    _anew(spark, docs)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]

# The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    _begun.pop(spark.sparkContext.applicationId, None)
    for at, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if at == len(STAGES) - 1:
            return made
        last, docs = docs, stored(made, f"stage-{name.replace(' ', '-')}")
        release(last)
        # The stage's result is none of its work tables.
        release_since(spark, _begun.pop(spark.sparkContext.applicationId), docs)
    return docs
