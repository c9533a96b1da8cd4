"""Work on the document manifest: what is pending, approved, generated, routed where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.functions.paths import base_name, part, stem
from shapeloom.session import small_side

# Flags that mean a schema has been generated.
DONE_FLAGS = ["yes", "true", "1"]


def _flag(default: str) -> Column:
    return F.lower(F.trim(F.coalesce("schema_generated", F.lit(default))))


def dataset_of(file: Column) -> Column:
    """Second part of ``processed/<dataset>/...``; NULL when the path is too short."""
    return part(file, 1)


def pending_documents(manifest: DataFrame, seed: int | None = None) -> DataFrame:
    """Rows still to be worked on: an empty or missing flag counts as pending.

    With a seed the rows also get a random order, as a column to sort or batch by: the same one
    however the rows are partitioned.
    """
    pending = manifest.filter(~_flag("").isin(DONE_FLAGS))
    if seed is not None:
        pending = pending.withColumn("turn", F.xxhash64("file", F.lit(seed)))
    return pending


def approved_documents(manifest: DataFrame) -> DataFrame:
    """Rows flagged exactly ``true``, with their dataset; paths without one are dropped."""
    return (
        manifest.filter(_flag("false") == "true")
        .withColumn("dataset", dataset_of(F.col("file")))
        .filter(F.col("dataset").isNotNull())
    )


def approved_counts(manifest: DataFrame) -> DataFrame:
    return (
        approved_documents(manifest).groupBy("dataset").agg(F.count(F.lit(1)).alias("documents"))
    )


def refresh_manifest(manifest: DataFrame, schema_files: DataFrame) -> DataFrame:
    """Set the flag to ``true`` where it is ``false`` and the schema file exists.

    ``schema_files(dataset, object_type, base_name)`` lists what exists. ``updated`` tells which
    rows changed; malformed paths pass through.
    """
    keys = ["dataset", "object_type", "base_name"]
    existing = schema_files.select(*keys).distinct().withColumn("found", F.lit(True))
    rows = (
        manifest.withColumn("dataset", dataset_of(F.col("file")))
        .withColumn("base_name", base_name(F.col("file")))
        .join(existing, keys, "left")
    )
    updated = (
        (_flag("false") == "false") & F.col("dataset").isNotNull() & F.coalesce("found", F.lit(False))
    )
    return rows.withColumn("updated", updated).select(
        *[
            F.when(F.col("updated"), "true").otherwise(F.col(c)).alias(c)
            if c == "schema_generated"
            else c
            for c in manifest.columns
        ],
        "updated",
    )


def refresh_report(refreshed: DataFrame) -> DataFrame:
    return refreshed.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if("updated").alias("updated")
    )


def _schema_stem(schema_path: Column) -> Column:
    return F.regexp_extract(base_name(schema_path), r"^(.*)\.schema\.json$", 1)


def schema_pairs(raw_files: DataFrame, schema_files: DataFrame) -> DataFrame:
    """Raw files and schemas of the same stem: ``json_path, schema_path``."""
    raw = raw_files.select(F.col("file").alias("json_path")).filter(
        F.endswith("json_path", F.lit(".json"))
    )
    schemas = schema_files.select(F.col("file").alias("schema_path")).filter(
        F.endswith("schema_path", F.lit(".schema.json"))
    )
    return (
        raw.withColumn("stem", stem(F.col("json_path")))
        .join(schemas.withColumn("stem", _schema_stem(F.col("schema_path"))), "stem")
        .select("json_path", "schema_path")
    )


def unprocessed_files(raw_files: DataFrame, schema_files: DataFrame) -> DataFrame:
    """Raw files without a schema of their stem."""
    done = schema_files.select(_schema_stem(F.col("file")).alias("stem")).distinct()
    return (
        raw_files.filter(F.endswith("file", F.lit(".json")))
        .withColumn("stem", stem(F.col("file")))
        .join(done, "stem", "left_anti")
        .drop("stem")
    )


def tier() -> Column:
    """``skip`` for low complexity, ``high`` for anything else, unknown included."""
    low = F.lower(F.coalesce("complexity", F.lit("high"))) == "low"
    return F.when(low, "skip").otherwise("high")


def route_by_complexity(manifest: DataFrame) -> DataFrame:
    """Pending documents with the tier that works on them."""
    return pending_documents(manifest).withColumn("tier", tier())


def tier_counts(manifest: DataFrame) -> DataFrame:
    return route_by_complexity(manifest).groupBy("tier").agg(F.count(F.lit(1)).alias("documents"))


def target_path(root: str) -> Column:
    """Where a document's schema goes: ``root/<dataset>/<object_type>/<base name>``."""
    return F.when(
        dataset_of(F.col("file")).isNotNull(),
        F.concat_ws(
            "/",
            F.lit(root.rstrip("/")),
            dataset_of(F.col("file")),
            F.coalesce("object_type", F.lit("unknown")),
            base_name(F.col("file")),
        ),
    )


def approved_texts(manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents (``file, json``) that are approved, with their dataset."""
    approved = small_side(approved_documents(manifest).select("file", "dataset").distinct())
    return documents.drop("dataset").join(approved, "file")
