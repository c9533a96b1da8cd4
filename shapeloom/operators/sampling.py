"""Cutting collections down and up: systematic samples, splits, subsets of a size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeloom.functions.json_text import json_kind, parse_strict, with_computed
from shapeloom.session import earlier_totals, small_side

# Fixed value: size a collection is sampled down to.
SIZE_TARGET_BYTES = 80 * 1024 * 1024


def sampling_plan(
    sizes: DataFrame, size_target: int = SIZE_TARGET_BYTES, by: str = "dataset"
) -> DataFrame:
    """``by, size_bytes`` to keep-all flag and step ``k``; halves round to even."""
    size = F.col("size_bytes")
    ratio = F.rint(size / F.lit(float(size_target)))
    return sizes.select(
        by,
        "size_bytes",
        (size <= size_target).alias("keep_all"),
        F.when(size <= size_target, F.lit(1))
        .otherwise(F.greatest(F.lit(1), ratio.cast("long")))
        .cast("long")
        .alias("k"),
    ).filter(size > 0)


def collection_sizes(docs: DataFrame, text: str = "json", per_row: int = 1) -> DataFrame:
    """Bytes per dataset; every row counts its text and its line end."""
    return docs.groupBy("dataset").agg(
        F.sum(F.octet_length(text) + F.lit(per_row)).cast("long").alias("size_bytes")
    )


def _block_offsets(docs: DataFrame, block: list[str], measure: Column, by: str) -> DataFrame:
    """What all earlier blocks of a dataset (or file) add up to, for each block.

    Block totals are smaller than the data by the number of rows in a block; however many they
    are, no window holds all of them.
    """
    totals = docs.groupBy(by, *block).agg(F.sum(measure).alias("total"))
    return earlier_totals(totals, by, block, {"total": "offset"}).drop("total")


def running_total(
    docs: DataFrame,
    block: list[str],
    order: list[str],
    measure: Column,
    name: str,
    facts: DataFrame | None = None,
    by: str = "dataset",
) -> DataFrame:
    """Inclusive running total of ``measure`` per dataset, or ``by``, in the order of ``block, order``.

    ``block`` columns split a dataset into ordered ranges. Rows are sorted inside their block
    only, so one very large dataset is worked on by as many tasks as it has blocks. ``facts`` per
    dataset are brought in by way of the blocks: no row is ever joined on its dataset alone.
    """
    offsets = _block_offsets(docs, block, measure, by)
    if facts is not None:
        offsets = offsets.join(facts, by)
    inside = (
        Window.partitionBy(by, *block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        docs.withColumn(name, F.sum(measure).over(inside))
        .join(offsets, [by, *block])
        .withColumn(name, F.col(name) + F.col("offset"))
        .drop("offset")
    )


def dense_index(
    docs: DataFrame,
    block: list[str],
    order: list[str],
    facts: DataFrame | None = None,
    by: str = "dataset",
) -> DataFrame:
    """``idx``: position of a row in its dataset, or ``by``, from 0, without gaps."""
    one = F.lit(1).cast("long")
    counted = running_total(docs, block, order, one, "idx", facts, by)
    return counted.withColumn("idx", F.col("idx") - 1)


def systematic_sample(
    docs: DataFrame, plan: DataFrame, block: list[str], order: list[str]
) -> DataFrame:
    """Every k-th row of each dataset, the first one included."""
    return (
        dense_index(docs, block, order, plan.select("dataset", "k"))
        .filter(F.col("idx") % F.col("k") == 0)
        .drop("k")
    )


def sample_lines(lines: DataFrame, plan: DataFrame, by: str = "dataset") -> DataFrame:
    """Every k-th line of a dataset, or of a ``file``, as read by ``sources.texts.text_lines``.

    Blank lines count. A line's position in its split is known from the scan, so only the
    number of lines per split has to be found out first: lines are neither sorted nor shuffled.
    """
    splits = lines.groupBy("dataset", "file", "block").agg(
        F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("total")
    )
    splits = splits.join(plan.select(by, "k"), by)
    offsets = earlier_totals(splits, by, ["file", "block"], {"total": "before"}).select(
        "file", "block", "k", (F.col("before") - F.col("first_pos")).alias("shift")
    )
    missing = F.raise_error(F.lit("the splits of a file changed between two reads"))
    return (
        lines.join(small_side(offsets), ["file", "block"], "left")
        .withColumn("idx", F.col("pos") + F.coalesce("shift", missing.cast("long")))
        .filter(F.col("idx") % F.col("k") == 0)
        .drop("shift", "k")
    )


def split_documents(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """Array texts to one row per element with a 1-based ``doc_no``; other roots are left out."""
    parsed = with_computed(arrays, "v", parse_strict(F.col("json"))).select(*keys, "v")
    opened = parsed.filter(json_kind("v") == "array").lateralJoin(
        parsed.sparkSession.tvf.variant_explode(F.col("v").outer())
    )
    number = F.col("pos") + 1
    return opened.select(
        *keys,
        number.alias("doc_no"),
        F.concat(F.lit("document_"), number).alias("doc_id"),
        F.col("value").alias("v"),
    )


def file_outcome(head: Column) -> Column:
    """``array``, ``lines``, ``empty`` or ``unknown``, by the first character that is not blank."""
    peek = F.regexp_extract(head, r"^\s*(\S)", 1)
    return (
        F.when(peek == "", "empty")
        .when(F.startswith(peek, F.lit("[")), "array")
        .when(F.startswith(peek, F.lit("{")), "lines")
        .otherwise("unknown")
    )


def detect_file_format(files: DataFrame, text: str = "text") -> DataFrame:
    return files.withColumn("format", file_outcome(F.col(text)))


def drop_empty_files(files: DataFrame, text: str = "text") -> DataFrame:
    """Files of a known format only."""
    return detect_file_format(files, text).filter(F.col("format").isin("array", "lines"))


def format_report(files: DataFrame, text: str = "text") -> DataFrame:
    return (
        detect_file_format(files, text).groupBy("format").agg(F.count(F.lit(1)).alias("files"))
    )


def size_subsets(
    docs: DataFrame, target_bytes: int, block: list[str], order: list[str], text: str = "json"
) -> DataFrame:
    """``subset``: number of the consecutive subset of about ``target_bytes`` a row falls in."""
    sized = running_total(docs, block, order, F.octet_length(text).cast("long"), "through")
    return sized.withColumn(
        "subset", F.floor((F.col("through") - 1) / F.lit(float(target_bytes))).cast("long")
    ).drop("through")

