"""JSON text from files: lines, arrays, one document or schema per file."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.functions.json_text import is_json
from shapeloom.session import cut, earlier_totals, small_side
from shapeloom.sources.structure import array_parts, split_starts, with_start


def _file_path() -> Column:
    """Path of the file a row comes from, scheme dropped and escapes undone."""
    raw = F.col("_metadata.file_path")
    escaped = F.contains(raw, F.lit("%")) | F.contains(raw, F.lit("+"))
    plain = F.when(escaped, F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)
    return F.regexp_replace(plain, r"^[A-Za-z0-9]+:(//[^/]*)?(?=/)", "")


def _collection(by: str) -> Column:
    # Paths of scanned files are clean already: cheap cuts do, this runs for every row.
    if by == "file":
        return F.regexp_replace(F.substring_index("file", "/", -1), r"(?<=[^.])\.[^.]*$", "")
    if by == "directory":
        return F.substring_index(F.substring_index("file", "/", -2), "/", 1)
    raise ValueError(f"a collection is a 'file' or a 'directory', not {by!r}")


# The extensions of raw files.
RAW_FILES = "*.{json,jsonl}"


def text_lines(
    spark: SparkSession,
    path: str,
    collection: str = "file",
    separator: str | None = None,
    glob: str | None = None,
) -> DataFrame:
    """``dataset, file, block, pos, size, text``: every line with its place in the file.

    Files are read in splits. ``block`` is where a split starts; within one, ``pos`` grows by
    one per line.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if separator is not None:
        reader = reader.option("lineSep", separator)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select(
        _file_path().alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").alias("text"),
    )
    return lines.withColumn("dataset", _collection(collection))


def whole_files(
    spark: SparkSession, path: str, collection: str = "file", glob: str | None = None
) -> DataFrame:
    """``dataset, file, size_bytes, text``: one row per file."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.text(path, wholetext=True).select(
        _file_path().alias("file"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.col("value").alias("text"),
    )
    return files.withColumn("dataset", _collection(collection))


def not_blank(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"\S"))


def scan_json_lines(
    spark: SparkSession, path: str, collection: str = "file", reject: str = "file"
) -> DataFrame:
    """``dataset, file, block, pos, json``: a row per line that is not blank.

    One line that is not JSON rejects its whole ``file``, or its whole ``dataset``. A line too
    large for the engine to parse does not.
    """
    return valid_lines(text_lines(spark, path, collection), reject).withColumnRenamed("text", "json")


def valid_lines(lines: DataFrame, reject: str = "file") -> DataFrame:
    lines = lines.filter(not_blank(F.col("text")))
    broken = lines.filter(~is_json(F.col("text"))).select(reject).distinct()
    return lines.join(small_side(broken), reject, "left_anti")


def file_heads(
    spark: SparkSession, path: str, collection: str = "file", glob: str | None = None
) -> DataFrame:
    """``dataset, file, size_bytes, text``: at most 100 characters of each file, from the first
    one on that is not blank.

    Files are read in pieces that end at commas, of which only the first of a file is looked at:
    one that is blank has a comma behind it, or nothing. Empty files are listed too.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    listed = reader.load(path).select(_file_path().alias("file"), F.col("length").alias("size_bytes"))
    pieces = text_lines(spark, path, collection, separator=",", glob=glob).filter("block = 0")
    start = F.substring(F.regexp_replace("text", r"^\s+", ""), 1, 100)
    opening = (
        pieces.select("file", "pos", start.alias("start"))
        .groupBy("file")
        .agg(F.min_by("start", "pos").alias("start"), F.count(F.lit(1)).alias("pieces"))
        .select("file", F.when((F.col("start") == "") & (F.col("pieces") > 1), ",").otherwise(F.col("start")).alias("text"))
    )
    return (
        listed.join(opening, "file", "left")
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("dataset", _collection(collection))
    )


def scan_documents(
    spark: SparkSession, path: str, exclude: str | None = None, glob: str = "*.json"
) -> DataFrame:
    """``dataset, file, size_bytes, json``: every readable JSON file below a folder.

    ``exclude`` names a folder to leave out, such as the one schemas are written to.
    """
    files = whole_files(spark, path, "directory", glob).withColumnRenamed("text", "json")
    if exclude is not None:
        files = files.filter(~F.contains("file", F.lit(f"/{exclude.strip('/')}/")))
    return files.filter(is_json(F.col("json")))


def without_scheme(root: str) -> str:
    """A folder as the scans name it."""
    return re.sub(r"^[A-Za-z0-9]+:(//[^/]*)?(?=/)", "", root).rstrip("/")


def scan_schema_corpus(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """``dataset, file, text``: every JSON file in the folder of each dataset, at any depth."""
    below = rf"\Q{without_scheme(root)}\E/+([^/]+)/"
    files = whole_files(spark, root, "directory", glob)
    return (
        files.withColumn("dataset", F.regexp_extract("file", below, 1))
        .filter(F.col("dataset") != "")
        .select("dataset", "file", "text")
    )


def scan_json_array(
    spark: SparkSession, path: str, collection: str = "file", wanted: DataFrame | None = None
) -> DataFrame:
    """``dataset, file, doc_no, json``: a row per element of the array each file holds.

    Of the files in ``wanted`` (``file``) only, if given: no others are shuffled.

    The text of the elements is kept as it is. Files are cut at their commas, split by split, so
    an array may be larger than any task could hold. Which commas separate elements follows from
    the quotes and brackets before; a split's pieces are put together in the task that reads them,
    and only the element that a split began or left open is moved. Files that are no array, or no
    JSON, are left out whole.
    """
    pieces = text_lines(spark, path, collection, separator=",")
    if wanted is not None:
        pieces = pieces.join(wanted, "file", "left_semi")
    parts = array_parts(with_start(pieces, split_starts(pieces)))
    # Written once; parts that are whole elements are checked on the way.
    plain = F.col("ends") & F.col("begins") & ~((F.col("block") == 0) & (F.col("place") == 0))
    parts = cut(parts.withColumn("valid", F.when(plain, is_json(F.col("text")))))
    ended = parts.groupBy("file", "block").agg(F.count_if("ends").alias("ends"))
    ended = earlier_totals(ended, "file", ["block"], {"ends": "ended"}).drop("ends")
    numbered = parts.join(small_side(ended), ["file", "block"]).withColumn("element", F.col("ended") + F.col("place"))
    whole = numbered.filter("valid is not null").select("file", "element", F.col("text").alias("json"), F.lit(False).alias("last"), "valid")
    # Only the open ends of splits are moved.
    pieced = (
        numbered.filter("valid is null")
        .groupBy("file", "element")
        .agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("pieces"), F.bool_or("ends").alias("ends"))
        .withColumn("json", F.array_join(F.transform("pieces", lambda p: p["text"]), ","))
    )
    edges = cut(_without_brackets(pieced).withColumn("valid", is_json(F.col("json"))))
    bounds = F.bool_or(F.col("element") == 0).alias("first"), F.bool_or("last").alias("last"), F.every("valid").alias("valid")
    sound = edges.groupBy("file").agg(*bounds).join(
        whole.groupBy("file").agg(F.every("valid").alias("all_valid")), "file", "left"
    ).filter("valid and last and coalesce(all_valid, true)")
    elements = edges.unionByName(whole).select("file", (F.col("element") + 1).alias("doc_no"), F.regexp_replace("json", r"^\s+|\s+$", "").alias("json"))
    return elements.join(small_side(sound.select("file")), "file", "left_semi").select(
        _collection(collection).alias("dataset"), "file", "doc_no", "json"
    )


def _without_brackets(elements: DataFrame) -> DataFrame:
    """Take the array's own brackets off its first and last element.

    A text that does not open or close as an array gets NULL for an element, or has no last one
    because the end of the file leaves it open. An empty array has one empty element, no row.
    """
    first, last = F.col("element") == 0, ~F.col("ends")
    opened = F.when(first, F.regexp_extract("json", r"(?s)^\s*\[(.*)$", 1)).otherwise(F.col("json"))
    opens = ~first | F.regexp_like("json", F.lit(r"^\s*\["))
    closed = F.when(last, F.regexp_extract("opened", r"(?s)^(.*)\]\s*$", 1)).otherwise(F.col("opened"))
    closes = ~last | F.regexp_like("opened", F.lit(r"\]\s*$"))
    empty = first & last & F.col("whole") & ~not_blank(F.col("json"))
    return (
        elements.withColumn("opens", opens)
        .withColumn("opened", opened)
        .withColumn("whole", F.col("opens") & closes)
        .withColumn("json", F.when(F.col("whole"), closed))
        .filter(F.coalesce(~empty, F.lit(True)))
        .select("file", "element", "json", last.alias("last"))
    )
