"""Schema inference over the node table: types, required members, array items."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapeloom.functions.json_text import parse_structure, reject_reason, strip_bom, with_computed
from shapeloom.functions.paths import is_item, is_member, parent_of
from shapeloom.operators.shred import DEFAULT_LEVELS, parse_documents, shred_documents
from shapeloom.session import cut, small_side
from shapeloom.sources.structure import counted, structure_counts
from shapeloom.sources.texts import not_blank, text_lines

# The JSON Schema type names.
KINDS = ["array", "boolean", "integer", "null", "number", "object", "string"]


def path_counts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Node counts per path and kind: one shuffle, combined on the map side."""
    return nodes.groupBy(*keys, "path").agg(
        F.count(F.lit(1)).alias("nodes"),
        *[F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind in KINDS],
    )


def type_set() -> Column:
    """Sorted type names seen at a path; ``number`` takes in ``integer``."""
    seen = []
    for kind in KINDS:
        present = F.col(f"n_{kind}") > 0
        if kind == "integer":
            present = present & (F.col("n_number") == 0)
        seen.append(F.when(present, kind))
    return F.array_compact(F.array(*seen))


def infer_path_types(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return path_counts(nodes, keys).select(*keys, "path", "nodes", type_set().alias("types"))


def infer_paths(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The path table ``keys, path, nodes, types, required`` of a whole collection.

    A member is required if every object at its parent path has it. The parent's object count
    is looked up in the same table by a join on the path, which adaptive execution can split
    when one parent has very many members. The table is cut off from the scan first, so that
    the documents are read once.
    """
    return paths_of_counts(path_counts(nodes, keys), keys)


def paths_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The path table of counts per path and kind."""
    counts = cut(counts)
    parents = counts.filter(F.col("n_object") > 0).select(
        *keys, F.col("path").alias("parent"), F.col("n_object").alias("parent_objects")
    )
    return (
        counts.withColumn("parent", F.when(F.col("path") != "", parent_of(F.col("path"))))
        .join(parents, [*keys, "parent"], "left")
        .select(*keys, "path", "nodes", type_set().alias("types"), _required().alias("required"))
    )


# Characters of documents whose path tables one task makes: some 200 bytes of memory for each.
TASK_CHARACTERS = 1_000_000


def document_tasks(docs: DataFrame) -> int:
    """Tasks for ``infer_document_paths`` of ``docs``, in proportion to their text."""
    size = docs.agg(F.sum(F.length("json"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_CHARACTERS))


def infer_document_paths(nodes: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """The path table of every single document, with what its children say about each path.

    Documents are spread by their keys once; counting per path and looking up the parent then
    both happen inside a document, without another shuffle. With a number of ``tasks``, as
    ``document_tasks`` gives it, the memory one of them needs does not grow with the input.
    """
    spread = nodes.repartition(*keys) if tasks is None else nodes.repartition(tasks, *keys)
    counts = path_counts(spread, keys)
    rows = counts.withColumn(
        "shelf",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(
                        F.when(F.col("path") != "", parent_of(F.col("path"))).alias("parent"),
                        F.lit(False).alias("is_parent"),
                    ),
                    F.when(
                        (F.col("n_object") > 0) | (F.col("n_array") > 0),
                        F.struct(F.col("path").alias("parent"), F.lit(True).alias("is_parent")),
                    ),
                )
            )
        ),
    ).select(*keys, "path", "nodes", *[f"n_{k}" for k in KINDS], "shelf.*")
    family = Window.partitionBy(*keys, "parent")
    own = ~F.col("is_parent")
    return (
        rows.withColumn(
            "parent_objects", F.max(F.when(F.col("is_parent"), F.col("n_object"))).over(family)
        )
        .withColumn("required", own & _required())
        .withColumn("has_required", F.max("required").over(family))
        .withColumn("has_members", F.max(own & is_member(F.col("path"))).over(family))
        .withColumn("has_items", F.max(own & is_item(F.col("path"))).over(family))
        .groupBy(*keys, "path", "nodes", *[f"n_{k}" for k in KINDS])
        .agg(
            F.bool_or("required").alias("required"),
            F.bool_or(F.col("is_parent") & F.col("has_required")).alias("has_required"),
            F.bool_or(F.col("is_parent") & F.col("has_members")).alias("has_members"),
            F.bool_or(F.col("is_parent") & F.col("has_items")).alias("has_items"),
        )
        .select(
            *keys,
            "path",
            "nodes",
            type_set().alias("types"),
            "required",
            "has_required",
            "has_members",
            "has_items",
        )
    )


def _required() -> Column:
    everywhere = F.col("nodes") == F.col("parent_objects")
    return F.coalesce(is_member(F.col("path")) & everywhere, F.lit(False))


def infer_required(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Members and whether each is required."""
    return (
        infer_paths(nodes, keys)
        .filter(is_member(F.col("path")))
        .select(*keys, "path", "required")
    )


def infer_array_items(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Element types per array path; arrays that are always empty do not show up."""
    return (
        infer_path_types(nodes.filter(is_item(F.col("path"))), keys)
        .withColumn("array_path", parent_of(F.col("path")))
        .select(*keys, "array_path", F.col("nodes").alias("items"), F.col("types").alias("item_types"))
    )


def infer_schema(
    docs: DataFrame, approved: DataFrame | None = None, levels: int = DEFAULT_LEVELS
) -> DataFrame:
    """Path table per dataset of ``dataset, file, json``, limited to approved files if given.

    A byte order mark before a document is overlooked.
    """
    if approved is not None:
        docs = docs.join(approved.select("file").distinct(), "file", "left_semi")
    parsed = parse_documents(docs, strip_bom(F.col("json")))
    return infer_paths(shred_documents(parsed, ["dataset"], levels), ["dataset"])


# A line that is all of its file, from this many characters on, is scanned split by split.
_LONG_LINE = 16_000_000


def file_schemas(
    spark: SparkSession,
    path: str,
    collection: str = "file",
    existing: DataFrame | None = None,
    whole_bytes: int | None = None,
    levels: int = DEFAULT_LEVELS,
    glob: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Path table per raw file, and ``dataset, file, outcome, rejected`` of every file.

    A file whose lines are all JSON counts by its lines: outcome ``lines``. Any other is scanned as
    one value, split by split, whatever its size, and counts if it is exactly that: ``whole``, else
    ``unparsable``. Files of more than ``whole_bytes`` bytes that do not open as an array are not
    tried, if such a bound is wanted: ``too_large``. ``rejected`` counts valid lines beyond the
    engine's value limit, which give nothing and do not reject their file. Files in ``existing``
    (``file``) are left out, and so are empty ones.
    """
    keys = ["dataset", "file"]
    lines = text_lines(spark, path, collection, glob=glob).filter(not_blank(F.col("text")))
    if existing is not None:
        lines = lines.join(existing.select("file").distinct(), "file", "left_anti")
    alone = (F.length("text") >= _LONG_LINE) & (F.octet_length("text") >= F.col("size") - 2)
    parsed = with_computed(lines, "v", F.when(~alone, parse_structure(F.col("text"))))
    reason = F.when(alone, "one_value").otherwise(reject_reason(F.col("text"), F.col("v")))
    opening = F.regexp_extract("text", r"^[\s\ufeff]*(\S)", 1)
    tried = cut(
        with_computed(parsed, "reason", reason).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("lines"),
            F.max("size").alias("size"),
            F.count_if(F.col("reason").isin("invalid", "one_value")).alias("broken"),
            F.count_if(F.col("reason") == "too_large").alias("rejected"),
            F.min_by(opening, F.struct("block", "pos")).alias("opening"),
        )
    )
    # A line of its own that is too large is scanned, too.
    by_lines = "broken = 0 and not (lines = 1 and rejected = 1)"
    # Only the lines of files that count by their lines are parsed once more.
    by_line = lines.join(small_side(tried.filter(by_lines).select("file")), "file", "left_semi")
    read = parse_documents(by_line, F.col("text"))
    counts = path_counts(shred_documents(read, keys, levels), keys)

    second = tried.filter(f"not ({by_lines})")
    large = F.lit(False) if whole_bytes is None else (F.col("opening") != "[") & (F.col("size") > whole_bytes)
    wanted = small_side(second.filter(~large).select("file"))
    pieces = text_lines(spark, path, collection, separator=",", glob=glob).join(wanted, "file", "left_semi")
    nodes, files = structure_counts(pieces)
    found = counts.unionByName(counted(nodes, keys, KINDS))
    outcome = (
        F.when(F.expr(by_lines), "lines")
        .when(F.col("fits"), "whole")
        .when(F.col("fits").isNull(), "too_large")
        .otherwise("unparsable")
    )
    rejected = F.when(F.expr(by_lines), F.col("rejected")).otherwise(F.lit(0))
    outcomes = tried.join(files.drop("dataset"), "file", "left").select(*keys, outcome.alias("outcome"), rejected.alias("rejected"))
    return paths_of_counts(found, keys), outcomes


def infer_file_schemas(
    spark: SparkSession,
    path: str,
    collection: str = "file",
    existing: DataFrame | None = None,
    whole_bytes: int | None = None,
    levels: int = DEFAULT_LEVELS,
) -> DataFrame:
    """Path table per raw file; warns of files that are not in it, or not with all their values.

    ``file_schemas`` returns the outcomes themselves.
    """
    paths, outcomes = file_schemas(spark, path, collection, existing, whole_bytes, levels)
    left_out = outcomes.filter("outcome not in ('lines', 'whole') or rejected > 0")
    for row in left_out.groupBy("outcome").agg(F.count(F.lit(1)).alias("files"), F.sum("rejected").alias("rejected")).collect():
        warnings.warn(f"{row.files} files with outcome {row.outcome}, {row.rejected} values beyond the engine's limit", stacklevel=2)
    return paths
