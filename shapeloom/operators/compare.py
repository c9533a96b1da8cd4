"""Comparing two schemas path by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.functions.paths import ancestors_of, is_member, parent_of
from shapeloom.session import cut


def schema_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome per path of two path tables: on one side only, or what differs.

    Types are compared as sets, so the place of a null in the list makes no difference.
    """
    by = [*keys, "path"]

    def side(paths: DataFrame, name: str) -> DataFrame:
        return paths.filter(is_member(F.col("path"))).select(
            *by,
            F.sort_array(F.array_distinct("types")).alias(f"{name}_types"),
            F.col("required").alias(f"{name}_required"),
        )

    both = side(left, "left").join(side(right, "right"), by, "full_outer")
    types_agree = F.col("left_types").eqNullSafe(F.col("right_types"))
    required_agrees = F.col("left_required").eqNullSafe(F.col("right_required"))
    outcome = (
        F.when(F.col("right_types").isNull(), "only_left")
        .when(F.col("left_types").isNull(), "only_right")
        .when(~types_agree & ~required_agrees, "type_and_required_differ")
        .when(~types_agree, "type_differs")
        .when(~required_agrees, "required_differs")
        .otherwise("equal")
    )
    return both.withColumn("outcome", outcome)


def schema_similarity(diff: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of paths, types and required flags two schemas agree on."""
    shared = ~F.col("outcome").isin("only_left", "only_right")
    same_type = F.col("outcome").isin("equal", "required_differs")
    same_required = F.col("outcome").isin("equal", "type_differs")
    counts = diff.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("paths"),
        F.count_if(shared).alias("shared_paths"),
        F.count_if(same_type).alias("same_type"),
        F.count_if(same_required).alias("same_required"),
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole).cast("double"))

    return (
        counts.withColumn("path_overlap", share("shared_paths", "paths"))
        .withColumn("type_agreement", share("same_type", "shared_paths"))
        .withColumn("required_agreement", share("same_required", "shared_paths"))
    )


def subtree_prints(paths: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, path, print``: equal prints mean that the same structure stands at two paths.

    Every path adds a hash of itself, relative to the ancestor, to each of its ancestors: prints
    of all levels come out of one aggregation. A path's own name and whether it is required are
    no part of its print; those of the paths below it are.
    """
    path = F.col("path")
    types = F.array_join(F.sort_array(F.array_distinct("types")), "|")
    above = F.concat(ancestors_of(path), F.array(path))
    rows = paths.filter(path != "").select(*keys, "path", types.alias("types"), "required", F.explode(above).alias("top"))
    below = F.expr("substring(path, length(top) + 1)")
    entry = [below, F.col("types"), F.when(below != "", F.col("required"))]
    # Entries below a path differ, so that none is taken out by another one.
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), *entry)).cast("string") for seed in (1, 2)]
    return rows.groupBy(*keys, F.col("top").alias("path")).agg(
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), *hashes).alias("print")
    )


def schema_changes(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``schema_diff`` that recognises what only changed its place: ``keys, path, to_path, outcome``.

    A subtree on the left side only and one on the right side only are the same one, ``renamed``,
    if they stand under the same parent and look alike, and ``moved`` if they have the same name
    and look alike; if there are several of either kind, there is no telling, and they stay as
    they are. Paths below go with the topmost one that is recognised.
    """
    left, right = cut(left), cut(right)
    diff = cut(schema_diff(left, right, keys).select(*keys, "path", "outcome"))

    def alone(side: DataFrame, outcome: str, name: str) -> DataFrame:
        rows = diff.filter(F.col("outcome") == outcome).join(subtree_prints(side, keys), [*keys, "path"])
        own = F.regexp_extract("path", r"([.][^.\[]*)$", 1)
        return cut(rows.select(*keys, F.col("path").alias(name), parent_of(F.col("path")).alias("parent"), own.alias("own"), "print"))

    gone, new = alone(left, "only_left", "path"), alone(right, "only_right", "to_path")

    def matched(by: str, outcome: str, gone: DataFrame, new: DataFrame) -> DataFrame:
        one = [F.count(F.lit(1)).alias("n")]
        a = gone.groupBy(*keys, by, "print").agg(*one, F.min("path").alias("path")).filter("n = 1").drop("n")
        b = new.groupBy(*keys, by, "print").agg(*one, F.min("to_path").alias("to_path")).filter("n = 1").drop("n")
        return a.join(b, [*keys, by, "print"]).select(*keys, "path", "to_path", F.lit(outcome).alias("outcome"))

    renamed = cut(matched("parent", "renamed", gone, new))
    rest = gone.join(renamed, [*keys, "path"], "left_anti"), new.join(renamed, [*keys, "to_path"], "left_anti")
    found = cut(renamed.unionByName(matched("own", "moved", *rest)))

    # The topmost recognised path at or above each path takes it along.
    above = F.explode(F.concat(ancestors_of(F.col("path")), F.array("path")))
    tops = found.select(*keys, F.col("path").alias("top"), F.col("to_path").alias("to_top"), F.col("outcome").alias("how"))
    taken = (
        gone.select(*keys, "path", above.alias("top"))
        .join(tops, [*keys, "top"])
        .groupBy(*keys, "path")
        .agg(F.min_by(F.struct("top", "to_top", "how"), F.length("top")).alias("m"))
        .select(*keys, "path", F.concat("m.to_top", F.expr("substring(path, length(m.top) + 1)")).alias("to_path"), F.col("m.how").alias("outcome"))
    )
    taken = cut(taken.join(new.select(*keys, "to_path"), [*keys, "to_path"], "left_semi"))
    left_out = diff.join(taken.select(*keys, "path"), [*keys, "path"], "left_anti")
    left_out = left_out.join(taken.select(*keys, F.col("to_path").alias("path")), [*keys, "path"], "left_anti")
    return left_out.select(*keys, "path", F.lit(None).cast("string").alias("to_path"), "outcome").unionByName(taken.select(*keys, "path", "to_path", "outcome"))


def change_similarity(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of paths that stayed, moved or were renamed, and of those that have a counterpart."""
    def count(*outcomes: str) -> Column:
        return F.count_if(F.col("outcome").isin(*outcomes))

    counts = changes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("paths"),
        count("moved").alias("moved"),
        count("renamed").alias("renamed"),
        count("only_left").alias("only_left"),
        count("only_right").alias("only_right"),
    )
    kept = F.col("paths") - F.col("only_left") - F.col("only_right")
    return counts.withColumn("structural_overlap", kept / F.col("paths").cast("double"))
