"""Merging many proposed schemas into one per dataset, by vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.functions.paths import ancestors_of, parent_of
from shapeloom.operators.repair import (
    DEFAULT_LEVELS,
    accepted_texts,
    counted_nodes,
)
from shapeloom.session import cut

# Shares at which a member is required and a type wins alone.
REQUIRED_SHARE = 0.6
TYPE_SHARE = 0.75


def schema_nodes(
    schemas: DataFrame,
    mode: str = "reference",
    levels: int = DEFAULT_LEVELS,
    with_root: bool = False,
) -> DataFrame:
    """``dataset, file, text`` to one row per counted property: path, votes, required flag.

    ``with_root`` adds the root of each file, path ''.
    """
    keys = ["dataset", "file"]
    nodes = counted_nodes(accepted_texts(schemas, keys, mode, levels), keys, mode)
    columns = nodes.select(*keys, "path", "types", "type_form", "is_required")
    return columns if with_root else columns.filter(F.col("path") != "")


def path_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("dataset", "path").agg(
        F.count(F.lit(1)).alias("appearances"),
        F.count_if("is_required").alias("required_count"),
    )


def type_votes(nodes: DataFrame) -> DataFrame:
    return (
        nodes.select("dataset", "path", F.explode("types").alias("type"))
        .groupBy("dataset", "path", "type")
        .agg(F.count(F.lit(1)).alias("votes"))
    )


def _tally(nodes: DataFrame) -> DataFrame:
    """Appearances, required counts and votes per path in one pass over the nodes.

    Counted per path and type first: a handful of rows each, however many files vote.
    """
    per_type = (
        nodes.select("dataset", "path", "is_required", F.posexplode_outer("types").alias("pos", "type"))
        .withColumn("first", F.coalesce(F.col("pos") == 0, F.lit(True)))
        .groupBy("dataset", "path", "type")
        .agg(
            F.count_if("first").alias("appearances"),
            F.count_if(F.col("first") & F.col("is_required")).alias("required_count"),
            F.count("type").alias("votes"),
        )
    )
    named = F.col("type") != "null"
    return per_type.groupBy("dataset", "path").agg(
        F.sum("appearances").alias("appearances"),
        F.sum("required_count").alias("required_count"),
        F.sum(F.when(named, F.col("votes")).otherwise(0)).alias("named_votes"),
        F.max(F.when(named, F.struct("votes", "type"))).alias("leader"),
        F.sort_array(F.collect_set(F.when(named, F.col("type")))).alias("named_types"),
        F.coalesce(F.bool_or(F.col("type") == "null"), F.lit(False)).alias("has_null"),
    )


def _majority() -> Column:
    """The leading type alone if its share is large enough, else all types, sorted."""
    share = F.col("leader.votes") / F.col("named_votes").cast("double")
    return (
        F.when(F.size("named_types") == 0, F.array(F.lit("null")))
        .when(share >= F.lit(TYPE_SHARE), F.array(F.col("leader.type")))
        .otherwise(F.col("named_types"))
    )


def resolve_types(nodes: DataFrame) -> DataFrame:
    """Types per path by majority, nulls left aside."""
    return _tally(nodes).select("dataset", "path", _majority().alias("types"))


def _nullable_types() -> Column:
    """Any null vote adds null: after a single type, in sorted place among several."""
    types = _majority()
    nullable = F.col("has_null") & (F.size("named_types") > 0)
    with_null = F.concat(types, F.array(F.lit("null")))
    return (
        F.when(nullable & (F.size(types) > 1), F.sort_array(with_null))
        .when(nullable, with_null)
        .otherwise(types)
    )


def resolve_nullable(nodes: DataFrame) -> DataFrame:
    """Types per path with null added where anyone voted for it."""
    nullable = F.col("has_null") & (F.size("named_types") > 0)
    return _tally(nodes).select(
        "dataset", "path", _nullable_types().alias("types"), nullable.alias("nullable")
    )


def _required_by_share() -> Column:
    share = F.col("required_count") / F.col("appearances").cast("double")
    return share >= F.lit(REQUIRED_SHARE)


def resolve_required(stats: DataFrame) -> DataFrame:
    """Required where enough of the schemas that have the member require it."""
    return stats.select("dataset", "path", _required_by_share().alias("required"))


def merged_paths(nodes: DataFrame) -> DataFrame:
    """The path table of the master schema per dataset; the root's row, if given, stays an object.

    A path stays only if every ancestor's resolved type names object; a path that keeps
    children becomes a plain object. Ancestors are looked up all at once, not level by level.
    """
    resolved = cut(
        _tally(nodes).select(
            "dataset", "path", _nullable_types().alias("types"), _required_by_share().alias("required")
        )
    )
    holds = F.exists("types", lambda t: F.contains(t, F.lit("object")))
    closed = resolved.filter(~holds).select("dataset", F.col("path").alias("ancestor"))
    lost = (
        resolved.select("dataset", "path", F.explode(ancestors_of(F.col("path"))).alias("ancestor"))
        .join(closed, ["dataset", "ancestor"], "left_semi")
        .select("dataset", "path")
        .distinct()
    )
    kept = resolved.join(lost, ["dataset", "path"], "left_anti")
    parents = (
        kept.select("dataset", parent_of(F.col("path")).alias("path"))
        .distinct()
        .withColumn("has_children", F.lit(True))
    )
    root = F.col("path") == ""
    types = F.when(root | F.col("has_children"), F.array(F.lit("object"))).otherwise(F.col("types"))
    return kept.join(parents, ["dataset", "path"], "left").select(
        "dataset", "path", types.alias("types"), (~root & F.col("required")).alias("required")
    )


def merge_schemas(
    schemas: DataFrame, mode: str = "reference", levels: int = DEFAULT_LEVELS
) -> DataFrame:
    """``dataset, file, text`` of proposals to the master schema's path table."""
    return merged_paths(schema_nodes(schemas, mode, levels, with_root=True))
