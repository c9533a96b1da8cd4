"""Schema text back to path tables, and many schemas of one collection to one.

A schema file says of every path which types stand there, and of every object which members all
its instances have. That is enough to join schemas inferred from parts of a collection without
looking at a document again: types are united, and a member is required if every schema that
knows an object at its parent path requires it. Schemas of parts fused this way equal the schema
of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.functions.json_text import is_object_sql, parse_strict, strip_bom, with_computed
from shapeloom.functions.paths import is_member, member_step_sql, parent_of
from shapeloom.session import cut

# Schemas deeper than this are not read by the engine's parser.
_DEEPEST = 1_000


def readable_schemas(schemas: DataFrame, text: str = "schema_json") -> DataFrame:
    """Add the variant column ``v``; text that is not JSON leaves no row. A byte order mark is overlooked."""
    return with_computed(schemas, "v", parse_strict(strip_bom(F.col(text)))).filter(F.col("v").isNotNull())


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _names(v: str) -> str:
    """Strings of a list; anything else in it is passed over."""
    return f"""coalesce(transform(filter(try_variant_get({v}, '$', 'array<variant>'),
        r -> schema_of_variant(r) = 'STRING'), r -> cast(r as string)), cast(array() as array<string>))"""


def _node(path: str, required: str, v: str) -> str:
    """What one (sub)schema says about a path."""
    types = f"""case when try_variant_get(t, '$', 'string') is not null and schema_of_variant(t) = 'STRING'
        then array(cast(t as string)) else {_names('t')} end"""
    return _let(
        "t",
        f"try_variant_get({v}, '$.type')",
        _let(
            "o",
            f"{is_object_sql(f'''try_variant_get({v}, '$.properties')''')}",
            f"""struct({path} as path, {required} as required, {types} as types,
                array_contains({types}, 'object') or (t is null and o) as is_object, {v} as v)""",
        ),
    )


def _children() -> str:
    """The (sub)schemas directly inside ``n``."""
    properties = f"""coalesce(transform(
        map_entries(try_variant_get(try_variant_get(n.v, '$.properties'), '$', 'map<string,variant>')),
        e -> {_node(f"concat(n.path, {member_step_sql('e.key')})", f"array_contains({_names('''try_variant_get(n.v, '$.required')''')}, e.key)", 'e.value')}),
        filter(array(n), x -> false))"""
    one_item = f"case when {is_object_sql('i')} then array(i) else try_variant_get(i, '$', 'array<variant>') end"
    items = _let(
        "i",
        "try_variant_get(n.v, '$.items')",
        f"coalesce(transform({one_item}, x -> {_node('''concat(n.path, '[]')''', 'false', 'x')}), filter(array(n), x -> false))",
    )
    branches = [
        f"""coalesce(transform(try_variant_get(try_variant_get(n.v, '$.{word}'), '$', 'array<variant>'),
            x -> {_node('n.path', 'false', 'x')}), filter(array(n), x -> false))"""
        for word in ("anyOf", "oneOf")
    ]
    return f"concat({properties}, {items}, {', '.join(branches)})"


def schema_statements(readable: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``keys, path, required, types, is_object``: what each (sub)schema says.

    ``properties``, ``items`` (one schema or a list), ``anyOf`` and ``oneOf`` are followed to any
    depth, inside the row: no shuffle, no job. A branch of ``anyOf`` speaks about the path it
    stands at. Other keywords that hold schemas (``$ref``, ``allOf``, ``patternProperties``) are
    not followed.
    """
    names = ", ".join(f"`{k}`" for k in keys)
    columns = ["path", "required", "types", "is_object"]
    said = "struct({})".format(", ".join(f"n.{c} as {c}" for c in columns))
    step = _let(
        "level",
        f"flatten(transform(s.front, n -> {_children()}))",
        f"""struct(filter(level, n -> {is_object_sql('n.v')}) as front,
            concat(s.done, transform(level, n -> {said})) as done)""",
    )
    root = _node("''", "false", "v")
    walk = f"""aggregate(
        sequence(1, least({_DEEPEST}, 1 + length(to_json(v)) - length(translate(to_json(v), '{{', '')))),
        struct(array(r) as front, transform(array(r), n -> {said}) as done),
        (s, i) -> case when size(s.front) = 0 then s else {step} end, s -> s.done)"""
    query = f"select {names}, inline({_let('r', root, walk)}) from ".replace("{", "{{").replace("}", "}}")
    return readable.sparkSession.sql(query + "{readable}", readable=readable)


def statement_counts(statements: DataFrame, keys: list[str]) -> DataFrame:
    """Types, objects and requirements per path: one shuffle, combined on the map side."""
    return statements.groupBy(*keys, "path").agg(
        F.array_distinct(F.flatten(F.collect_set("types"))).alias("seen"),
        F.count_if("is_object").alias("objects"),
        F.count_if("required").alias("required_by"),
    )


def _joined_types() -> Column:
    with_number = F.array_contains("seen", "number")
    return F.sort_array(F.filter("seen", lambda t: ~((t == "integer") & with_number)))


def read_paths(schemas: DataFrame, keys: list[str], text: str = "schema_json") -> DataFrame:
    """Schema text to the path table ``keys, path, types, required``.

    Schemas that share ``keys`` are fused: with the file's name among the keys every file gives
    its own table, without it all files of a dataset give one. A path that no schema gives a type
    has an empty list. A member is required if every object at its parent path, in every schema
    and branch, requires it.
    """
    return fused_paths(schema_statements(readable_schemas(schemas, text), keys), keys)


def fused_paths(statements: DataFrame, keys: list[str]) -> DataFrame:
    counts = cut(statement_counts(statements, keys))
    parents = counts.filter(F.col("objects") > 0).select(*keys, F.col("path").alias("parent"), F.col("objects").alias("parent_objects"))
    everywhere = is_member(F.col("path")) & (F.col("required_by") == F.col("parent_objects"))
    return (
        counts.withColumn("parent", F.when(F.col("path") != "", parent_of(F.col("path"))))
        .join(parents, [*keys, "parent"], "left")
        .select(*keys, "path", _joined_types().alias("types"), F.coalesce(everywhere, F.lit(False)).alias("required"))
    )
