"""Path tables to JSON Schema text.

A schema is written as ordered pieces of text. Every path contributes a handful of them, each
with a sort key that starts with the keys of its ancestors, so sorting the pieces puts the
text in order and joining them gives the document. No path needs to see another one.

``render_pieces`` gives the pieces themselves, for schemas of any size: each is final, its path
having been told by its parent whether it is the first member. ``render_schema`` joins them to one
cell per schema: there commas are written before each member, and the one after an opening bracket
is taken out at the end with the help of a control character JSON text can never contain. A schema
that is proven to be too long for a cell fails there and not in the middle of the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.functions.json_text import quote_json
from shapeloom.functions.paths import decode_key, is_item, last_key, parent_of, steps_of
from shapeloom.session import cut

SCHEMA_URI = "http://json-schema.org/schema#"

_FIRST = "\x1e"
# Characters that one cell is trusted with.
CELL_CHARACTERS = 500_000_000

# Order of the pieces of one node.
_OPEN, _ITEMS, _AFTER_ITEMS, _MEMBERS, _AFTER_MEMBERS, _REQUIRED, _CLOSE = "0123456"


def _piece(order: Column, text: Column) -> Column:
    return F.struct(order.alias("order"), text.alias("text"))


def _place(path: Column) -> Column:
    """Sort key of a node: its steps, each led by the section of the parent it belongs to."""
    return F.flatten(
        F.transform(
            steps_of(path),
            lambda s: F.when(s == "[]", F.array(F.lit(_ITEMS))).otherwise(
                F.array(F.lit(_MEMBERS), decode_key(F.substring(s, 2, 2147483647)))
            ),
        )
    )


def _parent_facts(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Per path, what its children say: has members, has items, has required members."""
    child = F.col("path") != ""
    return (
        paths.filter(child)
        .groupBy(*keys, parent_of(F.col("path")).alias("path"))
        .agg(
            F.bool_or(~is_item(F.col("path"))).alias("has_members"),
            F.bool_or(is_item(F.col("path"))).alias("has_items"),
            F.bool_or("required").alias("has_required"),
        )
    )


def _with_facts(paths: DataFrame, keys: list[str]) -> DataFrame:
    if "has_members" in paths.columns:
        return paths
    paths = cut(paths)
    facts = paths.join(_parent_facts(paths, keys), [*keys, "path"], "left")
    return facts.fillna(False, ["has_members", "has_items", "has_required"])


def _with_firsts(table: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a path is its parent's first member, and the first of its required members."""
    member = ~is_item(F.col("path"))
    firsts = (
        table.filter((F.col("path") != "") & member)
        .groupBy(*keys, parent_of(F.col("path")).alias("parent"))
        .agg(F.min(last_key(F.col("path"))).alias("one"), F.min(F.when(F.col("required"), last_key(F.col("path")))).alias("one_required"))
    )
    told = table.withColumn("parent", F.when(F.col("path") != "", parent_of(F.col("path")))).join(firsts, [*keys, "parent"], "left")
    first = lambda c: F.coalesce(last_key(F.col("path")) == F.col(c), F.lit(False))
    return told.withColumn("is_first", first("one")).withColumn("is_first_required", first("one_required")).drop("parent", "one", "one_required")


def _assemble(pieces: DataFrame, keys: list[str], measured: bool = True) -> DataFrame:
    if measured:
        pieces = cut(pieces)
        size = pieces.groupBy(*keys).agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] or 0
        if size > CELL_CHARACTERS:
            raise ValueError(f"a schema of {size} characters is too long for one cell; see render_pieces")
    ordered = F.sort_array(F.collect_list(F.struct("order", "text")))
    text = F.array_join(F.transform(ordered, lambda p: p["text"]), "")
    text = F.replace(text, F.lit(_FIRST + ", "), F.lit(""))
    return pieces.groupBy(*keys).agg(F.replace(text, F.lit(_FIRST), F.lit("")).alias("schema_json"))


def _member_head(uri: str | None, comma: Column) -> Column:
    path = F.col("path")
    root = "{" + (f'"$schema": "{uri}", ' if uri else "")
    return (
        F.when(path == "", F.lit(root))
        .when(is_item(path), F.lit("{"))
        .otherwise(F.concat(comma, quote_json(last_key(path)), F.lit(": {")))
    )


def _required_piece(place: Column, comma: Column) -> Column:
    """A required member is listed under its parent: same key, other section."""
    path = F.col("path")
    key = last_key(path)
    parent_place = F.slice(place, F.lit(1), F.greatest(F.size(place) - 2, F.lit(0)))
    return F.when(
        F.col("required"),
        _piece(
            F.concat(parent_place, F.array(F.lit(_REQUIRED), key)),
            F.concat(comma, quote_json(key)),
        ),
    )


def _commas(final: bool) -> tuple[Column, Column, str]:
    """What stands before a member and a required name, and what marks an opening bracket."""
    if not final:
        return F.lit(", "), F.lit(", "), _FIRST
    return F.when(F.col("is_first"), "").otherwise(", "), F.when(F.col("is_first_required"), "").otherwise(", "), ""


def render_pieces(paths: DataFrame, keys: list[str], uri: str | None = SCHEMA_URI) -> DataFrame:
    """``keys, order, text``: the text of ``render_schema`` in pieces, to be read in order."""
    return _inferred_pieces(_with_firsts(_with_facts(paths, keys), keys), keys, uri, True)


def master_pieces(paths: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, order, text``: the text of ``render_master`` in pieces, to be read in order."""
    return _master_pieces(_with_firsts(_with_facts(paths, keys), keys), keys, True)


def render_schema(paths: DataFrame, keys: list[str], uri: str | None = SCHEMA_URI) -> DataFrame:
    """Inferred path table (``path, types, required``) to schema text per key.

    Plain types come as one name or a sorted list. An object with members or an array with
    items that stands beside other types becomes a branch of ``anyOf``.
    """
    # A schema per document, its facts known, is no longer than a multiple of the document.
    measured = "has_members" not in paths.columns
    return _assemble(_inferred_pieces(_with_facts(paths, keys), keys, uri, False), keys, measured)


def _inferred_pieces(table: DataFrame, keys: list[str], uri: str | None, final: bool) -> DataFrame:
    comma, required_comma, first = _commas(final)
    bare = F.filter(
        "types",
        lambda t: ~(((t == "object") & F.col("has_members")) | ((t == "array") & F.col("has_items"))),
    )
    table = table.withColumn("bare", bare).withColumn("place", _place(F.col("path")))
    has_bare = F.size("bare") > 0
    members, items, required = F.col("has_members"), F.col("has_items"), F.col("has_required")
    branches = has_bare.cast("int") + members.cast("int") + items.cast("int")
    place = F.col("place")

    def at(section: str) -> Column:
        return F.concat(place, F.array(F.lit(section)))

    bare_text = F.when(F.size("bare") == 1, quote_json(F.col("bare")[0])).otherwise(
        F.replace(F.to_json("bare"), F.lit(","), F.lit(", "))
    )
    opening = F.concat(
        _member_head(uri, comma),
        F.when(branches > 1, '"anyOf": [{').otherwise(""),
        F.when(has_bare, F.concat(F.lit('"type": '), bare_text)).otherwise(""),
        F.when(has_bare & (branches > 1), "}, {").otherwise(""),
        F.when(items, '"type": "array", "items": ').otherwise(""),
    )
    before_members = F.concat(
        F.when(items, "}, {").otherwise(""), F.lit('"type": "object", "properties": {' + first)
    )
    after_members = F.concat(
        F.lit("}"), F.when(required, ', "required": [' + first).otherwise("")
    )
    closing = F.concat(
        F.when(required, "]").otherwise(""), F.when(branches > 1, "}]").otherwise(""), F.lit("}")
    )
    pieces = F.array_compact(
        F.array(
            _piece(at(_OPEN), opening),
            F.when(members, _piece(at(_MEMBERS), before_members)),
            F.when(members, _piece(at(_AFTER_MEMBERS), after_members)),
            _required_piece(place, required_comma),
            _piece(at(_CLOSE), closing),
        )
    )
    return table.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.*")


def render_master(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Merged path table (``path, types, required``, root row included) to schema text per key."""
    return _assemble(_master_pieces(_with_facts(paths, keys), keys, False), keys)


def _master_pieces(table: DataFrame, keys: list[str], final: bool) -> DataFrame:
    comma, required_comma, first = _commas(final)
    table = table.withColumn("place", _place(F.col("path")))
    place = F.col("place")

    def at(section: str) -> Column:
        return F.concat(place, F.array(F.lit(section)))

    open_object = F.col("has_members") | (F.col("path") == "")
    required = F.col("has_required")
    type_text = F.when(F.size("types") == 1, quote_json(F.col("types")[0])).otherwise(
        F.replace(F.to_json("types"), F.lit('","'), F.lit('", "'))
    )
    opening = F.concat(
        _member_head(None, comma),
        F.lit('"type": '),
        type_text,
        F.when(open_object, ', "properties": {' + first).otherwise(""),
    )
    after_members = F.concat(
        F.lit("}"), F.when(required, ', "required": [' + first).otherwise("")
    )
    pieces = F.array_compact(
        F.array(
            _piece(at(_OPEN), opening),
            F.when(open_object, _piece(at(_AFTER_MEMBERS), after_members)),
            _required_piece(place, required_comma),
            _piece(at(_CLOSE), F.concat(F.when(required, "]").otherwise(""), F.lit("}"))),
        )
    )
    return table.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.*")
