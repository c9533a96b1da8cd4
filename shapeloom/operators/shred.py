"""Documents to a node table: one row per JSON node."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapeloom.functions.json_text import kind_sql, parse_structure, reject_reason, with_computed
from shapeloom.functions.paths import STEP_SQL, member_step_sql

# Levels opened row by row. What lies deeper is opened inside its row, whatever its depth.
DEFAULT_LEVELS = 5
# The column that carries the text a value was parsed of.
TEXT = "__text"
# The engine's parser refuses text nested deeper than this.
_DEEPEST = 1_000


def parse_documents(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """Add the variant column ``v``; rows of ``rejected_documents`` are left out.

    The text goes along, as ``__text``. ``v`` is for its structure: where the engine refuses a string for its length, long strings
    are cut down.
    """
    text = F.col("json") if text is None else text
    parsed = with_computed(docs, "v", parse_structure(text)).filter(F.col("v").isNotNull())
    return parsed.withColumn(TEXT, F.make_valid_utf8(text))


def rejected_documents(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """Rows without a value, with the ``reason``: ``invalid`` if they are not exactly one JSON
    value, ``too_large`` if they are one beyond the engine's limit."""
    text = F.col("json") if text is None else text
    tried = with_computed(docs, "v", parse_structure(text)).filter(F.col("v").isNull())
    return tried.withColumn("reason", reject_reason(text, F.col("v"))).drop("v")


def shred_documents(
    docs: DataFrame, keys: list[str], levels: int = DEFAULT_LEVELS
) -> DataFrame:
    """Rows of ``keys, path, depth, kind`` for every node of the variant column ``v``.

    One narrow pass: no shuffle, one scan, and building it runs no job. Documents that carry
    their text are walked in it, batch by batch. Of those that only have their value the tree is
    opened level by level: each step opens the container a row still carries; the container's own
    row is put out beside its first child, so a finished node just rides along through the
    remaining steps. A container that a row still carries after ``levels`` levels is opened all the
    way down inside that row. The result does not depend on ``levels``, nor on the way taken.
    """
    if levels < 2:
        raise ValueError("two levels or more are opened row by row")
    if TEXT in docs.columns:
        return _walked(docs, keys)
    names = ", ".join(f"`{k}`" for k in keys)
    nested = f"""(select {names}, '' as path, 1 as depth, kind,
        case when kind in ('object', 'array') then v end as v
        from (select {names}, v, {kind_sql('v')} as kind from {{docs}}))"""
    for _ in range(1, levels):
        nested = f"({_open_once(nested, names)})"
    rest = f"""select {names}, inline(case when v is null or to_json(v) in ('{{{{}}}}', '[]')
        then array(struct(path, depth, kind))
        else concat(array(struct(path, depth, kind)), {_all_below("struct(path, depth, kind, v)")}) end)
        from {nested}"""
    return docs.sparkSession.sql(rest, docs=docs)


_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", float: "number", type(None): "null"}
# Whole numbers of more digits than this has zeros are numbers, as in the engine's values.
_NO_INTEGER = 10**38
# Nodes of one batch, roughly.
_BATCH_NODES = 50_000


def _walk(text: str, paths: list[str], depths: list[int], kinds: list[str]) -> None:
    """Put down the nodes of one JSON value, level by level."""
    front, depth = [("", json.loads(text))], 1
    while front:
        inside = []
        for path, value in front:
            kind = _KINDS.get(type(value)) or ("integer" if -_NO_INTEGER < value < _NO_INTEGER else "number")
            paths.append(path)
            kinds.append(kind)
            if kind == "object":
                for name, x in value.items():
                    if "~" in name or "." in name or "[" in name:
                        name = name.replace("~", "~0").replace(".", "~1").replace("[", "~2")
                    inside.append((f"{path}.{name}", x))
            elif kind == "array":
                item = path + "[]"
                inside += [(item, x) for x in value]
        depths += [depth] * len(front)
        front, depth = inside, depth + 1


def _strings(values: list[str]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # half of a pair, which the engine writes as a question mark
        return pa.array([v.encode("utf-8", "replace").decode() for v in values], pa.string())


def _walked(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes of documents that carry their text."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, paths, depths, kinds = [], [], [], []

            def done() -> pa.RecordBatch:
                own = [batch.column(i).take(pa.array(rows, pa.int32())) for i in range(len(keys))]
                columns = [*own, _strings(paths), pa.array(depths, pa.int32()), pa.array(kinds, pa.string())]
                return pa.RecordBatch.from_arrays(columns, names=[*keys, "path", "depth", "kind"])

            for row in range(batch.num_rows):
                _walk(batch.column(len(keys))[row].as_py(), paths, depths, kinds)
                rows += [row] * (len(paths) - len(rows))
                if len(rows) >= _BATCH_NODES:
                    yield done()
                    rows, paths, depths, kinds = [], [], [], []
            yield done()

    carried = docs.select(*[F.col(f"`{k}`") for k in keys], TEXT)
    node = [T.StructField("path", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("kind", T.StringType())]
    return carried.mapInArrow(walk, T.StructType([*carried.schema.fields[:-1], *node]))


def _node(path: str, depth: str, v: str) -> str:
    """A node with its container, if it is one."""
    return f"""transform(array({kind_sql(v)}), k -> struct({path} as path, {depth} as depth, k as kind,
        case when k in ('object', 'array') then {v} end as v))[0]"""


_CHILDREN = f"""case
    when n.kind = 'object' then transform(map_entries(try_variant_get(n.v, '$', 'map<string,variant>')),
        e -> {_node(f"concat(n.path, {member_step_sql('e.key')})", 'n.depth + 1', 'e.value')})
    when n.kind = 'array' then transform(try_variant_get(n.v, '$', 'array<variant>'),
        x -> {_node("concat(n.path, '[]')", 'n.depth + 1', 'x')}) end"""


def _all_below(root: str) -> str:
    """SQL for ``array<struct<path, depth, kind>>`` of all nodes below a node with its container.

    One level after the other: containers of the last level in front, finished nodes behind. There
    are no more levels than opening brackets; once nothing is in front, nothing happens any more.
    """
    containers = "filter(level, n -> n.v is not null)"
    return f"""aggregate(
        sequence(1, least({_DEEPEST}, length(to_json(v)) - length(translate(to_json(v), '[{{{{', '')))),
        struct(array({root}) as front, filter(array(struct(path, depth, kind)), n -> false) as done),
        (s, i) -> case when size(s.front) = 0 then s else
            transform(array(flatten(transform(s.front, n -> {_CHILDREN}))), level -> struct(
                {containers} as front,
                concat(s.done, transform(level, n -> struct(n.path as path, n.depth as depth, n.kind as kind))) as done))[0]
            end,
        s -> s.done)"""


def _open_once(level: str, names: str) -> str:
    return f"""
    select {names},
        case when own then path else child_path end as path,
        case when own then depth else depth + 1 end as depth,
        case when own then kind else child_kind end as kind,
        case when not own and child_kind in ('object', 'array') then value end as v
    from (
        select *, explode(case
            when pos is null then array(true)
            when pos = 0 then array(true, false)
            else array(false) end) as own
        from (
            select {names}, path, depth, kind, pos, value,
                case when pos is not null then concat(path, {STEP_SQL}) end as child_path,
                {kind_sql('value')} as child_kind
            from {level}, lateral variant_explode_outer(v)))"""
