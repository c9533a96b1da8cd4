"""Repair of proposed schemas: their text, their ``required`` lists, their misplaced members."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapeloom.functions.json_text import (
    brace_slice,
    is_object_sql,
    kind_sql,
    parse_strict,
    strip_bom,
    with_computed,
)
from shapeloom.functions.paths import STEP_SQL, member_step_sql
from shapeloom.operators.shred import TEXT
from shapeloom.session import small_side

# Levels of properties opened row by row. What lies deeper is walked inside its row.
DEFAULT_LEVELS = 4
# No schema is deeper than what the engine's parser reads.
_DEEPEST = 1_000

# Members that mark a node as a schema although it has no object type.
MARKER_KEYWORDS = [
    "title",
    "description",
    "default",
    "pattern",
    "format",
    "minimum",
    "maximum",
    "minLength",
    "maxLength",
]

# JSON Schema keywords whose own schema is no property (``mode="strict"``).
SCHEMA_KEYWORDS = [
    "$defs",
    "additionalItems",
    "additionalProperties",
    "contains",
    "definitions",
    "dependentSchemas",
    "else",
    "if",
    "items",
    "not",
    "patternProperties",
    "prefixItems",
    "propertyNames",
    "then",
    "unevaluatedItems",
    "unevaluatedProperties",
]


def repair_schema_text(schemas: DataFrame) -> DataFrame:
    """Add ``v`` and ``status`` to ``dataset, file, text``.

    ``ok``: the text parses, a byte order mark aside. ``sliced``: the part from the first brace
    to the last one does. ``failed``: neither, and ``v`` is NULL.
    """
    parsed = with_computed(schemas, "whole", parse_strict(strip_bom(F.col("text"))))
    sliced = F.when(F.col("whole").isNull(), parse_strict(brace_slice(F.col("text"))))
    return (
        with_computed(parsed, "v", F.coalesce("whole", sliced))
        .withColumn(
            "status",
            F.when(F.col("whole").isNotNull(), "ok")
            .when(F.col("v").isNotNull(), "sliced")
            .otherwise("failed"),
        )
        .drop("whole")
    )


def _is_schema_like(v: str) -> str:
    return f"({is_object_sql(v)} and try_variant_get({v}, '$.type') is not null)"


def _movable(key: str, value: str, mode: str) -> str:
    """A member that may be a property in the wrong place. ``required`` is emptied before."""
    exempt = ["required", *(SCHEMA_KEYWORDS if mode == "strict" else [])]
    names = ", ".join(f"'{name}'" for name in exempt)
    return f"({key} not in ({names}) and {_is_schema_like(value)})"


def _forced(mode: str, v: str = "v", type_: str = "type") -> str:
    """The node ``v`` holds properties directly and is to be made an object around them.

    Only asked of nodes without ``properties`` that have an object among their members.
    """
    markers = ", ".join(f"'{name}'" for name in MARKER_KEYWORDS)
    return f"""exists(array(try_variant_get({v}, '$', 'map<string,variant>')), m ->
        exists(map_keys(m), k -> {_movable('k', 'm[k]', mode)})
        and (coalesce(try_variant_get({type_}, '$', 'string') = 'object', false)
             or exists(array({markers}), k -> map_contains_key(m, k)
                       and not {_movable('k', 'm[k]', mode)})))"""


def _names_object(type_: str = "type") -> str:
    return f"""(coalesce(try_variant_get({type_}, '$', 'string') = 'object', false)
        or coalesce(array_contains(try_variant_get({type_}, '$', 'array<string>'), 'object'), false))"""


def _has_container(required: str = "required") -> str:
    return f"""case
        when {required} is null or schema_of_variant({required}) in
            ('ARRAY<STRING>', 'ARRAY<VOID>', 'BOOLEAN', 'STRING', 'VOID') then false
        else coalesce(exists(try_variant_get({required}, '$', 'array<variant>'),
            r -> {kind_sql('r')} in ('object', 'array')), false) end"""


def _required_names(required: str = "required") -> str:
    return f"""transform(filter(try_variant_get({required}, '$', 'array<variant>'),
        r -> schema_of_variant(r) = 'STRING'), r -> cast(r as string))"""


def _settle(source: str, names: str, mode: str) -> str:
    """Take from each new node ``v`` what the walk needs, and let go of the node.

    ``inside``: the variant whose members are the node's properties. ``visited``: its properties
    are counted. ``bad``: counting them is impossible. Rows without ``v`` are done and keep what
    they have; every expression asks for that first.
    """
    return f"""
    select {names}, path, depth, is_required, voted, type, required, forced, visited, has_properties,
        case when v is null then bad else visited and (
            (depth = 1 and not {is_object_sql('v')})
            or (not has_properties and not forced and properties is not null)
            or {_has_container()}) end as bad,
        case when v is null then null when has_properties then properties
             when forced then v end as inside,
        case when v is null or not (has_properties or forced) then null else
            {_required_names()} end as required_names
    from (
        select *, case when v is null or not voted then false when depth = 1 then true
            when forced then not {_is_schema_like('type')}
            else properties is not null and {_names_object()} end as visited
        from (
            select *, case when v is null then done_forced when has_properties then false
                when not contains(schema_of_variant(v), ': OBJECT<') then false
                else {_forced(mode)} end as forced
            from (
                select *, case when v is null then null else {is_object_sql('properties')} end
                    as has_properties
                from (
                    select {names}, path, depth, is_required, voted, v, bad, done_forced,
                        case when v is null then type else try_variant_get(v, '$.type') end as type,
                        case when v is null then required
                             else try_variant_get(v, '$.required') end as required,
                        case when v is null then null
                             else try_variant_get(v, '$.properties') end as properties
                    from {source}))))"""


def _step_down(level: str, names: str, mode: str) -> str:
    """Open every unfinished node: its own row, done, beside a row per property."""
    children = f"""(
        select {names},
            case when own then path else concat(path, {STEP_SQL}) end as path,
            case when own then depth else depth + 1 end as depth,
            case when own then is_required
                 else coalesce(array_contains(required_names, key), false) end as is_required,
            case when own then voted else visited end as voted,
            case when own then type end as type,
            case when own then required end as required,
            case when own then forced end as done_forced,
            case when own then bad end as bad,
            case when not own then value end as v
        from (
            select *, explode(case
                when pos is null then array(true)
                when pos = 0 then array(true, false)
                else array(false) end) as own
            from {level}, lateral variant_explode_outer(inside))
        where own or ({is_object_sql('value')}
            and (has_properties or {_movable('key', 'value', mode)})))"""
    return _settle(children, names, mode)


_OUT = ["path", "depth", "is_required", "voted", "type", "required", "forced", "bad"]


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _settled(path: str, depth: str, is_required: str, voted: str, v: str, mode: str) -> str:
    """A node below the first, settled as in ``_settle``, as a struct."""
    own = f"""struct(try_variant_get({v}, '$.type') as type, try_variant_get({v}, '$.required') as required,
        try_variant_get({v}, '$.properties') as properties)"""
    has = is_object_sql("a.properties")
    forced = f"""case when h then false when not contains(schema_of_variant({v}), ': OBJECT<') then false
        else {_forced(mode, v, 'a.type')} end"""
    visited = f"""case when not {voted} then false when f then not {_is_schema_like('a.type')}
        else a.properties is not null and {_names_object('a.type')} end"""
    node = f"""struct({path} as path, {depth} as depth, {is_required} as is_required, {voted} as voted,
        a.type as type, a.required as required, f as forced, w as visited, h as has_properties,
        w and ((not h and not f and a.properties is not null) or {_has_container('a.required')}) as bad,
        case when h then a.properties when f then {v} end as inside,
        case when h or f then {_required_names('a.required')} end as required_names)"""
    return _let("a", own, _let("h", f"({has})", _let("f", f"({forced})", _let("w", f"({visited})", node))))


def _all_below(mode: str) -> str:
    """SQL for the settled nodes below the row's node, one level after the other."""
    properties = f"""filter(map_entries(try_variant_get(n.inside, '$', 'map<string,variant>')),
        e -> {is_object_sql('e.value')} and (n.has_properties or {_movable('e.key', 'e.value', mode)}))"""
    child = _settled(
        f"concat(n.path, {member_step_sql('e.key')})",
        "n.depth + 1",
        "coalesce(array_contains(n.required_names, e.key), false)",
        "n.visited",
        "e.value",
        mode,
    )
    row = "struct(path, depth, is_required, voted, type, required, forced, visited, has_properties, bad, inside, required_names)"
    out = "struct({})".format(", ".join(f"n.{c} as {c}" for c in _OUT))
    blank = "struct({})".format(", ".join(_OUT))
    return f"""aggregate(
        sequence(1, least({_DEEPEST}, length(to_json(inside)) - length(translate(to_json(inside), '{{', '')))),
        struct(array({row}) as front, filter(array({blank}), n -> false) as done),
        (s, i) -> case when size(s.front) = 0 then s else
            {_let('level', f"flatten(transform(s.front, n -> transform({properties}, e -> {child})))", f"""struct(
                filter(level, n -> n.inside is not null) as front,
                concat(s.done, transform(level, n -> {out})) as done)""")} end,
        s -> s.done)"""


# The votes of a ``type`` that is a list.
_LISTED_VOTES = """transform(
        filter(try_variant_get(type, '$', 'array<variant>'), t -> not is_variant_null(t)),
        t -> case schema_of_variant(t)
             when 'BOOLEAN' then initcap(cast(t as string))
             when 'STRING' then cast(t as string)
             else to_json(t) end)"""
# The votes a node casts; none when its ``type`` has no usable form.
_VOTES = f"""case
    when forced and {_is_schema_like('type')} then array('null')
    when forced then array('object')
    when type_form in ('absent', 'null') then array('null')
    when type_form = 'string' then array(cast(type as string))
    when type_form = 'array' then {_LISTED_VOTES}
    else cast(array() as array<string>) end"""


def schema_tree(
    parsed: DataFrame,
    keys: list[str],
    mode: str = "reference",
    levels: int = DEFAULT_LEVELS,
) -> DataFrame:
    """Repaired schema documents as a node table, one row per schema node.

    Works on the variant column ``v``. A node is repaired inside its own row, from its own
    members only, so the walk down the tree needs no shuffle. ``voted`` marks the nodes the
    merge counts: those reached through object types only.
    """
    if mode not in ("reference", "strict"):
        raise ValueError(f"unknown repair mode {mode!r}")
    spark = parsed.sparkSession
    names = ", ".join(f"`{k}`" for k in keys)
    nothing = "cast(null as variant)"
    root = f"""(select {names}, '' as path, 1 as depth, false as is_required, true as voted,
        {nothing} as type, {nothing} as required, cast(null as boolean) as done_forced,
        cast(null as boolean) as bad, v from {{parsed}} where v is not null)"""
    nodes = spark.sql(_settle(root, names, mode), parsed=parsed)
    # A statement for each level: the analyser takes longer over nested ones.
    for _ in range(1, levels):
        nodes = spark.sql(_step_down("{nodes}", names, mode), nodes=nodes)
    own = "array(struct({}))".format(", ".join(_OUT))
    # Doubled braces: the text is a template for the table's name.
    below = _all_below(mode).replace("{", "{{").replace("}", "}}")
    return spark.sql(
        f"""select {names}, path, depth, is_required, voted, forced, bad, type_form,
            coalesce({kind_sql('required')}, 'absent') as required_form, {_VOTES} as types
        from (select *, coalesce({kind_sql('type')}, 'absent') as type_form
            from (select {names}, inline(case when inside is null or to_json(inside) = '{{{{}}}}' then {own}
                else concat({own}, {below}) end) from {{nodes}}))""",
        nodes=nodes,
    )


# A file can only be rejected if its shape shows properties that are no object, or a required
# list with containers in it, or a root that is no object.
_SUSPECT_SHAPE = r"^(?!OBJECT)|properties: (?!OBJECT)|required: ARRAY<(OBJECT|ARRAY|VARIANT)"


def rejected_files(
    parsed: DataFrame,
    keys: list[str],
    mode: str = "reference",
    levels: int = DEFAULT_LEVELS,
) -> DataFrame:
    """Files whose votes cannot be counted. Only files of a suspect shape are walked for it."""
    suspects = parsed.filter(F.regexp_like(F.schema_of_variant("v"), F.lit(_SUSPECT_SHAPE)))
    return schema_tree(suspects, keys, mode, levels).filter("bad").select(*keys).distinct()


class _Number(str):
    """A number as the text writes it; it goes back to a text as it is."""


def _form(value: object) -> str:
    """What JSON Schema calls the type of a parsed value, as ``kind_sql`` does."""
    if type(value) is _Number:
        whole = value.lstrip("-").isdigit() and len(value.lstrip("-")) <= 38
        return "integer" if whole else "number"
    return {dict: "object", list: "array", str: "string", bool: "boolean"}.get(type(value), "null")


def _valid(text: str) -> str:
    """Halves of pairs as question marks, as the engine writes them."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _written(value: object) -> str:
    """A parsed value as JSON text, its numbers as they were."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if type(x) is _Number:
            out.append(x)
        elif isinstance(x, (dict, list)):
            named = isinstance(x, dict)
            parts = [_Number("{" if named else "[")]
            for i, item in enumerate(x.items() if named else x):
                head = "," if i else ""
                parts += [_Number(f"{head}{json.dumps(item[0])}:"), item[1]] if named else [_Number(head), item]
            todo += reversed([*parts, _Number("}" if named else "]")])
        else:
            out.append(json.dumps(x))
    return "".join(out)


def _like_schema(value: object) -> bool:
    return type(value) is dict and "type" in value


def _counted(text: str, exempt: frozenset[str]) -> tuple[list[tuple], bool]:
    """The nodes of one schema that are counted, the root first, and whether they can be.

    A node is its path, whether it is required, its votes, the form of its ``type``, and that ``type``
    as text if it lists what the engine has to spell. The rules are those of ``_settle``.
    """
    nodes, bad = [], False
    front = [("", False, json.loads(text, parse_int=_Number, parse_float=_Number))]
    while front:
        inside = []
        for path, is_required, node in front:
            own = node if type(node) is dict else {}
            kind, properties, listed = own.get("type"), own.get("properties"), own.get("required")
            has = type(properties) is dict
            movable = {} if has else {k: x for k, x in own.items() if _like_schema(x) and k not in exempt}
            forced = bool(movable) and (
                (type(kind) is str and kind == "object") or any(k in own and k not in movable for k in MARKER_KEYWORDS)
            )
            form, spelt = _form(kind) if "type" in own else "absent", None
            if forced:
                votes = ["null"] if _like_schema(kind) else ["object"]
            elif kind is None:
                votes = ["null"]
            elif form == "string":
                votes = [_valid(kind)]
            elif form == "array":
                votes = [str(t) if type(t) is bool else _valid(t) for t in kind if type(t) in (bool, str)]
                if any(type(t) not in (bool, str, type(None)) for t in kind):
                    spelt = _written(kind)
            else:
                votes = []
            nodes.append((path, is_required, votes, form, spelt))
            if not path:
                visited = True
            elif forced:
                visited = not _like_schema(kind)
            else:
                visited = "properties" in own and (
                    (form == "string" and kind == "object") or (form == "array" and any(type(t) is str and t == "object" for t in kind))
                )
            if not visited:
                continue
            named = listed if type(listed) is list else []
            bad = bad or (
                type(node) is not dict
                or (not has and not forced and "properties" in own)
                or any(type(r) in (dict, list) for r in named)
            )
            names = {_valid(r) for r in named if type(r) is str}
            for key, x in (properties if has else movable if forced else {}).items():
                if type(x) is dict:
                    key = _valid(key)
                    step = key.replace("~", "~0").replace(".", "~1").replace("[", "~2")
                    inside.append((f"{path}.{step}", key in names, x))
        front = inside
    return nodes, bad


# Nodes of one batch, roughly.
_BATCH_NODES = 50_000


def counted_nodes(texts: DataFrame, keys: list[str], mode: str = "reference") -> DataFrame:
    """The nodes the merge counts, roots included, of schemas that have their text in ``__text``.

    Each text is walked once, batch by batch, and knows by then whether its votes can be counted: if
    not, it gives no rows, unless one of its keys is null. These are the ``voted`` nodes of
    ``schema_tree``: keys, ``path, is_required, type_form, types``.
    """
    if mode not in ("reference", "strict"):
        raise ValueError(f"unknown repair mode {mode!r}")
    exempt = frozenset(["required", *(SCHEMA_KEYWORDS if mode == "strict" else [])])
    node = T.StructType.fromDDL("path string, is_required boolean, types array<string>, type_form string, spelt string")
    kinds = [pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string(), pa.string()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unnamed = {row for c in batch.columns[:-1] if c.null_count for row, x in enumerate(c.is_null().to_pylist()) if x}
            rows, nodes = [], []

            def done() -> pa.RecordBatch:
                own = [column.take(pa.array(rows, pa.int32())) for column in batch.columns[:-1]]
                told = [pa.array(values, kind) for values, kind in zip(zip(*nodes), kinds)]
                return pa.RecordBatch.from_arrays([*own, *told], names=[*keys, *node.names])

            for row, text in enumerate(batch.columns[-1].to_pylist()):
                counted, bad = _counted(text, exempt)
                if not bad or row in unnamed:
                    nodes += counted
                    rows += [row] * len(counted)
                if len(rows) >= _BATCH_NODES:
                    yield done()
                    rows, nodes = [], []
            if rows:
                yield done()

    carried = texts.select(*[F.col(f"`{k}`") for k in keys], TEXT)
    walked = carried.mapInArrow(walk, T.StructType([*carried.schema.fields[:-1], *node.fields]))
    votes = f"case when spelt is null then types else {_LISTED_VOTES} end as types"
    own = walked.withColumn("type", parse_strict(F.col("spelt")))
    return own.selectExpr(*[f"`{k}`" for k in keys], "path", "is_required", "type_form", votes)


def _given_twice(schemas: DataFrame, keys: list[str]) -> DataFrame | None:
    """Rows whose keys more than one row has, and by chance a few others; None if there are none.

    Only the keys are read for it, and shuffled as a number each.
    """
    named = schemas.dropna(subset=keys)
    number = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    counts = named.groupBy(number.alias("__number")).agg(F.count(F.lit(1)).alias("rows"))
    twice = small_side(counts.filter("rows > 1").select("__number"))
    if twice.isEmpty():
        return None
    return named.withColumn("__number", number).join(twice, "__number", "left_semi").drop("__number")


def accepted_texts(
    schemas: DataFrame,
    keys: list[str],
    mode: str = "reference",
    levels: int = DEFAULT_LEVELS,
) -> DataFrame:
    """Schema texts that can be read, as ``__text``, for ``counted_nodes``, which leaves out those
    that are rejected. A file counts whole or not, also if it comes as several rows: only those are
    looked at beforehand."""
    several = _given_twice(schemas, keys)
    if several is not None:
        rejected = rejected_files(repair_schema_text(several), keys, mode, levels)
        schemas = schemas.join(small_side(rejected), keys, "left_anti")
    text = F.when(F.col("status") == "ok", strip_bom(F.col("text"))).otherwise(brace_slice(F.col("text")))
    readable = repair_schema_text(schemas).filter(F.col("v").isNotNull())
    return readable.withColumn(TEXT, F.make_valid_utf8(text)).drop("v")


def repair_required(
    parsed: DataFrame, mode: str = "reference", levels: int = DEFAULT_LEVELS
) -> DataFrame:
    """How often ``required`` had which form, and how often it was emptied, per dataset."""
    nodes = schema_tree(parsed, ["dataset"], mode, levels)
    return (
        nodes.filter(F.col("required_form") != "absent")
        .groupBy("dataset", "required_form")
        .agg(
            F.count(F.lit(1)).alias("nodes"),
            F.count_if(F.col("required_form") != "array").alias("emptied"),
        )
    )


def repair_misplaced_properties(
    parsed: DataFrame,
    keys: list[str],
    mode: str = "reference",
    levels: int = DEFAULT_LEVELS,
) -> DataFrame:
    """The nodes that were made objects around properties found beside their keywords."""
    return (
        schema_tree(parsed, keys, mode, levels)
        .filter("forced")
        .select(*keys, "path", "type_form", F.col("types").alias("types"))
    )


def repair_report(
    schemas: DataFrame, mode: str = "reference", levels: int = DEFAULT_LEVELS
) -> DataFrame:
    """Per dataset: files by outcome and nodes repaired; ``dataset, file, text`` comes in.

    Nodes fold into one row per file on the map side before files are counted.
    """
    parsed = repair_schema_text(schemas)
    repaired = (F.col("required_form") != "absent") & (F.col("required_form") != "array")
    # A failed file has no nodes; an empty object stands in so that it keeps a row.
    walked = schema_tree(
        parsed.withColumn("v", F.coalesce("v", F.parse_json(F.lit("{}")))),
        ["dataset", "file", "status"],
        mode,
        levels,
    )
    files = walked.groupBy("dataset", "file", "status").agg(
        F.bool_or("bad").alias("rejected"),
        F.count_if(repaired).alias("required_emptied"),
        F.count_if("forced").alias("objects_forced"),
    )
    accepted = ~F.col("rejected") & (F.col("status") != "failed")
    return files.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "sliced").alias("sliced"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if("rejected").alias("rejected"),
        F.count_if(accepted).alias("accepted"),
        F.sum("required_emptied").alias("required_emptied"),
        F.sum("objects_forced").alias("objects_forced"),
        (F.count_if(accepted) > 0).alias("has_schema"),
    )

