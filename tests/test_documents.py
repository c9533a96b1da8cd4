"""Parsing, the node table, complexity and inference, on hand-worked documents."""

import json
import random

from helpers import documents
from pyspark.sql import functions as F

from shapeloom.functions.json_text import brace_slice, parse_strict, with_serialized_length
from shapeloom.functions.paths import ancestors_of, decode_key, encode_key, part, stem, steps_of
from shapeloom.operators import infer, profile, propose, shred
from shapeloom.operators.render import render_schema
from shapeloom.operators.shred import parse_documents, shred_documents

DEPTH = 8


def test_strict_parse_accepts_exactly_one_value(spark):
    texts = {
        '{"a":1}': True,
        ' [1,2]\n': True,
        "7": True,
        "null": True,
        '{"a":1} junk': False,
        "{}{}": False,
        "1,2": False,
        "1],[2": False,
        "1] x": False,
        "": False,
        "  ": False,
        "﻿{}": False,
        '{"a":': False,
        "{'a':1}": False,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.ok for r in df.select("t", parse_strict(F.col("t")).isNotNull().alias("ok")).collect()}
    assert got == texts


def test_brace_slice(spark):
    cases = {"a {1} {2} b": "{1} {2}", "x } {": None, "none": None, "{\n}": "{\n}"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.s for r in df.select("t", brace_slice(F.col("t")).alias("s")).collect()}
    assert got == cases


def test_path_functions(spark):
    keys = ["a", "a.b", "x[]", "~1", "~", "", "[", "é"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    rows = df.select("k", decode_key(encode_key(F.col("k"))).alias("back")).collect()
    assert all(r.k == r.back for r in rows)
    row = spark.range(1).select(
        steps_of(F.lit(".a[][].b")).alias("s"),
        ancestors_of(F.lit(".a.b.c")).alias("up"),
        ancestors_of(F.lit(".a")).alias("none"),
        part(F.lit("./processed//d/x.json"), 1).alias("p"),
        part(F.lit("x.json"), 1).alias("short"),
        part(F.lit("/d/x.json"), 1).alias("rooted"),
        stem(F.lit("a/b.c.json")).alias("stem"),
        stem(F.lit("a/.hidden")).alias("hidden"),
    ).first()
    assert row.s == [".a", "[]", "[]", ".b"]
    assert row.up == [".a", ".a.b"] and row.none == []
    assert (row.p, row.short, row.rooted) == ("d", None, "d")
    assert (row.stem, row.hidden) == ("b.c", ".hidden")


def test_repeated_keys_last_one_wins(spark):
    docs = documents(spark, {"d": ['{"a":1,"a":"x"}']})
    nodes = shred_documents(parse_documents(docs), ["dataset"], DEPTH).collect()
    assert {(n.path, n.kind) for n in nodes} == {("", "object"), (".a", "string")}


def test_kinds(spark):
    text = json.dumps(
        {"i": 1, "big": 2**70, "f": 1.0, "e": 1e300, "s": "", "b": True, "n": None, "o": {}, "l": []}
    )
    nodes = shred_documents(parse_documents(documents(spark, {"d": [text]})), ["dataset"], DEPTH)
    assert {r.path: r.kind for r in nodes.filter("depth = 2").collect()} == {
        ".i": "integer",
        ".big": "integer",
        ".f": "number",
        ".e": "number",
        ".s": "string",
        ".b": "boolean",
        ".n": "null",
        ".o": "object",
        ".l": "array",
    }


def test_documents_of_any_depth_are_opened_fully(spark):
    """Passes of four levels give the nodes that a direct walk gives, strings with brackets too."""
    deep = {"x": 1.0, "big": 10**20}
    for k in range(40):
        deep = {"a": [deep, "[{"], "b": {}} if k % 2 else [deep, [], 1]
    texts = [json.dumps(deep), "[" * 6 + "]" * 6, '{"a":[{"b":[]}]}', '{"k":"[[[[[[[["}', '[[1,2],[[3]],"\\"[{"]', "7"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, json string")
    parsed = parse_documents(docs)
    for some in (parsed, parsed.select("doc_id", "v")):
        nodes = shred_documents(some, ["doc_id"], 4).groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"), F.count_if(F.col("kind") == "number").alias("floats")
        )
        got = {r.doc_id: (r.n, r.deepest, r.floats) for r in nodes.collect()}
        assert got == {k: _measured(json.loads(t)) for k, t in enumerate(texts)}


def test_levels_do_not_change_the_nodes(spark):
    docs = spark.createDataFrame([(1, '{"a":[{"b.c":{"d":[[1,2.0,null],{"~":[]}]}},7],"e":{}}')], "doc_id int, json string")
    parsed = parse_documents(docs)
    found = [sorted(map(str, shred_documents(parsed, ["doc_id"], levels).collect())) for levels in (2, 3, 5, 9)]
    assert all(f == found[0] for f in found) and len(found[0]) == 13


_SIGNS = ["", "a", "é", "🙂", 'q"x', "b\\s", "n\nl", "\t", "\x01", "\x1f/", "\\u0041", "\u2028", "\x7f", '\\\\"', "😀\\n", " : , "]
_WRITTEN = ['"\\u000a\\u0022\\u005C\\u001F\\u0041\\ud83d\\ude00"', '"\\u00e9\\\\u0041"', '"\\b\\f\\r\\/"']
_NUMBERS = "0 -0 1 12345678901234567890123 1.0 1.50 -0.0 0.000 0.0001 0.00012300 0.00001 1e5 1E-7 1.0e10 123456789012345.5 0.1234567890123456789 3.14159 100.00 -12.500 1e400 99999999999999999.0 1234567890123456.0 0.30000000000000004 5e-324 12345678901234.10 999999999999999.9".split()


def _text(rng, depth):
    """Random JSON text with odd blanks, escapes, numbers and now and then a repeated name."""
    if depth == 0 or rng.random() < 0.35:
        sign = json.dumps(rng.choice(_SIGNS), ensure_ascii=rng.random() < 0.5)
        return rng.choice([rng.choice(_NUMBERS), rng.choice(_NUMBERS), "true", "null", sign, sign.replace("/", "\\/"), rng.choice(_WRITTEN)])

    def blank():
        return rng.choice(["", "", " ", "\n ", "\t"])

    inside = [_text(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    if rng.random() < 0.5:
        return "[" + blank() + f"{blank()},{blank()}".join(inside) + blank() + "]"
    return "{" + blank() + ",".join(f'{blank()}"{rng.choice(["a", "b", "c:", "d,", "e}}", "f"])}"{blank()}:{blank()}{v}' for v in inside) + blank() + "}"


def test_serialized_length_is_what_python_writes(spark):
    rng = random.Random(5)
    texts = [_text(rng, rng.choice([0, 1, 2, 4])) for _ in range(1500)]
    docs = parse_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id int, json string"))
    got = {r.doc_id: r.n for r in with_serialized_length(docs, "n", F.col("json"), F.col("v")).collect()}
    assert got == {k: len(json.dumps(json.loads(t), ensure_ascii=False)) for k, t in enumerate(texts)}


def _measured(value, depth=1):
    """Nodes, deepest level, floats."""
    inside = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    below = [_measured(v, depth + 1) for v in inside]
    return 1 + sum(b[0] for b in below), max([depth, *(b[1] for b in below)]), isinstance(value, float) + sum(b[2] for b in below)


def _walk(value, depth=1):
    """Nodes of a value as (depth, is_member, is_item, is_array), by brute force."""
    kids = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    yield depth, isinstance(value, list), len(value) if isinstance(value, (dict, list)) else 0, isinstance(value, dict)
    for kid in kids:
        yield from _walk(kid, depth + 1)


COMPLEX = [
    "{}",
    "7",
    '{"a":1}',
    '{"a":[{"b":1}]}',
    "[[],[1,2]]",
    '{"a":1.50,"b":"\\u00e9\\n\\"","c":1e5}',
    '{"s":"' + "x" * 30_000 + '"}',
    json.dumps({f"k{i}": i for i in range(101)}),
    json.dumps({f"k{i}": i for i in range(100)}),
    '{"a":{"b":{"c":{}}}}',
]


def test_complexity_matches_brute_force(spark):
    docs = documents(spark, {"d": COMPLEX + ["broken {", "﻿{}"]})
    got = {
        r.doc_id: r
        for r in profile.classify_complexity(
            profile.document_complexity(docs, ["doc_id"], levels=DEPTH)
        ).collect()
    }
    assert len(got) == len(COMPLEX)
    for i, text in enumerate(COMPLEX):
        value = json.loads(text)
        nodes = list(_walk(value))
        row = got[f"d{i}"]
        size = len(json.dumps(value, ensure_ascii=False))
        assert row.depth == max(n[0] for n in nodes)
        assert row["keys"] == sum(n[2] for n in nodes if n[3])
        assert row.arrays == sum(n[1] for n in nodes)
        assert row.array_len == sum(n[2] for n in nodes if n[1])
        assert row.size_bytes == size
        high = row.depth > 3 or row["keys"] > 100 or size > 30_000
        assert row.complexity == ("high" if high else "low")


def test_manifest_rows(spark):
    docs = spark.createDataFrame(
        [("processed/shop/documents/document_1.json", '{"a":1}'), ("processed/shop/x/y.json", "oops")],
        "file string, json string",
    )
    rows = profile.build_manifest(docs, DEPTH).collect()
    assert [r.asDict() for r in rows] == [
        {
            "file": "processed/shop/documents/document_1.json",
            "object_type": "documents",
            "complexity": "low",
            "keys": 1,
            "depth": 2,
            "arrays": 0,
            "array_len": 0,
            "size_bytes": 8,
            "schema_generated": "False",
        }
    ]


SCHEMA_CASES = {
    "widened": (['{"a":1}', '{"a":2.5}'], {"a": {"type": "number"}}, ["a"]),
    "float": (['{"a":1.0}'], {"a": {"type": "number"}}, ["a"]),
    "union": (['{"a":1}', '{"a":"x"}'], {"a": {"type": ["integer", "string"]}}, ["a"]),
    "any": (
        ['{"a":null}', '{"a":{"b":1}}'],
        {
            "a": {
                "anyOf": [
                    {"type": "null"},
                    {"type": "object", "properties": {"b": {"type": "integer"}}, "required": ["b"]},
                ]
            }
        },
        ["a"],
    ),
    "empty_list": (['{"a":[]}'], {"a": {"type": "array"}}, ["a"]),
    "list": (
        ['{"a":[1,"x"]}'],
        {"a": {"type": "array", "items": {"type": ["integer", "string"]}}},
        ["a"],
    ),
    "optional": (['{"a":1,"b":1}', '{"a":1}'], {"a": {"type": "integer"}, "b": {"type": "integer"}}, ["a"]),
    "none": (['{"a":1}', "{}"], {"a": {"type": "integer"}}, None),
    "rows": (
        ['{"l":[{"x":1},{"x":2,"y":3}]}'],
        {
            "l": {
                "type": "array",
                "items": {
                    "type": "object",
                    "properties": {"x": {"type": "integer"}, "y": {"type": "integer"}},
                    "required": ["x"],
                },
            }
        },
        ["l"],
    ),
    "odd_keys": (
        ['{"a.b":{"[]":1,"q\\"\\\\":"\\u001e, "}}'],
        {
            "a.b": {
                "type": "object",
                "properties": {"[]": {"type": "integer"}, 'q"\\': {"type": "string"}},
                "required": ["[]", 'q"\\'],
            }
        },
        ["a.b"],
    ),
}


def test_inferred_schemas(spark):
    docs = documents(spark, {name: case[0] for name, case in SCHEMA_CASES.items()})
    nodes = shred_documents(parse_documents(docs), ["dataset"], DEPTH)
    got = render_schema(infer.infer_paths(nodes, ["dataset"]), ["dataset"]).collect()
    assert len(got) == len(SCHEMA_CASES)
    for row in got:
        _, properties, required = SCHEMA_CASES[row.dataset]
        expect = {"$schema": "http://json-schema.org/schema#", "type": "object", "properties": properties}
        if required:
            expect["required"] = required
        assert json.loads(row.schema_json) == expect, row.dataset


def test_schema_of_a_root_that_is_anything(spark):
    docs = documents(spark, {"d": ["[1,[2]]", "7", '{"a":1}']})
    nodes = shred_documents(parse_documents(docs), ["dataset"], DEPTH)
    text = render_schema(infer.infer_paths(nodes, ["dataset"]), ["dataset"], uri=None).first()
    assert json.loads(text.schema_json) == {
        "anyOf": [
            {"type": "integer"},
            {
                "type": "array",
                "items": {
                    "anyOf": [{"type": "integer"}, {"type": "array", "items": {"type": "integer"}}]
                },
            },
            {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a"]},
        ]
    }


def test_single_documents_agree_with_collections_of_one(spark):
    texts = [t for case in SCHEMA_CASES.values() for t in case[0]]
    docs = documents(spark, {f"s{i:02}": [t] for i, t in enumerate(texts)})
    nodes = shred_documents(parse_documents(docs), ["dataset"], DEPTH)
    one = render_schema(infer.infer_paths(nodes, ["dataset"]), ["dataset"]).collect()
    other = render_schema(infer.infer_document_paths(nodes, ["dataset"]), ["dataset"]).collect()
    assert {r.dataset: json.loads(r.schema_json) for r in one} == {
        r.dataset: json.loads(r.schema_json) for r in other
    }


def test_path_table_does_not_depend_on_order_or_partitions(spark):
    docs = documents(spark, {name: case[0] for name, case in SCHEMA_CASES.items()})
    tables = [
        {
            tuple(r)
            for r in infer.infer_paths(
                shred_documents(parse_documents(d), ["dataset"], DEPTH), ["dataset"]
            )
            .withColumn("types", F.array_join("types", "|"))
            .collect()
        }
        for d in (docs.coalesce(1), docs.orderBy(F.desc("json")).repartition(7))
    ]
    assert tables[0] == tables[1]


def test_byte_order_mark_and_approval(spark):
    docs = spark.createDataFrame(
        [("d", "a", "\ufeff" + '{"x":1}'), ("d", "b", '{"y":1}'), ("d", "c", "broken")],
        "dataset string, file string, json string",
    )
    approved = spark.createDataFrame([("a",), ("c",)], "file string")
    paths = infer.infer_schema(docs, approved, DEPTH).collect()
    assert {(r.path, r.required) for r in paths} == {("", False), (".x", True)}


def test_large_floats_are_numbers(spark):
    cases = {
        "12345678901234567890.0": "number", "12345678901234567890": "integer", "1234567890123456789.00": "number",
        "-9999999999999999999.0": "number", "1234567890123456789012345": "integer", "12345678901234567890.05": "number",
        "12345678901234567890.0e2": "number", "1.0": "number", "1234567890123456789": "integer",
        '"12345678901234567890.0"': "string",
    }
    rows = [(text, f'{{"12345678901234567890.0 \\" 1": {text}}}') for text in cases]
    docs = parse_documents(spark.createDataFrame(rows, "id string, json string"))
    nodes = shred_documents(docs, ["id"], 3).filter("depth = 2").collect()
    assert {r.id: r.kind for r in nodes} == cases
    assert {r.path for r in nodes} == {'.12345678901234567890~10 " 1'}


def test_both_ways_to_the_nodes_agree(spark):
    """Documents that carry their text are walked in it: the same nodes as those of the value."""
    odd = ['null', '{"a.b~[":{"":[{}]},"é\\ud83d\\ude00":-0}', '[1e5,1.0,12345678901234567890.0,-99999999999999999999]', '{"a":1,"a":[true]}', ' {"x" : [ ] } ', '{"\\ud800":1}', "1" * 38, "1" * 39]
    rng = random.Random(8)
    texts = odd + [_text(rng, 4) for _ in range(200)]
    parsed = parse_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id int, json string"))
    by_text, by_value = (shred_documents(some, ["doc_id"]) for some in (parsed, parsed.drop(shred.TEXT)))
    assert "MapInArrow" in by_text._jdf.queryExecution().toString()
    found = [sorted(map(str, nodes.collect())) for nodes in (by_text, by_value)]
    assert found[0] == found[1]
    counted = profile.document_complexity(parsed.select("doc_id", "json"), ["doc_id"])
    assert "Generate variant_explode" not in counted._jdf.queryExecution().toString()
    item = F.endswith("path", F.lit("[]"))
    told = by_value.groupBy("doc_id").agg(
        F.count_if((F.col("depth") > 1) & ~item).alias("keys"), F.max("depth").alias("depth"),
        F.count_if(F.col("kind") == "array").alias("arrays"), F.count_if(item).alias("array_len"),
    )
    assert sorted(counted.drop("size_bytes").collect()) == sorted(told.collect())


def test_path_tables_of_documents_take_tasks_by_text(spark, monkeypatch):
    monkeypatch.setattr(infer, "TASK_CHARACTERS", 100)
    docs = spark.createDataFrame([(k, '{"a":[1,{"b":"%d"}]}' % k) for k in range(100)], "file int, json string")
    tasks = infer.document_tasks(docs)
    assert tasks == 20  # 1,990 characters
    nodes = shred_documents(parse_documents(docs), ["file"])
    tables = infer.infer_document_paths(nodes, ["file"], tasks)
    assert tables.rdd.getNumPartitions() == 20
    plain = infer.infer_document_paths(nodes, ["file"])
    assert sorted(map(str, tables.collect())) == sorted(map(str, plain.collect()))
    assert propose.propose_offline(docs, ["file"]).rdd.getNumPartitions() == 20
