"""Repair and vote: hand-worked cases, and random schemas against a direct computation."""

import json
import random
from collections import Counter

from helpers import schemas
from pyspark.sql import functions as F

from shapeloom import session
from shapeloom.operators import repair, vote
from shapeloom.operators.render import render_master

DEPTH = 7


def with_p(node):
    return json.dumps({"type": "object", "properties": {"p": node}})


INNER = {"type": "object", "properties": {"c": {"type": "string"}}}

# dataset: proposals, type of ``p`` in the master schema
VOTES = {
    "m1": ([with_p({"type": "string"})] * 3 + [with_p({"type": "integer"})], "string"),
    "m2": ([with_p({"type": "string"})] * 2 + [with_p({"type": "integer"})], ["integer", "string"]),
    "m3": (
        [with_p({"type": "string"})] * 2 + [with_p({"type": "integer"}), with_p({"type": ["null"]})],
        ["integer", "null", "string"],
    ),
    "m4": ([with_p({"type": ["string", "null"]})], ["string", "null"]),
    "m5": ([with_p({"type": None})], "null"),
    "m6": ([with_p({})], "null"),
    "m7": ([with_p({"type": {}})], "null"),
    "m8": ([with_p({**INNER, "type": ["object", "null"]})], "object"),
    "m9": ([with_p(INNER), with_p({"type": "array"})], "object"),
    "m10": ([with_p({"type": "array"})] * 3 + [with_p(INNER)], "array"),
    "m13": ([with_p({"type": ["string", "string"]}), with_p({"type": "integer"})], ["integer", "string"]),
    "m14": ([with_p({"type": [None, "string"]})], "string"),
    "m15": ([with_p({"type": "integer"}), with_p({"type": "number"})], ["integer", "number"]),
    "odd": ([with_p({"type": [True, 1]})], ["1", "True"]),
}


def masters(spark, cases, **options):
    merged = vote.merge_schemas(schemas(spark, cases), levels=DEPTH, **options)
    return {
        r.dataset: json.loads(r.schema_json) for r in render_master(merged, ["dataset"]).collect()
    }


def test_votes(spark):
    got = masters(spark, {name: case[0] for name, case in VOTES.items()})
    assert {n: s["properties"]["p"]["type"] for n, s in got.items()} == {
        n: case[1] for n, case in VOTES.items()
    }
    assert got["m9"]["properties"]["p"]["properties"] == {"c": {"type": "string"}}
    assert "properties" not in got["m10"]["properties"]["p"]


def test_required_share_is_of_the_schemas_that_have_the_member(spark):
    yes = json.dumps({"properties": {"p": {"type": "string"}}, "required": ["p"]})
    no = with_p({"type": "string"})
    rare = json.dumps({"properties": {"q": {"type": "string"}}, "required": ["q"]})
    got = masters(spark, {"at": [yes] * 3 + [no] * 2, "below": [yes] * 2 + [no] * 2, "rare": [no] * 99 + [rare]})
    assert got["at"]["required"] == ["p"]
    assert "required" not in got["below"]
    assert got["rare"]["required"] == ["q"]


REPAIRS = {
    "r1": ({"type": "object", "properties": {"a": {"type": "string"}}, "required": True}, {"a": "string"}),
    "r2": ({"type": "object", "a": {"type": "string"}, "b": {"enum": [1]}}, {"a": "string"}),
    "r4": ({"type": "object", "properties": [1], "a": {"type": "string"}}, {"a": "string"}),
    "r5": ({"properties": {"p": {"type": "array", "items": {"type": "string"}}}}, {"p": "array"}),
    "r7": ({"properties": {"a": {"type": "string"}}, "stray": {"type": "string"}}, {"a": "string"}),
    "r8": ({"name": {"type": "string"}}, {}),
    "root_type": ({"title": "t", "type": {"type": "string"}}, {"type": "string"}),
    "r10": ({"properties": {"p": {"title": "t", "type": {"type": "string"}}}}, {"p": "null"}),
    "bool": ({"properties": {"p": True, "q": {"type": "string"}}}, {"q": "string"}),
    "required_dict": ({"type": "object", "required": {"type": "x"}, "a": {"type": "string"}}, {"a": "string"}),
}


def test_structure_repairs(spark):
    got = masters(spark, {name: [json.dumps(case[0])] for name, case in REPAIRS.items()})
    assert {n: {k: v["type"] for k, v in s["properties"].items()} for n, s in got.items()} == {
        n: case[1] for n, case in REPAIRS.items()
    }


def test_keywords_become_properties_unless_strict(spark):
    cases = {
        "items": [with_p({"type": "array", "description": "d", "items": {"type": "string"}})],
        "more": [with_p({"type": "object", "additionalProperties": {"type": "integer"}})],
    }
    loose, strict = masters(spark, cases), masters(spark, cases, mode="strict")
    assert loose["items"]["properties"]["p"]["properties"] == {"items": {"type": "string"}}
    assert loose["more"]["properties"]["p"]["properties"] == {"additionalProperties": {"type": "integer"}}
    assert strict["items"]["properties"]["p"] == {"type": "array"}
    assert strict["more"]["properties"]["p"] == {"type": "object"}


TEXTS = {
    '﻿{"properties":{"a":{"type":"string"}}}': "ok",
    'here: {"properties":{"a":{"type":"integer"}}} end': "sliced",
    '{"a":1} junk': "sliced",
    "{}{}": "failed",
    "no json": "failed",
    '{"a":1': "failed",
    "x } {": "failed",
    '{"a": 1 // note\n}': "failed",
    '[{"a":1}]': "ok",
}


def test_text_repair(spark):
    parsed = repair.repair_schema_text(schemas(spark, {"t": list(TEXTS)}))
    assert {r.text: r.status for r in parsed.collect()} == TEXTS


def test_report_counts_files_and_rejects_whole_ones(spark):
    good = with_p({"type": "string"})
    cases = {
        "t": list(TEXTS),
        "bad": [json.dumps({"type": "object", "properties": [1]}), json.dumps({"properties": None})],
        "mixed": [good, json.dumps({"properties": {"p": {"type": "string"}}, "required": [["p"]]})],
        "deep": [with_p({"type": "object", "properties": 3, "required": "no"}), good],
    }
    report = {r.dataset: r for r in repair.repair_report(schemas(spark, cases), levels=DEPTH).collect()}
    assert [report["t"][c] for c in ("files", "ok", "sliced", "failed", "rejected", "accepted")] == [9, 2, 2, 5, 1, 3]
    assert (report["bad"].rejected, report["bad"].has_schema) == (2, False)
    assert (report["mixed"].rejected, report["mixed"].accepted) == (1, 1)
    assert (report["deep"].rejected, report["deep"].required_emptied) == (1, 1)
    got = masters(spark, cases)
    assert "bad" not in got
    assert got["mixed"] == {"type": "object", "properties": {"p": {"type": "string"}}}


# --- random schemas against a direct computation --------------------------------------------


def random_node(rng, depth=0):
    names = ["a", "b", "items", "type", "title"]
    node = {}
    kind = rng.choice(["object", "object", "string", "integer", ["object", "null"], None, {}, 5, "absent"])
    if kind != "absent":
        node["type"] = kind
    if depth < 3:
        if rng.random() < 0.6:
            node["properties"] = rng.choice(
                [{n: random_node(rng, depth + 1) for n in rng.sample(names, 2)}] * 8 + [[1], None]
            )
        if rng.random() < 0.3:
            node[rng.choice(names)] = random_node(rng, depth + 1)
    if rng.random() < 0.4:
        node["required"] = rng.choice([["a"], ["a", "b"], True, None, ["type", 3], [{"x": 1}], []])
    if rng.random() < 0.2:
        node["description"] = "d"
    return node


WORDS = {"title", "description", "default", "pattern", "format", "minimum", "maximum", "minLength", "maxLength"}


class Rejected(Exception):
    pass


def votes_of(node, path=""):
    """Counted properties of one schema: (path, types, is_required)."""
    kept, forced_types = node.get("properties"), None
    if not isinstance(kept, dict):
        moved = {k: v for k, v in node.items() if k != "required" and isinstance(v, dict) and "type" in v}
        marked = node.get("type") == "object" or WORDS & (node.keys() - moved.keys())
        if moved and marked:
            kept = moved
            forced_types = ["null"] if "type" in moved else ["object"]
    if path:
        kind = node.get("type")
        if forced_types:
            types = forced_types
        elif kind is None:
            types = ["null"]
        elif isinstance(kind, str):
            types = [kind]
        elif isinstance(kind, list):
            types = [t for t in kind if t is not None]
        else:
            types = []
        yield "own", types
        if "object" not in types or (kept is None and "properties" not in node):
            return
    if not isinstance(kept, dict):
        if "properties" in node:
            raise Rejected
        kept = {}
    listed = node.get("required")
    listed = listed if isinstance(listed, list) else []
    if any(isinstance(r, (dict, list)) for r in listed):
        raise Rejected
    for key, child in kept.items():
        if isinstance(child, dict):
            inner = list(votes_of(child, f"{path}.{key}"))
            yield f"{path}.{key}", inner[0][1], key in listed
            yield from inner[1:]


def expected(files):
    seen, required, types = Counter(), Counter(), {}
    for schema in files:
        try:
            rows = list(votes_of(schema))
        except Rejected:
            continue
        for path, voted, is_required in rows:
            seen[path] += 1
            required[path] += is_required
            types.setdefault(path, Counter()).update(voted)
    resolved = {}
    for path in seen:
        named = {t: n for t, n in types[path].items() if t != "null"}
        total = sum(named.values())
        winners = [t for t, n in named.items() if n / total >= 0.75] or sorted(named)
        if not winners:
            final = ["null"]
        elif "null" not in types[path]:
            final = winners
        else:
            final = sorted([*winners, "null"]) if len(winners) > 1 else [*winners, "null"]
        resolved[path] = final
    kept = {
        p
        for p in seen
        if all(
            any("object" in t for t in resolved[p[:i]]) for i in range(1, len(p)) if p[i] == "."
        )
    }
    return {
        p: (
            ["object"] if any(q.startswith(p + ".") for q in kept) else resolved[p],
            required[p] / seen[p] >= 0.6,
        )
        for p in kept
    }


def test_random_schemas_match_a_direct_computation(spark):
    rng = random.Random(7)
    files = {f"d{i}": [random_node(rng) for _ in range(rng.choice([1, 3, 12]))] for i in range(60)}
    merged = vote.merge_schemas(
        schemas(spark, {d: [json.dumps(s) for s in nodes] for d, nodes in files.items()}), levels=DEPTH
    )
    got = {}
    for r in merged.filter(F.col("path") != "").collect():
        got.setdefault(r.dataset, {})[r.path] = (r.types, r.required)
    want = {d: expected(nodes) for d, nodes in files.items()}
    assert got == {d: paths for d, paths in want.items() if paths}


def test_schemas_of_any_depth_are_walked_fully(spark):
    """Passes of three levels count every property; a bad node far down rejects its file."""
    good, bad = {"type": "string"}, {"type": "object", "properties": 3}
    for _ in range(20):
        good, bad = ({"type": "object", "required": ["k"], "properties": {"k": inner}} for inner in (good, bad))
    cases = schemas(spark, {"deep": [json.dumps(good), json.dumps(bad)], "flat": [json.dumps(INNER)]})
    nodes = vote.schema_nodes(cases, levels=3)
    got = sorted((r.dataset, r.path, r.is_required, tuple(r.types)) for r in nodes.collect())
    deep = [("deep", ".k" * k, True, ("object" if k < 20 else "string",)) for k in range(1, 21)]
    assert got == sorted([*deep, ("flat", ".c", False, ("string",))])


# Values of ``type`` that the engine has to spell, keep out or cut to a form, as JSON text.
ODD_TYPES = """null 5 -0 1.0 1.50 12345678901234567890 12345678901234567890.0 1e400 true {} {"type":1} [] [null] [null,"object"]
["object",{"a":1}] [["object"]] [1,2.50,"x",true,false,1e3,-0,100.0] [12345678901234567890.0,0.12345678901234567890123456]
[{"b":[1.0,{"z":null,"a":"\\u00e9\\ud800"}],"a":[]},[]] "\\ud800" "\\u00e9" ["\\ud83d\\ude00","\\udc00"] "object" ["object","null"]
"string" ["\\u006fbject"] "Object" 123456789012345678901234567890123456789""".split()


def odd_schema(rng, depth=0):
    """A schema as text, with repeated and strange names, and anything where something is expected."""
    names = ["a", "b.c", "d[", "~", "", "é", "\\ud800", "items", "type", "title", "default", "required", "properties"]
    parts = []
    if rng.random() < 0.8:
        parts.append('"type":' + rng.choice([*ODD_TYPES, *['"object"'] * 25]))
    if depth < 4:
        if rng.random() < 0.7:
            members = [f'"{n}":{odd_schema(rng, depth + 1)}' for n in rng.choices(names, k=rng.choice([0, 1, 2, 4]))]
            parts.append('"properties":' + rng.choice(["{" + ", ".join(members) + "}"] * 40 + ["[1]", "null", "3", '{"~":"x"}', '"\\u007b"']))
        parts += [f'"{n}":{odd_schema(rng, depth + 1)}' for n in rng.choices(names, k=rng.choice([0, 0, 1, 2]))]
    if rng.random() < 0.5:
        lists = ['["a","?","\\ud800"]', '["b.c",3,null]', "true", "null", "[]", '"a"', '["~",""]', '["é","type","items"]']
        parts.append('"required":' + rng.choice(lists * 8 + ['[{"x":1}]', '["a",["b"]]', '{"a":[[]]}']))
    if rng.random() < 0.2:
        parts.append('"description":' + rng.choice(['"d"', "null", '{"type":"x"}']))
    rng.shuffle(parts)
    return rng.choice(["{}", "{}", "[{}]", "3", "true"]) if depth and rng.random() < 0.1 else "{" + ",".join(parts) + "}"


def odd_files(spark, n):
    """Files with keys that are null or come several times, some of them unreadable."""
    rng = random.Random(11)
    around = ["{}"] * 9 + ["Here: {} .", "﻿{}", "[{}]", "{}}}", '"{}']
    rows = [
        (rng.choice(["x", "y", None]), rng.choice([f"f{i}", f"f{i}", f"f{i % 50}", None]), rng.choice(around).replace("{}", odd_schema(rng)))
        for i in range(n)
    ]
    return spark.createDataFrame([*rows, ("x", "none", None), ("x", "null", "null"), (None, "list", "[1]")], "dataset string, file string, text string")


def test_counted_nodes_are_the_voted_ones_of_the_tree(spark):
    files, keys = odd_files(spark, 1500).cache(), ["dataset", "file"]
    parsed = repair.repair_schema_text(files)
    for mode in ("reference", "strict"):
        rejected = repair.rejected_files(parsed, keys, mode)
        tree = repair.schema_tree(parsed, keys, mode).filter("voted").join(rejected, keys, "left_anti")
        nodes = vote.schema_nodes(files, mode, with_root=True)
        want, got = (sorted(map(str, x.select(nodes.columns).collect())) for x in (tree, nodes))
        assert len(got) > 1500 and rejected.count() > 50
        assert got == want


def test_files_are_read_once_and_not_shuffled_however_many_are_rejected(spark, monkeypatch):
    monkeypatch.setattr(session, "SMALL_SIDE_ROWS", 2)
    good, bad = with_p({"type": "string"}), json.dumps({"type": "object", "properties": [1]})
    texts, read = schemas(spark, {"d": [good, bad] * 20}), spark.sparkContext.accumulator(0)

    def seen(text: str) -> str:
        read.add(1)
        return text

    nodes = vote.schema_nodes(texts.withColumn("text", F.udf(seen)("text")))
    assert "Exchange" not in nodes._jdf.queryExecution().executedPlan().toString()
    assert [r.path for r in nodes.collect()] == [".p"] * 20
    assert read.value == 40


def test_a_rejected_file_takes_its_other_rows_along(spark):
    good, bad = with_p({"type": "string"}), json.dumps({"type": "object", "properties": [1]})
    rows = [("d", "1", good), ("d", "1", bad), ("d", "2", good), ("d", "2", good), ("d", None, good), ("d", None, bad), ("d", "3", bad)]
    nodes = vote.schema_nodes(spark.createDataFrame(rows, "dataset string, file string, text string"))
    assert sorted((r.file or "", r.path) for r in nodes.collect()) == [("", ".p"), ("2", ".p"), ("2", ".p")]
