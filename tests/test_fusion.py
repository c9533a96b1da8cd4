"""Reading schema text, fusing schemas of parts, and inference batch by batch."""

import json
import pathlib
import random

import pytest
from helpers import documents

from shapeloom.operators import compare, fuse, incremental, infer
from shapeloom.operators.render import master_pieces, render_master, render_pieces, render_schema
from shapeloom.operators.shred import parse_documents, shred_documents
from shapeloom.plans import jobs
from shapeloom.session import fresh_dir
from shapeloom.sources import tables, versions


def table(df):
    return sorted((str(tuple(r)) for r in df.collect()))


def random_value(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([None, 1, 1.5, 1.0, True, "x", {}, []])
    if kind < 0.65:
        return {rng.choice(["a", "b.c", "d[e", "~", 'q"x']): random_value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]


def read(spark, schemas):
    """``{name: schema}`` to ``{name: {path: (types, required)}}``."""
    rows = [(k, s if isinstance(s, str) else json.dumps(s)) for k, s in schemas.items()]
    out = {}
    for r in fuse.read_paths(spark.createDataFrame(rows, "name string, schema_json string"), ["name"]).collect():
        out.setdefault(r.name, {})[r.path] = (r.types, r.required)
    return out


def test_rendered_schemas_come_back_and_parts_fuse_to_the_whole(spark):
    rng = random.Random(1)
    rows = [(f"d{i % 3}", i % 7, json.dumps(random_value(rng, rng.choice([1, 3, 5])))) for i in range(300)]
    parsed = parse_documents(spark.createDataFrame(rows, "dataset string, subset int, json string"))
    by = ["dataset", "subset"]
    parts = infer.infer_paths(shred_documents(parsed, by), by).drop("nodes")
    text = render_schema(parts, by)
    assert table(fuse.read_paths(text, by)) == table(parts)
    whole = infer.infer_paths(shred_documents(parsed, ["dataset"]), ["dataset"]).drop("nodes")
    assert table(fuse.read_paths(text, ["dataset"])) == table(whole)


def test_forms_of_schemas(spark):
    got = read(
        spark,
        {
            "plain": {"type": "object", "properties": {"a": {"type": "integer"}, "b": True, "c": 3}, "required": ["a", "zz", 5]},
            "untyped": {"properties": {"a": {"properties": {"b": {"type": ["null", "string"]}}, "required": ["b"]}}, "required": ["a"]},
            "any": {"anyOf": [{"type": ["null", "integer"]}, {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a"]}]},
            "two": {"oneOf": [{"type": "object", "properties": {"a": {"type": "integer"}, "b": {}}, "required": ["a", "b"]}, {"type": "object", "properties": {"a": {"type": "number"}}, "required": ["a"]}]},
            "items": {"type": "array", "items": [{"type": "string"}, {"type": "object", "properties": {"x.y": {"type": "null"}}, "required": "all"}]},
            "bom": "\ufeff" + '{"type": "string"}',
            "bool": "true",
            "broken": '{"type": "string"',
        },
    )
    assert got == {
        "plain": {"": (["object"], False), ".a": (["integer"], True), ".b": ([], False), ".c": ([], False)},
        "untyped": {"": ([], False), ".a": ([], True), ".a.b": (["null", "string"], True)},
        "any": {"": (["integer", "null", "object"], False), ".a": (["integer"], True)},
        "two": {"": (["object"], False), ".a": (["number"], True), ".b": ([], False)},
        "items": {"": (["array"], False), "[]": (["object", "string"], False), "[].x~1y": (["null"], False)},
        "bom": {"": (["string"], False)},
        "bool": {"": ([], False)},
    }


def test_deep_schemas_are_read_fully(spark):
    schema = {"type": "string"}
    for k in range(60):
        schema = {"type": "array", "items": schema} if k % 3 == 0 else {"type": "object", "properties": {"k": schema}, "required": ["k"]}
    got = read(spark, {"deep": schema})["deep"]
    assert len(got) == 61 and sum(required for _, required in got.values()) == 40


def test_required_counts_only_schemas_that_know_the_parent(spark):
    texts = ['{"a": {"x": 1}}', '{"a": {"x": 2, "y": 1}}', '{"a": 7}', "{}"]
    docs = spark.createDataFrame([("d", k, t) for k, t in enumerate(texts)], "dataset string, file int, json string")
    nodes = shred_documents(parse_documents(docs), ["dataset", "file"])
    schemas = render_schema(infer.infer_paths(nodes, ["dataset", "file"]), ["dataset", "file"])
    got = {r.path: (r.types, r.required) for r in fuse.read_paths(schemas, ["dataset"]).collect()}
    assert got == {"": (["object"], False), ".a": (["integer", "object"], False), ".a.x": (["integer"], True), ".a.y": (["integer"], False)}


# Known results: two collections, as merged from proposals and as inferred. Per path: type, whether
# null is allowed, and whether the merged schema requires it; the inferred one requires every path.
LISTINGS = """id integer; name string null; host_id integer; neighbourhood string; room_type string;
column_10 integer optional; minimum_nights integer; number_of_reviews integer; last_review string null;
reviews_per_month number null optional; calculated_host_listings_count integer;
availability_365 integer optional; updated_date string; city string; column_19 string optional;
coordinates object; coordinates.lon number optional; coordinates.lat number optional; column_20 string optional"""
SALES = """person object optional; person.id integer; person.name string; person.email string null;
person.age integer; person.phone string null optional; person.city string; person.state string;
person.registered_at string; product object optional; product.id integer; product.name string;
product.category string; product.price number; product.in_stock boolean; product.rating number;
product.created_at string; transaction object optional; transaction.id integer;
transaction.person_id integer; transaction.date string; transaction.status string;
transaction.payment_method string; transaction.product_id integer; transaction.quantity integer;
transaction.price number"""


def known_paths(spark, text, merged):
    rows = [("", ["object"], False)]
    for entry in text.replace("\n", " ").split(";"):
        path, kind, *marks = entry.split()
        null = ["null"] if "null" in marks else []
        rows.append((f".{path}", [kind, *null] if merged else sorted([kind, *null]), not (merged and "optional" in marks)))
    return spark.createDataFrame([("d", *r) for r in rows], "dataset string, path string, types array<string>, required boolean")


@pytest.mark.parametrize(("text", "paths", "required"), [(LISTINGS, 19, 12), (SALES, 26, 22)])
def test_known_agreements(spark, text, paths, required):
    """Schema texts of both sides, read back and compared."""
    merged = render_master(known_paths(spark, text, True), ["dataset"])
    inferred = render_schema(known_paths(spark, text, False), ["dataset"])
    assert '"required": ["' in merged.first().schema_json
    diff = compare.schema_diff(fuse.read_paths(merged, ["dataset"]), fuse.read_paths(inferred, ["dataset"]), ["dataset"])
    got = compare.schema_similarity(diff, ["dataset"]).first()
    assert (got.paths, got.shared_paths, got.same_type, got.same_required) == (paths, paths, paths, required)


def test_schema_files(spark, tmp_path):
    for side, types in (("left", ["integer", "string"]), ("right", ["number", "string"])):
        folder = tmp_path / side / "d"
        folder.mkdir(parents=True)
        for k, kind in enumerate(types):
            (folder / f"{k}.json").write_text(json.dumps({"type": "object", "properties": {"a": {"type": kind}}, "required": ["a"]}, indent=2))
        (folder / "broken.json").write_text("{")
    got = jobs.schema_file_similarity(spark, str(tmp_path / "left"), str(tmp_path / "right")).first()
    assert (got.paths, got.same_type, got.same_required) == (1, 0, 1)
    out = fresh_dir(spark, "fused")
    assert {r.path: r.types for r in jobs.fused_schemas(spark, str(tmp_path / "left"), out).collect()} == {"": ["object"], ".a": ["integer", "string"]}
    assert json.loads(spark.read.text(out, wholetext=True).first().value)["properties"] == {"a": {"type": ["integer", "string"]}}


# --- batches ------------------------------------------------------------------------------


def some_documents(spark, seed=3):
    rng = random.Random(seed)
    return documents(spark, {f"d{k}": [json.dumps(random_value(rng, 3)) for _ in range(40)] for k in range(3)})


def test_batches_count_once(spark):
    docs, state = some_documents(spark), fresh_dir(spark, "state")
    parts = [docs.filter(f"pmod(hash(doc_id), 4) = {k}") for k in range(4)]
    assert [incremental.add_batch(parts[k], state, f"b{k}") for k in (0, 1, 1, 0, 2)] == [True, True, False, False, True]
    before = table(incremental.infer_incremental(spark, state))
    assert incremental.fold_state(spark, state) == 1 == incremental.fold_state(spark, state)
    assert table(incremental.infer_incremental(spark, state)) == before
    # Known to the folded version, too.
    assert [incremental.add_batch(parts[k], state, f"b{k}") for k in (1, 3)] == [False, True]
    want = table(infer.infer_schema(docs))
    assert table(incremental.infer_incremental(spark, state)) == want
    assert incremental.fold_state(spark, state) == 2
    assert table(incremental.infer_incremental(spark, state)) == want


def test_a_state_without_batches_and_an_empty_batch(spark):
    state = fresh_dir(spark, "state")
    assert incremental.infer_incremental(spark, state).count() == 0
    assert incremental.add_batch(some_documents(spark).limit(0), state, "none")
    assert incremental.infer_incremental(spark, state).count() == 0


def test_a_batch_that_died_while_being_written_counts_when_repeated(spark, monkeypatch):
    docs, state = some_documents(spark), fresh_dir(spark, "state")

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(versions, "put_if_absent", dies)
        with pytest.raises(KeyboardInterrupt):
            incremental.add_batch(docs, state, "b")
    assert incremental.infer_incremental(spark, state).count() == 0
    assert incremental.add_batch(docs, state, "b")
    assert table(incremental.infer_incremental(spark, state)) == table(infer.infer_schema(docs))


def test_a_stream_goes_on_where_it_stopped(spark):
    docs, source, state, checkpoint = some_documents(spark), *(fresh_dir(spark, n) for n in ("source", "state", "checkpoint"))
    for part in range(3):
        docs.filter(f"pmod(hash(doc_id), 3) = {part}").select("dataset", "json").write.mode("append").parquet(source)
        stream = spark.readStream.schema("dataset string, json string").parquet(source)
        incremental.follow(stream, state, checkpoint).awaitTermination()
    assert len(versions.batches(spark, state)) == 3
    assert table(incremental.infer_incremental(spark, state)) == table(infer.infer_schema(docs))


# --- versions -----------------------------------------------------------------------------


def test_versions_are_put_once_and_never_overwritten(spark):
    root = fresh_dir(spark, "versions")
    one, two = (spark.createDataFrame([(k,)], "k int") for k in (1, 2))
    assert versions.latest_version(spark, root) == 0
    assert versions.write_version(one, root, 0) == 1
    pinned = spark.read.parquet(versions.version_path(spark, root, 1))
    with pytest.raises(versions.Conflict):
        versions.write_version(two, root, 0)
    assert versions.write_version(pinned.unionByName(two), root, 1) == 2 == versions.latest_version(spark, root)
    assert pinned.collect() == one.collect()
    assert spark.read.parquet(versions.version_path(spark, root, 2)).count() == 2
    assert not versions.put_if_absent(spark, f"{root}/versions/000000000002", "{}")


# --- pieces -------------------------------------------------------------------------------


def test_pieces_in_order_are_the_schema(spark):
    """Through files in many parts, for inferred and for merged schemas."""
    rng = random.Random(4)
    rows = [(f"d{i % 3}", i, json.dumps({"top": random_value(rng, 4), "n": 1})) for i in range(120)]
    nodes = shred_documents(parse_documents(spark.createDataFrame(rows, "dataset string, doc_id int, json string")), ["dataset"])
    paths = infer.infer_paths(nodes, ["dataset"])
    whole = table(render_schema(paths, ["dataset"]))
    for part_bytes in (40, 3_000, tables.PART_BYTES):
        path = fresh_dir(spark, "parts")
        tables.write_schemas(render_pieces(paths, ["dataset"]), path, part_bytes)
        assert table(tables.read_schemas(spark, path)) == whole
        files = [f for d in pathlib.Path(path).glob("dataset=*") for f in d.glob("part-*")]
        assert (len(files) == 3) == (part_bytes == tables.PART_BYTES)
    # The parts of a folder, one behind the other, are JSON as they are.
    text = "".join(f.read_text() for f in sorted((pathlib.Path(path) / "dataset=d1").glob("part-*")))
    assert json.loads(text) == json.loads(render_schema(paths, ["dataset"]).where("dataset = 'd1'").first().schema_json)
    merged = known_paths(spark, SALES, True)
    path = fresh_dir(spark, "parts")
    tables.write_schemas(master_pieces(merged, ["dataset"]), path, 100)
    assert table(tables.read_schemas(spark, path)) == table(render_master(merged, ["dataset"]))


def test_a_schema_too_long_for_a_cell_says_so(spark, monkeypatch):
    from shapeloom.operators import render

    monkeypatch.setattr(render, "CELL_CHARACTERS", 100)
    with pytest.raises(ValueError, match="too long for one cell"):
        render_schema(known_paths(spark, SALES, False), ["dataset"])


# --- changes ------------------------------------------------------------------------------


def paths_of(spark, entries):
    rows = [("d", path, [kind], required) for path, kind, required in entries]
    return spark.createDataFrame(rows, "dataset string, path string, types array<string>, required boolean")


def test_moved_and_renamed_parts(spark):
    address = [(".street", "string", True), (".geo", "object", False), (".geo.lat", "number", True)]
    left = [("", "object", False), (".id", "integer", True), (".home", "object", True), *((".home" + p, k, r) for p, k, r in address), (".note", "string", False), (".x", "integer", True), (".y", "integer", True), (".tags", "array", True), (".tags[]", "string", False)]
    right = [("", "object", False), (".id", "string", True), (".residence", "object", False), *((".residence" + p, k, r) for p, k, r in address), (".more", "object", True), (".more.note", "string", True), (".a", "integer", True), (".b", "integer", True), (".more.tags", "array", True), (".more.tags[]", "string", False)]
    changes = compare.schema_changes(paths_of(spark, left), paths_of(spark, right), ["dataset"])
    got = {r.path: (r.to_path, r.outcome) for r in changes.collect()}
    assert got == {
        ".id": (None, "type_differs"),
        ".home": (".residence", "renamed"), ".home.street": (".residence.street", "renamed"),
        ".home.geo": (".residence.geo", "renamed"), ".home.geo.lat": (".residence.geo.lat", "renamed"),
        ".note": (".more.note", "moved"), ".tags": (".more.tags", "moved"),
        # Two of a kind: no telling which is which.
        ".x": (None, "only_left"), ".y": (None, "only_left"), ".a": (None, "only_right"), ".b": (None, "only_right"),
        ".more": (None, "only_right"),
    }
    row = compare.change_similarity(changes, ["dataset"]).first()
    assert (row.paths, row.moved, row.renamed, row.only_left, row.only_right) == (12, 2, 4, 2, 3)
    assert row.structural_overlap == 7 / 12


def test_a_changed_part_is_not_renamed(spark):
    left = [("", "object", False), (".a", "object", True), (".a.k", "integer", True)]
    for entry in ((".b.k", "string", True), (".b.k", "integer", False), (".b.j", "integer", True)):
        right = [("", "object", False), (".b", "object", True), entry]
        got = {(r.path, r.outcome) for r in compare.schema_changes(paths_of(spark, left), paths_of(spark, right), ["dataset"]).collect()}
        assert (".a", "only_left") in got and (".b", "only_right") in got
    same = compare.schema_changes(paths_of(spark, left), paths_of(spark, left), ["dataset"])
    assert {r.outcome for r in same.collect()} == {"equal"}
