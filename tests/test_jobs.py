"""From raw files to both schemas and their comparison."""

import json

from pyspark.sql import functions as F

from shapeloom.plans import jobs
from shapeloom.session import cut, fresh_dir
from shapeloom.sources import tables, versions


def test_from_files_to_schemas(spark, tmp_path):
    shop = [{"id": i, "item": {"name": f"n{i}", "price": i + 0.5}, "tags": {"deep": {"x": 1}}} for i in range(40)]
    (tmp_path / "shop.json").write_text(json.dumps(shop))
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps({"n": i}) for i in range(30)) + "\n")
    (tmp_path / "odd.json").write_text("hello")
    documents, manifest = fresh_dir(spark, "documents"), fresh_dir(spark, "manifest")
    target = 1000
    outcomes = jobs.prepare_documents(spark, str(tmp_path), documents, target)
    assert {r.dataset: r.format for r in outcomes.collect()} == {"shop": "array", "log": "lines", "odd": "unknown"}
    size = (tmp_path / "shop.json").stat().st_size
    kept = shop[:: round(size / target)]
    docs = {(r.dataset, r.doc_id): json.loads(r.json) for r in tables.read_documents(spark, documents).collect()}
    assert {k: v for k, v in docs.items() if k[0] == "shop"} == {
        ("shop", f"document_{i + 1}"): d for i, d in enumerate(kept)
    }
    assert len([k for k in docs if k[0] == "log"]) == 30

    jobs.profile_documents(spark, documents, manifest, 6)
    rows = tables.scan_manifest(spark, manifest).collect()
    assert {(r.file.split("/")[1], r.complexity) for r in rows} == {("shop", "high"), ("log", "low")}

    def make():
        answer = json.dumps(
            {"type": "object", "properties": {"id": {"type": "integer"}, "item": {"type": "object"}}, "required": ["id"]}
        )
        return lambda prompts: [f"Here: {answer} end" for _ in prompts]

    answers, log = fresh_dir(spark, "answers"), fresh_dir(spark, "log")
    jobs.propose_for_pending(spark, manifest, documents, make, "large", answers, log)
    assert {r.status for r in tables.read_run_log(spark, log).collect()} == {"success"}
    flags = {r.file.split("/")[1]: r.schema_generated for r in tables.scan_manifest(spark, manifest).collect()}
    assert flags == {"shop": "true", "log": "False"}

    # As after a run that stored answers and then failed: nothing is asked or stored again.
    listed = cut(tables.scan_manifest(spark, manifest).withColumn("schema_generated", F.lit("False")))
    tables.write_manifest(listed, manifest)
    jobs.propose_for_pending(spark, manifest, documents, make, "large", answers, log)
    assert {r["count"] for r in spark.read.parquet(answers).groupBy("file").count().collect()} == {1}
    again = {r.file.split("/")[1]: r.schema_generated for r in tables.scan_manifest(spark, manifest).collect()}
    assert again["shop"] == "true"

    left = jobs.master_schemas(spark, spark.read.parquet(answers), fresh_dir(spark, "masters"), levels=6)
    right = jobs.traditional_schemas(spark, manifest, documents, fresh_dir(spark, "traditional"), 6)
    row = jobs.similarity(left, right).first()
    assert (row.dataset, row.paths, row.shared_paths, row.same_type, row.same_required) == ("shop", 7, 2, 2, 1)


def test_files_of_one_stem_are_numbered_on(spark, tmp_path):
    (tmp_path / "x.json").write_text(" " * 120 + '[{"a":1},{"a":2}]')
    (tmp_path / "x.jsonl").write_text('{"b":1}\n\n{"b":2}\n')
    (tmp_path / "README").write_text('{"no":"data"}\n')
    (tmp_path / "bad.jsonl").write_text('{"c":1}\n{"c":\n')
    (tmp_path / "blank.json").write_text(" \n")
    (tmp_path / "comma.json").write_text(" ,[1]")
    documents = fresh_dir(spark, "documents")
    outcomes = jobs.prepare_documents(spark, str(tmp_path), documents).collect()
    assert {(r.file.rsplit("/", 1)[1], r.format, r.documents) for r in outcomes} == {
        ("x.json", "array", 2), ("x.jsonl", "lines", 2), ("bad.jsonl", "lines", 0),
        ("blank.json", "empty", 0), ("comma.json", "unknown", 0),
    }
    got = sorted((r.dataset, r.doc_id, r.json) for r in tables.read_documents(spark, documents).collect())
    texts = ['{"a":1}', '{"a":2}', '{"b":1}', '{"b":2}']
    assert got == [("x", f"document_{i + 1}", text) for i, text in enumerate(texts)]


def test_each_file_is_sampled_by_its_own_size(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"a": i} for i in range(50)]))
    (tmp_path / "x.jsonl").write_text("".join(f'{{"b":{i}}}\n' for i in range(90)))
    sizes = {n: (tmp_path / n).stat().st_size for n in ("x.json", "x.jsonl")}
    documents, target = fresh_dir(spark, "documents"), 200
    jobs.prepare_documents(spark, str(tmp_path), documents, target)
    want = [{"a": i} for i in range(0, 50, round(sizes["x.json"] / target))]
    want += [{"b": i} for i in range(0, 90, round(sizes["x.jsonl"] / target))]
    got = {r.doc_id: json.loads(r.json) for r in tables.read_documents(spark, documents).collect()}
    assert got == {f"document_{i + 1}": d for i, d in enumerate(want)}


def test_raw_files_pair_with_their_schemas(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('{"x":1}\n{"x":2}\n')
    (tmp_path / "sub" / "a.json").write_text('[{"y":true}]')
    (tmp_path / "a.jsonl").write_text('{"z":1}\n')
    (tmp_path / "b.json").write_text("oops")
    out = fresh_dir(spark, "file_schemas")
    pairs = {r.json_path: r for r in jobs.raw_file_schemas(spark, str(tmp_path), out, 4).collect()}
    top, below, bad = (str(tmp_path / n) for n in ("a.json", "sub/a.json", "b.json"))
    assert {k: r.outcome for k, r in pairs.items()} == {top: "lines", below: "lines", bad: "unparsable"}
    assert pairs[bad].schema_path is None

    def schema(name):
        files = spark.read.text(pairs[name].schema_path, wholetext=True).collect()
        return [json.loads(r.value) for r in files]

    assert [list(s["properties"]) for s in schema(top)] == [["x"]]
    assert [list(s["items"]["properties"]) for s in schema(below)] == [["y"]]
    assert pairs[top].schema_path.endswith("/schema=a.schema.json")

    # What is there already is left alone, and stays.
    (tmp_path / "c.json").write_text('{"w":null}')
    done = spark.createDataFrame([(top,), (below,)], "file string")
    again = jobs.raw_file_schemas(spark, str(tmp_path), out, 4, done).collect()
    assert {r.json_path for r in again} == {bad, str(tmp_path / "c.json")}
    assert [list(s["properties"]) for s in schema(top)] == [["x"]]


def test_a_run_that_dies_and_is_repeated_counts_once(spark, tmp_path, monkeypatch):
    """Killed before and after each thing it puts in place; the generator is asked once per document."""
    asked = tmp_path / "asked"
    documents = fresh_dir(spark, "documents")
    docs = spark.createDataFrame([("d", f"document_{i}", json.dumps({"a": i})) for i in range(6)], "dataset string, doc_id string, json string")
    tables.write_documents(docs, documents)
    rows = [(f"processed/d/documents/document_{i}.json", "documents", "low" if i == 5 else "high", "1", "2", "0", "0", "9", "False") for i in range(6)]
    manifest = spark.createDataFrame([*rows, ("loose.json", "", "high", "1", "2", "0", "0", "9", "False")], ", ".join(f"{c} string" for c in tables.MANIFEST_COLUMNS))
    place = str(asked)

    def make():
        def generate(prompts):
            with open(place, "a") as file:
                file.write("".join(f"{p.split()[-2]}\n" for p in prompts))
            return [ValueError("odd") if '"a": 3' in p else '{"type": "object"}' for p in prompts]

        return generate

    put = versions.put_if_absent
    for dies_at in range(7):
        root, answers, log = (fresh_dir(spark, n) for n in ("manifest", "answers", "log"))
        assert versions.write_manifest_version(manifest, root, 0) == 1
        asked.write_text("")
        calls = [0]

        def dying(*args, calls=calls, dies_at=dies_at):
            calls[0] += 1
            if calls[0] == dies_at // 2 + 1 and dies_at % 2 == 0 and dies_at < 6:
                raise KeyboardInterrupt  # before it is in place
            done = put(*args)
            if calls[0] == dies_at // 2 + 1 and dies_at < 6:
                raise KeyboardInterrupt  # right behind
            return done

        with monkeypatch.context() as patch:
            patch.setattr(versions, "put_if_absent", dying)
            try:
                jobs.propose_once(spark, root, documents, make, "m", answers, log)
            except KeyboardInterrupt:
                assert versions.latest_version(spark, root) == (2 if dies_at == 5 else 1)
        if versions.latest_version(spark, root) == 1:
            assert jobs.propose_once(spark, root, documents, make, "m", answers, log) == 2
        counts = {r.original_file: r["count"] for r in jobs.stored_log(spark, log).groupBy("original_file").count().collect()}
        assert len(counts) == 6 and set(counts.values()) == {1}
        if dies_at != 0:  # whoever dies before the answers are in place asks again
            assert len(asked.read_text().split()) == 5
        flags = {r.file: r.schema_generated for r in tables.scan_manifest(spark, versions.version_path(spark, root, 2)).collect()}
        assert [f for f, flag in sorted(flags.items()) if flag == "true"] == [r[0] for r in rows if r[0][-6] in "0124"]
    # A next run asks about what failed only, under the next version's name.
    asked.write_text("")
    assert jobs.propose_once(spark, root, documents, make, "m", answers, log) == 3
    assert len(asked.read_text().split()) == 1
