"""Manifest rules, sampling, files and comparison, against direct computations."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from shapeloom.operators import compare, infer, manifest, propose, sampling, shred
from shapeloom.plans import corpora
from shapeloom.session import fresh_dir
from shapeloom.sources import tables, texts

FLAGS = ["True", "true ", "TRUE", "yes", "1", "False", "false", "", None, "no"]


def manifest_rows(spark, flags=FLAGS, files=None):
    files = files or [f"processed/d{i % 2}/documents/document_{i}.json" for i in range(len(flags))]
    rows = [(f, "documents", "low", flag) for f, flag in zip(files, flags)]
    return spark.createDataFrame(
        rows, "file string, object_type string, complexity string, schema_generated string"
    )


def test_the_three_flag_rules(spark):
    rows = manifest_rows(spark)
    pending = [r.schema_generated for r in manifest.pending_documents(rows).collect()]
    assert sorted(map(str, pending)) == sorted(["False", "false", "", "None", "no"])
    approved = [r.schema_generated for r in manifest.approved_documents(rows).collect()]
    assert sorted(approved) == ["TRUE", "True", "true "]
    existing = spark.createDataFrame(
        [(f"d{i % 2}", "documents", f"document_{i}.json") for i in range(len(FLAGS))],
        "dataset string, object_type string, base_name string",
    )
    refreshed = manifest.refresh_manifest(rows, existing)
    updated = [r.file for r in refreshed.filter("updated").collect()]
    assert sorted(f[-6] for f in updated) == ["5", "6", "8"]
    assert manifest.refresh_report(refreshed).first().asDict() == {"processed": 10, "updated": 3}
    assert refreshed.filter("updated and schema_generated <> 'true'").count() == 0


def test_malformed_paths_pass_through_the_refresh(spark):
    rows = manifest_rows(spark, ["False", "False"], ["lonely.json", "./processed//d/documents/x.json"])
    existing = spark.createDataFrame(
        [("d", "documents", "x.json")] * 2, "dataset string, object_type string, base_name string"
    )
    got = {r.file: r.schema_generated for r in manifest.refresh_manifest(rows, existing).collect()}
    assert got == {"lonely.json": "False", "./processed//d/documents/x.json": "true"}


def test_random_order_is_seeded(spark):
    rows = manifest_rows(spark).coalesce(1)
    turns = [
        [r.file for r in manifest.pending_documents(rows, seed=s).orderBy("turn").collect()]
        for s in (1, 1, 2)
    ]
    assert turns[0] == turns[1] != turns[2]


def test_sampling_steps_round_half_to_even(spark):
    sizes = [("a", 100), ("b", 101), ("c", 150), ("d", 250), ("e", 350), ("f", 1000), ("g", 0)]
    plan = sampling.sampling_plan(spark.createDataFrame(sizes, "dataset string, size_bytes long"), 100)
    got = {r.dataset: (r.keep_all, r.k) for r in plan.collect()}
    assert got == {
        name: (size <= 100, max(1, round(size / 100))) for name, size in sizes if size > 0
    }


def test_random_order_does_not_change_with_the_partitions(spark):
    rows = manifest_rows(spark, ["no"] * 50)
    orders = []
    for parts in (1, 7):
        pending = manifest.pending_documents(rows.repartition(parts), seed=3).orderBy("turn")
        orders.append([r.file for r in pending.collect()])
    other = [r.file for r in manifest.pending_documents(rows, seed=4).orderBy("turn").collect()]
    assert orders[0] == orders[1] != other and orders[0] != sorted(orders[0])


@pytest.fixture(scope="module")
def skewed(spark):
    """One dataset holds most rows; blocks hold a few each."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else f"d{i % 5}", i, "x" * rng.randint(0, 9) + "é") for i in range(2000)]
    df = spark.createDataFrame(rows, "dataset string, doc_id long, json string")
    return rows, df.withColumn("block", F.floor(F.col("doc_id") / 37)).repartition(7)


def test_systematic_sample_of_a_skewed_collection(spark, skewed):
    rows, df = skewed
    plan = spark.createDataFrame(
        [("hot", 7), *[(f"d{i}", 1 + i) for i in range(5)]], "dataset string, k long"
    )
    steps = {r.dataset: r.k for r in plan.collect()}
    want = set()
    for dataset, k in steps.items():
        ids = sorted(i for d, i, _ in rows if d == dataset)
        want |= set(ids[::k])
    got = sampling.systematic_sample(df, plan, ["block"], ["doc_id"])
    assert {r.doc_id for r in got.collect()} == want


def test_size_subsets_of_a_skewed_collection(spark, skewed):
    rows, df = skewed
    want, totals = {}, {}
    for dataset, i, text in sorted(rows, key=lambda r: r[1]):
        totals[dataset] = totals.get(dataset, 0) + len(text.encode())
        want[i] = (totals[dataset] - 1) // 50
    got = sampling.size_subsets(df, 50, ["block"], ["doc_id"])
    assert {r.doc_id: r.subset for r in got.collect()} == want


@pytest.fixture
def tiny_splits(spark):
    """Files are read in splits of 64 bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "64")
    spark.conf.set(names[1], "1")
    yield
    for n in names:
        spark.conf.set(n, old[n])


def test_lines_are_sampled_by_position_across_splits(spark, tiny_splits, tmp_path):
    lines = {}
    for name, n in (("a", 61), ("b", 40)):
        lines[name] = [f'{{"n":{i}}}' if i % 9 else "" for i in range(n)]
        (tmp_path / f"{name}.json").write_text("\n".join(lines[name]) + "\n")
    plan = spark.createDataFrame([("a", 4), ("b", 3)], "dataset string, k long")
    sample = sampling.sample_lines(texts.text_lines(spark, str(tmp_path)), plan)
    got = sorted((r.dataset, r.idx, r.text) for r in sample.collect())
    assert got == sorted(
        (d, i, t) for d, k in (("a", 4), ("b", 3)) for i, t in enumerate(lines[d]) if i % k == 0
    )


def random_value(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind <= 3:
        return [rng.randint(-9, 999), rng.choice(['a,"]}[{', "\\", '\\"', "é\n", ""]), None, rng.random()][kind]
    if kind <= 4:
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice("abc,]"): random_value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def test_arrays_are_cut_at_the_right_commas(spark, tiny_splits, tmp_path):
    rng = random.Random(11)
    want = {}
    for i in range(14):
        value = [random_value(rng) for _ in range(rng.choice([0, 1, 2, 30]))]
        text = json.dumps(value, indent=rng.choice([None, 2]), ensure_ascii=False)
        (tmp_path / f"f{i}.json").write_text(text + rng.choice(["", "\n"]))
        want.update({(f"f{i}", n + 1): v for n, v in enumerate(value)})
    broken = {
        "open": "[1,2", "comma": "[1,2,]", "hole": "[1,,2]", "object": '{"a":1,"b":2}', "two": "[1],[2]",
        "tail": "[1,2] x", "scalar": "7", "string": '["a,b', "early": "[1],2]", "blank": " \n",
    }
    for name, text in broken.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = texts.scan_json_array(spark, str(tmp_path)).collect()
    assert {(r.dataset, r.doc_no): json.loads(r.json) for r in got} == want
    heads = sampling.detect_file_format(texts.file_heads(spark, str(tmp_path)))
    formats = {r.dataset: r.format for r in heads.collect()}
    assert formats == {
        **{f"f{i}": "array" for i in range(14)},
        **{n: "array" for n in broken},
        "object": "lines", "scalar": "unknown", "blank": "empty",
    }


def test_lines_with_a_broken_one_are_left_out_whole(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a":1}\n\n  \n[2]\n')
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n{"a":\n')
    good = ["[2]", '{"a":1}']
    got = texts.scan_json_lines(spark, str(tmp_path)).collect()
    assert sorted((r.dataset, r.json) for r in got) == [("good", t) for t in good]
    folder = texts.scan_json_lines(spark, str(tmp_path), "directory").collect()
    assert sorted((r.dataset, r.json) for r in folder) == [(tmp_path.name, t) for t in good]
    assert texts.scan_json_lines(spark, str(tmp_path), "directory", reject="dataset").isEmpty()


def test_files_by_line_or_whole(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a":1}\n{"a":2.5}\n')
    (tmp_path / "whole.json").write_text('{\n "a":\n [1]\n}')
    (tmp_path / "broken.json").write_text("{\n}}")
    (tmp_path / "large.json").write_text('{\n "b": "' + "x" * 300 + '"}')
    (tmp_path / "empty.json").write_text("\n")
    (tmp_path / "blanks.json").write_text("[\n]" + " " * 150)
    paths, outcomes = infer.file_schemas(spark, str(tmp_path), whole_bytes=200)
    assert {r.dataset: r.outcome for r in outcomes.collect()} == {
        "lines": "lines", "whole": "whole", "broken": "unparsable", "large": "too_large", "blanks": "whole",
    }
    assert {r.dataset: r.nodes for r in paths.filter("path = ''").collect()} == {"lines": 2, "whole": 1, "blanks": 1}
    (tmp_path / "blanks.json").unlink()
    done = spark.createDataFrame([(str(tmp_path / "lines.json"),)], "file string")
    paths = infer.infer_file_schemas(spark, str(tmp_path), existing=done, whole_bytes=200, levels=4)
    assert {(r.dataset, r.path) for r in paths.collect()} == {("whole", ""), ("whole", ".a"), ("whole", ".a[]")}


def test_one_document_per_file(spark, tmp_path):
    for folder in ("shop/documents", "schema_documents/shop"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "d 1+.json").write_text('{\n "a": 1}')
        (tmp_path / folder / "d2.json").write_text("oops")
    docs = texts.scan_documents(spark, str(tmp_path), exclude="schema_documents").collect()
    assert [(r.dataset, r.file) for r in docs] == [("documents", str(tmp_path / "shop/documents/d 1+.json"))]
    corpus = texts.scan_schema_corpus(spark, str(tmp_path)).collect()
    assert sorted(r.dataset for r in corpus) == ["schema_documents"] * 2 + ["shop"] * 2


def test_log_messages_are_flat_and_short(spark):
    path = fresh_dir(spark, "log")
    rows = spark.createDataFrame(
        [("a.json", "m", "failed", 'x "q",\ny\r ' + "z" * 3000), ("b.json", "m", "success", None)],
        "original_file string, model string, status string, message string",
    )
    tables.append_run_log(rows, path)
    tables.append_run_log(rows.limit(1), path)
    got = tables.read_run_log(spark, path).orderBy("original_file").collect()
    assert [r.original_file for r in got] == ["a.json", "a.json", "b.json"]
    assert got[0].message == ('x "q", y\r ' + "z" * 3000)[:2000] and got[2].message == ""


def test_a_document_that_takes_too_long_is_a_row(spark, tmp_path):
    """Generators that hang, die or never load: the others are answered, the job goes on."""
    starts = str(tmp_path / "starts")

    def make():
        import os
        import time

        with open(starts, "a") as file:
            file.write("x")

        def generate(prompts):
            if any("hang" in p for p in prompts):
                time.sleep(600)
            if any("die" in p for p in prompts):
                os._exit(3)
            if any("boom" in p for p in prompts):
                raise KeyError("no model")
            return [TimeoutError("own") if "own" in p else p.upper() for p in prompts]

        return generate

    rows = [("a", "one"), ("b", "hang"), ("c", "two"), ("d", "die"), ("e", None), ("f", "boom"), ("g", "own"), ("h", "three")]
    prompted = spark.createDataFrame(rows, "file string, prompt string").coalesce(1)
    begun = time.perf_counter()
    got = {r.file: (r.response, r.error) for r in propose.propose_schemas(prompted, make, batch_rows=3, deadline=3).collect()}
    assert time.perf_counter() - begun < 60
    assert got == {
        "a": ("ONE", None), "b": (None, "Timeout: no answer within 3 s"), "c": ("TWO", None),
        "d": (None, "the generator died (exit code 3)"), "e": (None, propose.UNREADABLE),
        "f": (None, "'no model'"), "g": (None, "Timeout: own"), "h": ("THREE", None),
    }
    assert len((tmp_path / "starts").read_text()) > 2

    def never():
        import time

        time.sleep(600)

    got = propose.propose_schemas(prompted.limit(1), never, deadline=1, load_deadline=1).first()
    assert got.response is None and got.error == "Timeout: generator not ready within 1 s"


def test_generator_problems_become_rows(spark):
    def make():
        def generate(prompts):
            if any("boom" in p for p in prompts):
                raise RuntimeError("no model")
            return [TimeoutError("late") if "slow" in p else "got " + p.split('"')[1] for p in prompts]

        return generate

    docs = spark.createDataFrame(
        [("a", '{"a":1}'), ("b", '{"slow":1}'), ("c", '{"boom":1}'), ("d", "no json"), ("e", '{"e":1}')],
        "file string, json string",
    ).coalesce(1)
    prompted = propose.prompts(docs, instruction="")
    for batch_rows in (64, 2):
        told = propose.propose_schemas(prompted, make, batch_rows).collect()
        assert {r.file: (r.response, r.error) for r in told} == {
            "a": ("got a", None),
            "b": (None, "Timeout: late"),
            "c": (None, "no model"),
            "d": (None, propose.UNREADABLE),
            "e": ("got e", None),
        }


def test_saved_answers(spark):
    df = spark.createDataFrame(
        [("d", 'Sure:\n{"a":"é"} bye'), ("d", "  {oops} "), ("d", " nothing\n")],
        "dataset string, response string",
    )
    extracted = propose.extract_json_block(df)
    got = [(r.valid, r.saved) for r in propose.saved_text(extracted).collect()]
    assert got == [(True, '{\n  "a": "é"\n}'), (False, "{oops}"), (False, "nothing")]
    assert propose.block_counts(extracted).first().asDict() == {
        "dataset": "d", "valid_blocks": 1, "raw_texts": 2,
    }


def test_comparison_counts_paths_types_and_flags(spark):
    """Three shared paths: one alike in all, one of another type, one required on one side only;
    and a path on either side alone."""
    shape = "dataset string, path string, types array<string>, required boolean"
    left = [
        ("d", ".same", ["null", "string"], True),
        ("d", ".kind", ["integer"], True),
        ("d", ".flag", ["object"], False),
        ("d", ".left", ["array"], True),
    ]
    right = [
        ("d", ".same", ["string", "null"], True),
        ("d", ".kind", ["number"], True),
        ("d", ".flag", ["object"], True),
        ("d", ".flag.right", ["boolean"], False),
    ]
    diff = compare.schema_diff(
        spark.createDataFrame(left, shape), spark.createDataFrame(right, shape), ["dataset"]
    )
    row = compare.schema_similarity(diff, ["dataset"]).first()
    assert (row.paths, row.shared_paths, row.same_type, row.same_required) == (5, 3, 2, 2)
    assert row.path_overlap == 3 / 5 and row.required_agreement == 2 / 3


def test_values_beyond_the_parser_are_not_lost(spark, tmp_path):
    long = "x" * 20_000_001
    (tmp_path / "lines.json").write_text('{"a":1}\n{"b":"%s","c":["\\"%s"]}\n' % (long, "\\n\\\\" * 1_000_000))
    (tmp_path / "array.json").write_text('[\n{"a":1},\n{"b":"%s"}\n]' % long)
    (tmp_path / "line.json").write_text('[{"a":1},{"b":"%s"}]' % long)
    (tmp_path / "object.json").write_text('{\n"b":"%s"}' % long)
    (tmp_path / "fault.json").write_text('{"b":"%s\t"}\n' % long)
    (tmp_path / "none.json").write_text("[\n]\n")
    (tmp_path / "half.json").write_text("[\n[\n")
    found, outcomes = infer.file_schemas(spark, str(tmp_path))
    assert {r.dataset: (r.outcome, r.rejected) for r in outcomes.collect()} == {
        **{n: ("whole", 0) for n in ("array", "object", "none", "line")}, "lines": ("lines", 0),
        "fault": ("unparsable", 0), "half": ("unparsable", 0),
    }
    paths = {(r.dataset, r.path): (r.nodes, "|".join(r.types), r.required) for r in found.collect()}
    for name in ("array", "line"):
        assert {p: f for (d, p), f in paths.items() if d == name} == {
            "": (1, "array", False), "[]": (2, "object", False), "[].a": (1, "integer", False), "[].b": (1, "string", False),
        }
    assert paths["object", ".b"] == (1, "string", True) and paths["none", ""] == (1, "array", False)
    assert {p for d, p in paths if d == "lines"} == {"", ".a", ".b", ".c", ".c[]"}
    kept = texts.scan_json_lines(spark, str(tmp_path)).groupBy("dataset").count().collect()
    assert {r.dataset: r["count"] for r in kept} == {"lines": 2, "line": 1}
    elements = texts.scan_json_array(spark, str(tmp_path)).groupBy("dataset").count().collect()
    assert {r.dataset: r["count"] for r in elements} == {"array": 2, "line": 2}


def test_documents_without_a_value_are_reject_rows(spark):
    docs = spark.createDataFrame([("ok", "[1]"), ("bad", "{"), ("none", None)], "id string, json string").unionByName(
        spark.range(1).selectExpr("'large' as id", "concat('[', repeat('1e-300,', 18000000), '1]') as json")
    )
    assert {r.id: r.reason for r in shred.rejected_documents(docs).select("id", "reason").collect()} == {
        "bad": "invalid", "none": "invalid", "large": "too_large",
    }
    assert [r.id for r in shred.parse_documents(docs).select("id").collect()] == ["ok"]


def test_folders_are_written_by_many_tasks(spark, tmp_path):
    """A file in a folder per row: small rows, but the folders are dealt out all the same."""
    rows = [(i, i % 3, f"S{i}") for i in range(60)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_name string").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    path = corpora.write_supplier_files(spark, str(tmp_path), corpora.SUPPLIER_DOC_SQL)
    files = texts.whole_files(spark, path, "directory", "*.txt").collect()
    assert sorted(r.dataset for r in files) == sorted(f"supplier={i}" for i in range(60))
    parts = {re.search(r"part-(\d+)", r.file)[1] for r in files}
    assert len(parts) >= 4
