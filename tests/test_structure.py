"""Scanning splits of one JSON value from unknown places."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shapeloom.operators import infer
from shapeloom.session import earlier_totals
from shapeloom.sources import structure, texts


def value(rng, depth=4):
    kind = rng.random()
    if depth == 0 or kind < 0.35:
        return rng.choice([None, True, 0, -7, 1.5, 1e300, 10**30, 10**40, "a,b,,c", 'q"x,\\', "é\n,", "", "plain", ":{},["])
    if kind < 0.7:
        return {rng.choice(["a", "b,c", 'd"e,', "~.[", "f", "g,,h,i", "\\,"]): value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return [value(rng, depth - 1) for _ in range(rng.randint(0, 5))]


def walk(v, path=""):
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}
    yield path, "number" if isinstance(v, int) and abs(v) >= 10**38 else kinds[type(v)]
    if isinstance(v, dict):
        for name, inner in v.items():
            yield from walk(inner, path + "." + name.replace("~", "~0").replace(".", "~1").replace("[", "~2"))
    if isinstance(v, list):
        for inner in v:
            yield from walk(inner, path + "[]")


def scanned(rng, text):
    """Counts of a text cut at random commas, or None; each split scanned by itself."""
    splits, at = [[]], 0
    pieces = text.split(",")
    for k, piece in enumerate(pieces):
        if k and rng.random() < 0.4:
            splits.append([])
        splits[-1].append(piece)
    states, counts, inside = [], [], False
    for k, split in enumerate(splits):
        scan = structure.SplitScan(k == 0, inside)
        try:
            fed = 0
            while fed < len(split):  # in batches, as they come
                stop = fed + rng.randint(1, 3)
                scan.feed(("," if fed else "") + ",".join(split[fed:stop]))
                fed = stop
            states.append((k, scan.finish()))
        except structure.NotJson:
            states.append((k, {"fits": False}))
        counts.append(scan.counts)
        plain = ",".join(split).replace("\\\\", "").replace('\\"', "")
        inside ^= plain.count('"') % 2 == 1
        at += 1
    places = structure.composed(states)
    if places is None:
        return None
    out = Counter()
    for k, bases, step, entry in places:
        if entry is not None:
            out[entry, "string"] += 1
        for (level, carried, path, kind), n in counts[k].items():
            out[(bases[level] if level < len(bases) else "") + (step if carried else "") + path, kind] += n
    return out


def test_counts_of_any_cut_are_those_of_the_whole():
    rng = random.Random(5)
    for _ in range(3000):
        whole = value(rng, rng.choice([0, 2, 4]))
        text = json.dumps(whole, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1]))
        assert scanned(rng, text + rng.choice(["", "\n"])) == Counter(walk(whole)), text


def test_only_json_fits():
    rng = random.Random(6)
    refused = 0
    for _ in range(6000):
        text = list(json.dumps(value(rng, 3), ensure_ascii=False))
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randint(0, 1)] = rng.choice([",", '"', "]", "}", "[", "{", ":", "1", "\\", " ", "", "e", ".", "-"])
        text = "".join(text)
        if text.rstrip().endswith(","):
            continue  # told by the file's length
        try:
            want = Counter(walk(json.loads(text, parse_constant=lambda _: 1 / 0)))
            names = json.loads(text, object_pairs_hook=lambda pairs: 1 / 0 if len({k for k, _ in pairs}) < len(pairs) else 0)
            assert names is not None or text.strip() == "null"
        except ZeroDivisionError:
            continue
        except ValueError:
            want = None
        refused += want is None
        assert scanned(rng, text) == want, text
    assert refused > 2000


@pytest.fixture
def splits_of(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {n: spark.conf.get(n) for n in names}

    def size(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")

    yield size
    for n in names:
        spark.conf.set(n, old[n])


def test_files_in_many_splits(spark, splits_of, tmp_path):
    rng = random.Random(8)
    want = {}
    for k in range(10):
        whole = {f"k{i}": value(rng) for i in range(12)} if k % 2 else [value(rng) for _ in range(12)]
        (tmp_path / f"f{k}.json").write_text(json.dumps(whole, indent=1, ensure_ascii=False))
        want.update({(f"f{k}", p): c for p, c in _by_path(walk(whole)).items()})
    for name, text in {"open": '{"a":1,\n"b":[2,3}', "comma": '{"a":\n1,"b":2},', "two": '{"a":1}\n,{"b":2}', "end": '{"a":\n1}}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    splits_of(64)
    paths, outcomes = infer.file_schemas(spark, str(tmp_path))
    got = {(r.dataset, r.path): r.nodes for r in paths.collect()}
    assert got == want
    assert {r.dataset: r.outcome for r in outcomes.collect()} == {
        **{f"f{k}": "whole" for k in range(10)}, "open": "unparsable", "comma": "unparsable", "two": "unparsable", "end": "unparsable"
    }


def _by_path(nodes):
    return Counter(path for path, _ in nodes)


def test_one_object_larger_than_a_split(spark, splits_of, tmp_path):
    """One value on one line, of some megabytes, in splits of 256 KB."""
    rows = ",".join(f'"k{i}":{{"id":{i},"name":"n,{i}","tags":["a,b",{i}.5]}}' for i in range(60_000))
    (tmp_path / "one.json").write_text('{"rows":{' + rows + '},"n":60000}')
    assert (tmp_path / "one.json").stat().st_size > 3_000_000
    splits_of(256 * 1024)
    pieces = texts.text_lines(spark, str(tmp_path), separator=",")
    assert structure.split_starts(pieces).count() > 8
    nodes, files = structure.structure_counts(pieces)
    assert [r.fits for r in files.collect()] == [True]
    counts = structure.counted(nodes, ["dataset"], infer.KINDS)
    kinds = counts.groupBy(F.regexp_replace("path", r"\.k\d+", ".*").alias("path")).agg(F.sum("nodes").alias("nodes"), F.sum("n_number").alias("numbers"))
    assert {r.path: (r.nodes, r.numbers) for r in kinds.collect()} == {
        "": (1, 0), ".rows": (1, 0), ".n": (1, 0), ".rows.*": (60_000, 0), ".rows.*.id": (60_000, 0),
        ".rows.*.name": (60_000, 0), ".rows.*.tags": (60_000, 0), ".rows.*.tags[]": (120_000, 60_000),
    }


def test_running_totals_in_a_tree(spark):
    rng = random.Random(2)
    rows = [("hot" if k % 3 else f"d{k % 7}", k, rng.randint(0, 9)) for k in range(5_000)]
    df = spark.createDataFrame(rows, "dataset string, block long, total long").repartition(5)
    want, sums = {}, Counter()
    for dataset, block, total in rows:
        want[dataset, block] = (total, sums[dataset])
        sums[dataset] += total
    for most in (40, 700, 10_000):
        got = earlier_totals(df, "dataset", ["block"], {"total": "before"}, most)
        assert {(r.dataset, r.block): (r.total, r.before) for r in got.collect()} == want


def test_many_blocks(spark):
    df = spark.range(100_000).select(F.lit("d").alias("dataset"), F.col("id").alias("block"), F.lit(2).cast("long").alias("total"))
    got = earlier_totals(df, "dataset", ["block"], {"total": "before"}, 1_000)
    assert got.where("before <> 2 * block").isEmpty() and got.count() == 100_000
