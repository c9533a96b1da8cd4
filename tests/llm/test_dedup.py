"""Exact and near deduplication against direct computations."""

import hashlib
from collections import defaultdict

import cases
import pytest

from shapeloom.llm import exact, nearness


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(spark, bits):
    docs = cases.documents(spark)
    groups = defaultdict(list)
    for row in docs.collect():
        groups[cases.BLANKS.sub(" ", row.text or "")].append(row.doc_id)
    found = exact.exact_dedup(docs, id_bits=bits).collect()
    assert len(found) == docs.count()
    told = defaultdict(list)
    for row in found:
        told[row.text_sha256].append(row)
    assert set(told) == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    for text, ids in groups.items():
        rows = told[hashlib.sha256(text.encode()).hexdigest()]
        least = min((i for i in ids if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in rows} == {(least, len(ids))}
        assert [r.doc_id for r in rows if r.kept] == [least]


def test_chunks_are_the_text(spark):
    docs = cases.documents(spark)
    made = docs.select(exact.normalised("text").alias("t")).select("t", exact.chunks(exact.F.col("t")).alias("c")).collect()
    assert all("".join(r.c) == r.t for r in made)
    assert max(len(r.c) for r in made) > 20


def test_insertion_shifts_few_chunks(spark):
    long = next(t for t in cases.texts() if t and len(t) > 50_000)
    docs = cases.documents(spark, [long, "new words here " + long], repeat=False)
    a, b = (set(r.c) for r in docs.select(exact.chunks(exact.normalised("text")).alias("c")).collect())
    assert len(a & b) > 0.9 * len(a)


def test_drop_copies(spark):
    docs = cases.documents(spark)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    want = len({cases.BLANKS.sub(" ", r.text or "") for r in docs.collect()})
    assert kept.count() == want


def test_near_components(spark):
    made = dict(enumerate(cases.texts()))
    docs = cases.documents(spark, repeat=False)
    want = cases.components(made)
    found = {r.doc_id: r for r in nearness.near_dedup(docs).collect()}
    assert {k: r.component_id for k, r in found.items()} == want
    assert all(r.n_shingles == len(cases.shingles(made[k])) and r.kept == (k == want[k]) for k, r in found.items())
    assert len(set(want.values())) < len(want)


def test_near_rows_with_repeated_and_missing_ids(spark):
    docs = cases.documents(spark)
    kept = nearness.drop_near_copies(docs)
    assert kept.columns == docs.columns
    plain = {k: t for k, t in enumerate(cases.texts())}
    # Blank texts link with nothing; the row without id stands alone.
    half = docs.count() - len(plain) - 1
    assert half == 1
    assert kept.count() == len(set(cases.components(plain).values())) + 1


def test_stragglers_and_chains(spark):
    """A chain links its ends; pairs just below the limit stay apart."""
    words = [f"w{k}" for k in range(104)]
    chain = [" ".join(words[:k] + [f"x{j}" for j in range(k)] + words[k + k :]) for k in range(0, 12)]
    made = dict(enumerate(chain + [" ".join(words)] + [" ".join(words[: 104 - 5 * k]) for k in range(8)]))
    docs = cases.documents(spark, list(made.values()), repeat=False)
    found = {r.doc_id: r.component_id for r in nearness.near_dedup(docs).collect()}
    assert found == cases.components(made)


def test_empty(spark):
    none = cases.documents(spark).limit(0)
    assert exact.exact_dedup(none).count() == nearness.near_dedup(none).count() == 0
    assert exact.drop_copies(none).columns == nearness.drop_near_copies(none).columns == none.columns


def test_signature_estimates_similarity():
    import numpy as np

    made = np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = nearness.signature(np.sort(made[:2000])), nearness.signature(np.sort(made[500:2500]))
    assert abs(float((a == b).mean()) - 1500 / 2500) < 0.1
