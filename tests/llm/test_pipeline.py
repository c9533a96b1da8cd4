"""The pipeline against a direct computation, and queries against their SQL."""

import cases
import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from shapeloom.llm import quality, queries
from shapeloom.llm.common import stored, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    ours = entry.queries()[name](spark, SF).toPandas()
    assert compare(ours, connect(SF).execute(queries.oracle_sql()[name]).fetch_df()) == ""


def test_all_are_registered():
    assert {q.split("_")[0] for q in entry.queries() if q.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in entry.queries() and [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_stages(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    good = {r.doc_id: r.text for r in docs.join(quality.quality_scores(docs, labels).where("predicted = 1"), "doc_id", "left_semi").collect()}
    first = {}
    for doc_id in sorted(good):
        first.setdefault(cases.BLANKS.sub(" ", good[doc_id] or ""), doc_id)
    single = {i: good[i] for i in first.values()}
    want = set(cases.components(single).values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == want
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stored(stage(spark, step, SF), "test-stage")
        assert step.columns == docs.columns and step.dtypes == docs.dtypes
    assert {r.doc_id for r in step.collect()} == want


def test_awkward_rows_and_none(spark):
    for docs in (cases.documents(spark), cases.documents(spark).limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = stored(stage(spark, docs, SF), "test-stage")
            assert k == 4 or docs.columns == columns
