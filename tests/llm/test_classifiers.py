"""Held-out accuracy on the given tables, and the awkward cases."""

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.llm import language, quality, toxicity
from shapeloom.llm.common import fold, table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, SF, "documents"), table(spark, SF, "labels")


def rates(scored, labels, label):
    held = scored.where("held_out").join(labels, "doc_id").groupBy(label).agg(F.avg("predicted").alias("share"), F.count(F.lit(1)).alias("n"))
    return {r[label]: r["share"] for r in held.collect()}


def test_quality_held_out(tables):
    shares = rates(quality.quality_scores(*tables), tables[1], "quality")
    assert shares[1] > 0.98 and shares[0] < 0.1


def test_toxicity_held_out(tables):
    shares = rates(toxicity.toxicity_scores(*tables), tables[1], "toxic")
    assert shares[1] > 0.88 and shares[0] < 0.02


def test_language_held_out(tables):
    found = language.languages(tables[0]).where("held_out").join(tables[0].select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", fold("id", 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_awkward_documents(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(60)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for scored in (quality.quality_scores(docs, labels), toxicity.toxicity_scores(docs, labels)):
        found = scored.collect()
        assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert quality.keep_good(docs, labels).columns == docs.columns
    told = {r.doc_id: r for r in language.languages(docs).collect()}
    none = {k for k, t in enumerate(cases.texts()) if not any(c.isalpha() for c in t or "")}
    assert {k for k, r in told.items() if r.lang_pred == "und"} == none
    assert all(0 <= r.score <= 1 for r in told.values())


def test_one_class_no_labels_no_rows(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality.quality_scores(docs, labels).collect()} == {1}
    assert {r.predicted for r in toxicity.toxicity_scores(docs, labels).collect()} == {0}
    assert {round(r.score, 6) for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
    assert language.languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_counterfactual_penalty_takes_weight_off_identity_terms():
    rows = []
    for k in range(40):
        # The group is mentioned mostly in toxic texts, the insult in all of them.
        texts = [(1, f"muslims are idiots number{k}"), (0, f"people are nice number{k}"), (0, f"christians are nice number{k}")]
        rows += [(label, *toxicity.pair_features(t, 1 << 18)) for label, t in texts]
    gap = {}
    for penalty in (0.0, 5.0):
        weights, bias = toxicity.train(rows, toxicity.Settings(swap_penalty=penalty, sparsity=0.0, least_rows=1))
        score = lambda t, w=weights: w[np.unique(toxicity.features(t, 1 << 18))].sum()
        gap[penalty] = abs(score("muslims are here") - score("christians are here"))
        assert score("idiots") > 0
    assert gap[5.0] < 0.3 * gap[0.0]
    assert toxicity.swapped("The Women and men") == "The men and girls"


def test_the_penalty_is_at_work_on_the_given_tables(tables):
    told = toxicity.penalty_report(*tables)
    assert told["with_counterfactual"] > 0.1 * told["rows"]
    assert told["change_with"] < 0.8 * told["change_without"]


def test_mentions_by_template():
    made = [toxicity.mentioned(f"text {k}", 4) for k in range(4000)]
    pairs = [m for m in made if m]
    assert 800 < len(pairs) < 1200 and toxicity.mentioned("text", 0) is None
    assert all(a != b and a.split()[:2] == b.split()[:2] for a, b in pairs)
    ends = {m[0].split(" ", 2)[2] for m in pairs}
    assert len(ends) > 0.8 * sum(len(g) for groups in toxicity.IDENTITY_GROUPS.values() for g in groups)
    assert toxicity.swapped("Die Frauen und les réfugiés y los niños") == "Die männer und les étrangers y los mujeres"


def test_one_gradient_step_of_the_languages():
    """One epoch from zero weights against the formula written out."""
    rnd = np.random.default_rng(3)
    rows = [("abc"[k % 3], (np.sort(rnd.choice(32, 5, replace=False)).astype(np.uint32), rnd.random(5).astype(np.float32))) for k in range(7)]
    settings = language.Settings(buckets=32, epochs=1)
    model = language.train(rows, settings)
    codes = language.codewords(3, settings.bits, settings.seed)
    want, bias = np.zeros((32, settings.bits)), np.zeros(settings.bits)
    for label, (ids, values) in rows:
        code = codes["abc".index(label)]
        share = 1 / 3 / sum(other == label for other, _ in rows)
        for bit in range(settings.bits):
            wrong = -code[bit] * 0.5 * share
            want[ids, bit] -= settings.rate * 10 * values * wrong
            bias[bit] -= settings.rate * wrong
    assert np.allclose(model.weights, want, atol=1e-5) and np.allclose(model.bias, bias, atol=1e-6)


def test_decoding_is_the_least_weighted_loss():
    rnd = np.random.default_rng(4)
    for _ in range(200):
        model = language.Model([f"l{k}" for k in range(6)], language.codewords(6, 9, 2), None, None, rnd.dirichlet(np.ones(9)), close=0.05)
        outputs = rnd.normal(0, 2, 9)
        losses = [sum(t * np.log(1 + np.exp(-c * o)) for t, c, o in zip(model.trust, code, outputs, strict=True)) for code in model.codes]
        first, second = sorted(losses)[:2]
        name, score, near = language.decode(model, outputs)
        assert name == f"l{int(np.argmin(losses))}" and near == (second - first < 0.05) and 1 / 6 <= score <= 1
    tied = language.Model(["b", "a"], np.array([[1, -1], [1, -1]]), None, None, np.array([0.5, 0.5]))
    assert language.decode(tied, np.array([1.0, 2.0])) == ("b", 0.5, True)


def test_average_score_of_quality():
    """The score is the softmax of the mean of the features' vectors: one weight each."""
    weights = np.random.default_rng(5).normal(size=1 << 16).astype(np.float32)
    for text in ("a few words, a few words", "é", "x" * 500, "one two three four"):
        ids, shares = quality.features(text, len(weights))
        assert abs(float(shares @ weights[ids]) - weights[quality.grams(text, len(weights))].mean()) < 1e-4


def test_repeated_ids_stay_within_the_sample(spark):
    from shapeloom.llm.labelled import featured, sample_joined, sample_labelled

    docs = spark.createDataFrame([(1 if k < 1000 else k, f"text {k}", "en" if k % 2 else "de") for k in range(1200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(k, k % 2) for k in range(1000, 1200)], "doc_id long, toxic int")
    true = F.lit(True)
    for chosen in (sample_joined(docs, labels, "toxic", true, 20), sample_labelled(docs, "lang", true, 20)):
        rows = featured(chosen, lambda text: (np.array([len(text)]),))
        counts = {label: sum(r[0] == label for r in rows) for label in {r[0] for r in rows}}
        assert len(counts) == 2 and max(counts.values()) == 20 and min(counts.values()) > 0
        again = featured(chosen, lambda text: (np.array([len(text)]),))
        assert [(a, b[0]) for a, b in rows] == [(a, b[0]) for a, b in again]


def test_many_languages(spark):
    """600 labels, one read of the table whatever their number."""
    rows = [(k, f"{chr(0x4E00 + k % 600) * 6} {chr(0x4E00 + k % 600) * 4}", f"l{k % 600}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    settings = language.Settings(per_language=5, epochs=120, buckets=1 << 14, rate=20.0)
    model = language.fit(docs, settings)
    known = {r.lang for r in docs.where(fold("doc_id", 3) != 1).select("lang").collect()}
    assert set(model.languages) == known and model.codes.shape == (len(known), 40) and len(known) > 590
    capped = language.Settings(per_language=5, rows=700, epochs=1)
    assert set(language.fit(docs, capped).languages) == known
    found = language.languages(docs, settings).join(docs, "doc_id")
    assert found.count() == 3000
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.5


def test_codewords_and_ambiguity():
    codes = language.codewords(6, 15, 1)
    assert min((codes[a] != codes[b]).sum() for a in range(6) for b in range(a)) >= 4
    model = language.Model(["a", "b"], np.array([[1, -1], [-1, 1]]), np.zeros((4, 2)), np.zeros(2), np.array([0.5, 0.5]))
    assert language.decode(model, np.array([3.0, -3.0]))[0] == "a" and not language.decode(model, np.array([3.0, -3.0]))[2]
    assert language.decode(model, np.array([0.01, 0.0]))[2]
