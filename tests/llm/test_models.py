import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from corpus import documents  # noqa: E402

from quillmark.llm import langid, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    rows, toxic = documents()
    return rows, toxic, spark.createDataFrame(rows, DOCS)


def test_language_accuracy_on_held_out_rows(spark, corpus):
    rows, _, docs = corpus
    model = langid.fit(docs.where("doc_id % 3 <> 1"))
    odd = [(9000, None, "aa", "s", 0), (9001, "", "aa", "s", 0), (9002, "12 !! ..", "aa", "s", 0), (9003, "er", None, "s", 0), (9004, rows[0][1] * 400, None, "s", 0), (9004, rows[0][1] * 400, None, "s", 0), (None, rows[0][1], None, "s", 0)]
    every = docs.unionByName(spark.createDataFrame(odd, DOCS)).withColumn("lang_pred", F.lit("clash"))
    got = every.select("doc_id", langid.predict(every, model).alias("p")).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r.p for r in got}
    held = [r for r in rows if r[0] % 3 == 1]
    assert sum(by_id[r[0]].lang == r[2] for r in held) >= 0.98 * len(held)
    assert sum(by_id[r[0]].accepted for r in held) >= 0.98 * len(held)
    assert [tuple(by_id[i]) for i in (9000, 9001, 9002)] == [("und", 0.0, False)] * 3
    assert by_id[9004].lang == rows[0][2] == by_id[None].lang and 0 <= by_id[9003].score <= 1


def test_language_model_does_not_depend_on_partitions(corpus):
    _, _, docs = corpus
    a, b = langid.fit(docs.repartition(3)), langid.fit(docs.repartition(7, "text"))
    assert np.allclose(a.table, b.table) and a.threshold == pytest.approx(b.threshold)


def test_word_sums_equal_whole_text_sums(corpus, monkeypatch):
    rows, _, docs = corpus
    model = langid.fit(docs.limit(200))
    monkeypatch.setattr(langid, "CACHE_WORDS", 300)
    monkeypatch.setattr(langid, "BATCH_LETTERS", 1000)
    for (lang, score), (_, text, *_) in zip(langid.WordSums(model).predict([r[1] for r in rows[:80]]), rows):
        p = model.scores(model.logits(*langid.bucket_counts(text)))
        assert lang == model.languages[p.argmax()] and score == pytest.approx(p.max())


def test_language_fit_on_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    model = langid.fit(empty)
    assert empty.select(langid.predict(empty, model)).count() == 0
    one = spark.createDataFrame([(1, "text", None, "s", 0)], DOCS)
    assert one.select(langid.predict(one, model).alias("p")).first().p.lang == "und"


def test_toxicity_tells_held_out_rows(spark, corpus):
    rows, toxic, docs = corpus
    labels = spark.createDataFrame([(r[0], 1, int(r[0] in toxic)) for r in rows if r[0] % 4] + [(None, 1, 1), (5, 1, None), (1, 1, 0)], LABELS)
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(9000, None, "aa", "s", 0), (9001, "", "aa", "s", 0), (9002, "IDIOT, scum! Moron. " * 9000, "aa", "s", 0), (9002, "idiot scum moron", "aa", "s", 0)], DOCS)
    got = docs.unionByName(odd).select("doc_id", "text", toxicity.predict(docs, model).alias("p")).collect()
    held = [r for r in got if r.doc_id < 9000 and r.doc_id % 4 == 0]
    assert sum((r.p.p_toxic >= 0.5) == (r.doc_id in toxic) for r in held) >= 0.98 * len(held)
    rest = {(r.doc_id, len(r.text or "")): r.p for r in got if r.doc_id >= 9000}
    assert all(p.p_toxic < 0.5 and p.grade == 0 for (i, _), p in rest.items() if i < 9002)
    loud, plain = (p for (i, _), p in sorted(rest.items()) if i == 9002)
    assert plain.severity == pytest.approx(loud.severity) and plain.severity > 1 and plain.grade >= 1


def test_cumulative_link_has_ordered_cuts_and_shared_weights():
    rng = np.random.default_rng(4)
    rows, grades = [], []
    for _ in range(1500):
        marks = rng.integers(0, 7)
        rows.append(np.unique(np.concatenate([rng.choice(50, marks, replace=False), 100 + rng.integers(0, 3000, 20)])).astype(np.int32))
        grades.append(int(np.searchsorted([1.5, 3.5, 5.5], marks + rng.normal(0, 0.3))))
    model = toxicity.fit_ordinal(rows, np.array(grades), 4)
    assert (np.diff(model.cuts) > 0).all() and (model.weights >= 0).all() and set(model.columns) <= set(range(50))
    weight = dict(zip(model.columns.tolist(), model.weights.tolist()))
    expected = np.array([model.at_least(sum(weight.get(f, 0) for f in r)).sum() for r in rows])
    assert np.corrcoef(expected, grades)[0, 1] > 0.9


def test_toxicity_of_one_class_and_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", "aa", "s", 0)], DOCS)
    for labels, want in (([(1, 1, 1)], 1.0), ([(1, 1, 0)], 0.0), ([], 0.0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
        assert docs.select(toxicity.predict(docs, model).alias("p")).first().p.p_toxic == pytest.approx(want, abs=1e-6)


def test_objective_gradient():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(6, 6))
    a = a @ a.T + np.eye(6)
    b = rng.normal(size=6)
    best = toxicity.minimise(lambda x: (float(x @ a @ x / 2 - b @ x), a @ x - b), np.zeros(6))
    assert np.allclose(best, np.linalg.solve(a, b), atol=1e-3)
