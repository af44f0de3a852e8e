"""The fits against plain formulas, and without bounds on languages or features."""

import math

import numpy as np
import pytest

from quillmark.llm import langid, toxicity

DOCS = "doc_id long, text string, lang string, __toxic string, p string"


def test_loss_is_the_likelihood_row_by_row():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 12, rng.integers(0, 6))) for _ in range(40)]
    grades, weights, cuts, ridge = rng.integers(0, 4, 40), rng.normal(size=12), np.array([-0.4, 0.3, 1.1]), 0.2
    weight = rng.uniform(0.2, 1, 40)
    owner, at = np.repeat(np.arange(40), [len(r) for r in rows]), np.concatenate(rows)
    logistic = lambda x: 1 / (1 + math.exp(-x))

    def loss(w, c):
        total = ridge / 2 * sum(x * x for x in w)
        for r, g, k in zip(rows, grades.tolist(), weight.tolist()):
            reach = [1.0] + [logistic(sum(w[f] for f in r) - x) for x in c] + [0.0]
            total -= k * math.log(reach[g] - reach[g + 1])
        return total

    value, by_weight, by_cut = toxicity.ordinal_loss(owner, at, weight, grades, weights, cuts, ridge)
    assert value == pytest.approx(loss(weights, cuts))
    step = lambda v, i, d: np.where(np.arange(len(v)) == i, v + d, v)
    for i in range(12):
        assert by_weight[i] == pytest.approx((loss(step(weights, i, 1e-5), cuts) - loss(step(weights, i, -1e-5), cuts)) / 2e-5, abs=1e-4)
    for i in range(3):
        assert by_cut[i] == pytest.approx((loss(weights, step(cuts, i, 1e-5)) - loss(weights, step(cuts, i, -1e-5))) / 2e-5, abs=1e-4)


def test_predict_is_the_sum_over_features(spark):
    words = ["bad", "worse", "fine", "badly", "Ugly."]
    columns = sorted({f for w in ("bad", "worse", "ugly") for f in toxicity.word_features(w)})
    model = toxicity.OrdinalModel(np.array(columns), np.linspace(0.4, 1.9, len(columns)), np.array([0.7, 2.2]))
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, n)) for n in (1, 2, 3, 5, 8)] + [None, "", "bad " * 50_000, "bad", "bad"]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], DOCS)
    got = docs.withColumn("severity", toxicity.predict(docs, model)).collect()
    assert len(got) == len(texts)
    for r in got:
        held = {f for w in (r.text or "").lower().split() for f in toxicity.word_features(w)}
        score = sum(w for f, w in zip(columns, model.weights) if f in held)
        reach = [1 / (1 + math.exp(c - score)) for c in model.cuts]
        mass = [1 - reach[0], reach[0] - reach[1], reach[1]]
        assert r.severity.severity == pytest.approx(sum(reach)) and r.severity.p_toxic == pytest.approx(reach[0])
        assert r.severity.grade == mass.index(max(mass)) and r["__toxic"] == "y"
    empty = docs.limit(0)
    assert empty.select(toxicity.predict(empty, model)).count() == 0


def test_labels_of_many_values_are_grades():
    rows = [np.array([i]) for i in range(6)]
    assert toxicity.severity_grades(rows, np.array([0, 3, 1, 3, 0, 7])).tolist() == [0, 2, 1, 2, 0, 3]


def test_no_bound_on_features():
    rng = np.random.default_rng(8)
    marks = [np.arange(40 * k, 40 * k + 40) for k in range(50)]  # 2,000 telling features
    rows = [np.sort(np.concatenate([m, 5000 + rng.choice(4000, 30, replace=False)])) for m in marks for _ in range(14)]
    rows += [np.sort(5000 + rng.choice(4000, 30, replace=False)) for _ in range(1400)]
    model = toxicity.fit_ordinal([r.astype(np.int32) for r in rows], np.repeat([1, 0], [700, 1400]), 3)
    assert set(range(2000)) <= set(model.columns.tolist())


def test_three_hundred_languages_are_all_told(spark):
    rng = np.random.default_rng(2)
    letters = [chr(0x4E00 + k) for k in range(2700)]
    rows = []
    for n in range(300):
        own = letters[9 * n : 9 * n + 9]
        for _ in range(24 if n else 400):
            rows.append((len(rows), " ".join("".join(rng.choice(own, 3)) for _ in range(12)), f"l{n:03d}", "", ""))
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs, max_rows=600)
    assert len(model.languages) == 300
    got = docs.select("lang", langid.predict(docs, model).alias("p")).collect()
    assert sum(r.p.lang == r.lang for r in got) >= 0.97 * len(got)
    assert len({r.p.lang for r in got}) == 300
