import random

import numpy as np
import pytest

from tests.llm.helpers import frame, odd_rows, words
from trawl.llm import ordinal, quality, toxicity

LABELS = "doc_id bigint, quality int, toxic int, _id int"


def graded(n=900, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        text = words(rng, rng.randrange(20, 120))
        if bad:
            text = " ".join(w + rng.choice(["***", "!!", "$$$"]) for w in text.split(" "))
        if toxic:
            w = text.split(" ")
            w[rng.randrange(len(w))] = rng.choice(["rotter", "blighter"])
            text = " ".join(w)
        docs.append((i, text, "en", "s", 1, 1, 2, "x", 3, 4))
        labels.append((i, int(not bad), int(toxic), 0))
    return docs, labels


def test_gradient_fits_ordered_grades():
    rng = np.random.default_rng(2)
    features = ordinal.Features(pattern=r"\w+", parts=lambda t: [t], distinct=True, lower=True, scale=1.0, least_link=5.0)
    texts, grades = [], []
    for _ in range(1500):
        level = rng.integers(0, 4)
        texts.append(" ".join([*rng.choice([f"n{i}" for i in range(50)], 8), *rng.choice([f"g{k}" for k in range(level + 1)], 3)]))
        grades.append(int(level))
    x = [features.vector(t) for t in texts]
    model = ordinal.fit(x[:1000], np.array(grades[:1000]), 4, features)
    assert (np.diff(model.thresholds) > 0).all()
    above = model.above(np.array([model.margin(t) for t in texts[1000:]]))
    assert (np.diff(above, axis=1) <= 0).all()
    assert np.corrcoef(above.sum(axis=1), grades[1000:])[0, 1] > 0.7


def test_fit_against_plain_gradient_ascent():
    """The same likelihood, climbed by fixed small steps of differences, without Adam: as good a fit, the same order of documents."""
    rng = np.random.default_rng(6)
    features = ordinal.Features(pattern=r"\w+", parts=lambda t: [t], distinct=True, lower=True, scale=1.0, least_link=0.0)
    grades = rng.integers(0, 3, 240)
    texts = [" ".join([*rng.choice(["n1", "n2", "n3"], 2), f"g{min(2, max(0, g + rng.integers(-1, 2)))}"]) for g in grades]
    x = [features.vector(t) for t in texts]
    used = sorted({int(k) for keys, _ in x for k in keys})
    dense = np.array([[dict(zip(keys.tolist(), values.tolist(), strict=True)).get(k, 0.0) for k in used] for keys, values in x])

    def likelihood(p):
        theta = np.array([p[-2], p[-2] + np.exp(p[-1])])
        above = 1 / (1 + np.exp(theta[None, :] - (dense @ p[:-2])[:, None]))
        each = np.concatenate([1 - above[:, :1], above[:, :1] - above[:, 1:], above[:, 1:]], axis=1)
        return np.log(each[np.arange(len(grades)), grades]).mean() - 5e-3 / len(grades) * (p[:-2] ** 2).sum()

    p = np.zeros(len(used) + 2)
    for _ in range(1500):
        p = p + 0.5 * np.array([(likelihood(p + d) - likelihood(p - d)) / 2e-5 for d in np.eye(len(p)) * 1e-5])
    model = ordinal.fit(x, grades, 3, features, rounds=600)
    own = np.concatenate([model.weights[used], model.thresholds[:1], np.log(np.diff(model.thresholds))])
    assert abs(likelihood(own) - likelihood(p)) < 2e-3
    assert np.corrcoef(dense @ own[:-2], dense @ p[:-2])[0, 1] > 0.999
    expected = sum(1 / (1 + np.exp(t - dense @ p[:-2])) for t in (p[-2], p[-2] + np.exp(p[-1])))
    assert np.abs(model.above(np.array([model.margin(t) for t in texts])).sum(axis=1) - expected).max() < 0.05


def test_the_sample_bounds_rows(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(ordinal, "fit", lambda rows, grades, *a, **b: fitted.append(len(rows)))
    docs = spark.createDataFrame([(i % 12, f"text {i}") for i in range(600)], "doc_id bigint, text string")
    quality.train(docs, spark.createDataFrame([(i, 1, 0, 0) for i in range(12)], LABELS), sample=10)
    assert fitted == [10]


def test_margin_is_the_feature_vectors_product():
    rng = np.random.default_rng(3)
    for spec in (quality.FEATURES, toxicity.FEATURES):
        model = ordinal.Model(rng.normal(size=ordinal.MASK + 1), np.zeros(1), spec)
        for text in [r[1] for r in odd_rows()]:
            keys, values = spec.vector(text)
            assert model.margin(text) == pytest.approx(float(model.weights[keys] @ values), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_held_out_accuracy(spark, which):
    docs, labels = graded()
    df, own = frame(spark, docs), spark.createDataFrame(labels[:600], LABELS)
    if which == "quality":
        got = {r.doc_id: r["keep"] for r in quality.grade(df, quality.train(df, own)).collect()}
    else:
        got = {r.doc_id: r.toxic for r in toxicity.severity(df, toxicity.train(df, own)).collect()}
    column = 1 if which == "quality" else 2
    assert len(got) == len(docs)
    assert np.mean([got[r[0]] == bool(r[column]) for r in labels[600:]]) > 0.98


def test_selection_keeps_columns_and_agrees(spark):
    docs, labels = graded(300)
    df = frame(spark, docs + odd_rows())
    model = quality.train(df, spark.createDataFrame(labels, LABELS))
    kept = quality.select(df, model)
    assert kept.columns == df.columns
    assert kept.count() == quality.grade(df, model).where("keep").count()


def test_odd_labels_and_none(spark):
    df = frame(spark, odd_rows())
    odd = spark.createDataFrame([(None, 1, 1, 0), (3, None, None, 0), (3, 1, 0, 0), (3, 0, 1, 0), (10**9, 1, 1, 0)], LABELS)
    for labels in (odd, spark.createDataFrame([], LABELS)):
        assert quality.grade(df, quality.train(df, labels)).count() == df.count()
        assert toxicity.severity(df, toxicity.train(df, labels)).count() == df.count()
    none = quality.grade(df, quality.train(df, spark.createDataFrame([], LABELS))).collect()
    assert all(r["keep"] and r.p_good == 0.5 for r in none)
    empty = frame(spark, [])
    assert quality.grade(empty, quality.train(empty, odd)).count() == 0


def test_fit_is_repeatable_and_bounded(spark):
    docs, labels = graded(400)
    own = spark.createDataFrame(labels, LABELS)
    a, b = quality.train(frame(spark, docs, 2), own, sample=100), quality.train(frame(spark, docs, 5), own, sample=100)
    assert np.allclose(a.weights, b.weights)
    assert ordinal.sampled(own, "quality", 100).count() == 100
