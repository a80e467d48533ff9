import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality
from lodestone.session import table


def graded(n, seed):
    """Texts whose telling words depend on a grade."""
    rng = np.random.default_rng(seed)
    grades = rng.integers(0, 3, n)
    texts = []
    for g in grades:
        common = [f"common{x}" for x in rng.integers(0, 40, 30)]
        marks = [f"mark{g}{x}" for x in rng.integers(0, 4, 3)] + ([f"mark{rng.integers(0, 3)}9"] if rng.random() < 0.3 else [])
        texts.append(" ".join(rng.permutation(common + marks)))
    return pa.array(texts), grades


def test_learns_graded_ratings():
    model = quality.fit(*graded(900, 0))
    texts, grades = graded(300, 1)
    tails = model.tails(texts)
    assert (tails[:, 0] >= tails[:, 1]).all()  # ordered thresholds
    assert np.mean((tails > 0.5).sum(1) == grades) > 0.9


def test_tails_follow_the_definition():
    texts, grades = graded(200, 2)
    model = quality.fit(texts, grades)
    row, cell = quality.features(texts)
    for k in range(0, 200, 37):
        z = model.weights[cell[row == k]].astype(float).sum()
        assert model.tails(texts)[k] == pytest.approx(1 / (1 + np.exp(-(z - model.thresholds))), abs=1e-5)
    whole = model.tails(texts)
    one_by_one = np.concatenate([model.tails(texts.slice(i, 1)) for i in range(50)])
    assert np.allclose(whole[:50], one_by_one)


def test_held_out_accuracy(spark):
    """Trained on two thirds of the labels of sf0.1, scored on the rest."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"), quality.rating())
    rest = docs.join(labels.where("doc_id % 3 = 0"), "doc_id")
    got = quality.score(rest, model, quality.SELECT_GRADE, quality.LEAST).groupBy(((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean")).agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    share = {r.clean: r.kept for r in got}
    assert share[True] > 0.99, share
    assert share[False] < 0.06, share


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (8, None, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(edge_docs, labels, quality.rating())
    got = quality.score(edge_docs, model, 2)
    assert got.count() == edge_docs.count() and got.schema["keep"].dataType.simpleString() == "boolean"
    prior = {r.keep for r in got.where("text is null or text = ''").collect()}
    assert len(prior) == 1
    kept = quality.select(edge_docs, model, 2)
    assert kept.schema == edge_docs.schema
    assert kept.count() == got.where("keep").count()
    assert quality.score(no_docs, model, 2).count() == 0
    none = quality.train(no_docs, labels, quality.rating())
    assert {r.keep for r in quality.score(edge_docs, none, 2).collect()} == {False}
    one = quality.train(edge_docs, labels.where("quality = 1"), quality.rating())
    assert {(r.keep, r.expected_grade) for r in quality.score(edge_docs, one, 2).collect()} == {(True, 2.0)}


def test_fit_is_the_maximum_of_the_likelihood(monkeypatch):
    """Against plain gradient descent on the definition, with features made by hand."""
    monkeypatch.setattr(quality, "CHI2", -1.0)
    rng = np.random.default_rng(4)
    n, f, l2 = 300, 7, 1e-2
    x = rng.random((n, f)) < 0.4
    score = x @ rng.normal(size=f) + rng.logistic(size=n)
    y = (score > -0.5).astype(int) + (score > 0.8)
    rows, cells = np.nonzero(x)
    model = quality.fit_cells(rows.astype(np.int32), cells.astype(np.int32), y, steps=200, l2=l2)
    w, cut = np.zeros(f), np.array([-1.0, 1.0])
    sig = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(30_000):
        s = sig((x @ w)[:, None] - cut)
        full = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], 1)
        p = full[np.arange(n), y] - full[np.arange(n), y + 1]
        slope = full * (1 - full)
        up, low = slope[np.arange(n), y] / p, slope[np.arange(n), y + 1] / p
        gw = x.T @ (low - up) / n + l2 * w
        gc = np.array([(up[y == k + 1].sum() - low[y == k].sum()) / n for k in range(2)])
        w, cut = w - 0.5 * gw, cut - 0.5 * gc
    assert np.abs(model.weights[:f] - w).max() < 0.02
    assert np.abs(model.thresholds - cut).max() < 0.02
