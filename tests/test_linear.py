"""The linear model's own search, and tables that are scored whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgflow.functions.terms import vector_parts
from msgflow.operators import features as X, linear
from msgflow.plans import classifiers as K


def texts(n, seed):
    """Common words, words of a class, and many rare ones."""
    rng = random.Random(seed)
    return [(" ".join([rng.choice(["the", "and", "of"]), f"{'abc'[i % 3]}{rng.randrange(30)}", f"rare{rng.randrange(n)}", rng.choice(["x1", "x2", "x3"])]),
             "abc"[i % 3] if i % 11 else "a") for i in range(n)]


def test_the_fit_is_the_least_loss_in_few_passes(spark, monkeypatch):
    """Against the same objective in plain numpy, searched far longer; scaled features need hundreds of passes."""
    df = spark.createDataFrame(texts(600, 5), "text string, label string").repartition(3)
    sizes = K.class_sizes(df, "label")
    fitted = X.TfIdf.fit(df, "text", X.TermRule("char", 3, 5000, sublinear=True))
    vectors = K.training_vectors(df, "text", "label", sizes, fitted, balanced=True)
    passes, added = [], linear._added
    monkeypatch.setattr(linear, "_added", lambda *a: passes.append(1) or added(*a))
    model = K.fit_linear(vectors, 10.0)
    rows = vectors.select(vector_parts(F.col("features")).alias("p"), "target", "weight").collect()
    matrix, weight = np.zeros((len(rows), len(fitted.terms))), np.array([r.weight for r in rows])
    for i, r in enumerate(rows):
        matrix[i, r.p.indices] = r.p["values"]
    target, total = np.array([int(r.target) for r in rows]), weight.sum()

    def measure(theta):
        scores = matrix @ theta[:, :-1].T + theta[:, -1]
        scores -= scores.max(1, keepdims=True)
        share = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        value = -(weight @ np.log(share[np.arange(len(rows)), target])) / total + (theta[:, :-1] ** 2).sum() / (20.0 * total)
        share[np.arange(len(rows)), target] -= 1
        share *= weight[:, None] / total
        return value, np.c_[share.T @ matrix + theta[:, :-1] / (10.0 * total), share.sum(0)]

    found = np.c_[model.coefficientMatrix.toArray(), model.interceptVector.toArray()]
    least = measure(linear.minimised(measure, np.zeros_like(found), 2000, 1e-9))[0]
    assert least <= measure(found)[0] <= least * 1.02
    assert len(passes) <= 120 and abs(found[:, -1].sum()) < 1e-9


def test_blocks_hold_every_row(spark, monkeypatch):
    """Rows without a term, rows longer than a block, several partitions: loss and gradient are those of all rows."""
    monkeypatch.setattr(linear, "CELLS", 4)
    df = spark.createDataFrame([("aa bb cc dd ee ff gg", "x"), ("", "y"), ("aa", "x"), (None, "y"), ("zz bb", "y")] * 3, "text string, label string").repartition(2)
    sizes = K.class_sizes(df, "label")
    fitted = X.TfIdf.fit(df, "text", X.TermRule("word", 1, 50))
    vectors = K.training_vectors(df, "text", "label", sizes, fitted, balanced=False)
    theta = np.arange(2.0 * (len(fitted.terms) + 1)).reshape(2, -1) / 10
    loss, gradient = linear._added(linear.packed(vectors), theta, 2)
    want, slope = 0.0, np.zeros_like(theta)
    for r in vectors.collect():
        x = np.r_[r.features.toArray(), 1.0]
        share = np.exp(theta @ x) / np.exp(theta @ x).sum()
        want -= np.log(share[int(r.target)])
        share[int(r.target)] -= 1
        slope += np.outer(share, x)
    assert loss == pytest.approx(want) and np.allclose(gradient, slope)


def test_a_table_scored_whole_is_scored_alike(spark, models):
    odd = [None, "", "  ", "　", "a", "ça va où", "x" * 3000, "\U0001f600 \x1cfin", "wo ist meine bestellung", "http://only.a/link", "where is my order today"]
    df = spark.createDataFrame(list(enumerate(odd)) + [(0, "again")], "id long, text string").repartition(3)
    one, other = (sorted((r.id, r.text or "", r.language, round(r.language_confidence, 9)) for r in K.predict_language(df, models.language, whole=whole).collect())
                  for whole in (False, True))
    assert one == other and len(one) == len(odd) + 1


def test_terms_are_added_up_before_they_leave_a_task(spark):
    """A row for each term of a batch of texts, not one for each term of each text."""
    df = spark.range(3000).select(F.concat(F.lit("order number "), F.col("id") % 7).alias("text")).coalesce(1)
    rule = X.TermRule("char", 3, 100)
    assert X._counted(df, "text", rule).count() < 200
    counts = {r.term: (r.total, r.n_docs) for r in X.term_counts(df, "text", rule).collect()}
    assert counts["r"] == (9000, 3000) and counts["ord"] == (3000, 3000) and counts[" 0 "] == (429, 429)


def test_texts_longer_than_a_batch_of_characters(spark, monkeypatch):
    monkeypatch.setattr(X, "CHARS_AT_ONCE", 8)
    df = spark.createDataFrame([("ab ab é",), ("",), (None,), ("é" * 20,), ("ab",)], "text string").coalesce(1)
    counts = {r.term: (r.total, r.n_docs) for r in X.term_counts(df, "text", X.TermRule("char", 4, 100)).collect()}
    assert counts["ab"] == (3, 2) and counts[" ab "] == (3, 2) and counts["é"] == (21, 2) and counts["éééé"] == (17, 1) and "b a" not in counts
