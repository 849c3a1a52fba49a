import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgflow.llm import language_crf as crf

DATA = "/root/testdata/sf0.01"


def model_of(k, seed):
    rng = np.random.default_rng(seed)
    none = np.zeros((0, k))
    return crf.Crf(list("abcdef")[:k], none, none, none, np.zeros(0, np.uint64), none, np.zeros(k), rng.normal(size=(k, k)) * 2,
                   rng.normal(size=k))


@pytest.mark.parametrize("k", [1, 2, 4])
def test_shares_equal_the_sum_over_all_paths(k):
    model, rng = model_of(k, k), np.random.default_rng(9)
    lengths = [0, 1, 5, 3]
    scores = rng.normal(size=(sum(lengths), k)) * 3
    first = np.r_[0, np.cumsum(lengths)]
    got = crf.label_shares(scores, first, model)
    for i, n in enumerate(lengths):
        own, total = scores[first[i]:first[i + 1]], np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            weight = np.exp(sum(own[j, y] for j, y in enumerate(path)) + sum(model.step[a, b] for a, b in zip(path, path[1:]))
                            + (model.start[path[0]] if n else 0))
            for j, y in enumerate(path):
                total[j, y] += weight
        want = (total / total.sum(axis=1, keepdims=True)).sum(axis=0) if n else np.zeros(k)
        assert np.allclose(got[i], want)


def test_long_chains_equal_one_step_at_a_time():
    model, rng = model_of(3, 1), np.random.default_rng(3)
    lengths = [1000, 32, 33, 64, 1]
    scores, first = rng.normal(size=(sum(lengths), 3)) * 2, np.r_[0, np.cumsum(lengths)]
    got, step = crf.label_shares(scores, first, model), np.exp(model.step)
    for i, n in enumerate(lengths):
        e = np.exp(scores[first[i]:first[i + 1]])
        alpha, beta = [np.exp(model.start) * e[0]], [np.ones(3)]
        for t in range(1, n):
            alpha.append((alpha[-1] / alpha[-1].sum() @ step) * e[t])
            beta.insert(0, step @ (e[n - t] * beta[0] / beta[0].sum()))
        both = np.array(alpha) * np.array(beta)
        assert np.allclose(got[i], (both / both.sum(axis=1, keepdims=True)).sum(axis=0))


@pytest.fixture(scope="module")
def learned(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").where(~crf.held_out(F.col("doc_id")))
    return crf.train(crf.training_segments(rows, "text", "lang", rows=100), epochs=25)


def test_held_out_accuracy(spark, learned):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").where(crf.held_out(F.col("doc_id")))
    got = crf.predicted(rows, "text", learned).collect()
    assert len(got) == rows.count() > 200
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_switched_text_keeps_its_parts(spark, learned):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) > 800 and lang in ('en', 'de')").select("lang", "text").collect()
    english, german = (next(r.text for r in rows if r.lang == x) for x in ("en", "de"))
    words = " ".join(english.split()[:90] + german.split()[:30])
    import pyarrow as pa
    from msgflow.llm.words import Words
    text = crf._Text(pa.array([words]), Words(crf.SPACES))
    shares = crf.label_shares(crf.emissions(text, learned), text.first, learned)[0] / 120
    by = dict(zip(learned.labels, shares))
    assert abs(by["en"] - 0.75) < 0.08 and abs(by["de"] - 0.25) < 0.08


def test_texts_without_letters_and_clashing_names(spark, learned):
    rows = [(1, None, "x"), (2, "", "x"), (3, " 12 +-*/   一 ", "x"), (4, " 12 ²½ ...", "x"), (5, "the and of", "x"), (5, "the and of", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in crf.predicted(df, "text", learned).collect())
    assert [g[:2] for g in got[:2]] == [(1, "und"), (2, "und")] and got[0][2] == 0.0
    assert got[2][1] != "und" and got[3][1] == "und" and got[4] == got[5] and got[4][1] == "en"
    assert crf.predicted(df.limit(0), "text", learned).collect() == []


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = crf.train(crf.training_segments(df, "text", "lang"))
    assert model is None and {r.lang_pred for r in crf.predicted(df, "text", model).collect()} == {"und"}


def test_sample_is_bounded_and_spread(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    df = spark.createDataFrame([(i, text + f" {i}", "en" if i % 9 else "fr") for i in range(300)], "doc_id long, text string, lang string")
    got = crf.training_segments(df, "text", "lang", rows=20)
    assert sum(own == "en" for _, own in got) <= 20 * crf.SEGMENTS and sum(own == "fr" for _, own in got) > 0
    assert any("w4" in t for t, _ in got) and any("w3" in t for t, _ in got)
    assert all(len(t.split()) <= crf.SEGMENT_WORDS for t, _ in got)


def test_labels_of_many_copies_are_learned(spark):
    """The step of the sample counts distinct texts: a label of 20 texts with 500 copies each gives its rows, as others do."""
    df = spark.range(10_000).selectExpr("concat('texte ', id % 20) text", "'fr' lang").unionByName(
        spark.range(3_000).selectExpr("concat('text ', id) text", "'en' lang"))
    got = crf.training_segments(df, "text", "lang", rows=5)
    assert sum(own == "fr" for _, own in got) == 5 and sum(own == "en" for _, own in got) == 5
    assert len(crf.training_segments(df.where("lang = 'fr'"), "text", "lang")) == 20
