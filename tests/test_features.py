import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from msgflow.functions.terms import vector_parts
from msgflow.operators import features as X

TEXTS = ["where is my order", "my order is late, my order is lost", "refund the order", "the refund is late", "", "zz",
         "Où est ma commande", "late late late"]


def char_grams(t):
    found = []
    for w in t.lower().split():
        w = f" {w} "
        found += [w[i:i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return found


def word_grams(t):
    import re

    w = re.findall(r"\w\w+", t.lower())
    return w + [" ".join(p) for p in zip(w, w[1:])]


def plain_tfidf(grams, min_df, top, sublinear):
    counts = [Counter(grams(t)) for t in TEXTS]
    df, total = Counter(), Counter()
    for c in counts:
        df.update(c.keys())
        total.update(c)
    kept = sorted((t for t in total if df[t] >= min_df), key=lambda t: (-total[t], t))[:top]
    idf = {t: math.log((1 + len(TEXTS)) / (1 + df[t])) + 1 for t in kept}
    found = {}
    for i, c in enumerate(counts):
        w = {t: (1 + math.log(n) if sublinear else n) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        found.update({(i, t): x / norm for t, x in w.items()})
    return found


@pytest.mark.parametrize("rule,grams", [
    (X.TermRule("char", 3, 60, sublinear=True), char_grams),
    (X.TermRule("word", 2, 6, min_df=2), word_grams),
    (X.TermRule("word", 2, 1000), word_grams),
])
def test_tfidf(spark, rule, grams):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)
    fitted = X.TfIdf.fit(df, "text", rule)
    got = {(r.id, r.term): r.weight for r in fitted.long(df, "id", "text").collect()}
    want = plain_tfidf(grams, rule.min_df, rule.max_features, rule.sublinear)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_vector_fields_survive_exactly(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    fitted = X.TfIdf.fit(df, "text", X.LANGUAGE_TERMS)
    for r in fitted.vectors(df, "text", "v").withColumn("p", vector_parts(F.col("v"))).collect():
        assert list(r.v.indices) == r.p.indices and list(r.v.values) == r.p["values"] and r.v.size == r.p.size


def test_unseen_text_is_the_zero_vector(spark):
    fitted = X.TfIdf.fit(spark.createDataFrame([("aa bb",), ("aa cc",)], "text string"), "text", X.INTENT_TERMS)
    row = fitted.arrays(spark.createDataFrame([("qq",)], "text string"), "text").first()
    assert fitted.terms == ["aa"] and row.embedding.indices == []


def test_class_weights(spark):
    df = spark.createDataFrame([(c,) for c in "aaab"], "label string")
    assert {(r.label, r.n): r.weight for r in X.class_weights(df).collect()} == {("a", 3): pytest.approx(4 / 6), ("b", 1): 2.0}


def test_unit_length(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "e array<float>")
    assert [r[0] for r in df.select(X.unit_length(F.col("e"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_weights_at_hand_and_joined_are_the_same(spark):
    """A term in every row, rows without terms, unknown terms and repeats: both ways give one vector."""
    rows = [(i, "hot hot " + " ".join(f"w{i % 7} x{i}" for _ in range(i % 3 + 1))) for i in range(300)] + [(300, None), (301, ""), (302, "unknown zz")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    fitted = X.TermWeights.fit(df.where("id < 302"), "text")
    joined = X.TermWeights(fitted.rule, fitted.vocabulary, local_terms=0)
    a, b = ({r.id: (list(r.embedding.indices), [round(v, 12) for v in r.embedding["values"]]) for r in x.arrays(df, "text").collect()} for x in (fitted, joined))
    assert a == b and a[300] == a[301] == a[302] == ([], []) and len(a) == 303
    assert all(abs(sum(v * v for v in values) - 1) < 1e-9 and idx == sorted(idx) for i, (idx, values) in a.items() if i < 300)


def test_a_hot_term_is_no_key_of_the_join(spark):
    """One term in every row: the sketch names it, and the light terms that are left spread evenly."""
    df = spark.range(6000).select("id", F.format_string("everywhere w%d x%d", F.col("id") % 997, "id").alias("text"))
    fitted = X.TermWeights.fit(df, "text", local_terms=0)
    terms = F.transform(fitted.rule.terms(F.col("text")), lambda t: F.xxhash64(t))
    rows = df.withColumn("_row", F.col("id")).withColumn("_terms", terms)
    heavy = fitted.heavy_terms(rows)
    assert [r.term for r in heavy.collect()] == ["everywhere"]
    light = X.light_terms(X._weighed(rows, X._weights_at_hand(heavy), rest="_light"))
    sizes = sorted(r["count"] for r in light.repartition(16, "idx").groupBy(F.spark_partition_id().alias("task")).count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]


@pytest.mark.parametrize("rule", [X.TermRule("char", 3, 60, sublinear=True), X.TermRule("word", 2, 12), X.TermRule("word", 3, 1000)])
def test_vectors_in_batches_equal_those_of_the_jvm(spark, rule):
    """Nulls, blanks, white space beyond ASCII, letters beyond 16 bits, words that the vocabulary lacks."""
    texts = [*TEXTS, None, "  ", "a", "Ünï \x1cX \U0001f600y \U0001f600", "aa aa bb aa_b aa bb"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    fitted = X.TfIdf.fit(df, "text", rule)
    a = {r.id: r.v for r in fitted.vectors(df, "text", "v").collect()}
    b = {r.id: r.v for r in fitted.written_vectors(df, "text", ["id"], "v").collect()}
    assert a.keys() == b.keys() and len(a) == len(texts)
    for i in a:
        assert a[i].size == b[i].size and list(a[i].indices) == list(b[i].indices)
        assert list(a[i].values) == pytest.approx(list(b[i].values), abs=1e-12)


@pytest.mark.parametrize("rule", [X.LANGUAGE_TERMS, X.INTENT_TERMS, X.TermRule("word", 3, 10)])
def test_term_counts_emit_a_term_once_for_each_text(spark, rule):
    df = spark.createDataFrame([("late " * 500,), ("late again",), (None,)], "text string")
    grams = {"late": (501, 2)} | ({"la": (501, 2)} if rule.analyzer == "char" else {"late late": (499, 1)})
    got = {r.term: (r.total, r.n_docs) for r in X.term_counts(df, "text", rule).collect()}
    assert got.items() >= ({t: n for t, n in grams.items() if rule.analyzer == "word" or len(t) < 4}).items()
    assert X._counted(df, "text", rule).groupBy("term").count().agg(F.max("count")).first()[0] == 2


def test_gradients_sent_to_the_driver_do_not_grow_with_the_tasks():
    from msgflow.plans import classifiers as K

    assert K.sent_home(360, 2) >= 18  # the depth that Spark takes by itself
    assert all(K.sent_home(n, K.aggregation_depth(n)) <= 5 for n in range(1, 400))
