import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Observation, functions as F

from msgflow import values
from msgflow.operators import prepare as P
from msgflow.operators import profile


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one text and one label."""
    rng = random.Random(3)
    rows = [(i, "same text" if i % 3 == 0 else f"text {rng.randint(0, 400)}", "a" if i % 3 == 0 else rng.choice("bcd"))
            for i in range(1500)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, text string, label string")


@pytest.mark.parametrize("parts", [1, 7])
def test_keep_first(skewed, parts):
    rows, df = skewed
    first = {}
    for i, text, label in sorted(rows):
        first.setdefault(text, (i, text, label))
    got = {tuple(r) for r in P.keep_first(df.repartition(parts), "text", "id").collect()}
    assert got == set(first.values())
    counts = P.duplicate_counts(df, "text").first()
    assert (counts.n_before, counts.n_after, counts.n_dropped) == (1500, len(first), 1500 - len(first))


@pytest.mark.parametrize("parts", [1, 7])
def test_dense_ids(skewed, parts):
    rows, df = skewed
    got = {r.id: r.doc_id for r in P.dense_ids(df.repartition(parts), ["label", "id"]).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}


@pytest.mark.parametrize("parts", [1, 7])
def test_split_quotas_are_exact(skewed, parts):
    rows, df = skewed
    got = P.stratified_split(df.repartition(parts), "id", "label").collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows)
    counts = Counter((r.label, r.split) for r in got)
    sizes = Counter(r[2] for r in rows)
    n_test = math.ceil(0.15 * 1500)
    n_val = math.ceil(0.15 / 0.85 * (1500 - n_test))
    assert sum(v for (_, s), v in counts.items() if s == "test") == n_test
    assert sum(v for (_, s), v in counts.items() if s == "val") == n_val
    for c, n in sizes.items():
        assert abs(counts[c, "test"] - 0.15 * n) < 1 and abs(counts[c, "val"] - 0.15 * n) < 1.2
    if parts == 7:
        again = P.stratified_split(df.repartition(2), "id", "label").collect()
        assert {(r.id, r.split) for r in got} == {(r.id, r.split) for r in again}


def test_split_with_other_seed_and_integer_labels(spark):
    df = spark.range(200).withColumn("label", (F.col("id") % 3).cast("int"))
    one, two = (P.stratified_split(df, "id", "label", seed=s).collect() for s in (1, 2))
    assert {(r.id, r.split) for r in one} != {(r.id, r.split) for r in two}
    assert Counter(r.split for r in one) == Counter(r.split for r in two) == {"train": 139, "test": 30, "val": 31}  # 0.15 / 0.85 * 170 is a hair above 30


def test_split_refuses_missing_and_single_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, label string")
    with pytest.raises(ValueError, match="stratified"):
        P.stratified_split(df, "id", "label")
    with pytest.raises(ValueError, match="at least 2"):
        P.stratified_split(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, label string"), "id", "label")


def plain_quotas(sizes, test_size, val_size):
    def share(sizes, wanted):
        total = sum(sizes.values())
        given = {c: wanted * n // total for c, n in sizes.items()}
        for c in sorted(sizes, key=lambda c: (-(wanted * sizes[c] % total), c))[:wanted - sum(given.values())]:
            given[c] += 1
        return given

    total = sum(sizes.values())
    test = share(sizes, math.ceil(test_size * total))
    left = {c: n - test[c] for c, n in sizes.items()}
    val = share(left, math.ceil(val_size / (1 - test_size) * sum(left.values())))
    return {c: (test[c], val[c]) for c in sizes}


def test_quotas_are_largest_remainders_with_ties_by_label(spark):
    rng = random.Random(5)
    tables = [{"b": 10, "a": 10}, {f"c{i}": rng.randint(2, 50) for i in range(3000)}, {"x": 3 * 10 ** 17, "y": 10 ** 17, "z": 7}]
    for sizes in tables:
        df = spark.createDataFrame(list(sizes.items()), "_label string, _n long")
        got = P.split_quotas(df, sum(sizes.values()), 0.15, 0.15).collect()
        if max(sizes.values()) < 10 ** 17:
            assert {r._label: (r._test, r._val) for r in got} == plain_quotas(sizes, 0.15, 0.15)
        else:
            assert all(0 <= r._test + r._val <= r._n for r in got) and sum(r._test for r in got) == math.ceil(0.15 * sum(sizes.values()))


def test_many_classes_and_no_rows(spark):
    df = spark.range(6000).withColumn("label", F.col("id") % 2000)
    got = P.stratified_split(df, "id", "label").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"test": 900, "val": 901, "train": 4199}
    assert P.stratified_split(df.limit(0), "id", "label").count() == 0


def test_keep_first_with_null_keys_and_ties(spark):
    df = spark.createDataFrame([(1, None), (2, None), (5, ""), (3, ""), (7, "x"), (7, "x")], "id long, text string")
    assert sorted(str(tuple(r)) for r in P.keep_first(df, "text", "id").collect()) == sorted(map(str, [(1, None), (3, ""), (7, "x")]))


def test_map_intents(spark):
    df = spark.createDataFrame([(raw,) for raw in values.RAW_INTENT_ROUTING], "intent string")
    got = {r.intent: r.routing_intent for r in P.map_intents(df).collect()}
    assert got == values.RAW_INTENT_ROUTING and len(got) == 27 and len(set(got.values())) == 6
    bad = spark.createDataFrame([("zeta",), ("review",), ("alpha",), ("zeta",)], "intent string")
    with pytest.raises(ValueError, match=r"\['alpha', 'zeta'\]"):
        P.map_intents(bad)
    many = spark.range(2500).select(F.format_string("raw%04d", "id").alias("intent"))
    with pytest.raises(ValueError, match="2500 raw values") as raised:
        P.map_intents(many)
    listed = spark.read.parquet(str(raised.value).split("all are listed in ")[1].split(". Extend")[0])
    assert [r.intent for r in listed.orderBy("intent").collect()] == [f"raw{i:04d}" for i in range(2500)]


def test_map_emotions(spark):
    rows = P.map_emotions(spark.range(8).withColumnRenamed("id", "label")).orderBy("label").collect()
    assert [r.emotion for r in rows] == values.EMOTIONS + [None, None]
    assert [r.sentiment_id for r in rows] == [0, 2, 2, 0, 0, 1, None, None]


def test_clean_rows_reports_drops(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, " "), (3, None), (4, "www.x.y")], "id long, text string")
    seen = Observation("clean")
    assert [tuple(r) for r in P.clean_rows(df, observation=seen).collect()] == [(1, "a b")]
    assert seen.get["n_dropped"] == 3


def test_short_spans(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 12)), f"l{i % 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    got = P.short_spans(df, "id", spans_per_row=3).collect()
    per_id = defaultdict(list)
    starts = 0
    for r in got:
        words = r.text.split()
        begin = int(words[0][1:])
        assert words == [f"w{j}" for j in range(begin, begin + len(words))]
        assert 2 <= len(words) <= min(6, r.id % 12) and begin + len(words) <= r.id % 12 and r.label == f"l{r.id % 2}"
        starts += begin == 0
        per_id[r.id].append(r.span_no)
    assert set(per_id) == {i for i in range(600) if i % 12 > 2} and all(sorted(v) == [1, 2, 3] for v in per_id.values())
    assert 0.6 < starts / len(got) < 0.85
    assert {tuple(r) for r in got} == {tuple(r) for r in P.short_spans(df.repartition(5), "id", spans_per_row=3).collect()}


def test_examples_go_to_train_only(spark):
    split = spark.createDataFrame([(1, "a", "x", "test"), (2, "b", "y", "train")], "id long, text string, label string, split string")
    extra = spark.createDataFrame([("c", "z")], "text string, label string")
    rows = P.add_training_examples(split, extra).collect()
    assert [(r.id, r.text, r.split) for r in rows] == [(1, "a", "test"), (2, "b", "train"), (None, "c", "train")]


def test_leakage(spark):
    rows = [("a {{x}}", "train"), ("a {{y}}", "test"), ("b", "train"), ("b", "val"), ("b", "train"), ("c", "test")]
    df = spark.createDataFrame(rows, "text string, split string")
    assert tuple(P.split_overlap(df).first()) == (0, 1)
    assert tuple(P.template_overlap(df).first()) == (2, 2, 1, 50.0)
    assert tuple(P.template_overlap(df.where("split <> 'test'")).first())[3] is None
    assert {tuple(r) for r in P.split_uniqueness(df).collect()} == {("train", 3, 2), ("test", 2, 2), ("val", 1, 1)}
    assert [r.text for r in P.shared_texts(df.where("split='train'"), df.where("split='val'")).collect()] == ["b"]


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, float("nan")), (3, "a", None), (4, "b", 2.0)], "id long, label string, v double")
    assert {tuple(r) for r in profile.missing_values(df).collect()} == {("id", 0), ("label", 1), ("v", 2)}
    assert [tuple(r) for r in profile.class_counts(df, "label").collect()] == [("a", 2), ("b", 1)]
    assert {tuple(r) for r in profile.class_shares(df, "label").collect()} == {("a", 2, 50.0), ("b", 1, 25.0)}
    assert tuple(profile.table_shape(df).first()) == (4, 3, "id,label,v")
    sample = [r.id for r in profile.seeded_sample(df, "id", 2).collect()]
    assert sample == [r.id for r in profile.seeded_sample(df.repartition(3), "id", 2).collect()] and len(sample) == 2
