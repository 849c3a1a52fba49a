"""Models on the written examples, and the whole message flow."""

import json

import pytest
from pyspark.sql import Observation, functions as F

from msgflow import values
from msgflow.operators.answers import hook_answers, hook_embeddings
from msgflow.plans import classifiers as K
from msgflow.plans import message_flow as M
from msgflow.plans.knowledge import retrieve
from msgflow.streaming.messages import answer_stream, read_output
from msgflow.staging import new_path

MESSAGES = [
    (1, "good morning", "greeting", "direct"),
    (2, "thx a lot, team", "gratitude", "direct"),
    (3, "see you soon", "goodbye", "direct"),
    (4, "did the courier bring the tracking number", "order_status", "rag"),
    (5, "hey, is the truck with the courier still in the depot?", "order_status", "rag"),
    (6, "the amounts on the bill and on my card differ", "billing_and_refunds", "rag"),
    (7, "my profile is blocked and the login fails", "account_management", "rag"),
    (8, "shame on your rude staff, i am furious", "complaint", "rag_escalate"),
    (9, "which song suits the weather", "out_of_scope", "refusal"),
    (10, "", "out_of_scope", "refusal"),
    (11, "  \t ", "out_of_scope", "refusal"),
    (12, None, "out_of_scope", "refusal"),
    (13, "https://only.a/link", None, None),
    (14, "the tracking page has said packed since tuesday", "order_status", "rag"),
]


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(i, t) for i, t, _, _ in MESSAGES], "message_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def answered(messages, models):
    return {r.message_id: r for r in M.answer_messages(messages, models).collect()}


def test_routes_and_fields(answered):
    assert len(answered) == len(MESSAGES)
    for i, _, intent, route in MESSAGES:
        r = answered[i]
        assert intent is None or (r.intent, r.route) == (intent, route), r
        assert r.response and r.language and r.sentiment in values.SENTIMENTS and r.error is None
        assert 0.0 <= r.intent_confidence <= 1.0 and 0.0 <= r.sentiment_confidence <= 1.0
        assert len(r.retrieved_documents) == (3 if r.route in ("rag", "rag_escalate") else 0)
        scores = [d.similarity_score for d in r.retrieved_documents]
        assert scores == sorted(scores, reverse=True)
        assert r.escalate == (r.route == "rag_escalate") == ("flagged this conversation for review" in r.response)


def test_fixed_rows(answered):
    for i in (10, 11, 12):
        r = answered[i]
        assert tuple(r[c] for c in M.RESULT_FIELDS) == ("unknown", 0.0, "Neutral", 0.0, "out_of_scope", 0.0, "rule", "refusal",
                                                        [], values.BLANK_REPLY, False)
    assert (answered[1].intent_source, answered[1].intent_confidence) == ("rule", 1.0)
    assert answered[9].response == values.REFUSAL_REPLY
    # A lone link has no language, but the other stages still see it.
    assert (answered[13].language, answered[13].language_confidence) == ("unknown", 0.0)
    assert answered[13].intent_source == "model" and answered[13].intent_confidence > 0


def test_best_document_answers(answered):
    known = "the tracking page has said packed since tuesday"
    doc = answered[14].retrieved_documents[0]
    assert doc.instruction == known and doc.similarity_score == 1.0
    assert answered[14].response == doc.response == f"Answer to: {known}"


def test_hook_sees_only_knowledge_routes(messages, models):
    def make_hook():
        def answer(prompt):
            if "blocked" in prompt.split("Customer question")[1]:
                raise RuntimeError("no luck")
            assert 'Customer question: "' in prompt and "[Support response 3]" in prompt
            return "hooked"
        return answer

    for r in M.answer_messages(messages, models, make_hook=make_hook).collect():
        if r.message_id == 7:
            assert (r.response, r.error) == (values.ANSWER_FALLBACK, "no luck")
        elif r.route in ("rag", "rag_escalate"):
            assert r.response.startswith("hooked") and r.error is None
        else:
            assert "hooked" not in r.response


def test_broken_hook_factory_gives_fallbacks(spark):
    def make_hook():
        raise ValueError("no key")

    df = spark.createDataFrame([(1, "p"), (2, "q")], "message_id long, prompt string")
    assert {tuple(r) for r in hook_answers(df, make_hook).collect()} == {(1, values.ANSWER_FALLBACK, "no key"),
                                                                         (2, values.ANSWER_FALLBACK, "no key")}


def test_encoder_hook_normalises(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, text string")
    got = hook_embeddings(df, lambda: lambda texts: [[3, 4] for _ in texts], "id", "text").first()
    assert got.embedding == [0.6, 0.8]


def test_encoder_through_the_flow(messages, models):
    from dataclasses import replace

    from msgflow.operators.answers import EncoderFeatures
    from msgflow.plans.knowledge import build_vectors

    def stand_in_encoder():
        def encode(texts):
            if any("furious" in t for t in texts):
                raise RuntimeError("too angry")
            return [[len(t), sum(c in "aeiou" for c in t), 1.0] for t in texts]
        return encode

    features, vectors = build_vectors(models.knowledge_base.where("instruction not like '%furious%'"), EncoderFeatures(stand_in_encoder))
    own = replace(models, question_features=features, vectors=vectors)
    for r in M.answer_messages(messages, own).collect():
        if r.message_id == 8:
            assert (r.response, r.error, r.retrieved_documents) == (values.FAILED_REPLY, "too angry", [])
        else:
            assert r.error is None and len(r.retrieved_documents) == (3 if r.route.startswith("rag") else 0)
    embedded = features.arrays(messages, "text").where("message_id = 8").first()
    assert embedded.embedding is None and embedded.embedding_error == "too angry"


def test_broken_encoder_factory_is_contained(spark, messages):
    def broken():
        raise OSError("no weights")

    rows = hook_embeddings(messages.where("text is not null"), broken, "message_id", "text").collect()
    assert {r.embedding_error for r in rows} == {"no weights"} and all(r.embedding is None for r in rows)


def test_other_routes_are_not_shuffled(messages, models):
    scored = M.score_messages(messages, models)
    answered = M.answer_scored(scored, models.knowledge_base, models.question_features, models.index)
    plan = answered._jdf.queryExecution().optimizedPlan().toString()
    union = plan.index("Union")
    assert "Join" in plan and plan[:union].count("Join") == 0


def test_partitioning_does_not_matter(messages, models, answered):
    for parts in (1, 7):
        again = {r.message_id: r for r in M.answer_messages(messages.repartition(parts), models).collect()}
        assert again == answered


def test_stream_equals_batch(spark, messages, models, answered):
    arriving, output, checkpoint = (new_path(spark, n) for n in ("in", "out", "check"))
    messages.repartition(4).write.parquet(arriving)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 2).parquet(arriving)
    for _ in range(2):  # the second run finds nothing new
        answer_stream(stream, models, output, checkpoint).awaitTermination()
    got = {r.message_id: r for r in read_output(spark, output).drop("batch_id").collect()}
    assert read_output(spark, output).count() == len(MESSAGES)
    other = spark.readStream.schema(messages.schema).parquet(arriving)
    answer_stream(other, models, output, new_path(spark, "other-check")).awaitTermination()
    assert read_output(spark, output).count() == 2 * len(MESSAGES)  # another checkpoint overwrites nothing
    assert {i: r.asDict(True) for i, r in got.items()} == {i: r.asDict(True) for i, r in answered.items()}


def test_json_and_counts(messages, models):
    df = M.answer_messages(messages, models)
    seen = Observation("routes")
    rows = M.observe_routes(df, seen).select("message_id", M.result_json().alias("j")).collect()
    one = json.loads(next(r.j for r in rows if r.message_id == 14))
    assert list(one) == M.RESULT_FIELDS and one["retrieved_documents"][0]["instruction"] == "the tracking page has said packed since tuesday"
    assert seen.get["direct"] == 3 and sum(seen.get.values()) == len(MESSAGES)
    assert sum(r.n for r in M.outcome_counts(df).collect()) == len(MESSAGES)


def test_retrieve_by_text(spark, models):
    queries = spark.createDataFrame([(1, "amounts on the bill"), (2, "qqq")], "query_id long, text string")
    got = {r.query_id: r.retrieved_documents for r in
           retrieve(queries, models.question_features, models.vectors, models.knowledge_base).collect()}
    assert len(got[1]) == len(got[2]) == 5
    assert got[1][0].category == "BILLING_AND_REFUNDS" and [d.doc_id for d in got[2]] == [0, 1, 2, 3, 4]


# ------------------------------------------------------------------- models


@pytest.mark.parametrize("text,label", [
    ("Rude, filthy, useless: a nightmare", "Negative/Frustrated"), ("The bench is beautiful and the advice was kind", "Positive/Satisfied"),
    ("which aisle holds the soil", "Neutral"), ("far from brilliant, it leaks", "Negative/Frustrated"), ("cannot fault the lovely roses", "Positive/Satisfied"),
])
def test_sentiment(spark, models, text, label):
    row = K.predict_sentiment(spark.createDataFrame([(text,)], "text string"), models.sentiment).first()
    assert row.sentiment == label and 0.0 <= row.sentiment_confidence <= 1.0


@pytest.mark.parametrize("text,label", [
    ("when will the things arrive", "en"), ("¿cuándo van a llegar las cosas?", "es"), ("quand les choses vont arriver", "fr"), ("wann kommt die bestellung aus dem laden", "de"),
    (" ", "unknown"), (None, "unknown"),
])
def test_language(spark, models, text, label):
    row = K.predict_language(spark.createDataFrame([(text,)], "text string"), models.language).first()
    assert row.language == label and (label == "unknown") == (row.language_confidence == 0.0)


def test_fit_meets_its_optimum(spark):
    """Intercepts are free, so at the optimum every class has its weighted share of the probability."""
    rows = [(f"common {'apple pear' if i % 3 == 0 else 'plum fig' if i % 3 == 1 else 'nut'} w{i % 5}", "abc"[i % 3] if i % 7 else "a")
            for i in range(120)]
    df = spark.createDataFrame(rows, "text string, label string")
    for balanced in (False, True):
        model = K.fit_classifier(df, "text", "label", K.INTENT_TERMS, c=1.0, balanced=balanced)
        scored = model.score(df, "text", probability="p")
        counts = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
        weight = {c: 120 / (3 * n) if balanced else 1.0 for c, n in counts.items()}
        total = {c: 0.0 for c in counts}
        for r in scored.collect():
            assert sum(r.p) == pytest.approx(1.0) and r.confidence == max(r.p) and r.prediction == model.labels[r.p.index(max(r.p))]
            for c, p in zip(model.labels, r.p):
                total[c] += weight[r.label] * p
        for c, n in counts.items():
            assert total[c] == pytest.approx(weight[c] * n, rel=0.02)


def test_best_candidate_wins(spark):
    rows = [("good fine nice" if i % 2 else "bad poor sad", "Positive/Satisfied" if i % 2 else "Negative/Frustrated") for i in range(40)]
    df = spark.createDataFrame(rows, "text string, sentiment string")
    model, tried = K.train_sentiment(df, df, penalties=(0.1, 1.0))
    assert [t["c"] for t in tried] == [0.1, 1.0] and max(t["macro_f1"] for t in tried) == 1.0
    assert {r.accuracy for r in K.split_accuracy(model, df.withColumn("split", F.lit("val")), "text", "sentiment").collect()} == {1.0}


def test_save_load_and_errors(spark, models):
    path = new_path(spark, "saved")
    models.intent.save(path)
    again = K.TextClassifier.load(spark, path)
    df = spark.createDataFrame([("is the courier near",), ("?",)], "text string")
    assert again.score(df, "text").collect() == models.intent.score(df, "text").collect()
    assert again.labels == models.intent.labels and again.features.rule == models.intent.features.rule
    with pytest.raises(FileNotFoundError, match="train one"):
        K.TextClassifier.load(spark, path + "-missing")
    with pytest.raises(ValueError, match="two classes"):
        K.fit_classifier(df.withColumn("label", F.lit("x")), "text", "label", K.INTENT_TERMS)


def test_contained_failures(spark):
    df = spark.createDataFrame([(1, "0.5"), (2, "oops"), (3, None)], "id int, said string")
    rows = M.contain_failures(df, {"confidence": ("said", "double")}).orderBy("id").collect()
    assert [(r.confidence, r.error) for r in rows] == [(0.5, None), (None, "bad confidence"), (None, None)]
