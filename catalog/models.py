"""Fitted models.

Fitting is iterative, so SQL cannot follow the numbers.  It knows facts about
them: which rows are scored, from which splits, that every answer is one of the
classes, that confidences are probabilities, that accuracies reach a floor, and
that a stream says what the batch says.  The tests check the models themselves
against closed forms and against each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog.preparation import SQL_PAIRS, SQL_SPLIT_DOCUMENTS, pairs, split_documents, sql_examples, sql_split
from catalog.registry import SQL_DECORATED, decorated, query, sql_clean_intent, sql_clean_language, sql_map, table
from catalog.retrieval import knowledge_base
from catalog.routes import SQL_CHATTY, chatty, sql_small_talk
from msgflow import values
from msgflow.examples import INTENT_EXAMPLES, SENTIMENT_EXAMPLES, intent_examples, sentiment_examples
from msgflow.functions import routing
from msgflow.functions.text import clean_intent_text
from msgflow.operators import evaluate, prepare
from msgflow.plans import classifiers as K
from msgflow.plans.knowledge import build_vectors
from msgflow.plans.message_flow import MessageModels, RESULT_FIELDS, answer_messages
from msgflow.sources.tables import add_sentiment_examples
from msgflow.staging import new_path, stage
from msgflow.streaming.messages import answer_stream, read_output

_saved: dict[tuple, str] = {}


def _once(spark, sf_dir, name, train):
    """Train, save, and from then on load: what a scoring job does with a trained model."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _saved:
        path = new_path(spark, f"model-{name}")
        train().save(path)
        _saved[key] = path
    return K.TextClassifier.load(spark, _saved[key])


# -------------------------------------------------------------- training sets


def language_rows(spark, sf_dir):
    return split_documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"), "split")


def intent_rows(spark, sf_dir):
    """Questions with their mapped intent, distinct texts, split, and the written examples in train.

    The tables hold no topics, so the language of a question stands in for its raw intent.
    """
    rows = pairs(spark, sf_dir).withColumn("intent", prepare.mapped(F.col("category"), _RAW))
    rows = prepare.map_intents(rows).withColumn("text", clean_intent_text(F.col("instruction")))
    rows = prepare.keep_first(rows.select("id", "text", "routing_intent"), "text", "id")
    rows = prepare.stratified_split(stage(rows, "intent-rows"), "id", "routing_intent")
    return prepare.add_training_examples(rows, intent_examples(spark))


def sentiment_rows(spark, sf_dir):
    """Labelled documents as emotions: toxic is anger, poor quality surprise, the rest joy."""
    rows = table(spark, sf_dir, "documents", ["doc_id", "text"]).join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.withColumn("label", F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 0, 5).otherwise(1))
    rows = prepare.map_emotions(rows).select("doc_id", "text", "emotion", "sentiment", "sentiment_id")
    rows = prepare.stratified_split(stage(rows, "sentiment-rows"), "doc_id", "sentiment")
    return add_sentiment_examples(rows, sentiment_examples(spark))


def language_model(spark, sf_dir):
    return _once(spark, sf_dir, "language", lambda: K.train_language(
        language_rows(spark, sf_dir).where("split = 'train'")))


def intent_model(spark, sf_dir):
    return _once(spark, sf_dir, "intent", lambda: K.train_intent(intent_rows(spark, sf_dir).where("split = 'train'")))


def _sentiment_candidates(spark, sf_dir):
    rows = stage(sentiment_rows(spark, sf_dir), "sentiment-split")
    return K.train_sentiment(rows.where("split = 'train'"), rows.where("split = 'val'"))


def sentiment_model(spark, sf_dir):
    return _once(spark, sf_dir, "sentiment", lambda: _sentiment_candidates(spark, sf_dir)[0])


def message_models(spark, sf_dir) -> MessageModels:
    kb = knowledge_base(spark, sf_dir)
    features, vectors = build_vectors(kb)
    return MessageModels(language_model(spark, sf_dir), sentiment_model(spark, sf_dir), intent_model(spark, sf_dir),
                         kb, features, vectors)


# ---------------------------------------------------------------------- facts

#: Accuracies that the models must reach on every split of the test tables.
LANGUAGE_FLOOR, INTENT_FLOOR, SENTIMENT_FLOOR = 0.95, 0.6, 0.35

_RAW = {"EN": "track_order", "FR": "get_refund", "DE": "edit_account", "ES": "complaint"}
_ROUTED = {k: values.RAW_INTENT_ROUTING[v] for k, v in _RAW.items()}
SQL_INTENT_ROWS = f"""{SQL_PAIRS},
asked AS (SELECT id, {sql_clean_intent('instruction')} AS text, {sql_map('category', _ROUTED)} AS routing_intent FROM pairs),
distinct_asked AS (SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY text ORDER BY id) = 1),
{sql_split('distinct_asked', 'id', 'routing_intent')}, {sql_examples(INTENT_EXAMPLES, 'label')},
intent_rows AS (SELECT split FROM split_rows UNION ALL SELECT 'train' FROM examples)"""
SQL_SENTIMENT_ROWS = f"""
felt AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Negative/Frustrated' WHEN quality = 0 THEN 'Neutral' ELSE 'Positive/Satisfied' END AS sentiment
  FROM documents JOIN labels USING (doc_id)),
{sql_split('felt', 'doc_id', 'sentiment')}, {sql_examples(SENTIMENT_EXAMPLES, 'label')},
sentiment_rows AS (SELECT split FROM split_rows UNION ALL SELECT 'train' FROM examples)"""


def _reached(scores, floor):
    """Rows of each split, and whether the accuracy reaches the floor."""
    return scores.select("split", "n", ((F.col("accuracy") >= floor) & (F.col("accuracy") <= 1)).alias("reached"))


def _listed(answer, classes, confidence):
    """The answer is one of the classes and its confidence a probability no smaller than an even share."""
    even = 1.0 / len(classes) - 1e-9
    return answer.isin(*classes) & (confidence >= even) & (confidence <= 1)


# ------------------------------------------------------------------- queries


@query("f4_language_training", f"WITH {SQL_SPLIT_DOCUMENTS} SELECT split, count(*) AS n, true AS reached FROM split_rows GROUP BY split")
def language_training(spark, sf_dir):
    """Accuracy of the language model on each split, the augmented rows left out."""
    return _reached(K.split_accuracy(language_model(spark, sf_dir), language_rows(spark, sf_dir), "text", "label"), LANGUAGE_FLOOR)


@query("f5_intent_training", f"WITH {SQL_INTENT_ROWS} SELECT split, count(*) AS n, true AS reached FROM intent_rows GROUP BY split")
def intent_training(spark, sf_dir):
    return _reached(K.split_accuracy(intent_model(spark, sf_dir), intent_rows(spark, sf_dir), "text", "routing_intent"), INTENT_FLOOR)


@query("f6_sentiment_training", f"WITH {SQL_SENTIMENT_ROWS} SELECT split, count(*) AS n, true AS reached FROM sentiment_rows GROUP BY split")
def sentiment_training(spark, sf_dir):
    scores = K.split_accuracy(sentiment_model(spark, sf_dir), sentiment_rows(spark, sf_dir), "text", "sentiment")
    return _reached(scores, SENTIMENT_FLOOR)


@query("f7_best_candidate", "SELECT unnest([0.1, 1.0, 10.0]::DOUBLE[]) AS c, true AS scored, true AS best_kept")
def best_candidate(spark, sf_dir):
    """The candidates: each has scores on the validation split, and the model kept scores like the best of them."""
    rows = stage(sentiment_rows(spark, sf_dir), "sentiment-split")
    val = rows.where("split = 'val'")
    model, tried = K.train_sentiment(rows.where("split = 'train'"), val)
    kept = evaluate.macro_scores(model.score(val, "text"), "sentiment").first()["macro_f1"]
    best = max(t["macro_f1"] for t in tried)
    facts = [(t["c"], all(0 <= v <= 1 for k, v in t.items() if k != "c"), abs(kept - best) < 1e-9) for t in tried]
    return spark.createDataFrame(facts, "c double, scored boolean, best_kept boolean")


@query("f9_predict_language", "SELECT doc_id, lang, true AS listed FROM documents")
def predict_language(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    model = language_model(spark, sf_dir)
    scored = K.predict_language(rows, model, whole=True)
    blank = (F.col("language") == K.UNKNOWN_LANGUAGE) & (F.col("language_confidence") == 0)
    return scored.select("doc_id", "lang", (blank | _listed(F.col("language"), model.labels, F.col("language_confidence"))).alias("listed"))


@query("f9_blank_language", f"""
WITH {SQL_DECORATED} SELECT doc_id, {sql_clean_language('text')} = '' AS unknown FROM decorated""")
def blank_language(spark, sf_dir):
    """Texts with nothing left after cleaning are unknown with confidence 0, and no others."""
    rows = decorated(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    scored = K.predict_language(rows, language_model(spark, sf_dir), whole=True)
    return scored.select("doc_id", ((F.col("language") == "unknown") & (F.col("language_confidence") == 0)).alias("unknown"))


@query("f10_predict_sentiment", "SELECT doc_id, true AS listed FROM documents")
def predict_sentiment(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", ["doc_id", "text"])
    scored = K.predict_sentiment(rows, sentiment_model(spark, sf_dir))
    return scored.select("doc_id", _listed(F.col("sentiment"), values.SENTIMENTS, F.col("sentiment_confidence")).alias("listed"))


def predicted_intents(spark, sf_dir):
    return K.predict_intent(chatty(spark, sf_dir), intent_model(spark, sf_dir)).select(
        "message_id", "intent", "intent_confidence", "intent_source")


@query("f12_predict_intent", f"WITH {SQL_CHATTY} SELECT message_id, true AS listed FROM chatty")
def predict_intent(spark, sf_dir):
    trained = values.ROUTING_INTENTS[3:]
    rows = predicted_intents(spark, sf_dir)
    modelled = (F.col("intent_source") == "model") & _listed(F.col("intent"), trained, F.col("intent_confidence"))
    ruled = (F.col("intent_source") == "rule") & F.col("intent").isin(*values.DIRECT_INTENTS) & (F.col("intent_confidence") == 1)
    return rows.select("message_id", (modelled | ruled).alias("listed"))


@query("f12_rule_first", f"""
WITH {SQL_CHATTY}, ruled AS (SELECT message_id, {sql_small_talk(sql_clean_intent('text'))} AS talk FROM chatty)
SELECT message_id, CASE WHEN talk IS NULL THEN 'model' ELSE 'rule' END AS intent_source, coalesce(talk, '') AS talk FROM ruled""")
def rule_first(spark, sf_dir):
    """Where the rule hits it decides, with confidence 1; everywhere else the model does."""
    rows = predicted_intents(spark, sf_dir)
    ruled = (F.col("intent_source") == "rule") & (F.col("intent_confidence") == 1.0)
    return rows.select("message_id", "intent_source", F.when(ruled, F.col("intent")).otherwise("").alias("talk"))


@query("f14_score_test_table", f"""
WITH {SQL_SPLIT_DOCUMENTS}, tested AS (SELECT lang, count(*) AS n FROM split_rows WHERE split = 'test' AND {sql_clean_language('text')} <> '' GROUP BY 1)
SELECT 0 AS position, lang AS name, n AS support, true AS reached FROM tested UNION ALL
SELECT unnest([1, 2, 3]), unnest(['accuracy', 'macro avg', 'weighted avg']), (SELECT sum(n)::BIGINT FROM tested), true""")
def score_test_table(spark, sf_dir):
    """The report of the language model on the held-out rows: every F1 reaches the floor."""
    test = language_rows(spark, sf_dir).where("split = 'test'")
    report = evaluate.report(language_model(spark, sf_dir).score(prepare.clean_rows(test).select("text", "label"), "text", whole=True))
    return report.select("position", "name", "support", ((F.col("f1") >= LANGUAGE_FLOOR) & (F.col("f1") <= 1)).alias("reached"))


@query("s6_saved_classifier", f"WITH {SQL_CHATTY} SELECT message_id, true AS same FROM chatty")
def saved_classifier(spark, sf_dir):
    """A model that was saved and loaded scores every message as before."""
    path = new_path(spark, "model-copy")
    model = intent_model(spark, sf_dir)
    model.save(path)
    rows = model.score(chatty(spark, sf_dir), "text", "before", "sure_before")
    rows = K.TextClassifier.load(spark, path).score(rows, "text", "after", "sure_after")
    same = (F.col("before") == F.col("after")) & (F.col("sure_before") == F.col("sure_after"))
    return rows.select("message_id", same.alias("same"))


def answered_messages(spark, sf_dir):
    """Every user turn through the three models, routing, retrieval and reply."""
    messages = chatty(spark, sf_dir).select("message_id", "conv_id", "text")
    return answer_messages(messages, message_models(spark, sf_dir))


@query("c7_answer_messages", f"WITH {SQL_CHATTY} SELECT message_id, conv_id, true AS consistent FROM chatty")
def answers(spark, sf_dir):
    """The fields of every answer agree with each other and with the fixed rules."""
    rows = answered_messages(spark, sf_dir)
    grounded = F.col("route").isin("rag", "rag_escalate")
    scores = F.col("retrieved_documents.similarity_score")
    expected = routing.route(F.col("intent"), F.col("intent_confidence"), F.col("intent_source"), F.col("sentiment"))
    facts = [
        F.col("route") == expected, F.col("error").isNull(), F.length("response") > 0,
        F.size("retrieved_documents") == F.when(grounded, values.MODEL_TOP_K).otherwise(0),
        F.forall(F.zip_with(scores, F.sort_array(scores, asc=False), lambda a, b: a == b), lambda same: same),
        F.col("escalate") == (F.col("route") == "rag_escalate"),
        F.contains("response", F.lit(values.ESCALATION_NOTICE)) == F.col("escalate"),
        ~grounded | F.startswith("response", F.get("retrieved_documents.response", 0)),
        F.col("sentiment").isin(*values.SENTIMENTS), F.col("intent").isin(*values.ROUTING_INTENTS)]
    return rows.select("message_id", "conv_id", reduce(lambda a, b: a & b, facts).alias("consistent"))


@query("c11_answered_stream", f"WITH {SQL_CHATTY} SELECT message_id, true AS same FROM chatty")
def answered_stream(spark, sf_dir):
    """The same messages as a stream of files, answered batch by batch, say what the batch job says."""
    models = message_models(spark, sf_dir)
    arriving, output = new_path(spark, "arriving"), new_path(spark, "answers")
    messages = chatty(spark, sf_dir).select("message_id", "conv_id", "text")
    messages.repartition(3, "conv_id").write.parquet(arriving)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 2).parquet(arriving)
    answer_stream(stream, models, output, new_path(spark, "stream-checkpoint")).awaitTermination()
    fields = F.sha2(F.to_json(F.struct("conv_id", "text", *RESULT_FIELDS, "error"), {"ignoreNullFields": "false"}), 256)
    batch = answer_messages(messages, models).select("message_id", fields.alias("batch"))
    streamed = read_output(spark, output).select("message_id", fields.alias("streamed"))
    both = batch.join(streamed, "message_id", "full")
    return both.select("message_id", F.col("batch").eqNullSafe(F.col("streamed")).alias("same"))
