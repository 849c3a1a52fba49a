"""Messages in, answers out: score, route, retrieve, answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, functions as F

from msgflow import values
from msgflow.functions import routing
from msgflow.functions.prompting import PromptRules, user_prompt
from msgflow.functions.text import is_blank
from msgflow.operators.answers import default_answer, hook_answers
from msgflow.operators.retrieval import VectorIndex, top_k, with_documents
from msgflow.plans.knowledge import Embedder
from msgflow.plans.classifiers import (TextClassifier, UNKNOWN_LANGUAGE, predict_intent, predict_language,
                                       predict_sentiment)
from msgflow.staging import stage

RESULT_FIELDS = [
    "language", "language_confidence", "sentiment", "sentiment_confidence", "intent",
    "intent_confidence", "intent_source", "route", "retrieved_documents", "response", "escalate",
]
DOCUMENTS = ("array<struct<doc_id:bigint,instruction:string,response:string,intent:string,"
             "category:string,similarity_score:double>>")


@dataclass
class MessageModels:
    """Everything a message needs: three classifiers, the knowledge base and its vectors."""

    language: TextClassifier
    sentiment: TextClassifier
    intent: TextClassifier
    knowledge_base: DataFrame
    question_features: Embedder
    vectors: DataFrame

    @cached_property
    def index(self) -> VectorIndex:
        """The vectors made ready to search, once for all batches."""
        return VectorIndex.of(self.vectors)


def apply_blank_rule(scored: DataFrame, text: str = "text") -> DataFrame:
    """Blank messages get the fixed result whatever the models say."""
    fixed = {
        "language": F.lit(UNKNOWN_LANGUAGE), "language_confidence": F.lit(0.0),
        "sentiment": F.lit("Neutral"), "sentiment_confidence": F.lit(0.0),
        "intent": F.lit("out_of_scope"), "intent_confidence": F.lit(0.0), "intent_source": F.lit("rule"),
    }
    blank = is_blank(F.col(text))
    return scored.withColumns({c: F.when(blank, v).otherwise(F.col(c)) for c, v in fixed.items()})


def score_messages(messages: DataFrame, models: MessageModels, text: str = "text") -> DataFrame:
    """Add the seven stage results and the route; rows stay where they are."""
    out = predict_language(messages, models.language, text)
    out = predict_sentiment(out, models.sentiment, text)
    out = apply_blank_rule(predict_intent(out, models.intent, text), text)
    return out.withColumn("route", routing.route(F.col("intent"), F.col("intent_confidence"),
                                                 F.col("intent_source"), F.col("sentiment")))


def answer_scored(scored: DataFrame, knowledge_base: DataFrame, question_features: Embedder,
                  vectors: DataFrame | VectorIndex,
                  message_id: str = "message_id", text: str = "text", k: int = values.MODEL_TOP_K,
                  make_hook: Callable[..., Callable[[str], str]] | None = None,
                  hold: Callable[[DataFrame, str], DataFrame] = stage, rules: PromptRules = PromptRules()) -> DataFrame:
    """Add documents, response, escalate and error to scored messages.

    Retrieval and answers see only the messages on a knowledge route; the others
    stay where they are and are not shuffled.  A message whose text the encoder
    fails on gets the fixed apology and the error; so does no other.
    """
    on_route = F.coalesce(routing.needs_documents(F.col("route")), F.lit(False))
    none = F.lit(None).cast("string")
    rest = scored.where(~on_route).select("*", F.array().cast(DOCUMENTS).alias("retrieved_documents"),
                                          none.alias("_answer"), none.alias("error"))
    asked = question_features.arrays(scored.where(on_route).select(message_id, text), text, hold=hold)
    failed = None
    if "embedding_error" in asked.columns:
        asked = hold(asked, "asked")
        failed = asked.where(F.col("embedding_error").isNotNull()).select(message_id, F.col("embedding_error").alias("_failed"))
    documents = with_documents(top_k(asked, vectors, k, message_id), knowledge_base, message_id, hold=hold)
    grounded = scored.where(on_route).join(documents, message_id, "left").withColumn(
        "retrieved_documents", F.coalesce("retrieved_documents", F.array().cast(DOCUMENTS)))
    grounded = grounded.withColumn("_failed", none) if failed is None else grounded.join(failed, message_id, "left")
    responses = F.col("retrieved_documents.response")
    if make_hook is None:
        grounded = grounded.withColumn("_answer", default_answer(responses)).withColumn("error", none)
    else:
        grounded = hold(grounded, "grounded")
        prompts = grounded.where(F.col("_failed").isNull()).select(
            message_id, user_prompt(F.col(text), responses, F.col("sentiment")).alias("prompt"))
        answers = hook_answers(prompts, make_hook, message_id, rules=rules).withColumnRenamed("answer", "_answer")
        grounded = grounded.join(answers, message_id, "left")
    grounded = grounded.withColumn("error", F.coalesce("_failed", "error"))
    response = routing.reply(F.col("route"), F.col("intent"), is_blank(F.col(text)), F.col("_answer"))
    grounded = grounded.withColumn("response", failed_reply(response, F.col("_failed"))).drop("_failed")
    answered = grounded.unionByName(rest.withColumn("response", response))
    return answered.withColumn("escalate", routing.escalates(F.col("route"))).drop("_answer")


def answer_messages(messages: DataFrame, models: MessageModels, message_id: str = "message_id",
                    text: str = "text", k: int = values.MODEL_TOP_K,
                    make_hook: Callable[..., Callable[[str], str]] | None = None,
                    hold: Callable[[DataFrame, str], DataFrame] = stage, rules: PromptRules = PromptRules()) -> DataFrame:
    """The full result of every message, and ``error`` where the answer hook failed.

    ``hold`` keeps the scored table, so that the models run once: staged by
    default; a stream keeps a micro-batch in the cache.
    """
    scored = hold(score_messages(messages, models, text), "scored")
    answered = answer_scored(scored, models.knowledge_base, models.question_features, models.index,
                             message_id, text, k, make_hook, hold, rules)
    return answered.select(*messages.columns, *RESULT_FIELDS, "error")


def result_json(fields: list[str] | None = None) -> Column:
    """The result of a message as one JSON object, documents nested."""
    return F.to_json(F.struct(*(fields or RESULT_FIELDS)), {"ignoreNullFields": "false"})


def outcome_counts(scored: DataFrame) -> DataFrame:
    """(route, intent, language, sentiment, n)."""
    return scored.groupBy("route", "intent", "language", "sentiment").agg(F.count("*").alias("n"))


def observe_routes(scored: DataFrame, observation: Observation) -> DataFrame:
    """Count messages per route in flight; the counts arrive when the result is first used."""
    routes = ("direct", "rag", "rag_escalate", "refusal")
    return scored.observe(observation, *[F.count_if(F.col("route") == r).alias(r) for r in routes])


def contain_failures(df: DataFrame, parsed: dict[str, tuple[str, str]], error: str = "error") -> DataFrame:
    """Parse text columns; a bad value gives null and names its column in ``error``, the row stays.

    ``parsed`` maps an output column to (text column, type).
    """
    out = df.withColumns({name: F.col(source).try_cast(kind) for name, (source, kind) in parsed.items()})
    bad = [F.when(F.col(source).isNotNull() & F.col(name).isNull(), F.lit(f"bad {name}"))
           for name, (source, _) in parsed.items()]
    found = F.concat_ws("; ", *bad)
    return out.withColumn(error, F.when(found != "", found))


def failed_reply(response: Column, error: Column) -> Column:
    """The response, or the fixed apology where there is an error."""
    return F.when(error.isNotNull(), values.FAILED_REPLY).otherwise(response)
