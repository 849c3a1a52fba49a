"""Prompts, answers and whole results, over messages routed by rule."""

from pyspark.sql import functions as F

from catalog.features import sql_weights, sql_word_terms
from catalog.preparation import SQL_KB
from catalog.registry import query, sql_text
from catalog.retrieval import SQL_KB_WEIGHTS, knowledge_base
from catalog.routes import SQL_DIRECT, SQL_RULED, chatty, ruled
from msgflow import values
from msgflow.functions.prompting import PromptRules, SYSTEM_RULES, user_prompt
from msgflow.operators.answers import EncoderFeatures
from msgflow.plans.knowledge import build_vectors
from msgflow.plans.message_flow import RESULT_FIELDS, answer_scored, result_json
from msgflow.staging import stage


def answered(spark, sf_dir, make_hook=None, **options):
    """Messages routed by rule, answered from the knowledge base of the conversations."""
    kb = knowledge_base(spark, sf_dir)
    features, vectors = build_vectors(kb)
    scored = stage(ruled(chatty(spark, sf_dir)), "ruled")
    return answer_scored(scored, kb, features, vectors, make_hook=make_hook, **options)


SQL_ANSWERED = f"""{SQL_RULED}, {SQL_KB_WEIGHTS},
asked AS (SELECT * FROM ruled WHERE route IN ('rag', 'rag_escalate')),
{sql_word_terms('asked', 'message_id', 'text', 'asked_terms')}, {sql_weights('asked_terms', False, 'asked_weights')},
met AS (SELECT a.id AS message_id, k.id AS doc_id, sum(a.weight * k.weight) AS s FROM asked_weights a JOIN kb_weights k ON a.term = k.term GROUP BY 1, 2),
scored AS (SELECT a.message_id, k.doc_id, instruction, response, round(coalesce(s, 0.0::DOUBLE), 6) AS similarity_score
  FROM asked a CROSS JOIN kb k LEFT JOIN met m ON m.message_id = a.message_id AND m.doc_id = k.doc_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY similarity_score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 3),
found AS (SELECT message_id, count(*) AS n_docs, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids,
  max(similarity_score) AS best_score, max(response) FILTER (rank = 1) AS answer,
  string_agg('[Support response ' || rank || ']' || chr(10) || response, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY 1),
answered AS (SELECT r.*, coalesce(n_docs, 0) AS n_docs, coalesce(doc_ids, '') AS doc_ids, best_score, answer, context,
  CASE route WHEN 'direct' THEN {SQL_DIRECT} WHEN 'rag' THEN answer WHEN 'rag_escalate' THEN answer || {sql_text(values.ESCALATION_NOTICE)}
    ELSE CASE WHEN trim(text) = '' THEN {sql_text(values.BLANK_REPLY)} ELSE {sql_text(values.REFUSAL_REPLY)} END END AS response,
  route = 'rag_escalate' AS escalate FROM ruled r LEFT JOIN found f ON f.message_id = r.message_id)"""


@query("c5_user_prompts", f"""
WITH {SQL_ANSWERED} SELECT message_id, 'Context (retrieved past support responses):' || chr(10) || coalesce(context, {sql_text(values.NO_CONTEXT)})
  || chr(10) || chr(10) || 'Detected customer sentiment: ' || sentiment || chr(10) || 'Customer question: "' || text || '"' || chr(10) AS prompt
FROM answered""")
def user_prompts(spark, sf_dir):
    rows = answered(spark, sf_dir)
    return rows.select("message_id", user_prompt(F.col("text"), F.col("retrieved_documents.response"),
                                                 F.col("sentiment")).alias("prompt"))


@query("c6_default_answers", f"WITH {SQL_ANSWERED} SELECT message_id, response FROM answered WHERE route IN ('rag', 'rag_escalate')")
def default_answers(spark, sf_dir):
    return answered(spark, sf_dir).where(F.col("route").isin("rag", "rag_escalate")).select("message_id", "response")


SQL_PROMPTS = f"""{SQL_ANSWERED}, prompted AS (SELECT *, 'Context (retrieved past support responses):' || chr(10) || coalesce(context, {sql_text(values.NO_CONTEXT)})
  || chr(10) || chr(10) || 'Detected customer sentiment: ' || sentiment || chr(10) || 'Customer question: "' || text || '"' || chr(10) AS prompt
  FROM answered WHERE route IN ('rag', 'rag_escalate'))"""


@query("c6_hook_answers", f"""
WITH {SQL_PROMPTS} SELECT message_id, CASE WHEN contains(prompt, 'ç') THEN {sql_text(values.ANSWER_FALLBACK)} ELSE length(prompt) || ' characters' END
  || CASE WHEN escalate THEN {sql_text(values.ESCALATION_NOTICE)} ELSE '' END AS response,
  CASE WHEN contains(prompt, 'ç') THEN 'cannot answer' END AS error FROM prompted""")
def hooked_answers(spark, sf_dir):
    """The prompts that the flow builds go to the hook, and its answers into the replies."""
    def make_hook():  # inside the query, so that executors need not import this module
        def answer(prompt):
            if "ç" in prompt:
                raise ValueError("cannot answer")
            return f"{len(prompt)} characters"
        return answer

    rows = answered(spark, sf_dir, make_hook)
    return rows.where(F.col("route").isin("rag", "rag_escalate")).select("message_id", "response", "error")


@query("c6_ruled_answers", f"""
WITH {SQL_PROMPTS} SELECT message_id, length({sql_text(SYSTEM_RULES)}) || ' + ' || length(prompt) || ' at 0.5'
  || CASE WHEN escalate THEN {sql_text(values.ESCALATION_NOTICE)} ELSE '' END AS response FROM prompted""")
def ruled_answers(spark, sf_dir):
    """The hook gets the system text and the temperature with the prompts."""
    def make_hook(rules):
        return lambda prompt: f"{len(rules.system)} + {len(prompt)} at {rules.temperature}"

    rows = answered(spark, sf_dir, make_hook, rules=PromptRules(temperature=0.5))
    return rows.where(F.col("route").isin("rag", "rag_escalate")).select("message_id", "response")


SQL_ENCODED = f"""{SQL_RULED}, {SQL_KB},
sized AS (SELECT doc_id, length(instruction)::DOUBLE AS a, length(regexp_replace(lower(instruction), '[^aeiou]', '', 'g'))::DOUBLE AS b FROM kb),
known AS (SELECT doc_id, a / sqrt(a * a + b * b + 1) AS x, b / sqrt(a * a + b * b + 1) AS y, 1 / sqrt(a * a + b * b + 1) AS z FROM sized),
asked_sized AS (SELECT *, length(text)::DOUBLE AS a, length(regexp_replace(lower(text), '[^aeiou]', '', 'g'))::DOUBLE AS b FROM ruled WHERE route IN ('rag', 'rag_escalate')),
asked AS (SELECT *, a / sqrt(a * a + b * b + 1) AS x, b / sqrt(a * a + b * b + 1) AS y, 1 / sqrt(a * a + b * b + 1) AS z FROM asked_sized WHERE NOT contains(text, 'ç')),
met AS (SELECT message_id, k.doc_id, round(asked.x * k.x + asked.y * k.y + asked.z * k.z, 6) AS s FROM asked CROSS JOIN known k),
hits AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY s DESC, doc_id) AS rank FROM met QUALIFY rank <= 3),
found AS (SELECT message_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids FROM hits GROUP BY 1)"""


@query("c7_encoder_flow", f"""
WITH {SQL_ENCODED} SELECT r.message_id, r.route, coalesce(doc_ids, '') AS doc_ids, contains(text, 'ç') AND r.route IN ('rag', 'rag_escalate') AS failed,
  CASE WHEN contains(text, 'ç') AND r.route IN ('rag', 'rag_escalate') THEN 'no ç please' END AS error FROM ruled r LEFT JOIN found USING (message_id)""")
def encoder_flow(spark, sf_dir):
    """A stand-in encoder, text -> (characters, vowels, 1), that fails on a ç: such a message gets the apology, the others go on."""
    def make_encoder():
        return lambda texts: [[len(t), sum(c in "aeiou" for c in t.lower()), 1.0] for t in texts]

    def make_strict_encoder():
        def encode(texts):
            if any("ç" in t for t in texts):
                raise ValueError("no ç please")
            return [[len(t), sum(c in "aeiou" for c in t.lower()), 1.0] for t in texts]
        return encode

    kb = knowledge_base(spark, sf_dir)
    _, vectors = build_vectors(kb, EncoderFeatures(make_encoder))
    scored = stage(ruled(chatty(spark, sf_dir)), "ruled")
    rows = answer_scored(scored, kb, EncoderFeatures(make_strict_encoder), vectors)
    return rows.select("message_id", "route", F.array_join(F.col("retrieved_documents.doc_id").cast("array<string>"), ",").alias("doc_ids"),
                       (F.col("response") == values.FAILED_REPLY).alias("failed"), "error")


@query("c7_answer_scored", f"""
WITH {SQL_ANSWERED} SELECT message_id, intent, intent_confidence, intent_source, sentiment, route, n_docs, doc_ids, best_score,
  response, escalate FROM answered""")
def answer_by_rule(spark, sf_dir):
    docs = F.col("retrieved_documents")
    return answered(spark, sf_dir).select(
        "message_id", "intent", "intent_confidence", "intent_source", "sentiment", "route",
        F.size(docs).cast("bigint").alias("n_docs"), F.array_join(docs["doc_id"].cast("array<string>"), ",").alias("doc_ids"),
        F.array_max(docs["similarity_score"]).alias("best_score"), "response", "escalate")


@query("c8_result_json", f"""
WITH {SQL_ANSWERED} SELECT message_id, 'en' AS language, 0.5::DOUBLE AS language_confidence, sentiment, 0.25::DOUBLE AS sentiment_confidence,
  intent, intent_confidence, intent_source, route, response, escalate, n_docs, doc_ids, best_score FROM answered""")
def result_as_json(spark, sf_dir):
    """Serialise every result, all eleven fields, then read them back out of the JSON."""
    rows = answered(spark, sf_dir).withColumns({"language": F.lit("en"), "language_confidence": F.lit(0.5),
                                                "sentiment_confidence": F.lit(0.25)})
    rows = rows.select("message_id", result_json().alias("json"))
    back = F.from_json("json", "language string, language_confidence double, sentiment string, sentiment_confidence double, intent string, "
                               "intent_confidence double, intent_source string, route string, "
                               "retrieved_documents array<struct<doc_id:bigint,similarity_score:double>>, response string, escalate boolean")
    documents = F.col("r.retrieved_documents")
    return rows.select("message_id", back.alias("r")).select(
        "message_id", *[f"r.{c}" for c in RESULT_FIELDS if c != "retrieved_documents"], F.size(documents).cast("bigint").alias("n_docs"),
        F.array_join(documents["doc_id"].cast("array<string>"), ",").alias("doc_ids"),
        F.array_max(documents["similarity_score"]).alias("best_score"))
