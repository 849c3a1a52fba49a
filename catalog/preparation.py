"""Dedupe, ids, splits, augmentation, leakage."""

from pyspark.sql import functions as F

from catalog.registry import (query, sql_clean_intent, sql_clean_language, sql_draw, sql_text, sql_vote, table, vote)
from msgflow import values
from msgflow.examples import INTENT_EXAMPLES, SENTIMENT_EXAMPLES, intent_examples, sentiment_examples
from msgflow.functions.text import clean_intent_text
from msgflow.operators import prepare
from msgflow.sources.tables import add_sentiment_examples, pairs_from_turns

# ------------------------------------------------- pairs and knowledge base


RAW_INTENTS = list(values.RAW_INTENT_ROUTING)


def pairs(spark, sf_dir):
    """Question/answer pairs out of the conversations; intent and category stand in."""
    turns = pairs_from_turns(table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))
    number = (F.col("conv_id") % len(RAW_INTENTS) + 1).cast("int")
    return turns.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("id"), "instruction", "response",
                        F.element_at(F.array(*[F.lit(x) for x in RAW_INTENTS]), number).alias("intent"),
                        F.upper(vote(F.col("instruction"))).alias("category"))


_LISTED = "[" + ", ".join(sql_text(x) for x in RAW_INTENTS) + "]"
SQL_PAIRS = f"""
spoken AS (SELECT *, lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
pairs AS (
  SELECT conv_id * 1000000 + turn AS id, before AS instruction, text AS response,
         ({_LISTED})[(conv_id % {len(RAW_INTENTS)} + 1)::INT] AS intent, upper({sql_vote('before')}) AS category
  FROM spoken WHERE role = 'assistant')"""
SQL_KB = f"""{SQL_PAIRS},
kept AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY {sql_clean_intent('instruction')} ORDER BY id) = 1),
kb AS (SELECT row_number() OVER (ORDER BY id) - 1 AS doc_id, instruction, response, intent, category FROM kept)"""


@query("d1_keep_first", f"""
WITH t AS (SELECT doc_id, lang, {sql_clean_intent('text')} AS text FROM documents)
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def keep_first(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", clean_intent_text(F.col("text")).alias("text"))
    return prepare.keep_first(documents, "text", "doc_id")


@query("d1_duplicate_counts", f"""
SELECT count(*) AS n_before, count(DISTINCT text) AS n_after, count(*) - count(DISTINCT text) AS n_dropped
FROM (SELECT {sql_clean_intent('text')} AS text FROM documents)""")
def duplicate_counts(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(clean_intent_text(F.col("text")).alias("text"))
    return prepare.duplicate_counts(documents, "text")


@query("d2_knowledge_base", f"WITH {SQL_KB} SELECT * FROM kb")
def knowledge_base(spark, sf_dir):
    return prepare.build_knowledge_base(pairs(spark, sf_dir))


@query("d2_dense_ids", """
SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS doc_id, o_orderkey FROM orders""")
def dense_ids(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return prepare.dense_ids(orders, ["o_totalprice", "o_orderkey"]).select("doc_id", "o_orderkey")


# -------------------------------------------------------------------- splits


def sql_split(source: str, id_col: str, label: str, seed: int = 42) -> str:
    """CTEs that end in split_rows: every row of ``source`` with its split."""
    return f"""
sizes AS (SELECT {label} AS c, count(*)::BIGINT AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM {source} GROUP BY 1),
tests AS (SELECT *, ceil(0.15::DOUBLE * total)::BIGINT AS want FROM sizes),
tests2 AS (SELECT *, want * n // total AS base, want * n % total AS rest FROM tests),
tests3 AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, c) <= want - sum(base) OVER () THEN 1 ELSE 0 END AS n_test FROM tests2),
vals AS (SELECT c, n_test, n - n_test AS n, total - want AS total, ceil(0.15::DOUBLE / (1 - 0.15::DOUBLE) * (total - want))::BIGINT AS want FROM tests3),
vals2 AS (SELECT *, want * n // total AS base, want * n % total AS rest FROM vals),
quotas AS (SELECT c, n_test, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, c) <= want - sum(base) OVER () THEN 1 ELSE 0 END AS n_val FROM vals2),
placed AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}:' || {id_col}::VARCHAR), {id_col}) AS place FROM {source}),
split_rows AS (
  SELECT s.* EXCLUDE (place), CASE WHEN place <= n_test THEN 'test' WHEN place <= n_test + n_val THEN 'val' ELSE 'train' END AS split
  FROM placed s JOIN quotas q ON s.{label} = q.c)"""


def split_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    return prepare.stratified_split(documents, "doc_id", "lang")


SQL_DOCUMENTS = "docs AS (SELECT doc_id, text, lang FROM documents)"
SQL_SPLIT_DOCUMENTS = f"{SQL_DOCUMENTS}, {sql_split('docs', 'doc_id', 'lang')}"


@query("d3_stratified_split", f"WITH {SQL_SPLIT_DOCUMENTS} SELECT doc_id, lang, split FROM split_rows")
def stratified_split(spark, sf_dir):
    return split_documents(spark, sf_dir).select("doc_id", "lang", "split")


@query("d3_split_events", f"""
WITH {sql_split('events', 'event_id', 'event_type')} SELECT event_type, split, count(*) AS n, min(event_id) AS first_id,
 sum(event_id)::BIGINT AS sum_id FROM split_rows GROUP BY ALL""")
def split_events(spark, sf_dir):
    events = prepare.stratified_split(table(spark, sf_dir, "events"), "event_id", "event_type")
    return events.groupBy("event_type", "split").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.sum("event_id").alias("sum_id"))


# -------------------------------------------------------------- augmentation


def sql_examples(examples: dict, label: str) -> str:
    rows = ", ".join(f"({sql_text(t)}, {sql_text(c)})" for c, texts in examples.items() for t in texts)
    return f"examples AS (SELECT * FROM (VALUES {rows}) AS e(text, {label}))"


@query("d4_training_examples", f"""
WITH {SQL_SPLIT_DOCUMENTS}, {sql_examples(INTENT_EXAMPLES, 'lang')}
SELECT doc_id, text, lang, split FROM split_rows UNION ALL SELECT NULL, text, lang, 'train' FROM examples""")
def training_examples(spark, sf_dir):
    examples = intent_examples(spark).withColumnRenamed("routing_intent", "lang")
    return prepare.add_training_examples(split_documents(spark, sf_dir), examples)


_EMOTION_ROWS = """
SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN 'sadness' WHEN 1 THEN 'joy' WHEN 2 THEN 'love' WHEN 3 THEN 'anger'
  WHEN 4 THEN 'fear' ELSE 'surprise' END AS emotion, split FROM split_rows"""
_SENTIMENT = """CASE WHEN emotion IN ('sadness', 'anger', 'fear') THEN 'Negative/Frustrated' WHEN emotion = 'surprise'
  THEN 'Neutral' ELSE 'Positive/Satisfied' END"""
_SENTIMENT_ID = "CASE sentiment WHEN 'Negative/Frustrated' THEN 0 WHEN 'Neutral' THEN 1 ELSE 2 END"


@query("d5_sentiment_examples", f"""
WITH {SQL_SPLIT_DOCUMENTS}, {sql_examples(SENTIMENT_EXAMPLES, 'sentiment')}, mapped AS ({_EMOTION_ROWS}),
named AS (SELECT doc_id, text, emotion, {_SENTIMENT} AS sentiment, split FROM mapped
  UNION ALL SELECT NULL, text, 'synthetic', sentiment, 'train' FROM examples)
SELECT *, {_SENTIMENT_ID} AS sentiment_id FROM named""")
def sentiment_rows(spark, sf_dir):
    rows = split_documents(spark, sf_dir).withColumn("label", F.col("doc_id") % 6)
    rows = prepare.map_emotions(rows).select("doc_id", "text", "emotion", "sentiment", "sentiment_id", "split")
    return add_sentiment_examples(rows, sentiment_examples(spark))


_N = "len(w)"


@query("d6_short_spans", f"""
WITH split_words AS (
  SELECT doc_id, lang, list_filter(string_split({sql_clean_language('text')}, ' '), lambda x: x <> '') AS w FROM documents),
spans AS (SELECT *, unnest([1, 2]) AS span_no FROM split_words WHERE {_N} > 2),
sized AS (SELECT *, 2 + {sql_draw(42, 'length', 'doc_id', 'span_no')} % (least(6, {_N}) - 2 + 1) AS n FROM spans),
begun AS (SELECT *, CASE WHEN {sql_draw(42, 'front', 'doc_id', 'span_no')} / 4294967296.0::DOUBLE < 0.6::DOUBLE THEN 0
  ELSE {sql_draw(42, 'start', 'doc_id', 'span_no')} % ({_N} - n + 1) END AS s FROM sized)
SELECT doc_id, span_no, array_to_string(list_slice(w, s + 1, s + n), ' ') AS text, lang FROM begun""")
def short_spans(spark, sf_dir):
    documents = prepare.clean_rows(table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))
    return prepare.short_spans(documents, "doc_id", "text", "lang", spans_per_row=2)


# ------------------------------------------------------------------- leakage


@query("d7_split_uniqueness", f"""
WITH {SQL_SPLIT_DOCUMENTS} SELECT split, count(*) AS n_rows, count(DISTINCT text) AS n_texts FROM split_rows GROUP BY split""")
def split_uniqueness(spark, sf_dir):
    return prepare.split_uniqueness(split_documents(spark, sf_dir))


@query("d8_split_overlap", f"""
WITH {SQL_SPLIT_DOCUMENTS},
 s AS (SELECT DISTINCT split, text FROM split_rows)
SELECT (SELECT count(*) FROM s a JOIN s b ON a.text = b.text WHERE a.split = 'train' AND b.split = 'test') AS train_test,
       (SELECT count(*) FROM s a JOIN s b ON a.text = b.text WHERE a.split = 'train' AND b.split = 'val') AS train_val""")
def split_overlap(spark, sf_dir):
    return prepare.split_overlap(split_documents(spark, sf_dir))


@query("d8_shared_texts", """
SELECT text FROM documents INTERSECT SELECT text FROM conversations UNION
(SELECT text FROM documents INTERSECT SELECT text FROM benchmark)""")
def shared_texts(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    others = table(spark, sf_dir, "conversations").select("text").unionByName(
        table(spark, sf_dir, "benchmark").select("text"))
    return prepare.shared_texts(documents, others)


def _templated(split_rows):
    """Texts with the row's number as a placeholder, so that copies differ until it is normalised."""
    text = F.concat(F.lit("order {{No "), F.col("doc_id").cast("string"), F.lit("}} about "), F.col("text"))
    return split_rows.withColumn("text", text)


@query("d9_template_overlap", f"""
WITH {SQL_SPLIT_DOCUMENTS},
 s AS (SELECT DISTINCT split, regexp_replace('order {{{{No ' || doc_id || '}}}} about ' || text, '\\{{\\{{.*?\\}}\\}}',
   {sql_text(values.PLACEHOLDER_TOKEN)}, 'g') AS text FROM split_rows WHERE split <> 'val'),
 n AS (SELECT count(*) FILTER (split = 'train') AS train_templates, count(*) FILTER (split = 'test') AS test_templates,
   (SELECT count(*) FROM s a JOIN s b ON a.text = b.text AND a.split = 'train' AND b.split = 'test') AS shared_templates FROM s)
SELECT *, round(shared_templates * 100.0::DOUBLE / test_templates, 1) AS shared_percent FROM n""")
def template_overlap(spark, sf_dir):
    return prepare.template_overlap(_templated(split_documents(spark, sf_dir)))
