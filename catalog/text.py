"""M1-M7: cleaning, filters and label maps."""

from pyspark.sql import functions as F

from catalog.registry import (SQL_DECORATED, decorated, query, sql_clean_intent, sql_clean_language, sql_map,
                              sql_text, table)
from msgflow import values
from msgflow.functions import text as X
from msgflow.operators import prepare


@query("m1_clean_language", f"""
WITH {SQL_DECORATED} SELECT doc_id, {sql_clean_language('text')} AS text FROM decorated""")
def clean_language(spark, sf_dir):
    return decorated(table(spark, sf_dir, "documents")).select(
        "doc_id", X.clean_language_text(F.col("text")).alias("text"))


@query("m2_clean_intent", f"""
WITH {SQL_DECORATED} SELECT doc_id, {sql_clean_intent('text')} AS text FROM decorated""")
def clean_intent(spark, sf_dir):
    return decorated(table(spark, sf_dir, "documents")).select(
        "doc_id", X.clean_intent_text(F.col("text")).alias("text"))


@query("m3_drop_empty_rows", f"""
WITH {SQL_DECORATED}
SELECT doc_id, text FROM (SELECT doc_id, {sql_clean_language('text')} AS text FROM decorated) WHERE length(text) > 0""")
def drop_empty_rows(spark, sf_dir):
    return prepare.clean_rows(decorated(table(spark, sf_dir, "documents")).select("doc_id", "text"))


_EMOTIONS = sql_map("label", dict(enumerate(values.EMOTIONS)))
_SENTIMENTS = sql_map("emotion", values.EMOTION_SENTIMENT)
_SENTIMENT_IDS = sql_map("sentiment", {s: i for i, s in enumerate(values.SENTIMENTS)})


@query("m4_map_emotions", f"""
WITH a AS (SELECT event_id, (event_id % 7)::INT AS label FROM events),
b AS (SELECT *, {_EMOTIONS} AS emotion FROM a),
c AS (SELECT *, {_SENTIMENTS} AS sentiment FROM b)
SELECT *, {_SENTIMENT_IDS} AS sentiment_id FROM c""")
def map_emotions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7).cast("int").alias("label"))
    return prepare.map_emotions(events)


PRIORITY_MAP = {"1-URGENT": "complaint", "2-HIGH": "order_status", "3-MEDIUM": "order_management",
                "4-NOT SPECIFIED": "out_of_scope", "5-LOW": "account_management"}


@query("m5_map_intents", f"""
SELECT o_orderkey, o_orderpriority, {sql_map('o_orderpriority', PRIORITY_MAP)} AS routing_intent FROM orders""")
def map_intents(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return prepare.map_intents(orders, "o_orderpriority", PRIORITY_MAP)


@query("m5_unmapped_values", """
SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'click')""")
def unmapped_values(spark, sf_dir):
    return prepare.unmapped_values(table(spark, sf_dir, "events"), "event_type", {"view": "a", "click": "b"})


@query("m6_normalise_placeholders", f"""
WITH {SQL_DECORATED}
SELECT doc_id, regexp_replace(text, '\\{{\\{{.*?\\}}\\}}', {sql_text(values.PLACEHOLDER_TOKEN)}, 'g') AS text FROM decorated""")
def normalise_placeholders(spark, sf_dir):
    return decorated(table(spark, sf_dir, "documents")).select(
        "doc_id", X.normalise_placeholders(F.col("text")).alias("text"))


@query("m7_blank_guard", f"""
WITH {SQL_DECORATED}
SELECT doc_id, coalesce({sql_clean_intent('text')}, '') = '' AS blank FROM decorated""")
def blank_guard(spark, sf_dir):
    return decorated(table(spark, sf_dir, "documents")).select("doc_id", X.is_blank(F.col("text")).alias("blank"))
