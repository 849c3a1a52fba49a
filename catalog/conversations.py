"""V1-V4: turns, pairs, sizes, feedback."""

from pyspark.sql import functions as F

from catalog.registry import query, table
from catalog.routes import SQL_CHATTY, chatty
from msgflow.operators import conversation as C
from msgflow.staging import new_path
from msgflow.streaming import conversations as S


@query("v1_message_turns", f"""
WITH {SQL_CHATTY}, both_turns AS (
  SELECT conv_id, turn * 2 AS turn, 'user' AS role, text AS content FROM chatty UNION ALL
  SELECT conv_id, turn * 2 + 1, 'assistant', 'reply to ' || message_id FROM chatty)
SELECT conv_id, turn, role, content, NULL::VARCHAR AS feedback FROM both_turns""")
def message_turns(spark, sf_dir):
    rows = chatty(spark, sf_dir).withColumn("response", F.concat(F.lit("reply to "), F.col("message_id").cast("string")))
    return C.message_turns(rows, position="turn")


_PAIRS = """
spoken AS (SELECT *, lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS user_message FROM conversations),
pairs AS (SELECT conv_id, turn, user_message, text AS assistant_response FROM spoken WHERE role = 'assistant')"""


@query("v2_assistant_pairs", f"WITH {_PAIRS} SELECT * FROM pairs")
def assistant_pairs(spark, sf_dir):
    return C.assistant_pairs(table(spark, sf_dir, "conversations"))


@query("v2_previous_event", """
SELECT event_id, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events""")
def previous_event(spark, sf_dir):
    """Long groups: a fifth of the events each, cut into blocks."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("event_id").alias("value"))
    return C.previous_value(events, "event_type", "event_id", "value", "before", block=500).select("event_id", "before")


@query("v3_conversation_sizes", "SELECT conv_id, count(*) AS n_messages FROM conversations GROUP BY conv_id")
def conversation_sizes(spark, sf_dir):
    return C.conversation_sizes(table(spark, sf_dir, "conversations"))


SQL_FEEDBACK = f"""{_PAIRS},
feedback AS (SELECT '2024-01-01 00:00:00' AS timestamp, user_message, assistant_response, CASE WHEN turn % 4 = 1 THEN 'en' ELSE '' END AS language,
  CASE WHEN turn % 4 = 1 THEN 'Neutral' ELSE '' END AS sentiment, CASE WHEN turn % 4 = 1 THEN 'review' ELSE '' END AS intent,
  CASE WHEN turn % 4 = 1 THEN 'rag' ELSE '' END AS route, CASE WHEN conv_id % 3 = 0 THEN 'down' ELSE 'up' END AS feedback FROM pairs)"""


def feedback(spark, sf_dir):
    """A vote on every assistant turn; only some turns have result fields on record."""
    turns = table(spark, sf_dir, "conversations")
    pairs = C.assistant_pairs(turns)
    votes = pairs.select("conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, "down").otherwise("up").alias("feedback"))
    known = lambda value, name: F.when(F.col("turn") % 4 == 1, value).alias(name)
    results = pairs.select("conv_id", "turn", known("en", "language"), known("Neutral", "sentiment"),
                           known("review", "intent"), known("rag", "route"))
    return C.feedback_records(pairs, results, votes, ["conv_id", "turn"], F.lit("2024-01-01 00:00:00"))


@query("v4_feedback_records", f"WITH {SQL_FEEDBACK} SELECT * FROM feedback")
def feedback_records(spark, sf_dir):
    return feedback(spark, sf_dir)


def tracked(spark, sf_dir):
    """The turns as a stream of three batches, out of order: late ones come last, and every seventh comes twice."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    arriving, output = new_path(spark, "turns"), new_path(spark, "tracked")
    late = (F.col("turn") * 5 + F.col("conv_id")) % 3
    for i in (2, 0, 1):
        part = turns.where(late == i)
        part.unionByName(turns.where((F.col("turn") + F.col("conv_id")) % 7 == 0)).coalesce(1).write.mode("append").parquet(arriving)
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    S.track_conversations(stream, output, new_path(spark, "tracked-checkpoint")).awaitTermination()
    return output


@query("v2_streamed_pairs", f"WITH {_PAIRS} SELECT * FROM pairs")
def streamed_pairs(spark, sf_dir):
    return S.current_pairs(spark, tracked(spark, sf_dir))


@query("v3_streamed_sizes", "SELECT conv_id, count(*) AS n_messages FROM conversations GROUP BY conv_id")
def streamed_sizes(spark, sf_dir):
    return S.current_sizes(spark, tracked(spark, sf_dir))
