"""The small-talk rule, routes, replies, failures, counts, the stream."""

from pyspark.sql import functions as F

from catalog.registry import WORD, query, sql_clean_intent, sql_draw, sql_map, sql_text, table
from msgflow import values
from msgflow.functions import routing
from msgflow.functions.draws import draw
from msgflow.functions.smalltalk import small_talk
from msgflow.functions.text import clean_intent_text
from msgflow.operators.prepare import mapped
from msgflow.plans.message_flow import contain_failures, failed_reply, outcome_counts
from msgflow.staging import new_path
from msgflow.sources.commits import read_committed
from msgflow.streaming.counts import OutcomeListener, landed_counts, observe_outcomes
from msgflow.streaming.messages import quarantine_stream, read_output, replay_failed, start_stream

# --------------------------------------------------------------- small talk

OPENINGS = ["Hi there! ", "Good  morning, ", "Thanks a lot — ", "bye bye ", "THANK YOU so much", "See you later, folks",
            "hello thanks", "Take care & goodbye", "thanks, you're great", "hi", ""]
ALONE = 3        # every third message comes again as its opening and nothing else,
LATER = 500_000  # so many turns later


def chatty(spark, sf_dir):
    """User turns, most of them after some small talk, and added ones that are nothing but small talk, by (conv_id, turn)."""
    turns = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]).where(F.col("role") == "user")
    n = F.col("conv_id") * 7 + F.col("turn")
    opening = F.element_at(F.array(*[F.lit(x) for x in OPENINGS]), (n % len(OPENINGS) + 1).cast("int"))
    whole = turns.select("conv_id", "turn", F.concat(opening, F.col("text")).alias("text"))
    alone = turns.where(n % ALONE == 0).select("conv_id", (F.col("turn") + LATER).alias("turn"), opening.alias("text"))
    return whole.unionByName(alone).select((F.col("conv_id") * 1000000 + F.col("turn")).alias("message_id"), "conv_id", "turn", "text")


_N = "(conv_id * 7 + turn)"
_OPENING = f"([{', '.join(sql_text(x) for x in OPENINGS)}])[({_N} % {len(OPENINGS)} + 1)::INT]"
SQL_CHATTY = f"""chatty AS (SELECT conv_id * 1000000 + turn AS message_id, conv_id, turn, {_OPENING} || text AS text FROM conversations WHERE role = 'user'
  UNION ALL SELECT conv_id * 1000000 + turn + {LATER}, conv_id, turn + {LATER}, {_OPENING} FROM conversations WHERE role = 'user' AND {_N} % {ALONE} = 0)"""


def sql_small_talk(text: str) -> str:
    """DuckDB knows no look-around; its word boundary is ASCII, which the test texts allow."""
    allowed = "[" + ", ".join(sql_text(w) for w in values.SMALL_TALK_FILLERS) + "]"
    whens = []
    for label, template in values.SMALL_TALK_PATTERNS.items():
        regex = template.replace("{s}", r"\s").replace("{b}", r"\b").replace("{e}", r"\b")
        rest = f"regexp_extract_all(regexp_replace({text}, '{regex}', '', 'g'), '{WORD}+')"
        whens.append(f"WHEN regexp_matches({text}, '{regex}') AND len(list_filter({rest}, "
                     f"lambda w: NOT list_contains({allowed}, w))) = 0 THEN '{label}'")
    return f"CASE {' '.join(whens)} END"


@query("f11_small_talk", f"""
WITH {SQL_CHATTY}, cleaned AS (SELECT message_id, {sql_clean_intent('text')} AS text FROM chatty)
SELECT message_id, {sql_small_talk('text')} AS small_talk FROM cleaned""")
def small_talk_rule(spark, sf_dir):
    return chatty(spark, sf_dir).select("message_id", small_talk(clean_intent_text(F.col("text"))).alias("small_talk"))


# -------------------------------------------------------------------- routes

EVENT_INTENTS = {"view": "order_status", "click": "greeting", "error": "complaint", "purchase": "billing_and_refunds",
                 "signup": "out_of_scope"}


def predictions(spark, sf_dir):
    """One made prediction per event; every branch and both thresholds occur."""
    n = draw(1, "sentiment", F.col("event_id")) % 4
    sentiment = F.element_at(F.array(*[F.lit(s) for s in values.SENTIMENTS]), F.least(n + 1, F.lit(3)).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", mapped(F.col("event_type"), EVENT_INTENTS).alias("intent"),
        F.when(F.col("event_id") % 11 != 0, (draw(1, "confidence", F.col("event_id")) % 21) * 5 / F.lit(100.0)).alias("confidence"),
        F.when(draw(1, "source", F.col("event_id")) % 5 == 0, "rule").otherwise("model").alias("source"),
        F.when(F.col("event_id") % 13 != 0, sentiment).alias("sentiment"))


SQL_PREDICTIONS = f"""predictions AS (SELECT event_id, {sql_map('event_type', EVENT_INTENTS)} AS intent,
  CASE WHEN event_id % 11 <> 0 THEN ({sql_draw(1, 'confidence', 'event_id')} % 21) * 5 / 100.0::DOUBLE END AS confidence,
  CASE WHEN {sql_draw(1, 'source', 'event_id')} % 5 = 0 THEN 'rule' ELSE 'model' END AS source,
  CASE WHEN event_id % 13 <> 0 THEN CASE {sql_draw(1, 'sentiment', 'event_id')} % 4 WHEN 0 THEN 'Negative/Frustrated'
    WHEN 1 THEN 'Neutral' ELSE 'Positive/Satisfied' END END AS sentiment FROM events)"""


def sql_route(intent="intent", confidence="confidence", source="source", sentiment="sentiment") -> str:
    sure = f"coalesce({confidence}, 0.0::DOUBLE)"
    acting = (f"CASE WHEN {source} IS DISTINCT FROM 'model' OR {sure} >= {values.CONFIDENT}::DOUBLE OR {intent} = 'complaint' THEN {intent} "
              f"WHEN {sure} >= {values.NOISE_FLOOR}::DOUBLE AND {sentiment} IS NOT DISTINCT FROM 'Negative/Frustrated' THEN 'complaint' "
              f"ELSE 'out_of_scope' END")
    return (f"CASE WHEN ({acting}) IN ('greeting', 'goodbye', 'gratitude') THEN 'direct' WHEN ({acting}) = 'complaint' THEN 'rag_escalate' "
            f"WHEN ({acting}) IN ('order_status', 'order_management', 'billing_and_refunds', 'account_management') THEN 'rag' ELSE 'refusal' END")


def routed(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn(
        "route", routing.route(F.col("intent"), F.col("confidence"), F.col("source"), F.col("sentiment")))


SQL_ROUTED = f"{SQL_PREDICTIONS}, routed AS (SELECT *, {sql_route()} AS route FROM predictions)"


@query("c1_route_decision", f"WITH {SQL_ROUTED} SELECT event_id, intent, confidence, source, sentiment, route FROM routed")
def route_decision(spark, sf_dir):
    return routed(spark, sf_dir)


_DIRECT = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in values.DIRECT_REPLIES.items())
SQL_DIRECT = f"CASE intent {_DIRECT} ELSE {sql_text(values.DIRECT_DEFAULT)} END"


@query("c2_direct_replies", f"WITH {SQL_ROUTED} SELECT event_id, {SQL_DIRECT} AS reply FROM routed")
def direct_replies(spark, sf_dir):
    return routed(spark, sf_dir).select("event_id", routing.direct_reply(F.col("intent")).alias("reply"))


@query("c3_refusal_replies", f"""
WITH {SQL_ROUTED} SELECT event_id, CASE WHEN sentiment IS NULL THEN {sql_text(values.BLANK_REPLY)} ELSE {sql_text(values.REFUSAL_REPLY)} END AS reply
FROM routed WHERE route = 'refusal'""")
def refusal_replies(spark, sf_dir):
    rows = routed(spark, sf_dir).where(F.col("route") == "refusal")
    return rows.select("event_id", routing.refusal_reply(F.col("sentiment").isNull()).alias("reply"))


@query("c4_escalation", f"""
WITH {SQL_ROUTED} SELECT event_id, route = 'rag_escalate' AS escalate,
  CASE WHEN route = 'rag_escalate' THEN 'answer ' || event_id || {sql_text(values.ESCALATION_NOTICE)} ELSE 'answer ' || event_id END AS answer
FROM routed""")
def escalation(spark, sf_dir):
    answer = F.concat(F.lit("answer "), F.col("event_id").cast("string"))
    return routed(spark, sf_dir).select("event_id", routing.escalates(F.col("route")).alias("escalate"),
                                        routing.with_notice(answer, F.col("route")).alias("answer"))


# ------------------------------------------------------ failures and counts


@query("c9_contained_failures", f"""
WITH {SQL_PREDICTIONS},
raw AS (SELECT event_id, intent, source, sentiment, CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE confidence::VARCHAR END AS said FROM predictions),
parsed AS (SELECT *, try_cast(said AS DOUBLE) AS confidence FROM raw),
checked AS (SELECT *, CASE WHEN said IS NOT NULL AND confidence IS NULL THEN 'bad confidence' END AS error FROM parsed)
SELECT event_id, confidence, error, CASE WHEN error IS NULL THEN {sql_route()} ELSE {sql_text(values.FAILED_REPLY)} END AS outcome FROM checked""")
def contained_failures(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumnRenamed("confidence", "known")
    rows = rows.withColumn("said", F.when(F.col("event_id") % 17 == 0, "n/a").otherwise(F.col("known").cast("string")))
    rows = contain_failures(rows, {"confidence": ("said", "double")})
    outcome = routing.route(F.col("intent"), F.col("confidence"), F.col("source"), F.col("sentiment"))
    return rows.select("event_id", "confidence", "error", failed_reply(outcome, F.col("error")).alias("outcome"))


@query("c10_outcome_counts", f"""
WITH {SQL_ROUTED} SELECT route, intent, source AS language, sentiment, count(*) AS n FROM routed GROUP BY ALL""")
def outcomes(spark, sf_dir):
    return outcome_counts(routed(spark, sf_dir).withColumnRenamed("source", "language"))


@query("c10_streamed_counts", f"""
WITH {SQL_ROUTED} SELECT route, intent, source AS language, sentiment, count(*) AS n FROM routed GROUP BY ALL""")
def streamed_outcomes(spark, sf_dir):
    """The same rows as a stream of three batches: counts are observed in flight and landed per batch by a listener."""
    arriving, folder = new_path(spark, "routed"), new_path(spark, "landed")
    rows = routed(spark, sf_dir).withColumnRenamed("source", "language")
    rows.repartition(3).write.parquet(arriving)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    listener = OutcomeListener(spark, folder)
    spark.streams.addListener(listener)
    try:
        written = observe_outcomes(stream).writeStream.format("parquet").option("path", new_path(spark, "routed-out"))
        listener.wait(written.option("checkpointLocation", new_path(spark, "routed-check")).trigger(availableNow=True).start())
    finally:
        spark.streams.removeListener(listener)
    return landed_counts(spark, folder).groupBy("route", "intent", "language", "sentiment").agg(F.sum("n").alias("n"))


@query("c9_quarantined_stream", "SELECT doc_id, n_chars, doc_id % 5 = 0 AS replayed FROM documents")
def quarantined(spark, sf_dir):
    """Numbers that do not parse land once, beside the good rows; after the fix they are replayed."""
    arriving, output, raw = new_path(spark, "raw"), new_path(spark, "parsed"), F.col("n_chars").cast("string")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(raw, F.lit("?"))).otherwise(raw).alias("raw"))
    rows.repartition(3).write.parquet(arriving)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(arriving)

    def parse(batch):
        return contain_failures(batch, {"n_chars": ("raw", "bigint")})

    quarantine_stream(stream, parse, output, new_path(spark, "parsed-check"), "numbers").awaitTermination()
    for _ in range(2):  # the second replay finds the first
        replay_failed(spark, output, "numbers", ["doc_id", "raw"], lambda df: parse(df.withColumn("raw", F.rtrim(F.replace("raw", F.lit("?"), F.lit(""))))), "fixed")
    good = read_committed(spark, output, "good", ["job"])
    return good.select("doc_id", "n_chars", (F.col("job") == "j-fixed").alias("replayed"))


# ------------------------------------------------ messages by the rule alone


def ruled(messages):
    """Small talk by rule; every other message gets a made model prediction from its id."""
    key = F.col("message_id")
    talk = small_talk(clean_intent_text(F.col("text")))
    made = F.element_at(F.array(*[F.lit(x) for x in values.ROUTING_INTENTS[3:]]), (draw(2, "intent", key) % 6 + 1).cast("int"))
    sentiment = F.element_at(F.array(*[F.lit(s) for s in values.SENTIMENTS]), (draw(2, "sentiment", key) % 3 + 1).cast("int"))
    out = messages.withColumn("_talk", talk)
    out = (out.withColumn("intent", F.coalesce("_talk", made))
           .withColumn("intent_confidence", F.when(F.col("_talk").isNotNull(), 1.0)
                       .otherwise((draw(2, "confidence", key) % 21) * 5 / F.lit(100.0)))
           .withColumn("intent_source", F.when(F.col("_talk").isNotNull(), "rule").otherwise("model"))
           .withColumn("sentiment", sentiment).drop("_talk"))
    return out.withColumn("route", routing.route(F.col("intent"), F.col("intent_confidence"),
                                                 F.col("intent_source"), F.col("sentiment")))


_MADE = "([" + ", ".join(sql_text(x) for x in values.ROUTING_INTENTS[3:]) + "])"
_FEELING = "([" + ", ".join(sql_text(x) for x in values.SENTIMENTS) + "])"


def sql_ruled(source: str) -> str:
    key = "message_id"
    return f"""
talk AS (SELECT *, {sql_small_talk('clean')} AS talk FROM (SELECT *, {sql_clean_intent('text')} AS clean FROM {source})),
made AS (SELECT * EXCLUDE (clean, talk), coalesce(talk, {_MADE}[({sql_draw(2, 'intent', key)} % 6 + 1)::INT]) AS intent,
  CASE WHEN talk IS NOT NULL THEN 1.0::DOUBLE ELSE ({sql_draw(2, 'confidence', key)} % 21) * 5 / 100.0::DOUBLE END AS intent_confidence,
  CASE WHEN talk IS NOT NULL THEN 'rule' ELSE 'model' END AS intent_source,
  {_FEELING}[({sql_draw(2, 'sentiment', key)} % 3 + 1)::INT] AS sentiment FROM talk),
ruled AS (SELECT *, {sql_route('intent', 'intent_confidence', 'intent_source')} AS route FROM made)"""


SQL_RULED = f"{SQL_CHATTY}, {sql_ruled('chatty')}"


@query("route_messages", f"""
WITH {SQL_RULED} SELECT route, intent, count(*) AS n, round(avg(intent_confidence), 6) AS confidence FROM ruled GROUP BY ALL""")
def route_messages(spark, sf_dir):
    rows = ruled(chatty(spark, sf_dir))
    return rows.groupBy("route", "intent").agg(F.count("*").alias("n"), F.round(F.avg("intent_confidence"), 6).alias("confidence"))


SQL_TURNS = "turns AS (SELECT conv_id * 1000000 + turn AS message_id, conv_id, turn, role, text FROM conversations)"


@query("c11_drained_stream", f"""
WITH {SQL_TURNS}, {sql_ruled('turns')} SELECT message_id, role, intent, intent_confidence, intent_source, sentiment, route FROM ruled""")
def drained_stream(spark, sf_dir):
    """The conversations as a stream of several files, routed batch by batch until it is drained."""
    turns = table(spark, sf_dir, "conversations")
    arriving = new_path(spark, "arriving-turns")
    turns.repartition(4, "conv_id").write.parquet(arriving)
    stream = (spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
              .withColumn("message_id", F.col("conv_id") * 1000000 + F.col("turn")))
    output = new_path(spark, "routed-stream")
    start_stream(stream, ruled, output, new_path(spark, "stream-checkpoint")).awaitTermination()
    return read_output(spark, output).select(
        "message_id", "role", "intent", "intent_confidence", "intent_source", "sentiment", "route")
