"""The route table on every combination, thresholds included."""

import itertools

from pyspark.sql import functions as F

from msgflow import values
from msgflow.functions import prompting, routing

INTENTS = values.ROUTING_INTENTS + [None, "unheard_of"]
CONFIDENCES = [None, 0.0, 0.2999, 0.30, 0.5499, 0.55, 1.0]
SOURCES = ["model", "rule", None]
SENTIMENTS = values.SENTIMENTS + [None]


def expected(intent, confidence, source, sentiment):
    sure = confidence or 0.0
    if source == "model" and sure < 0.55 and intent != "complaint":
        intent = "complaint" if sure >= 0.30 and sentiment == "Negative/Frustrated" else "out_of_scope"
    if intent in ("greeting", "goodbye", "gratitude"):
        return "direct"
    if intent == "complaint":
        return "rag_escalate"
    return "rag" if intent in values.KNOWLEDGE_INTENTS else "refusal"


def test_every_combination(spark):
    cases = list(itertools.product(INTENTS, CONFIDENCES, SOURCES, SENTIMENTS))
    df = spark.createDataFrame(cases, "i string, c double, s string, m string")
    rows = df.select("*", routing.route(*[F.col(x) for x in "icsm"]).alias("route")).collect()
    assert len(rows) == len(cases)
    for r in rows:
        assert r.route == expected(r.i, r.c, r.s, r.m), r


def test_replies(spark):
    cases = [("direct", "greeting", False), ("direct", "complaint", False), ("refusal", "x", True), ("refusal", "x", False),
             ("rag", "x", False), ("rag_escalate", "x", False)]
    df = spark.createDataFrame(cases, "route string, intent string, blank boolean")
    got = [r[0] for r in df.select(routing.reply(F.col("route"), F.col("intent"), F.col("blank"), F.lit("answer"))).collect()]
    assert got == [values.DIRECT_REPLIES["greeting"], values.DIRECT_DEFAULT, values.BLANK_REPLY, values.REFUSAL_REPLY,
                   "answer", "answer" + values.ESCALATION_NOTICE]
    assert "flagged this conversation for review" in got[-1]


def test_prompt(spark):
    df = spark.createDataFrame([(1, ["one", "two"], "Neutral"), (2, [], None), (3, None, "")], "id int, docs array<string>, s string")
    got = [r[0] for r in df.orderBy("id").select(prompting.user_prompt(F.lit("why?"), F.col("docs"), F.col("s"))).collect()]
    head, ask = "Context (retrieved past support responses):\n", '\nCustomer question: "why?"\n'
    assert got[0] == (head + "[Support response 1]\none\n\n[Support response 2]\ntwo\n\nDetected customer sentiment: Neutral" + ask)
    assert got[1] == got[2] == head + values.NO_CONTEXT + "\n" + ask
