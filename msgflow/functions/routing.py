"""Route decision and the fixed replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from msgflow import values


def effective_intent(intent: Column, confidence: Column, source: Column, sentiment: Column,
                     confident: float = values.CONFIDENT,
                     noise_floor: float = values.NOISE_FLOOR) -> Column:
    """The intent that routing acts on; the reported intent stays the predicted one.

    A null confidence counts as 0.0 and a null sentiment as not negative.
    """
    sure = F.coalesce(confidence, F.lit(0.0))
    trusted = ~(source.eqNullSafe(F.lit("model"))) | (sure >= confident) | (intent.eqNullSafe(F.lit("complaint")))
    upset = (sure >= noise_floor) & (sentiment.eqNullSafe(F.lit(values.SENTIMENTS[0])))
    return F.when(trusted, intent).when(upset, "complaint").otherwise("out_of_scope")


def route(intent: Column, confidence: Column, source: Column, sentiment: Column,
          confident: float = values.CONFIDENT, noise_floor: float = values.NOISE_FLOOR) -> Column:
    """direct, rag, rag_escalate or refusal."""
    acting = effective_intent(intent, confidence, source, sentiment, confident, noise_floor)
    return (F.when(acting.isin(values.DIRECT_INTENTS), "direct")
            .when(acting == "complaint", "rag_escalate")
            .when(acting.isin(values.KNOWLEDGE_INTENTS), "rag")
            .otherwise("refusal"))


def needs_documents(route_col: Column) -> Column:
    return route_col.isin("rag", "rag_escalate")


def direct_reply(intent: Column) -> Column:
    """The fixed reply to a small-talk intent, or the default."""
    reply = F.lit(values.DIRECT_DEFAULT)
    for label, text in values.DIRECT_REPLIES.items():
        reply = F.when(intent == label, text).otherwise(reply)
    return reply


def refusal_reply(blank: Column) -> Column:
    """The refusal; an empty message gets a reply of its own."""
    return F.when(blank, values.BLANK_REPLY).otherwise(values.REFUSAL_REPLY)


def escalates(route_col: Column) -> Column:
    return F.coalesce(route_col == "rag_escalate", F.lit(False))


def with_notice(answer: Column, route_col: Column) -> Column:
    """The answer, followed by the notice when the route escalates."""
    return F.when(escalates(route_col), F.concat(answer, F.lit(values.ESCALATION_NOTICE))).otherwise(answer)


def reply(route_col: Column, intent: Column, blank: Column, answer: Column) -> Column:
    """The response text of any route."""
    return (F.when(route_col == "direct", direct_reply(intent))
            .when(needs_documents(route_col), with_notice(answer, route_col))
            .otherwise(refusal_reply(blank)))
