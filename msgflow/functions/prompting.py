"""The grounding prompt as a Column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from msgflow import values

SYSTEM_RULES = """You write for the support desk of a web shop and stay friendly and to the point.

- The support responses in the context are your only source. What they do not say about rules, orders or refunds, you do not say either.
- A name in double braces, such as {{Order Number}}, is a gap in a template. Do not repeat it and do not fill it: write around it, or ask for the detail if the answer depends on it.
- If the customer is upset, show in one short sentence that you have understood before you answer.
- If the context does not answer the question, admit it and offer to hand over to a colleague.
- Keep it short.
"""


@dataclass(frozen=True)
class PromptRules:
    """What an answer hook gets besides the prompts."""

    system: str = SYSTEM_RULES
    temperature: float = 0.3


def context_block(responses: Column) -> Column:
    """Numbered response blocks with a blank line between them, or a line saying there are none."""
    blocks = F.transform(
        responses,
        lambda text, i: F.concat(F.lit(values.PROMPT_BLOCK[0]), (i + 1).cast("string"), F.lit(values.PROMPT_BLOCK[1]),
                                 F.coalesce(text, F.lit(""))),
    )
    none = responses.isNull() | (F.size(responses) == 0)
    return F.when(none, values.NO_CONTEXT).otherwise(F.array_join(blocks, "\n\n"))


def user_prompt(message: Column, responses: Column, sentiment: Column | None = None) -> Column:
    """Context, the sentiment if there is one, and the question last."""
    line = F.lit("")
    if sentiment is not None:
        said = F.coalesce(sentiment, F.lit("")) != ""
        line = F.when(said, F.concat(F.lit(values.PROMPT_SENTIMENT), sentiment)).otherwise("")
    return F.concat(
        F.lit(values.PROMPT_CONTEXT), context_block(responses),
        F.lit("\n"), line, F.lit(values.PROMPT_QUESTION[0]), message, F.lit(values.PROMPT_QUESTION[1]),
    )
