"""The small-talk rule: greeting, goodbye, gratitude, or nothing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from msgflow import values
from msgflow.functions.text import SPACE, WORD


def _pattern(template: str) -> str:
    # Case is ignored for letters that lowercasing leaves alone (long s).
    marks = {"{s}": SPACE, "{b}": f"(?<!{WORD})", "{e}": f"(?!{WORD})"}
    for mark, regex in marks.items():
        template = template.replace(mark, regex)
    return f"(?iU){template}"


def small_talk(text: Column, patterns: dict[str, str] | None = None,
               fillers: list[str] | None = None) -> Column:
    """The first label whose pattern occurs and leaves only filler words, else null."""
    patterns = patterns or values.SMALL_TALK_PATTERNS
    allowed = F.array(*[F.lit(w) for w in (fillers or values.SMALL_TALK_FILLERS)])
    lowered = F.lower(text)
    rule = F.lit(None).cast("string")
    for label, template in reversed(patterns.items()):
        regex = _pattern(template)
        rest = F.regexp_replace(lowered, regex, "")
        rest_words = F.regexp_extract_all(rest, F.lit(f"{WORD}+"), 0)
        only_fillers = F.size(F.array_except(rest_words, allowed)) == 0
        rule = F.when(F.rlike(lowered, F.lit(regex)) & only_fillers, F.lit(label)).otherwise(rule)
    return rule
