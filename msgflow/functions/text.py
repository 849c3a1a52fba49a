"""Cleaning and text helpers as Column expressions.

Whitespace and word characters follow Python's Unicode rules, which differ a
little from Java's ``(?U)\\s`` and ``(?U)\\w``; the classes below are explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = r"[\s\x1c-\x1f]"          # use with (?U)
NOT_SPACE = r"[^\s\x1c-\x1f]"     # use with (?U)
WORD = r"[\p{L}\p{N}_]"


def collapse_spaces(text: Column) -> Column:
    """Every whitespace run becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def clean_language_text(text: Column) -> Column:
    """Lowercase, drop URLs, collapse whitespace; null becomes the empty string."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    url = f"(?U)http{NOT_SPACE}+|www\\.{NOT_SPACE}+"
    return collapse_spaces(F.regexp_replace(lowered, url, " "))


def clean_intent_text(text: Column) -> Column:
    """Lowercase and collapse whitespace; placeholders and URLs stay, null stays null."""
    return collapse_spaces(F.lower(text))


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text; never null."""
    return F.coalesce(~F.rlike(text, F.lit(f"(?U){NOT_SPACE}")), F.lit(True))


def normalise_placeholders(text: Column, token: str = "{{PLACEHOLDER}}") -> Column:
    """Replace each shortest ``{{...}}`` by ``token``; a match never crosses a newline."""
    # (?d): only \n ends a line.  The token holds no $ or backslash by default,
    # and both are escaped for callers whose token does.
    safe = token.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, r"(?d)\{\{.*?\}\}", safe)


def preview(text: Column, width: int) -> Column:
    """The first ``width`` characters, with an ellipsis only if the text is longer."""
    cut = F.concat(F.substring(text, 1, width), F.lit("..."))
    return F.when(F.length(text) > width, cut).otherwise(text)


def words(text: Column) -> Column:
    """Whitespace-separated words, never an empty one."""
    return F.filter(F.split(collapse_spaces(text), " "), lambda w: w != "")
