"""The registry and the SQL fragments that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from msgflow.functions.terms import once
from msgflow.staging import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL it must agree with."""

    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A given table; text-heavy callers name their columns and get the rows spread over all cores."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return scan if columns is None else spread(scan.select(*columns))


# Unicode whitespace and word characters for DuckDB's regular expressions.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_]"


def sql_collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{SPACE}]+', ' ', 'g'))"


def sql_clean_language(text: str) -> str:
    url = f"http[^{SPACE}]+|www\\.[^{SPACE}]+"
    return sql_collapse(f"regexp_replace(lower(coalesce({text}, '')), '{url}', ' ', 'g')")


def sql_clean_intent(text: str) -> str:
    return sql_collapse(f"lower({text})")


def sql_draw(seed: int, purpose: str, *keys: str) -> str:
    joined = " || ':' || ".join(f"({k})::VARCHAR" for k in keys)
    return f"('0x' || substr(md5('{seed}:{purpose}:' || {joined}), 1, 8))::BIGINT"


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def sql_map(column: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {_literal(k)} THEN {_literal(v)}" for k, v in mapping.items())
    return f"CASE {column} {whens} END"


def _literal(value) -> str:
    return sql_text(value) if isinstance(value, str) else str(value)


# ------------------------------------------- columns that stand in, both ways

VOTE_WORDS = {"en": ["the", "and", "of"], "fr": ["le", "la", "des"], "de": ["der", "die", "und"],
              "es": ["el", "los", "la"]}


def vote(text):
    """A closed-form language guess: the language whose stop words occur most, ties in order."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    counts = []
    for listed in VOTE_WORDS.values():
        n = F.lit(0)
        for w in listed:
            gone = F.length(padded) - F.length(F.replace(padded, F.lit(f" {w} "), F.lit("")))
            n = n + gone
        counts.append(n)
    names = F.array(*[F.lit(name) for name in VOTE_WORDS])
    return once(F.array(*counts), lambda n: F.element_at(names, F.array_position(n, F.array_max(n)).cast("int")))


def sql_vote(text: str) -> str:
    padded = f"(' ' || lower({text}) || ' ')"
    counts = {}
    for name, listed in VOTE_WORDS.items():
        counts[name] = " + ".join(f"(length({padded}) - length(replace({padded}, ' {w} ', '')))" for w in listed)
    best = f"greatest({', '.join(counts.values())})"
    whens = " ".join(f"WHEN {n} = {best} THEN '{name}'" for name, n in counts.items())
    return f"CASE {whens} END"


def decorated(documents: DataFrame) -> DataFrame:
    """documents, and beside them copies with URLs, placeholders and blank texts, by doc_id (a billion higher)."""
    n = F.col("doc_id") % 10
    text = (F.when(n == 0, F.concat(F.lit("See HTTPS://shop.example/a?b=1 "), F.col("text")))
            .when(n == 1, F.concat(F.col("text"), F.lit("\twww.Shop.example/x  now")))
            .when(n == 2, F.concat(F.lit("  {{Order Number}} "), F.col("text"), F.lit(" {{Person Name}} {{")))
            .when(n == 3, F.lit("http://only.example/link"))
            .when(n == 4, F.lit("  \n"))
            .when(n == 5, F.lit(None).cast("string"))
            .otherwise(F.col("text")))
    copies = documents.withColumn("text", text).withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    return documents.unionByName(copies)


SQL_DECORATED = """
decorated AS (
  SELECT * FROM documents UNION ALL
  SELECT * REPLACE (doc_id + 1000000000 AS doc_id, CASE doc_id % 10
    WHEN 0 THEN 'See HTTPS://shop.example/a?b=1 ' || text
    WHEN 1 THEN text || chr(9) || 'www.Shop.example/x  now'
    WHEN 2 THEN '  {{Order Number}}' || chr(160) || text || ' {{Person Name}} {{'
    WHEN 3 THEN 'http://only.example/link'
    WHEN 4 THEN ' ' || chr(8195) || chr(10)
    WHEN 5 THEN NULL
    ELSE text END AS text)
  FROM documents)
"""
