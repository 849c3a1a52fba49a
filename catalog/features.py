"""TF-IDF features and class weights."""

from pyspark.sql import functions as F

from catalog.registry import WORD, query, sql_collapse, table
from msgflow.operators.features import INTENT_TERMS, LANGUAGE_TERMS, TermRule, TfIdf, class_weights


def sql_char_terms(source: str, id_col: str, text: str, max_n: int = 3) -> str:
    """CTE counted(id, term, tf) of character n-grams inside padded words."""
    grams = " UNION ALL ".join(
        f"SELECT id, n, unnest(list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i, {n}))) AS term FROM word_counts"
        for n in range(1, max_n + 1))
    return f"""
split_words AS (SELECT {id_col} AS id, unnest(string_split({sql_collapse(f'lower({text})')}, ' ')) AS w FROM {source}),
word_counts AS (SELECT id, ' ' || w || ' ' AS w, count(*) AS n FROM split_words WHERE w <> '' GROUP BY 1, 2),
counted AS (SELECT id, term, sum(n)::BIGINT AS tf FROM ({grams}) GROUP BY 1, 2)"""


def sql_word_terms(source: str, id_col: str, text: str, name: str = "counted") -> str:
    """CTE (id, term, tf) of words of two characters or more, and pairs of neighbours."""
    return f"""
{name}_words AS (SELECT {id_col} AS id, regexp_extract_all(lower({text}), '{WORD}{{2,}}') AS w FROM {source}),
{name} AS (SELECT id, term, count(*) AS tf FROM (
  SELECT id, unnest(w) AS term FROM {name}_words UNION ALL
  SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {name}_words) GROUP BY 1, 2)"""


def sql_vocabulary(source: str, counted: str, min_df: int = 1, max_features: int | None = None) -> str:
    most = "" if max_features is None else f"ORDER BY total DESC, term LIMIT {max_features}"
    return f"""
vocabulary AS (SELECT term, sum(tf)::BIGINT AS total, count(*) AS n_docs,
  ln((1.0::DOUBLE + (SELECT count(*) FROM {source})) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
  FROM {counted} GROUP BY term HAVING count(*) >= {min_df} {most})"""


def sql_weights(counted: str, sublinear: bool, name: str = "weights") -> str:
    tf = "(1.0::DOUBLE + ln(tf))" if sublinear else "tf::DOUBLE"
    return f"""
{name}_raw AS (SELECT id, c.term, {tf} * idf AS w FROM {counted} c JOIN vocabulary v ON c.term = v.term),
{name} AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM {name}_raw)"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents", ["doc_id", "text"])


def _vocabulary(spark, sf_dir, rule: TermRule):
    fitted = TfIdf.fit(documents(spark, sf_dir), "text", rule)
    return fitted.vocabulary.select("term", "total", "n_docs", F.round("idf", 6).alias("idf"))


def _weights(spark, sf_dir, rule: TermRule):
    rows = documents(spark, sf_dir)
    fitted = TfIdf.fit(rows, "text", rule)
    return fitted.long(rows, "doc_id", "text").withColumn("weight", F.round("weight", 6))


_CHARS = f"""WITH {sql_char_terms('documents', 'doc_id', 'text')},
{sql_vocabulary('documents', 'counted', 1, 50000)}"""
_WORDS = f"""WITH {sql_word_terms('documents', 'doc_id', 'text')},
{sql_vocabulary('documents', 'counted', 2, 20000)}"""


@query("f1_char_vocabulary", f"{_CHARS} SELECT term, total, n_docs, round(idf, 6) AS idf FROM vocabulary")
def char_vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir, LANGUAGE_TERMS)


@query("f1_char_tfidf", f"{_CHARS}, {sql_weights('counted', True)} SELECT id AS doc_id, term, round(weight, 6) AS weight FROM weights")
def char_tfidf(spark, sf_dir):
    return _weights(spark, sf_dir, LANGUAGE_TERMS)


@query("f2_word_vocabulary", f"{_WORDS} SELECT term, total, n_docs, round(idf, 6) AS idf FROM vocabulary")
def word_vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir, INTENT_TERMS)


@query("f2_word_tfidf", f"{_WORDS}, {sql_weights('counted', False)} SELECT id AS doc_id, term, round(weight, 6) AS weight FROM weights")
def word_tfidf(spark, sf_dir):
    return _weights(spark, sf_dir, INTENT_TERMS)


@query("f3_class_weights", """
WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, n, round((SELECT sum(n)::DOUBLE FROM n) / ((SELECT count(*) FROM n) * n), 6) AS weight FROM n""")
def balanced_weights(spark, sf_dir):
    weights = class_weights(table(spark, sf_dir, "documents"), "lang")
    return weights.withColumn("weight", F.round("weight", 6))
