"""Embeddings, vector tables, exact top-k, documents, checks."""

from pyspark.sql import Observation, functions as F

from catalog.features import sql_vocabulary, sql_weights, sql_word_terms
from catalog.preparation import SQL_KB, pairs
from catalog.registry import query, table
from msgflow.operators import prepare
from msgflow.operators.answers import hook_embeddings
from msgflow.operators.features import TermWeights, unit_length
from msgflow.operators.retrieval import retrieval_checks, top_k, with_documents
from msgflow.plans.knowledge import build_vectors
from msgflow.staging import stage


def knowledge_base(spark, sf_dir):
    return stage(prepare.build_knowledge_base(pairs(spark, sf_dir)), "knowledge-base")


def user_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]).where(F.col("role") == "user")
    return turns.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("query_id"), "text")


# ---------------------------------------------------------------- embeddings


@query("r1_unit_vectors", """
WITH raw AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 3)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM raw)
SELECT vec_id, p::INT AS pos, round(e[p] / l, 6) AS value FROM (SELECT *, unnest(range(1, len(e) + 1)) AS p FROM n)""")
def unit_vectors(spark, sf_dir):
    stretched = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", unit_length(stretched).alias("e"))
    return rows.select("vec_id", F.posexplode("e").alias("pos", "value")).select(
        "vec_id", (F.col("pos") + 1).alias("pos"), F.round("value", 6).alias("value"))


@query("r1_encoder_hook", """
WITH raw AS (SELECT doc_id, length(text)::DOUBLE AS a, length(regexp_replace(lower(text), '[^aeiou]', '', 'g'))::DOUBLE AS b FROM documents)
SELECT doc_id, round(a / sqrt(a * a + b * b + 1), 6) AS x, round(b / sqrt(a * a + b * b + 1), 6) AS y FROM raw""")
def encoder_hook(spark, sf_dir):
    """A stand-in encoder: text -> (characters, vowels, 1)."""
    def make_encoder():
        return lambda texts: [[len(t), sum(c in "aeiou" for c in t.lower()), 1.0] for t in texts]

    rows = hook_embeddings(table(spark, sf_dir, "documents"), make_encoder, "doc_id", "text")
    return rows.select("doc_id", F.round(F.get("embedding", 0), 6).alias("x"), F.round(F.get("embedding", 1), 6).alias("y"))


SQL_KB_WEIGHTS = f"""{SQL_KB}, {sql_word_terms('kb', 'doc_id', 'instruction', 'kb_terms')},
{sql_vocabulary('kb', 'kb_terms')}, {sql_weights('kb_terms', False, 'kb_weights')}"""


@query("r2_vector_table", f"""
WITH {SQL_KB_WEIGHTS} SELECT id AS doc_id, term, round(weight, 6) AS weight FROM kb_weights""")
def vector_table(spark, sf_dir):
    return term_weights(*build_vectors(knowledge_base(spark, sf_dir)))


SQL_HOT_WEIGHTS = f"""{SQL_KB}, hot_kb AS (SELECT doc_id, 'everywhere everywhere ' || instruction AS instruction FROM kb),
{sql_word_terms('hot_kb', 'doc_id', 'instruction', 'hot_terms')}, {sql_vocabulary('hot_kb', 'hot_terms')}, {sql_weights('hot_terms', False, 'hot_weights')}"""


@query("r2_hot_term_join", f"WITH {SQL_HOT_WEIGHTS} SELECT id AS doc_id, term, round(weight, 6) AS weight FROM hot_weights")
def hot_term_join(spark, sf_dir):
    """A word that stands in every question, and a table of weights too large to hold: hot terms apart, the others joined."""
    hot = F.concat(F.lit("everywhere everywhere "), "instruction").alias("instruction")
    questions = knowledge_base(spark, sf_dir).select("doc_id", hot)
    features = TermWeights.fit(questions, "instruction", local_terms=0)
    return term_weights(features, features.arrays(questions, "instruction"))


def term_weights(features, vectors):
    parts = vectors.select("doc_id", F.inline(F.arrays_zip(
        F.col("embedding.indices").alias("idx"), F.col("embedding.values").alias("weight"))))
    terms = features.vocabulary.select("idx", "term")  # staged: broadcast only if its files are small
    return parts.join(terms, "idx").select("doc_id", "term", F.round("weight", 6).alias("weight"))


# --------------------------------------------------------------------- top-k


_DENSE = """
WITH pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label AS wanted, d.label AS label,
  round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS similarity_score
  FROM embeddings q CROSS JOIN embeddings d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, doc_id) AS rank FROM pairs)
"""


def _dense(spark, sf_dir, k, **limits):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    return top_k(queries, vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), k, **limits)


@query("r3_dense_top_k", f"{_DENSE} SELECT query_id, rank::INT AS rank, doc_id, similarity_score FROM ranked WHERE rank <= 5")
def dense_top_k(spark, sf_dir):
    return _dense(spark, sf_dir, 5)


@query("r3_dense_top_k_blocks", f"{_DENSE} SELECT query_id, rank::INT AS rank, doc_id, similarity_score FROM ranked WHERE rank <= 5")
def dense_top_k_blocks(spark, sf_dir):
    """The way beyond the broadcast limit, with small blocks."""
    return _dense(spark, sf_dir, 5, broadcast_bytes=0, block_bytes=64_000, chunk_bytes=100_000)


SQL_TEXT_HITS = f"""{SQL_KB_WEIGHTS},
asked AS (SELECT conv_id * 1000000 + turn AS query_id, text FROM conversations WHERE role = 'user'),
{sql_word_terms('asked', 'query_id', 'text', 'asked_terms')}, {sql_weights('asked_terms', False, 'asked_weights')},
met AS (SELECT a.id AS query_id, k.id AS doc_id, sum(a.weight * k.weight) AS s FROM asked_weights a JOIN kb_weights k ON a.term = k.term GROUP BY 1, 2),
scored AS (SELECT a.query_id, k.doc_id, round(coalesce(s, 0.0::DOUBLE), 6) AS similarity_score FROM asked a CROSS JOIN kb k
  LEFT JOIN met m ON m.query_id = a.query_id AND m.doc_id = k.doc_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 3)"""


def _text_hits(spark, sf_dir, **limits):
    kb = knowledge_base(spark, sf_dir)
    features, vectors = build_vectors(kb)
    asked = features.arrays(user_turns(spark, sf_dir), "text")
    return kb, top_k(asked, vectors, 3, **limits)


@query("r3_text_top_k", f"WITH {SQL_TEXT_HITS} SELECT query_id, rank::INT AS rank, doc_id, similarity_score FROM hits")
def text_top_k(spark, sf_dir):
    return _text_hits(spark, sf_dir)[1]


@query("r3_text_top_k_blocks", f"WITH {SQL_TEXT_HITS} SELECT query_id, rank::INT AS rank, doc_id, similarity_score FROM hits")
def text_top_k_blocks(spark, sf_dir):
    return _text_hits(spark, sf_dir, broadcast_bytes=0, block_bytes=100_000, chunk_bytes=100_000)[1]


@query("r3_cells_skipped", "SELECT count(*) AS n_queries, true AS whole_result, true AS skips_cells FROM conversations WHERE role = 'user'")
def cells_skipped(spark, sf_dir):
    """Cells (question, block) that the bounds rule out are never built, and no hit is lost by it."""
    seen = Observation("cells")
    hits = stage(_text_hits(spark, sf_dir, broadcast_bytes=0, block_bytes=10_000, cells=seen)[1], "hits")
    row = hits.groupBy("query_id").count().agg(F.count("*").alias("n_queries"), (F.min("count") == 3).alias("whole_result"))
    return row.withColumn("skips_cells", F.lit(seen.get["built"] < seen.get["all"]))


@query("r4_retrieved_documents", f"""
WITH {SQL_TEXT_HITS} SELECT h.query_id, (rank - 1)::INT AS pos, h.doc_id, instruction, response, intent, category, similarity_score
FROM hits h JOIN kb ON kb.doc_id = h.doc_id""")
def retrieved_documents(spark, sf_dir):
    kb, hits = _text_hits(spark, sf_dir)
    found = with_documents(hits, kb).select("query_id", F.posexplode("retrieved_documents").alias("pos", "d"))
    return found.select("query_id", "pos", "d.*")


@query("r5_retrieval_checks", f"""
{_DENSE} SELECT query_id, count(*) AS n_hits, true AS descending, round(avg((label = wanted)::INT), 6) AS precision
FROM ranked WHERE rank <= 5 GROUP BY query_id""")
def checks(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = (_dense(spark, sf_dir, 5)
            .join(labels.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
            .join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id"))
    checked = retrieval_checks(hits, F.col("label") == F.col("wanted"))
    return checked.withColumn("precision", F.round("precision", 6))
