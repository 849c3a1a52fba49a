"""What the physical plans must look like, so that they hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from msgflow.operators import conversation, evaluate, features, prepare, retrieval
from msgflow.plans import classifiers as K
from msgflow.plans.message_flow import score_messages

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|RoundRobin|SinglePartition)", text))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_scoring_has_no_shuffle_and_no_python(spark, models, documents):
    messages = documents.select(F.col("doc_id").alias("message_id"), "text")
    text = plan(score_messages(messages, models))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


def test_vectors_stay_where_they_are(spark, documents, models):
    fitted = models.intent.features
    text = plan(fitted.arrays(documents.select("doc_id", "text"), "text").select("doc_id", "embedding"))
    assert "Exchange" not in text and "Python" not in text


def test_term_counts_shuffle_terms_only(documents):
    text = plan(features.term_counts(documents, "text", features.LANGUAGE_TERMS))
    assert exchanges(text) == 1 and "hashpartitioning(term" in text and "partial_count" in text
    assert "ReadSchema: struct<text:string>" in text


def test_texts_are_compared_by_digest(documents):
    text = plan(prepare.keep_first(documents.select("doc_id", "text"), "text", "doc_id"))
    assert "HashAggregate(keys=[_key" in text and "partial_min(doc_id" in text and "hashpartitioning(text" not in text
    rows = documents.select("doc_id", "text", F.lit("train").alias("split"))
    for counted in (prepare.split_uniqueness(rows), prepare.split_overlap(rows), prepare.template_overlap(rows),
                    prepare.duplicate_counts(rows, "text")):
        text = plan(counted)
        assert "SortAggregate" not in text and "hashpartitioning(text" not in text and "hashpartitioning(split#" in text or "sha2" in text


def test_split_does_not_shuffle_the_table(documents):
    text = plan(prepare.stratified_split(documents.select("doc_id", "text", "lang"), "doc_id", "lang"))
    assert exchanges(text) == 0 and "BroadcastHashJoin" in text


def test_previous_turn_shuffles_texts_once(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    text = plan(conversation.assistant_pairs(turns))
    assert len(re.findall(r"Exchange hashpartitioning\(_part#\d+L?, _block", text)) >= 1
    assert exchanges(text) <= 2


def test_cleaning_is_computed_once(documents):
    text = plan(prepare.clean_rows(documents.select("doc_id", "text")))
    assert text.count("http[^") == 1


def test_pairs_are_counted_before_anything_else(documents):
    pairs = documents.select(F.col("lang").alias("label"), F.col("source").alias("prediction"))
    text = plan(evaluate.macro_scores(pairs))
    assert "partial_count(1)" in text and "ReadSchema: struct<lang:string,source:string>" in text


def test_large_vector_tables_are_searched_in_blocks(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = vectors.withColumnRenamed("doc_id", "query_id")
    text = plan(retrieval.top_k(queries, vectors, 3, broadcast_bytes=0, block_bytes=50_000))
    assert "Cartesian" not in text and "NestedLoop" not in text
    assert len(re.findall("WindowGroupLimit", text)) == 2  # before and after the shuffle
    small = plan(retrieval.top_k(queries, vectors, 3))
    assert "Exchange" not in small and "NestedLoop" not in small


def test_trained_models_score_in_the_jvm(spark, models, documents):
    text = plan(K.predict_language(documents.select("doc_id", "text"), models.language))
    assert "Python" not in text and "Exchange" not in text
