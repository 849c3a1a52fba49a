"""From a knowledge base to its vector table and back to documents."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame

from msgflow import values
from msgflow.operators.features import RETRIEVAL_TERMS, TermRule, TermWeights
from msgflow.operators.retrieval import VectorIndex, top_k, with_documents
from msgflow.staging import stage


class Embedder(Protocol):
    """What turns texts into vectors: :class:`TermWeights`, or an encoder by
    :class:`msgflow.operators.answers.EncoderFeatures`."""

    def arrays(self, df: DataFrame, text: str, output: str = "embedding", hold: Callable = stage) -> DataFrame: ...


def build_vectors(knowledge_base: DataFrame, features: Embedder | TermRule = RETRIEVAL_TERMS) -> tuple[Embedder, DataFrame]:
    """The embedder and the vector table (doc_id, embedding) of the questions.

    By default the term weights of the questions are fitted; an encoder is used as it is.
    """
    questions = knowledge_base.select("doc_id", "instruction")
    if isinstance(features, TermRule):
        features = TermWeights.fit(questions, "instruction", features)
    vectors = features.arrays(questions, "instruction").select("doc_id", "embedding")
    return features, stage(vectors, "vectors")


def retrieve(queries: DataFrame, features: Embedder, vectors: DataFrame | VectorIndex, knowledge_base: DataFrame,
             k: int = values.SEARCH_TOP_K, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, retrieved_documents) for text queries."""
    asked = features.arrays(queries.select(query_id, text), text)
    return with_documents(top_k(asked, vectors, k, query_id), knowledge_base, query_id)
