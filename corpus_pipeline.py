"""From raw documents to token ids: five stages, each a table that the next one reads.

``run`` applies them to ``documents``.  Every stage but the last returns the columns of
its input; a stage's decisions hold for all that follow.  Null and empty texts have no
letter, so the first stage rejects them.  The columns ``doc_id`` and ``text`` are
looked at (``lang`` too, to learn from); others, whatever their names, are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from msgflow.llm import language_crf, line_chunks, ngram_join, pieces, winnow
from msgflow.staging import stage

#: A document is rejected if it has no letter, or if its best language has a lower mean chance per word.
LEAST_SCORE = 0.3
#: Near duplicates share this part of their sets of five words.
NEAR = ngram_join.Rule(5, 80, 100)


def _text_key() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _renamed(docs: DataFrame) -> DataFrame:
    """All columns as one, and beside it what a stage looks at; so names cannot clash."""
    return docs.select(F.struct("*").alias("own"), "doc_id", "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach."""
    known = docs.where(~language_crf.held_out(F.col("doc_id")))
    model = language_crf.train(language_crf.training_segments(known, "text", "lang"))
    found = language_crf.predicted(_renamed(docs).select("own", "text"), "text", model)
    kept = found.where((F.col("lang_pred") != language_crf.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select("own.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier one; one that loses all its words goes."""
    left = line_chunks.deduplicated(_renamed(docs))
    left = left.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", "\\s+", "")) != ""))
    own = F.when(F.col("n_removed") == 0, F.col("own")).otherwise(_with_text(docs))
    return left.select(own.alias("own")).select("own.*")


def _with_text(docs: DataFrame) -> F.Column:
    own = F.col("own").withField("text", F.col("text"))
    return own.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else own


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, once."""
    found = ngram_join.components(docs, "doc_id", "text", NEAR)
    keepers = stage(found.where("keeper").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")), "near-keepers")
    rows = _renamed(docs).select("own", "doc_id", _text_key().alias("text_key"))
    kept = rows.join(keepers.distinct(), (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    # Rows of one id and text may differ in other columns: the least as text stays, so a task run again keeps the same.
    return kept.groupBy("doc_id", "text_key").agg(F.min_by("own", F.to_json("own")).alias("own")).select("own.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages, by :func:`winnow.contamination`."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    judged = winnow.contamination(docs.select("doc_id", _text_key().alias("key"), "text"), benchmark)
    bad = stage(judged.where("contaminated").select(F.col("doc_id").alias("id"), "key").distinct(), "contaminated")
    rows = _renamed(docs).select("own", "doc_id", _text_key().alias("text_key"))
    return rows.join(bad, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_anti").select("own.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of token ids, and digests of the ids and of the text decoded from them."""
    import public_tokenizers

    return pieces.digests(docs.select("doc_id", "text"), "text", public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: A trained CRF and BPE merges have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
