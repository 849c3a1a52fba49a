"""Input tables, the knowledge base, vectors, splits and feedback."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from msgflow.functions.text import is_blank
from msgflow.operators.conversation import assistant_pairs
from msgflow.sources.commits import read_committed, write_committed
from msgflow.operators.prepare import add_training_examples, map_emotions, sentiment_id
from msgflow.values import SYNTHETIC_EMOTION

SPLITS = ("train", "val", "test")
PAIRS_SCHEMA = "id bigint, instruction string, response string, intent string, category string"
KNOWLEDGE_SCHEMA = "doc_id bigint, instruction string, response string, intent string, category string"
MESSAGE_SCHEMA = "message_id bigint, conv_id bigint, turn int, text string"


def _read_saved(spark: SparkSession, path: str, what: str, schema: str | None = None,
                fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as gone:
        raise FileNotFoundError(f"No {what} at {path}: build and save it first.") from gone


# ------------------------------------------------------------- labelled text


def load_labelled_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, label, split), the splits ready made."""
    return _read_saved(spark, path, "labelled text").select("id", "text", "label", "split")


def three_splits(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """train, val and test; on a table partitioned by split each reads its own files only."""
    return tuple(df.where(F.col("split") == s).drop("split") for s in SPLITS)


def load_emotion_text(spark: SparkSession, path: str, examples: DataFrame | None = None) -> DataFrame:
    """Emotion rows with mapped labels; ``examples`` (text, sentiment) join the train split."""
    df = map_emotions(_read_saved(spark, path, "emotion text"))
    df = df.select("id", "text", "emotion", "sentiment", "sentiment_id", "split")
    return df if examples is None else add_sentiment_examples(df, examples)


def add_sentiment_examples(df: DataFrame, examples: DataFrame) -> DataFrame:
    """Append (text, sentiment) rows to train, marked by a synthetic emotion."""
    tagged = examples.withColumn("sentiment_id", sentiment_id(F.col("sentiment")))
    return add_training_examples(df, tagged, {"emotion": SYNTHETIC_EMOTION})


# ------------------------------------------------------------------ messages


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Raw question/answer pairs."""
    return _read_saved(spark, path, "pairs", PAIRS_SCHEMA)


def pairs_from_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, instruction, response): each assistant turn answers the turn before it."""
    return assistant_pairs(turns).select("conv_id", "turn", F.col("user_message").alias("instruction"),
                                         F.col("assistant_response").alias("response"))


def load_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Arriving messages; a malformed record keeps its row, its text null."""
    return spark.read.schema(MESSAGE_SCHEMA).format(fmt).load(path)


def stream_messages(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(MESSAGE_SCHEMA).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def intake_counts(messages: DataFrame, text: str = "text") -> DataFrame:
    """One row: messages, messages without the required text, and blank ones."""
    return messages.agg(F.count("*").alias("n_messages"),
                        F.count_if(F.col(text).isNull()).alias("n_invalid"),
                        F.count_if(F.col(text).isNotNull() & is_blank(F.col(text))).alias("n_blank"))


# -------------------------------------------- knowledge base, vectors, splits


def save_knowledge_base(kb: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = kb.select("doc_id", "instruction", "response", "intent", "category").write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def load_knowledge_base(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read_saved(spark, path, "knowledge base", KNOWLEDGE_SCHEMA, fmt)


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("doc_id", "embedding").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return _read_saved(spark, path, "vector table")


def save_splits(df: DataFrame, path: str) -> None:
    """Keep the exact rows of each split; evaluation reads its own partition back."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return _read_saved(spark, path, "saved splits").where(F.col("split") == split)


# ------------------------------------------------------------------ feedback

FEEDBACK_FIELDS = ["timestamp", "user_message", "assistant_response", "language", "sentiment",
                   "intent", "route", "feedback"]


def append_feedback(records: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append records; with CSV every file has its own header, read away on load."""
    writer = records.select(*FEEDBACK_FIELDS).write.mode("append")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def append_feedback_once(records: DataFrame, path: str, job: str, batch: int = 0) -> bool:
    """Append the records of one batch of a job; a batch that is run again, or was killed before its end, is there once.

    False if the batch is there already; then nothing is written.
    """
    return write_committed({"feedback": records.select(*FEEDBACK_FIELDS)}, path, job, batch)


def load_feedback(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`append_feedback_once` has committed."""
    return read_committed(spark, path, "feedback").select(*FEEDBACK_FIELDS)
