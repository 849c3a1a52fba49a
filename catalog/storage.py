"""What is written is read back."""

from pyspark.sql import functions as F

from catalog.conversations import SQL_FEEDBACK, feedback
from catalog.evaluation import SQL_CONFUSION, SQL_LINES, voted
from catalog.preparation import (SQL_KB, SQL_PAIRS, SQL_SPLIT_DOCUMENTS, pairs, sql_examples, split_documents)
from catalog.registry import SQL_DECORATED, decorated, query, sql_clean_intent, table
from catalog.retrieval import knowledge_base
from msgflow.examples import SENTIMENT_EXAMPLES, sentiment_examples
from msgflow.operators import evaluate
from msgflow.sources import commits, reports, tables
from msgflow.staging import new_path

_SPLIT = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END"


def _ready_made(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("split", F.expr(_SPLIT)).withColumnRenamed("doc_id", "id")


@query("s1_labelled_text", f"SELECT doc_id AS id, text, lang AS label, {_SPLIT} AS split FROM documents")
def labelled_text(spark, sf_dir):
    path = new_path(spark, "labelled")
    tables.save_splits(_ready_made(spark, sf_dir).select("id", "text", F.col("lang").alias("label"), "split"), path)
    train, val, test = tables.three_splits(tables.load_labelled_text(spark, path))
    named = [d.withColumn("split", F.lit(s)) for d, s in zip((train, val, test), tables.SPLITS)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("s2_emotion_text", f"""
WITH {sql_examples(SENTIMENT_EXAMPLES, 'sentiment')},
a AS (SELECT doc_id AS id, text, ['sadness', 'joy', 'love', 'anger', 'fear', 'surprise'][(doc_id % 7)::INT + 1] AS emotion, {_SPLIT} AS split FROM documents),
b AS (SELECT id, text, emotion, CASE WHEN emotion IN ('sadness', 'anger', 'fear') THEN 'Negative/Frustrated' WHEN emotion = 'surprise' THEN 'Neutral'
  WHEN emotion IN ('joy', 'love') THEN 'Positive/Satisfied' END AS sentiment, split FROM a
  UNION ALL SELECT NULL, text, 'synthetic', sentiment, 'train' FROM examples)
SELECT *, CASE sentiment WHEN 'Negative/Frustrated' THEN 0 WHEN 'Neutral' THEN 1 WHEN 'Positive/Satisfied' THEN 2 END AS sentiment_id FROM b""")
def emotion_text(spark, sf_dir):
    path = new_path(spark, "emotions")
    rows = _ready_made(spark, sf_dir).withColumn("label", (F.col("id") % 7).cast("int"))
    tables.save_splits(rows.select("id", "text", "label", "split"), path)
    return tables.load_emotion_text(spark, path, sentiment_examples(spark))


@query("s3_raw_pairs", f"WITH {SQL_PAIRS} SELECT * FROM pairs")
def raw_pairs(spark, sf_dir):
    path = new_path(spark, "pairs")
    pairs(spark, sf_dir).write.parquet(path)
    return tables.load_pairs(spark, path)


@query("s4_knowledge_base", f"WITH {SQL_KB} SELECT * FROM kb")
def saved_knowledge_base(spark, sf_dir):
    path = new_path(spark, "kb")
    tables.save_knowledge_base(knowledge_base(spark, sf_dir), path)
    return tables.load_knowledge_base(spark, path)


@query("s4_knowledge_base_csv", f"WITH {SQL_KB} SELECT * FROM kb")
def saved_knowledge_base_csv(spark, sf_dir):
    path = new_path(spark, "kb-csv")
    tables.save_knowledge_base(knowledge_base(spark, sf_dir), path, "csv")
    return tables.load_knowledge_base(spark, path, "csv")


@query("s5_held_out_rows", f"WITH {SQL_SPLIT_DOCUMENTS} SELECT doc_id, text, lang, split FROM split_rows WHERE split = 'test'")
def held_out_rows(spark, sf_dir):
    path = new_path(spark, "splits")
    tables.save_splits(split_documents(spark, sf_dir), path)
    return tables.load_split(spark, path, "test")


@query("s7_saved_vectors", """
SELECT vec_id AS doc_id, p::INT AS pos, round(embedding[p + 1]::DOUBLE, 6) AS value FROM (SELECT *, unnest(range(0, len(embedding))) AS p FROM embeddings)""")
def saved_vectors(spark, sf_dir):
    path = new_path(spark, "vectors")
    tables.save_vectors(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), path)
    rows = tables.load_vectors(spark, path).select("doc_id", F.posexplode("embedding").alias("pos", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("s8_confusion_csv", f"WITH {SQL_CONFUSION}")
def confusion_csv(spark, sf_dir):
    path = new_path(spark, "confusion")
    reports.save_confusion_matrix(evaluate.confusion_matrix(voted(spark, sf_dir)), path)
    return spark.read.schema("label string, de bigint, en bigint, es bigint, fr bigint").csv(path, header=True)


@query("s8_report_text", f"WITH {SQL_LINES} SELECT line FROM lines")
def report_text(spark, sf_dir):
    path = new_path(spark, "report")
    reports.save_report(evaluate.report_lines(evaluate.report(voted(spark, sf_dir))), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("s9_feedback_log", f"WITH {SQL_FEEDBACK} SELECT * FROM feedback UNION ALL SELECT * FROM feedback")
def feedback_log(spark, sf_dir):
    path = new_path(spark, "feedback")
    records = feedback(spark, sf_dir)
    tables.append_feedback(records, path)
    tables.append_feedback(records, path)
    return spark.read.parquet(path)


@query("s9_feedback_once", f"WITH {SQL_FEEDBACK} SELECT * FROM feedback")
def feedback_once(spark, sf_dir):
    """Two batches: the first is run twice, the second is killed between data and commit, and run again."""
    path, records = new_path(spark, "feedback"), feedback(spark, sf_dir)
    first, second = (records.where((F.length("assistant_response") % 2) == i) for i in (0, 1))
    for _ in range(2):
        tables.append_feedback_once(first, path, "votes", 0)
    commits.write_attempt({"feedback": second}, path, "votes", 1)
    tables.append_feedback_once(second, path, "votes", 1)
    return tables.load_feedback(spark, path)


@query("s10_message_intake", f"""
WITH {SQL_DECORATED} SELECT count(*) AS n_messages, count(*) FILTER (text IS NULL) AS n_invalid,
  count(*) FILTER (text IS NOT NULL AND {sql_clean_intent('text')} = '') AS n_blank FROM decorated""")
def message_intake(spark, sf_dir):
    path = new_path(spark, "messages")
    decorated(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("message_id"), F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), "text").write.parquet(path)
    return tables.intake_counts(tables.load_messages(spark, path))
