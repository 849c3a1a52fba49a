"""Profiling."""

from pyspark.sql import functions as F

from catalog.registry import query, table
from msgflow.functions.text import preview
from msgflow.operators import profile


def _labelled(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("p1_missing_values", """
WITH t AS (SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'doc_id' AS "column", count(*) FILTER (doc_id IS NULL) AS n_missing FROM t
UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM t
UNION ALL SELECT 'source', count(*) FILTER (source IS NULL) FROM t
UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM t
UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM t""")
def missing_values(spark, sf_dir):
    return profile.missing_values(_labelled(spark, sf_dir))


@query("p2_class_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def class_counts(spark, sf_dir):
    return profile.class_counts(table(spark, sf_dir, "documents"), "source", top=10)


@query("p3_class_shares", """
WITH t AS (SELECT quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT quality, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM t), 2) AS percent
FROM t WHERE quality IS NOT NULL GROUP BY quality""")
def class_shares(spark, sf_dir):
    return profile.class_shares(_labelled(spark, sf_dir), "quality")


@query("p4_seeded_sample", """
SELECT conv_id, turn, text FROM conversations
ORDER BY md5('42:' || (conv_id * 1000000 + turn)::VARCHAR), conv_id * 1000000 + turn LIMIT 5""")
def seeded_sample(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000000 + F.col("turn"))
    return profile.seeded_sample(turns, "id", 5).select("conv_id", "turn", "text")


@query("p5_table_shape", """
SELECT count(*) AS n_rows, 4 AS n_columns, 'conv_id,turn,role,text' AS columns FROM conversations""")
def table_shape(spark, sf_dir):
    return profile.table_shape(table(spark, sf_dir, "conversations"))


@query("p6_text_preview", """
SELECT conv_id, turn, CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS long_preview,
       CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS short_preview
FROM conversations""")
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", preview(F.col("text"), 150).alias("long_preview"),
        preview(F.col("text"), 120).alias("short_preview"))
