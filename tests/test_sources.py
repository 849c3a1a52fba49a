import pytest
from pyspark.sql import functions as F

from msgflow import staging
from msgflow.operators import evaluate
from msgflow.sources import reports, tables
from msgflow.staging import new_path

KB = [(0, 'How, "exactly"?', "Line one\nline two, with a comma", "get_refund", "REFUND"), (1, "b", "", None, "ORDER")]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_knowledge_base_round_trip(spark, fmt):
    kb = spark.createDataFrame(KB[:1] + [(1, "b", "r", "x", "ORDER")], tables.KNOWLEDGE_SCHEMA)
    path = new_path(spark, "kb")
    tables.save_knowledge_base(kb, path, fmt)
    assert sorted(tables.load_knowledge_base(spark, path, fmt).collect()) == sorted(kb.collect())


def test_missing_tables_say_what_to_do(spark):
    path = new_path(spark, "nowhere")
    for load in (tables.load_knowledge_base, tables.load_vectors, tables.load_labelled_text, tables.load_pairs):
        with pytest.raises(FileNotFoundError, match="build and save it first"):
            load(spark, path)
    with pytest.raises(FileNotFoundError):
        tables.load_split(spark, path, "test")


def test_splits_are_read_by_partition(spark):
    df = spark.createDataFrame([(1, "a", "x", "train"), (2, "b", "y", "val"), (3, "c", "x", "test")],
                               "id long, text string, label string, split string")
    path = new_path(spark, "splits")
    tables.save_splits(df, path)
    train, val, test = tables.three_splits(tables.load_labelled_text(spark, path))
    assert [tuple(x.first()) for x in (train, val, test)] == [(1, "a", "x"), (2, "b", "y"), (3, "c", "x")]
    plan = tables.load_split(spark, path, "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_emotions_with_examples(spark):
    rows = spark.createDataFrame([(1, "t", 0, "train"), (2, "u", 5, "test"), (3, "v", 9, "val")], "id long, text string, label int, split string")
    path = new_path(spark, "emotions")
    tables.save_splits(rows, path)
    extra = spark.createDataFrame([("w", "Neutral")], "text string, sentiment string")
    got = {r.text: (r.emotion, r.sentiment, r.sentiment_id, r.split) for r in tables.load_emotion_text(spark, path, extra).collect()}
    assert got == {"t": ("sadness", "Negative/Frustrated", 0, "train"), "u": ("surprise", "Neutral", 1, "test"),
                   "v": (None, None, None, "val"), "w": ("synthetic", "Neutral", 1, "train")}


def test_intake_keeps_malformed_json_rows(spark):
    path = new_path(spark, "messages")
    spark.createDataFrame([('{"message_id": 1, "text": "hi"}',), ("not json",), ('{"message_id": 3, "text": " "}',), ('{"message_id": 4}',)],
                          "value string").write.text(path)
    counts = tables.intake_counts(tables.load_messages(spark, path, "json")).first()
    assert tuple(counts) == (4, 2, 1)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_feedback_appends(spark, fmt):
    record = spark.createDataFrame([("q", "a,\n\"b\"", "en", "Neutral", "review", "rag", "up")],
                                   "user_message string, assistant_response string, language string, sentiment string, intent string, route string, feedback string")
    record = record.withColumn("timestamp", F.current_timestamp())
    path = new_path(spark, "feedback")
    tables.append_feedback(record, path, fmt)
    tables.append_feedback(record, path, fmt)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    rows = reader.format(fmt).load(path)
    assert rows.columns == tables.FEEDBACK_FIELDS and rows.count() == 2
    assert {r.assistant_response for r in rows.collect()} == {'a,\n"b"'}


def test_report_files(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "label string, prediction string")
    path = new_path(spark, "report")
    reports.save_confusion_matrix(evaluate.confusion_matrix(df), path + "-matrix")
    assert [tuple(r) for r in spark.read.csv(path + "-matrix", header=True).collect()] == [("a", "1", "1"), ("b", "0", "1")]
    reports.save_report(evaluate.report_lines(evaluate.report(df)), path + "-text")
    lines = [r.value for r in spark.read.text(path + "-text").collect()]
    assert lines[0].split() == ["precision", "recall", "f1-score", "support"] and lines[-1].split()[:2] == ["weighted", "avg"]


class Session:
    """A session as far as the shared folder is concerned."""

    def __init__(self, setting, master):
        self.setting, self.master, self.folder = setting, master, None
        self.conf = self.sparkContext = self

    def get(self, name, default):
        assert name == "spark.checkpoint.dir"
        return self.setting or default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_is_the_cluster_setting(spark):
    assert staging.shared_folder(Session("hdfs:///shared/", "yarn")) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session(None, "yarn"))
    local = Session(None, "local[8]")
    own = staging.shared_folder(local)
    assert own.startswith("/tmp/run-") and staging.shared_folder(local) == own
    assert staging.shared_folder(spark) == staging.shared_folder(spark)


def test_few_partitions_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert staging.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == cores
    wide = spark.range(0, 100, 1, cores + 3)
    assert staging.spread(wide) is wide
