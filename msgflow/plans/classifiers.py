"""Text classifiers: TF-IDF and multinomial logistic regression on Spark ML.

A label column may have at most ``evaluate.MAX_CLASSES`` values: the model is one dense
matrix of classes by terms, which the driver and every task hold. With more, training
raises an error; no class is dropped.
"""

from __future__ import annotations

import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame, SparkSession, functions as F

from msgflow.functions.smalltalk import small_talk
from msgflow.functions.text import clean_intent_text, clean_language_text
from msgflow.operators import evaluate
from msgflow.operators.features import (INTENT_TERMS, LANGUAGE_TERMS, SENTIMENT_TERMS, TermRule, TfIdf)
from msgflow.operators.linear import fit_softmax
from msgflow.operators.prepare import clean_rows, mapped, short_spans
from msgflow.staging import new_path, stage

UNKNOWN_LANGUAGE = "unknown"
ROWS_PER_TASK = 2_000  # at least, when a model is fitted
TASKS_PER_CORE = 4     # at most, so that the gradients that meet in an iteration do not grow with the table


@dataclass
class TextClassifier:
    """A vocabulary, the class names in order and a fitted linear model."""

    features: TfIdf
    labels: list[str]
    model: LogisticRegressionModel

    def score(self, df: DataFrame, text: str, output: str = "prediction",
              confidence: str = "confidence", probability: str | None = None, whole: bool = False) -> DataFrame:
        """Add the most probable class (the first on a tie) and its probability.

        Rows are scored where they are; there is no shuffle and no Python.  For a ``whole`` table
        of long texts the vectors are made in batches, many times as fast; then Python has a part in it.
        """
        vector = "_features"
        rows = self.features.written_vectors(df, text, df.columns, vector) if whole else self.features.vectors(df, text, vector)
        return self.score_vectors(rows, vector, output, confidence, probability).drop(vector)

    def score_vectors(self, df: DataFrame, vector: str, output: str = "prediction",
                      confidence: str = "confidence", probability: str | None = None) -> DataFrame:
        """The same for rows whose vectors are made already."""
        raw, shares = "_probability", "_shares"
        self.model.setFeaturesCol(vector).setProbabilityCol(raw)
        self.model.setRawPredictionCol("").setPredictionCol("")
        out = self.model.transform(df)
        out = out.withColumn(shares, vector_to_array(raw)).withColumn(confidence, F.array_max(shares))
        names = F.array(*[F.lit(x) for x in self.labels])
        out = out.withColumn(output, F.element_at(names, F.array_position(shares, F.col(confidence)).cast("int")))
        if probability:
            out = out.withColumn(probability, F.col(shares))
        return out.drop(raw, shares)

    def save(self, path: str) -> None:
        """Write vocabulary, class names and model below ``path``."""
        spark = self.features.vocabulary.sparkSession
        self.features.vocabulary.write.mode("overwrite").parquet(f"{path}/terms")
        about = [(self.labels, *asdict(self.features.rule).values())]
        spark.createDataFrame(about, _ABOUT).write.mode("overwrite").parquet(f"{path}/about")
        self.model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextClassifier:
        try:
            about = spark.read.parquet(f"{path}/about").first().asDict()
        except AnalysisException as gone:
            raise FileNotFoundError(f"No classifier at {path}: train one and save it there first.") from gone
        labels = about.pop("labels")
        features = TfIdf(TermRule(**about), spark.read.parquet(f"{path}/terms"))
        return cls(features, labels, LogisticRegressionModel.load(f"{path}/model"))


_ABOUT = ("labels array<string>, analyzer string, max_n int, max_features int, min_df int, "
          "sublinear boolean, max_words int")


def class_sizes(df: DataFrame, label: str) -> dict[str, int]:
    """Rows per class, in label order; an error if there are too many values, or only one, to be classes."""
    rows = (df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
            .limit(evaluate.MAX_CLASSES + 1).collect())
    if len(rows) > evaluate.MAX_CLASSES:
        raise ValueError(f"More than {evaluate.MAX_CLASSES} classes in {label}.")
    if len(rows) < 2:
        raise ValueError(f"A classifier needs at least two classes in {label}.")
    return dict(sorted((r[label], r["n"]) for r in rows))


def training_vectors(df: DataFrame, text: str, label: str, sizes: dict[str, int],
                     features: TfIdf, balanced: bool) -> DataFrame:
    """(features, target, weight), staged: the optimiser reads it again and again."""
    target = mapped(F.col(label), {c: float(i) for i, c in enumerate(sizes)})
    weight = F.lit(1.0)
    if balanced:
        n = sum(sizes.values())
        weight = mapped(F.col(label), {c: n / (len(sizes) * k) for c, k in sizes.items()})
    rows = df.where(F.col(label).isNotNull()).select(text, target.alias("target"), weight.alias("weight"))
    return stage(features.written_vectors(rows, text, ["target", "weight"]).select("features", "target", "weight"), "training-vectors")


def sent_home(tasks: int, depth: int) -> int:
    """How many gradients Spark's tree aggregation over so many tasks leaves for the driver to add up."""
    scale = max(2, math.ceil(tasks ** (1.0 / depth)))
    while tasks > scale + math.ceil(tasks / scale):
        tasks //= scale
    return tasks


def aggregation_depth(tasks: int) -> int:
    """The least depth that sends the fewest gradients, each a dense matrix, to the driver in an iteration."""
    return min(range(2, 9), key=lambda depth: (sent_home(tasks, depth), depth))


def fit_linear(vectors: DataFrame, c: float, max_iter: int = 1000, tol: float = 1e-4) -> LogisticRegressionModel:
    """Minimise c * sum(w * loss) + |coefficients|^2 / 2, intercepts free; see :mod:`msgflow.operators.linear`.

    The loss is averaged over the weights, so the penalty is 1 / (c * sum(w)).
    """
    spark = vectors.sparkSession
    sums = {int(r["target"]): (r["n"], r["weight"]) for r in vectors.groupBy("target").agg(
        F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()}  # a row per class
    rows, weights = sum(n for n, _ in sums.values()), np.array([sums.get(k, (0, 0.0))[1] for k in range(max(sums) + 1)])
    # Every step is a job: a small table in few partitions saves most of its cost.
    spread = spark.sparkContext.defaultParallelism * TASKS_PER_CORE
    tasks = min(vectors.rdd.getNumPartitions(), rows // ROWS_PER_TASK + 1, spread)
    coefficients, intercepts = fit_softmax(vectors.coalesce(tasks), vectors.first()["features"].size, weights,
                                           1.0 / (c * weights.sum()), max_iter, tol, aggregation_depth(tasks))
    matrix = DenseMatrix(*coefficients.shape, coefficients.ravel(order="F"))
    java = [_py2java(spark.sparkContext, x) for x in (matrix, DenseVector(intercepts))]
    model = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(f"softmax-{uuid.uuid4().hex}", *java, len(weights), True)
    path = new_path(spark, "fitted")
    model.write().save(path)
    return LogisticRegressionModel.load(path)


def fit_classifier(df: DataFrame, text: str, label: str, rule: TermRule, c: float = 1.0,
                   balanced: bool = False, max_iter: int = 1000) -> TextClassifier:
    """Fit vocabulary and model on ``df`` and nothing else."""
    df = df.where(F.col(label).isNotNull())
    sizes = class_sizes(df, label)
    features = TfIdf.fit(df, text, rule, sum(sizes.values()))
    vectors = training_vectors(df, text, label, sizes, features, balanced)
    return TextClassifier(features, list(sizes), fit_linear(vectors, c, max_iter))


# ------------------------------------------------------------ the three models


def language_training_rows(train: DataFrame, id_col: str = "id", text: str = "text",
                           label: str = "label", seed: int = 42) -> DataFrame:
    """Cleaned rows, staged, and, cleaned again, one short span of each."""
    cleaned = stage(clean_rows(train.select(id_col, text, label), text), "cleaned-rows")
    spans = clean_rows(short_spans(cleaned, id_col, text, label, seed=seed).select(id_col, text, label), text)
    return cleaned.unionByName(spans)


def train_language(train: DataFrame, id_col: str = "id", text: str = "text", label: str = "label") -> TextClassifier:
    rows = stage(language_training_rows(train, id_col, text, label).select(text, label), "language-rows")  # read three times
    return fit_classifier(rows, text, label, LANGUAGE_TERMS, c=10.0)


def train_intent(train: DataFrame, text: str = "text", label: str = "routing_intent") -> TextClassifier:
    """``text`` is cleaned already."""
    return fit_classifier(train, text, label, INTENT_TERMS, c=1.0, balanced=True)


def train_sentiment(train: DataFrame, val: DataFrame, text: str = "text", label: str = "sentiment",
                    penalties: tuple[float, ...] = (0.1, 1.0, 10.0)) -> tuple[TextClassifier, list[dict]]:
    """Weighted loss; keeps the candidate with the best validation macro-F1, the first on a tie.

    The vectors of both splits are made once.  The candidates are fitted and scored side by side:
    an optimiser leaves most of a cluster waiting between its small jobs.
    """
    sizes = class_sizes(train, label)
    features = TfIdf.fit(train, text, SENTIMENT_TERMS)
    vectors = training_vectors(train, text, label, sizes, features, balanced=True)
    held = stage(features.written_vectors(val, text, [label]).select("features", label), "validation-vectors")

    def candidate(c: float) -> tuple[TextClassifier, dict]:
        fitted = TextClassifier(features, list(sizes), fit_linear(vectors, c))
        return fitted, evaluate.macro_scores(fitted.score_vectors(held, "features"), label).first().asDict()

    with ThreadPoolExecutor(max(1, len(penalties))) as pool:
        run = inheritable_thread_target(vectors.sparkSession)(candidate)
        done = list(pool.map(run, penalties))
    best = max(done, key=lambda d: d[1]["macro_f1"])[0]  # max keeps the first of equal ones
    return best, [{"c": c, **scores} for c, (_, scores) in zip(penalties, done)]


def split_accuracy(classifier: TextClassifier, df: DataFrame, text: str, label: str,
                   split: str = "split") -> DataFrame:
    """Accuracy of a fitted model on each split."""
    return evaluate.accuracy(classifier.score(df.select(text, label, split), text, whole=True), label, by=[split])


# --------------------------------------------------------------- predictions


def predict_language(df: DataFrame, classifier: TextClassifier, text: str = "text", whole: bool = False) -> DataFrame:
    """Add language and language_confidence; nothing left after cleaning gives unknown and 0.0."""
    out = df.withColumn("_clean", clean_language_text(F.col(text)))
    out = classifier.score(out, "_clean", "language", "language_confidence", whole=whole)
    empty = F.col("_clean") == ""
    return (out.withColumn("language", F.when(empty, UNKNOWN_LANGUAGE).otherwise(F.col("language")))
            .withColumn("language_confidence", F.when(empty, 0.0).otherwise(F.col("language_confidence")))
            .drop("_clean"))


def predict_sentiment(df: DataFrame, classifier: TextClassifier, text: str = "text") -> DataFrame:
    """Add sentiment and sentiment_confidence, from the text as it is."""
    return classifier.score(df, text, "sentiment", "sentiment_confidence")


def predict_intent(df: DataFrame, classifier: TextClassifier, text: str = "text") -> DataFrame:
    """Add intent, intent_confidence and intent_source; a small-talk rule beats the model."""
    out = df.withColumn("_clean", clean_intent_text(F.col(text)))
    out = classifier.score(out, "_clean", "_intent", "_sure").withColumn("_rule", small_talk(F.col("_clean")))
    ruled = F.col("_rule").isNotNull()
    return (out.withColumn("intent", F.coalesce("_rule", "_intent"))
            .withColumn("intent_confidence", F.when(ruled, 1.0).otherwise(F.col("_sure")))
            .withColumn("intent_source", F.when(ruled, "rule").otherwise("model"))
            .drop("_clean", "_intent", "_sure", "_rule"))


