"""Evaluation of a classifier on held-out rows, from the saved split to the report files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from msgflow.operators import evaluate
from msgflow.sources.reports import save_confusion_matrix, save_report
from msgflow.sources.tables import load_split
from msgflow.staging import stage


@dataclass
class Evaluation:
    """What one pass of scoring says; every table is computed from the staged predictions."""

    predictions: DataFrame
    scores: DataFrame
    report: DataFrame
    matrix: DataFrame
    errors: DataFrame
    totals: DataFrame
    confused: DataFrame


def evaluate_predictions(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                         labels: list | None = None, top: int = 10) -> Evaluation:
    """Score once: the predictions are staged, and all measures read them from there."""
    rows = stage(scored, "predictions")
    return Evaluation(
        rows, evaluate.macro_scores(rows, label, prediction), evaluate.report(rows, label, prediction),
        evaluate.confusion_matrix(rows, labels, label, prediction), evaluate.errors(rows, label, prediction),
        evaluate.error_totals(rows, label, prediction), evaluate.confused_pairs(rows, top, label, prediction))


def evaluate_split(spark: SparkSession, splits: str, score: Callable[[DataFrame], DataFrame], output: str,
                   split: str = "test", label: str = "label", prediction: str = "prediction",
                   labels: list | None = None, top: int = 10) -> Evaluation:
    """Load a saved split, score it, and write ``report`` and ``confusion_matrix`` below ``output``."""
    found = evaluate_predictions(score(load_split(spark, splits, split)), label, prediction, labels, top)
    save_report(evaluate.report_lines(found.report), f"{output}/report")
    save_confusion_matrix(found.matrix, f"{output}/confusion_matrix")
    return found
