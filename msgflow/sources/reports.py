"""Evaluation reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_confusion_matrix(matrix: DataFrame, path: str) -> None:
    """CSV with a header, true labels in the first column; at most classes x classes cells."""
    matrix.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_report(lines: DataFrame, path: str) -> None:
    """The report's lines in order, as one text file of a line per class and a few more."""
    (lines.orderBy("line_no").coalesce(1).select("line").write.mode("overwrite").text(path))
