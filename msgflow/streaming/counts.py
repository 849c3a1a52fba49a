"""Outcome counts of a running stream: observed in flight, landed per micro-batch by a listener."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

OUTCOME = ["route", "intent", "language", "sentiment"]
MOST = 8192  # outcomes that a batch's sketch holds; it is exact up to three quarters of them
_NAME = "outcomes"


def observe_outcomes(scored: DataFrame, outcome: list[str] | None = None) -> DataFrame:
    """Observe the number of rows of each outcome; the rows are not touched, and no further pass is made."""
    outcome = outcome or OUTCOME
    key = F.to_json(F.struct(*outcome), {"ignoreNullFields": "false"})
    return scored.withColumn("_outcome", key).observe(
        _NAME, F.count("*").alias("n"), F.expr(f"approx_top_k(_outcome, {MOST // 8}, {MOST})").alias("top")).drop("_outcome")


class OutcomeListener(StreamingQueryListener):
    """Writes one small table per batch below ``folder``: the query, the batch, the outcome and its rows.

    A batch that is reported again overwrites its own.  ``wait`` returns once a query
    that has ended is on record in full.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.ended: dict[str, threading.Event] = {}
        self.faults: list[str] = []

    def _event(self, run: str) -> threading.Event:
        return self.ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event) -> None:
        self._event(event.runId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(_NAME)
        if seen is None or not seen["n"]:
            return
        rows = [(t["item"], t["count"]) for t in seen["top"]]
        if sum(n for _, n in rows) != seen["n"]:
            self.faults.append(f"batch {progress.batchId} has more outcomes than are counted exactly")
        table = self.spark.createDataFrame(rows, "outcome string, n long").coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.folder}/query={progress.id}/batch_id={progress.batchId}")

    def onQueryTerminated(self, event) -> None:
        self._event(event.runId).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        query.awaitTermination()
        if not self._event(query.runId).wait(seconds):
            raise TimeoutError("the listener has not heard of the end of the query")
        if self.faults:
            raise RuntimeError("; ".join(self.faults))


def landed_counts(spark: SparkSession, folder: str, outcome: list[str] | None = None) -> DataFrame:
    """(query, batch_id, outcome fields, n) of all batches on record."""
    outcome = outcome or OUTCOME
    rows = spark.read.option("basePath", folder).parquet(folder)
    parsed = F.from_json("outcome", ", ".join(f"{c} string" for c in outcome))
    return rows.select("query", "batch_id", parsed.alias("o"), "n").select("query", "batch_id", "o.*", "n")
