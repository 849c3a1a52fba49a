"""Continuous scoring of arriving messages.

Messages are independent, so the job keeps no state.  Each micro-batch runs the
batch plan and replaces its own folder, named by the checkpoint and the batch: a
batch that is replayed after a failure overwrites what it wrote, nothing doubles,
and a job with another checkpoint never touches what this one wrote.  What a batch
stages is deleted when it is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from msgflow.functions.prompting import PromptRules
from msgflow.plans.message_flow import MessageModels, answer_messages
from msgflow.sources.commits import read_committed, write_committed
from msgflow.staging import passing, stage


def start_stream(messages: DataFrame, handle: Callable[[DataFrame], DataFrame], output: str,
                 checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Apply ``handle`` to every micro-batch; without an interval, drain what is there and stop."""

    return _start(messages, lambda batch, held: handle(batch), output, checkpoint, interval)


def _start(messages: DataFrame, handle: Callable[[DataFrame, list[DataFrame]], DataFrame], output: str,
           checkpoint: str, interval: str | None) -> StreamingQuery:
    source = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        held: list[DataFrame] = []
        try:
            with passing(batch.sparkSession):
                handle(batch, held).write.mode("overwrite").parquet(f"{output}/source={source}/batch_id={batch_id}")
        finally:
            for df in held:
                df.unpersist()

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def answer_stream(messages: DataFrame, models: MessageModels, output: str, checkpoint: str,
                  interval: str | None = None, make_hook: Callable | None = None, rules: PromptRules = PromptRules()) -> StreamingQuery:
    """Answer arriving messages with the batch plan; a batch is cached until it is written."""

    models.index  # noqa: B018 - made once, before the first batch, and kept

    def handle(batch: DataFrame, held: list[DataFrame]) -> DataFrame:
        def hold(df: DataFrame, name: str) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        return answer_messages(batch, models, make_hook=make_hook, hold=hold, rules=rules)

    return _start(messages, handle, output, checkpoint, interval)


def read_output(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.option("basePath", output).parquet(output).drop("source")


def quarantine_stream(records: DataFrame, handle: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, job: str,
                      error: str = "error", interval: str | None = None) -> StreamingQuery:
    """Good and failed records of every micro-batch, in one commit.

    ``handle`` keeps a failed record's row and names the fault in ``error`` (see
    :func:`msgflow.plans.message_flow.contain_failures`).  ``good`` gets the rows without a
    fault; ``failed`` the others, with the file and the place in it that they came from.
    A batch that is replayed after a loss is there once.
    """
    origin = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    arriving = records.withColumn("origin", origin)

    def write(batch: DataFrame, batch_id: int) -> None:
        with passing(batch.sparkSession):
            done = stage(handle(batch), "handled")
            failed = F.col(error).isNotNull()
            write_committed({"good": done.where(~failed).drop("origin", error), "failed": done.where(failed)}, output, job, batch_id)

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def replay_failed(spark: SparkSession, output: str, job: str, columns: list[str], handle: Callable[[DataFrame], DataFrame],
                  replay: str, error: str = "error") -> bool:
    """Handle the failed records of ``job`` again, as job ``replay``; what fails once more is quarantined there. Once only."""
    rows = read_committed(spark, output, "failed", ["job"]).where(F.col("job") == f"j-{job}").drop("job")
    with passing(spark):
        done = stage(handle(rows.select(*columns, "origin")), "handled")
        failed = F.col(error).isNotNull()
        return write_committed({"good": done.where(~failed).drop("origin", error), "failed": done.where(failed)}, output, replay)
