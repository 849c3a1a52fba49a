"""Tables staged in the folder that all executors share.

A staged table cuts lineage (a lost executor costs a re-read, not a recompute)
and gives Catalyst an exact size: a join with a staged table is broadcast only
if its files are below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_PASSING: contextvars.ContextVar[str | None] = contextvars.ContextVar("passing", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; local runs may go without it."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"Set {_SETTING} to a folder that all executors can reach.")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_PASSING.get() or shared_folder(spark) + '/msgflow'}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def passing(spark: SparkSession):
    """What is staged inside is deleted at the end, also after an error; so results must be written by then."""
    folder = f"{shared_folder(spark)}/msgflow/passing-{uuid.uuid4().hex}"
    token = _PASSING.set(folder)
    try:
        yield
    finally:
        _PASSING.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_small_batches(run, limit: str = "4m"):
    """``run(df, ...)``, whose staged tables hand texts to Python in batches of at most ``limit`` bytes.

    Ten thousand long texts at once would be held by Spark, twice while its buffer grows, and by the worker.
    Batches do not change results; the session's setting is as before when ``run`` ends.
    """

    @functools.wraps(run)
    def wrapped(df: DataFrame, *args, **options):
        conf = df.sparkSession.conf
        before = conf.get(_BATCH)
        conf.set(_BATCH, limit)
        try:
            return run(df, *args, **options)
        finally:
            conf.set(_BATCH, before)

    return wrapped


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scanned table of few partitions over all cores before costly per-row work.

    A table with at least as many partitions as the cluster has cores, so any
    large one, is left alone.  For plain scans only: to count the partitions of
    a plan with shuffles, Spark would have to run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
