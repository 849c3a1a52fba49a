"""Tables that a job writes exactly once, whatever is retried, killed or run twice.

Every attempt writes into folders of its own.  One small file per (job, batch), created if
it is not there yet, names the attempt that counts; readers follow these files.  So
several tables become visible together, and an attempt without its file never does.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

_COMMITS = "commits"
_KEYS = ["job", "batch", "attempt"]


def _file(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _record(path: str, job: str, batch: int) -> str:
    return f"{path}/{_COMMITS}/{quote(job, safe='')}-{int(batch)}.json"


def committed(spark: SparkSession, path: str, job: str, batch: int) -> bool:
    fs, record = _file(spark, _record(path, job, batch))
    return fs.exists(record)


def write_attempt(tables: dict[str, DataFrame], path: str, job: str, batch: int) -> str:
    """Write the tables where no reader looks yet; returns the attempt's name."""
    attempt = f"a-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}/job=j-{quote(job, safe='')}/batch={int(batch)}/attempt={attempt}")
    return attempt


def commit(spark: SparkSession, path: str, job: str, batch: int, attempt: str) -> bool:
    """Let an attempt count; False if another one already does."""
    fs, record = _file(spark, _record(path, job, batch))
    line = json.dumps({"job": f"j-{job}", "batch": int(batch), "attempt": attempt}) + "\n"
    try:
        out = fs.create(record, False)  # fails if the file is there
    except Exception:  # noqa: BLE001 - the file system's own kind of error
        if committed(spark, path, job, batch):
            return False
        raise
    try:
        out.write(bytearray(line.encode()))
    finally:
        out.close()
    return True


def write_committed(tables: dict[str, DataFrame], path: str, job: str, batch: int = 0) -> bool:
    """Write ``tables`` (by name) as batch ``batch`` of ``job``, all or nothing, once; False if that batch is there already."""
    spark = next(iter(tables.values())).sparkSession
    if committed(spark, path, job, batch):
        return False
    return commit(spark, path, job, batch, write_attempt(tables, path, job, batch))


def read_committed(spark: SparkSession, path: str, name: str, keep: list[str] | None = None) -> DataFrame:
    """The rows of table ``name`` in all committed batches; ``keep`` names of job, batch and attempt stay as columns.

    The commits are joined on the partition columns, so only folders that count are read.
    """
    commits = spark.read.schema("job string, batch long, attempt string").json(f"{path}/{_COMMITS}")
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}/job=*")
    rows = rows.withColumn("batch", rows["batch"].cast("long"))
    return rows.join(commits, _KEYS, "left_semi").select(*[c for c in rows.columns if c not in _KEYS or c in (keep or [])])
