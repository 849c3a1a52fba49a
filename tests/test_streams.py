"""Streams and logs: conversation state, counts in flight, exactly-once tables, quarantine, nothing left behind."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from msgflow.plans.message_flow import contain_failures
from msgflow.sources import commits
from msgflow.staging import new_path, passing, shared_folder, stage
from msgflow.streaming import conversations as S
from msgflow.streaming.counts import OutcomeListener, landed_counts, observe_outcomes
from msgflow.streaming.messages import quarantine_stream, replay_failed, start_stream


def files_stream(spark, rows, schema, batches):
    """``rows`` as a stream of one file per batch, in the order of ``batches``."""
    path = new_path(spark, "arriving")
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


TURN = "conv_id long, turn long, role string, text string"


def test_late_repeated_and_odd_turns(spark):
    """Gaps, negative and far numbers, blocks of one turn, null texts; every order of arrival ends in the batch result."""
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", None])) for c in (1, 2, None)
            for t in rng.sample([-600, -1, 0, 1, 2, 3, 255, 256, 257, 511, 512, 5000, 10 ** 12], 11)] + [(3, None, "user", "x"), (4, 0, "assistant", "alone")]
    shuffled = rng.sample(rows, len(rows))
    batches = [shuffled[:9], shuffled[9:20] + shuffled[:3], shuffled[20:]]
    output = new_path(spark, "tracked")
    S.track_conversations(files_stream(spark, rows, TURN, batches), output, new_path(spark, "check")).awaitTermination()
    want, sizes = set(), Counter()
    for c in (1, 2, 4):
        own = sorted((t, role, text) for conv, t, role, text in rows if conv == c)
        sizes[c] = len(own)
        for k, (t, role, text) in enumerate(own):
            if role == "assistant":
                want.add((c, t, (own[k - 1][2] or "") if k else "", text))
    assert {tuple(r) for r in S.current_pairs(spark, output).collect()} == want
    assert {r.conv_id: r.n_messages for r in S.current_sizes(spark, output).collect()} == dict(sizes)


def test_expiring_state_needs_an_interval(spark):
    turns = files_stream(spark, [], TURN, [[(1, 0, "user", "x")]])
    with pytest.raises(ValueError, match="interval"):
        S.track_conversations(turns, new_path(spark, "out"), new_path(spark, "check"), ttl=1000)


def test_state_expires(spark):
    """A turn that comes after the state is forgotten begins anew."""
    path, output = new_path(spark, "arriving"), new_path(spark, "tracked")
    spark.createDataFrame([(1, 0, "user", "early")], TURN).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(TURN).parquet(path)
    query = S.track_conversations(stream, output, new_path(spark, "check"), ttl=1, interval="0 seconds")
    def read(n):
        """Wait until ``n`` rows have arrived; such a query never runs out of batches."""
        end = time.time() + 40
        while sum(p.numInputRows for p in query.recentProgress) < n and time.time() < end:
            time.sleep(0.2)

    try:
        read(1)
        spark.createDataFrame([(1, 1, "assistant", "late")], TURN).coalesce(1).write.mode("append").parquet(path)
        read(2)
    finally:
        query.stop()
    assert [tuple(r) for r in S.current_pairs(spark, output).collect()] == [(1, 1, "", "late")]
    assert [tuple(r) for r in S.current_sizes(spark, output).collect()] == [(1, 1)]


def test_counts_land_per_batch(spark):
    schema = "route string, intent string, language string, sentiment string"
    batches = [[("rag", "review", "en", None)] * 3 + [("rag", "review", "de", "x")], [("direct", "hi", "en", "y")], [("rag", "review", "en", None)] * 2]
    folder = new_path(spark, "landed")
    listener = OutcomeListener(spark, folder)
    spark.streams.addListener(listener)
    try:
        written = observe_outcomes(files_stream(spark, [], schema, batches)).writeStream.format("parquet")
        query = written.option("path", new_path(spark, "out")).option("checkpointLocation", new_path(spark, "check")).trigger(availableNow=True).start()
        listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
    got = {(r.batch_id, r.route, r.intent, r.language, r.sentiment): r.n for r in landed_counts(spark, folder).collect()}
    assert got == {(i, *row): n for i, batch in enumerate(batches) for row, n in Counter(batch).items()}


def test_a_batch_is_there_once(spark):
    path = new_path(spark, "log")
    a, b = spark.range(3), spark.range(10, 12)
    assert commits.write_committed({"rows": a, "more": b}, path, "a job/1", 0)
    assert not commits.write_committed({"rows": a, "more": b}, path, "a job/1", 0)
    killed = commits.write_attempt({"rows": b}, path, "a job/1", 1)  # no commit
    assert sorted(r.id for r in commits.read_committed(spark, path, "rows").collect()) == [0, 1, 2]
    assert commits.write_committed({"rows": b}, path, "a job/1", 1)
    assert not commits.commit(spark, path, "a job/1", 1, killed)  # it comes too late
    assert commits.write_committed({"rows": a}, path, "other", 0)
    assert sorted(r.id for r in commits.read_committed(spark, path, "rows").collect()) == [0, 0, 1, 1, 2, 2, 10, 11]
    kept = commits.read_committed(spark, path, "more", ["job", "batch"])
    assert {tuple(r) for r in kept.collect()} == {(10, "j-a job/1", 0), (11, "j-a job/1", 0)}


def test_failed_records_are_kept_and_replayed(spark):
    batches = [[(1, "5"), (2, "x6")], [(3, None), (4, "x7")], [(5, "xx")]]
    output = new_path(spark, "parsed")

    def parse(df):
        return contain_failures(df, {"n": ("raw", "bigint")})

    stream = files_stream(spark, [], "id long, raw string", batches)
    quarantine_stream(stream, parse, output, new_path(spark, "check"), "numbers").awaitTermination()
    failed = commits.read_committed(spark, output, "failed").collect()
    assert {(r.id, r.raw, r.n, r.error) for r in failed} == {(2, "x6", None, "bad n"), (4, "x7", None, "bad n"), (5, "xx", None, "bad n")}
    assert all("arriving" in r.origin.file for r in failed)

    def fixed(df):
        return parse(df.withColumn("raw", F.regexp_replace("raw", "^x", "")))

    assert replay_failed(spark, output, "numbers", ["id", "raw"], fixed, "fixed")
    assert not replay_failed(spark, output, "numbers", ["id", "raw"], fixed, "fixed")
    assert {(r.id, r.n) for r in commits.read_committed(spark, output, "good").collect()} == {(1, 5), (2, 6), (3, None), (4, 7)}
    again = [(r.id, r.job) for r in commits.read_committed(spark, output, "failed", ["job"]).collect()]
    assert again.count((5, "j-fixed")) == 1 and len(again) == 4


def folders(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark) + "/msgflow")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in fs.listStatus(path)}


def test_a_stream_leaves_nothing_staged(spark):
    batches = [[(i,)] for i in range(20)]
    stream = files_stream(spark, [], "id long", batches)
    output, check = new_path(spark, "out"), new_path(spark, "check")
    before = folders(spark)
    start_stream(stream, lambda batch: stage(batch.withColumn("twice", F.col("id") * 2), "within"), output, check).awaitTermination()
    assert folders(spark) - before <= {output.split("/")[-1], check.split("/")[-1]}
    assert spark.read.parquet(output).count() == 20


def test_staged_tables_go_after_an_error_too(spark):
    before = folders(spark)
    with pytest.raises(ZeroDivisionError), passing(spark):
        stage(spark.range(3), "within")
        1 / 0
    assert folders(spark) == before
