import random

import pytest
from pyspark.sql import functions as F

from msgflow.operators import conversation as C


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_previous_value_over_blocks_and_gaps(spark, block):
    rng = random.Random(block)
    rows, want = [], {}
    for conv in range(6):
        before = None
        for turn in sorted(rng.sample(range(-20, 400), 200 if conv == 0 else rng.randint(1, 9))):
            text = None if rng.random() < 0.1 else f"{conv}/{turn}"
            rows.append((conv, turn, text))
            want[conv, turn] = before
            before = text
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): r.before for r in C.previous_value(df, "conv_id", "turn", "text", "before", block).collect()}
    assert got == want


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_previous_value_with_ties_null_groups_and_sparse_orders(spark, block):
    rows = [("g", 0, "a"), ("g", 0, "b"), ("g", 3, "c"), ("g", 3, "c"), ("g", 10 ** 15, "d"), (None, 1, "x"), (None, 2, "y"),
            ("h", -5, None), ("h", -5, "z"), ("h", None, "n")]
    df = spark.createDataFrame(rows, "g string, n long, text string").repartition(3)
    got = sorted((str(r.g), str(r.n), str(r.text), str(r.before)) for r in C.previous_value(df, "g", "n", "text", "before", block).collect())
    assert got == sorted([("g", "0", "a", "None"), ("g", "0", "b", "a"), ("g", "3", "c", "b"), ("g", "3", "c", "c"),
                          ("g", str(10 ** 15), "d", "c"), ("None", "1", "x", "None"), ("None", "2", "y", "x"),
                          ("h", "None", "n", "None"), ("h", "-5", "None", "n"), ("h", "-5", "z", "None")])
    assert C.previous_value(df.limit(0), "g", "n", "text", "before", block).count() == 0


def test_turns_pairs_and_sizes(spark):
    scored = spark.createDataFrame([(1, 0, "hi", "hello"), (1, 1, "where", "there"), (2, 0, "a", "b")],
                                   "conv_id long, position long, text string, response string")
    turns = C.message_turns(scored)
    got = sorted((r.conv_id, r.turn, r.role, r.content, r.feedback) for r in turns.collect())
    assert got == [(1, 0, "user", "hi", None), (1, 1, "assistant", "hello", None), (1, 2, "user", "where", None),
                   (1, 3, "assistant", "there", None), (2, 0, "user", "a", None), (2, 1, "assistant", "b", None)]
    pairs = C.assistant_pairs(turns, text="content")
    assert {(r.user_message, r.assistant_response) for r in pairs.collect()} == {("hi", "hello"), ("where", "there"), ("a", "b")}
    assert {tuple(r) for r in C.conversation_sizes(turns).collect()} == {(1, 4), (2, 2)}


def test_result_rides_on_the_assistant_turn(spark):
    scored = spark.createDataFrame([(1, 0, "hi", "hello", "direct")], "conv_id long, position long, text string, response string, route string")
    scored = scored.withColumn("result", F.struct("route"))
    debug = {r.role: r.debug for r in C.message_turns(scored, result="result").collect()}
    assert debug["user"] is None and debug["assistant"].route == "direct"


def test_assistant_first(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "hi"), (1, 1, "assistant", "still there?")],
                                  "conv_id long, turn long, role string, text string")
    assert {(r.user_message, r.assistant_response) for r in C.assistant_pairs(turns).collect()} == {("", "hi"), ("hi", "still there?")}


def test_feedback_without_result(spark):
    pairs = spark.createDataFrame([(1, 1, "q", "a"), (1, 3, "q2", "a2")], "conv_id long, turn long, user_message string, assistant_response string")
    results = spark.createDataFrame([(1, 1, "en", "Neutral", "review", "rag")],
                                    "conv_id long, turn long, language string, sentiment string, intent string, route string")
    votes = spark.createDataFrame([(1, 1, "up"), (1, 3, "down")], "conv_id long, turn long, feedback string")
    rows = C.feedback_records(pairs, results, votes, ["conv_id", "turn"]).collect()
    assert {tuple(r)[1:] for r in rows} == {("q", "a", "en", "Neutral", "review", "rag", "up"), ("q2", "a2", "", "", "", "", "down")}
    assert all(r.timestamp is not None for r in rows)
