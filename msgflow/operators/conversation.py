"""Conversation turns and feedback records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from msgflow.staging import stage

TURN_BLOCK = 100_000  # turns of one conversation that a single task orders


def message_turns(scored: DataFrame, conv_id: str = "conv_id", position: str = "position",
                  text: str = "text", response: str = "response", result: str | None = None) -> DataFrame:
    """Two turns per scored message: the user's at 2i and the assistant's at 2i + 1.

    Only the assistant's turn carries the result record; feedback starts out null.
    """
    keep = result is not None
    empty = F.lit(None)

    def turn(offset: int, role: str, content: str, record: Column) -> Column:
        fields = [(F.col(position) * 2 + offset).alias("turn"), F.lit(role).alias("role"),
                  F.col(content).alias("content")]
        fields += [record.alias("debug")] if keep else []
        return F.struct(*fields, F.lit(None).cast("string").alias("feedback"))

    user = turn(0, "user", text, empty)
    assistant = turn(1, "assistant", response, F.col(result) if keep else empty)
    return scored.select(conv_id, F.inline(F.array(user, assistant)))


def previous_value(df: DataFrame, group: str, order: str, value: str, output: str,
                   block: int = TURN_BLOCK) -> DataFrame:
    """Add the value of the row before in its group, null for the first row.

    Rows of a group stand in the order of ``order`` and, where that ties, of
    ``value``; rows equal in both are alike.  The table is sorted over all tasks
    and staged with each row's place, so its places are unique, and cut into
    blocks of ``block`` places, whatever the values of the order column are.  A
    task orders one block; the last row of each block, a small table, is handed
    to the next one.
    """
    keys = [group, order, value]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = stage(placed, "turn-places").withColumn("_part", F.shiftright("_at", 33))
    place = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    placed = placed.withColumn("_block", F.floor(place / block))
    before = F.struct(F.col(group).alias("g"), F.col(value).alias("v"))
    ends = placed.groupBy("_part", "_block").agg(F.max_by(before, "_at").alias("_end"))
    across = Window.partitionBy(F.lit(0)).orderBy("_part", "_block")  # one row per block
    handed = stage(ends.select("_part", "_block", F.lag("_end").over(across).alias("_handed")), "block-ends")
    inside = Window.partitionBy("_part", "_block").orderBy("_at")
    out = placed.withColumn("_before", F.lag(before).over(inside)).join(handed, ["_part", "_block"])
    last = F.coalesce("_before", "_handed")
    return out.select(*df.columns, F.when(last["g"].eqNullSafe(F.col(group)), last["v"]).alias(output))


def assistant_pairs(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text", block: int = TURN_BLOCK) -> DataFrame:
    """Each assistant turn with the turn before it, whoever spoke; empty for the first."""
    paired = previous_value(turns, conv_id, turn, text, "user_message", block)
    return (paired.where(F.col(role) == "assistant")
            .select(conv_id, turn, F.coalesce("user_message", F.lit("")).alias("user_message"),
                    F.col(text).alias("assistant_response")))


def conversation_sizes(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    return turns.groupBy(conv_id).agg(F.count("*").alias("n_messages"))


def feedback_records(pairs: DataFrame, results: DataFrame, votes: DataFrame, keys: list[str],
                     when: Column | None = None) -> DataFrame:
    """One record per vote (``keys`` and ``feedback``): the pair, the result's fields or "", and the time."""
    fields = ["language", "sentiment", "intent", "route"]
    rows = votes.join(pairs, keys).join(results.select(*keys, *fields), keys, "left")
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields]
    stamp = (F.current_timestamp() if when is None else when).alias("timestamp")
    return rows.select(stamp, "user_message", "assistant_response", *blank, "feedback")
