"""Conversation state on a stream: each assistant turn with the turn before it, and the size of each conversation.

Turns may come late, out of order and twice.  The state of a conversation lives in the
state store, turn by turn, with the turn numbers in small sorted blocks; a new turn
touches its own block and at most one before and one after it, so a conversation of any
length costs a batch what the batch brings.  When a late turn changes what another one
answers, that pair is written again; readers take the last version.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

BLOCK = 256  # turn numbers that stand in one block of the state

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ConversationState(StatefulProcessor):
    """Turns of one conversation; ``ttl`` milliseconds after its last write an entry is forgotten (0: never)."""

    def __init__(self, ttl: int = 0):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        limit = self.ttl or None
        self.turns = handle.getMapState("turns", "turn long", "role string, text string", limit)
        self.blocks = handle.getMapState("blocks", "block long", "turns array<long>", limit)
        self.size = handle.getValueState("size", "n long", limit)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        touched, n = set(), (self.size.get()[0] if self.size.exists() else 0)
        for row in rows:
            if row.turn is None or self.turns.containsKey((row.turn,)):
                continue  # a repeated turn: the first one that came stays
            self.turns.updateValue((row.turn,), (row.role, row.text))
            number = row.turn // BLOCK
            known = self._block(number)
            bisect.insort(known, row.turn)
            self.blocks.updateValue((number,), (known,))
            touched.add(row.turn)
            n += 1
        if not touched:
            return
        self.size.update((n,))
        numbers = sorted(k[0] for k in self.blocks.keys())
        for turn in sorted(touched | {after for t in touched if (after := self._beside(t, numbers, 1)) is not None}):
            role, text = self.turns.getValue((turn,))
            if role == "assistant":
                before = self._beside(turn, numbers, -1)
                said = (self.turns.getValue((before,))[1] or "") if before is not None else ""
                yield Row(conv_id=key[0], turn=turn, user_message=said, assistant_response=text, n_messages=n)
        yield Row(conv_id=key[0], turn=None, user_message=None, assistant_response=None, n_messages=n)

    def _block(self, number: int) -> list[int]:
        return list(self.blocks.getValue((number,))[0]) if self.blocks.containsKey((number,)) else []

    def _beside(self, turn: int, numbers: list[int], step: int) -> int | None:
        """The turn before (-1) or after (1)."""
        own = self._block(turn // BLOCK)
        at = bisect.bisect_left(own, turn) + step
        if 0 <= at < len(own):
            return own[at]
        at = bisect.bisect_left(numbers, turn // BLOCK) + step
        if not 0 <= at < len(numbers):
            return None
        other = self._block(numbers[at])
        return other[0] if step > 0 else other[-1]

    def close(self) -> None:
        pass


def conversation_updates(turns: DataFrame, ttl: int = 0) -> DataFrame:
    """A row per pair that is new or changed, and one per conversation that grew (turn null, with its size).

    ``turns`` is a stream of conv_id, turn, role and text, the turn numbers unique in a
    conversation; turns without conv_id or number are left out.  Needs the state store STATE_STORE.
    """
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("turn", T.LongType()),
                           T.StructField("user_message", T.StringType()), T.StructField("assistant_response", T.StringType()),
                           T.StructField("n_messages", T.LongType())])
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.groupBy("conv_id").transformWithState(ConversationState(ttl), schema, "Update", "ProcessingTime" if ttl else "None")


def track_conversations(turns: DataFrame, output: str, checkpoint: str, ttl: int = 0, interval: str | None = None) -> StreamingQuery:
    """Write the updates of every micro-batch into a folder of its own; a replayed batch overwrites it.

    Without an interval the stream is drained and ends.  With ``ttl`` Spark goes on
    with empty batches that look for expired state, so give an interval and stop the query.
    """
    if ttl and not interval:
        raise ValueError("a stream whose state expires does not end by itself: give an interval")
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    writer = conversation_updates(turns, ttl).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()


def current_pairs(spark: SparkSession, output: str) -> DataFrame:
    """(conv_id, turn, user_message, assistant_response): the last version of every pair."""
    rows = spark.read.option("basePath", output).parquet(output).where(F.col("turn").isNotNull())
    last = F.max_by(F.struct("user_message", "assistant_response"), "batch_id").alias("last")
    return rows.groupBy("conv_id", "turn").agg(last).select("conv_id", "turn", "last.*")


def current_sizes(spark: SparkSession, output: str) -> DataFrame:
    """(conv_id, n_messages) as of the last batch."""
    rows = spark.read.option("basePath", output).parquet(output).where(F.col("turn").isNull())
    return rows.groupBy("conv_id").agg(F.max_by("n_messages", "batch_id").alias("n_messages"))
