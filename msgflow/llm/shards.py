"""Sharding by fixed virtual slots.

Records are hashed by key into a fixed number of virtual slots, far more than
there are shards.  A small table, the slot map, says which shard holds a slot;
it has versions, and a rebalancing is an edit that makes the next version.  Only
the map is edited: no record is hashed again.

Everything is DataFrame functions.  The map and the slot totals have as many
rows as there are virtual slots, whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from msgflow.staging import stage

VIRTUAL_SLOTS = 4096


def virtual_slot(key: Column, slots: int = VIRTUAL_SLOTS) -> Column:
    """The virtual slot of a key, by the first 32 bits of its MD5; a null key counts as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots


def grown_map(shard_of: list[int]) -> list[int]:
    """One shard more: it takes its even share of the slots, always the last slot of the fullest shard."""
    held: dict[int, list[int]] = {}
    for slot, shard in enumerate(shard_of):
        held.setdefault(shard, []).append(slot)
    new, edited = max(held, default=-1) + 1, list(shard_of)
    for _ in range(len(shard_of) // (len(held) + 1)):
        fullest = max(held, key=lambda s: (len(held[s]), -s))
        edited[held[fullest].pop()] = new
    return edited


def map_for(shards: int, slots: int = VIRTUAL_SLOTS) -> list[int]:
    """The map that an empty store with one shard has after growing to ``shards``: slots and shards alone decide."""
    if not 1 <= shards <= slots:
        raise ValueError(f"{shards} shards do not fit {slots} slots")
    shard_of = [0] * slots
    for _ in range(shards - 1):
        shard_of = grown_map(shard_of)
    return shard_of


def rebalanced_map(shard_of: list[int], load: dict[int, int], edits: int) -> list[int]:
    """At most ``edits`` slots moved from the heaviest to the lightest shard, as long as that narrows their gap."""
    edited, total = list(shard_of), dict.fromkeys(set(shard_of), 0)
    for slot, shard in enumerate(edited):
        total[shard] += load.get(slot, 0)
    for _ in range(edits):
        heavy, light = max(total, key=lambda s: (total[s], s)), min(total, key=lambda s: (total[s], s))
        gap = total[heavy] - total[light]
        fits = [(abs(gap - 2 * load.get(k, 0)), k) for k, s in enumerate(edited) if s == heavy and 0 < load.get(k, 0) < gap]
        if not fits:
            break
        slot = min(fits)[1]
        edited[slot] = light
        total[heavy] -= load[slot]
        total[light] += load[slot]
    return edited


def slot_map(spark: SparkSession, versions: Iterable[list[int]]) -> DataFrame:
    """The versions of a map as a table: version (from 1), virtual_slot, shard."""
    rows = [(v, k, s) for v, shard_of in enumerate(versions, 1) for k, s in enumerate(shard_of)]
    return spark.createDataFrame(rows, "version int, virtual_slot long, shard int")


def sized(docs: DataFrame, key: str, text: str, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Key, size (UTF-8 bytes plus 1; null: 1), text_crc32 (null: that of the empty text) and virtual slot of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), virtual_slot(F.col(key), slots).alias("virtual_slot"))


def slot_totals(rows: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot that holds any."""
    return rows.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def assign(docs: DataFrame, key: str, text: str, shards: int, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Shard, place in the shard and the shard after growing by one, for every row.

    The key and the number of shards decide (the law ``key``): equal keys share a
    shard, and growing by one moves rows only into the new shard.  ``slot`` numbers
    a shard's rows without gaps from 0: virtual slots in order, in each the rows by
    key, size and checksum; rows equal in all three are alike, so their order does
    not matter.  Null keys form one key; other columns are not read; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = stage(sized(docs, key, text, slots), "shard-rows")
    now = map_for(shards, slots)
    edited = stage(slot_map(spark, [now, grown_map(now)]), "slot-map")
    table = slot_totals(rows).join(
        edited.groupBy("virtual_slot").agg(F.max_by("shard", F.when(F.col("version") == 1, 1).otherwise(0)).alias("shard"),
                                           F.max_by("shard", "version").alias("grown_shard")), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select("virtual_slot", "shard", "grown_shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = Window.partitionBy("virtual_slot").orderBy(F.col(key), "size", "text_crc32")
    placed = rows.withColumn("place", F.row_number().over(place) - 1)
    # One row for each virtual slot, so at most ``slots`` rows are sent to the executors.
    return placed.join(F.broadcast(table), "virtual_slot").select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("place")).alias("slot"), "grown_shard")
