"""Rows in a global order beside their neighbours, without one task that sees them all.

The order is cut into buckets of about equal size.  A bucket's first and last
rows are also sent to the bucket before and after it, as border rows, so each
task can look at the neighbours of all its own rows.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Keys that are looked at per bucket to place the bounds (the bounds decide on balance only, never on results).
LOOKED_AT = 64


def bounds(keys: DataFrame, key: str, rows_per_bucket: int) -> list:
    """Keys that begin a bucket. At most LOOKED_AT keys per bucket come to the driver."""
    n = keys.count()
    buckets = -(-n // rows_per_bucket)
    if buckets < 2:
        return []
    step = max(1, n // (LOOKED_AT * buckets))
    some = keys.where(F.pmod(F.xxhash64(key), F.lit(step)) == 0).select(key)
    seen = sorted(r[0] for r in some.collect())
    return sorted({seen[i * len(seen) // buckets] for i in range(1, buckets)}) if seen else []


def with_neighbours(rows: DataFrame, key: str, tie: list[str], rows_per_bucket: int = 2000, before: bool = False,
                    around: bool = False) -> DataFrame:
    """``rows`` by bucket, sorted by ``key`` (not null) and ``tie``, with the border rows.

    Adds ``bucket`` and ``border``: 0 for a bucket's own rows, 1 for rows that follow
    its last one, -1 (with ``before``) for rows that precede its first one.  With
    ``around`` the order is a ring: the first rows follow the last bucket.  Rows that
    share a key are in one bucket, so the key should be nearly unique.
    """
    cuts = bounds(rows.select(key), key, rows_per_bucket)

    def place(column: pd.Series) -> pd.Series:
        return column.map(lambda k: bisect.bisect_right(cuts, k)).astype("int32")

    bucket_of = F.pandas_udf(place, "int")
    ends = {}
    if cuts or around:
        edges = rows.select(key, bucket_of(key).alias("bucket")).groupBy("bucket").agg(F.min(key).alias("a"), F.max(key).alias("z"))
        ends = {r.bucket: (r.a, r.z) for r in edges.collect()}  # a row per bucket
    order = sorted(ends)
    targets: dict = {}  # key -> buckets that need its rows as border rows
    for left, right in zip(order, order[1:]):
        targets.setdefault(ends[right][0], []).append((left, 1))
        if before:
            targets.setdefault(ends[left][1], []).append((right, -1))
    if around and order:
        targets.setdefault(ends[order[0]][0], []).append((order[-1], 1))

    def placements(column: pd.Series) -> pd.Series:
        return column.map(lambda k: [{"bucket": b, "border": s} for b, s in
                                     [(bisect.bisect_right(cuts, k), 0), *targets.get(k, [])]])

    spread = F.pandas_udf(placements, "array<struct<bucket:int, border:int>>")
    copies = rows.withColumn("at", spread(key)).select("*", F.explode("at").alias("to")).select(
        *rows.columns, "to.bucket", "to.border")
    return copies.repartition(max(1, len(cuts) + 1), "bucket").sortWithinPartitions("bucket", "border", key, *tie)
